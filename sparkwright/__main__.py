"""python -m sparkwright verify --P .. --D .. --t_actual .. | audit LOG | scan SCRIPT | batch CSV. Exit code 0: valid, no packet leaves, safe, all valid; 1: not."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import audit, compliance
from sparkwright.sources import files

#: Metric defaults of the command line.
DEFAULTS = {"P": None, "D": None, "S": 137.9, "E": 1.0, "Y": 0.4, "c": 3.0, "t_actual": None}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkwright")
    forms = parser.add_subparsers(dest="form", required=True)
    one = forms.add_parser("verify")
    for name, usual in DEFAULTS.items():
        one.add_argument(f"--{name}", type=float, default=usual)
    forms.add_parser("audit").add_argument("log")
    forms.add_parser("scan").add_argument("script")
    forms.add_parser("batch").add_argument("csv")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("sparkwright").getOrCreate()
    if given.form == "verify":
        row = compliance.piping(spark.createDataFrame([tuple(getattr(given, n) for n in compliance.INPUTS)], ", ".join(f"{n} double" for n in compliance.INPUTS))).first()
        print(f"{row['status']} margin={row['margin']:.6f}", *row["violations"], sep="\n")
        return int(not row["valid"])
    if given.form == "scan":
        found = audit.scan_scripts(files.texts(spark, given.script).select(F.lit(0).alias("script_id"), F.col("text").alias("code"))).first()
        print("SAFE" if found["is_safe"] else "UNSAFE", *found["findings"], sep="\n")
        return int(not found["is_safe"])
    if given.form == "batch":
        rows = files.line_list(spark, given.csv)
        usual = {n: F.coalesce(F.col(n).try_cast("double") if n in rows.columns else F.lit(None), F.lit(v)) for n, v in DEFAULTS.items()}
        found = compliance.piping(rows.select(*[c.cast("double").alias(n) for n, c in usual.items()])).agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("sat")).first()
        print(f"{found['sat']} of {found['rows']} rows are SAT")
        return int(found["sat"] != found["rows"])
    found = audit.verdict(audit.packets(files.packet_lines(spark, given.log))).first()
    print(f"{found['verdict']} packets={found['packets']} egress={found['egress']}")
    return int(found["verdict"] != "PASS")


if __name__ == "__main__":
    raise SystemExit(main())
