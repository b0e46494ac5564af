"""Wall thickness and remaining life, exact where it decides.

A piping row is valid if t_actual >= P*D / (2(S*E + P*Y)) + c in exact rational arithmetic over the decimal text of the
inputs. Doubles are used first: no term cancels, so the sign of the margin is certain outside a narrow band around zero,
and only the rows inside the band are settled by fractions, in the Arrow batches that all rows pass through.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED = -999999.0
BAND = 1e-9
INPUTS = ("P", "D", "S", "E", "Y", "c", "t_actual")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def violations() -> Column:
    """Messages of all pre-checks that fail, in a fixed order; range checks need finite values."""
    checks = [F.when(F.col(n).isNull(), f"missing {n}") for n in INPUTS]
    checks += [F.when(F.col(n).isNotNull() & ~_finite(F.col(n)), f"{n} is not finite") for n in INPUTS]
    rules = [("P > 0", F.col("P") > 0), ("D > 0", F.col("D") > 0), ("S > 0", F.col("S") > 0), ("0 < E <= 1", (F.col("E") > 0) & (F.col("E") <= 1)), ("0 <= Y <= 1", (F.col("Y") >= 0) & (F.col("Y") <= 1)), ("c >= 0", F.col("c") >= 0), ("t_actual > 0", F.col("t_actual") > 0)]
    all_finite = F.lit(True)
    for n in INPUTS:
        all_finite = all_finite & _finite(F.col(n))
    checks += [F.when(all_finite & ~ok, f"needs {name}") for name, ok in rules]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def exact_verdict(p: float, d: float, s: float, e: float, y: float, c: float, t: float) -> tuple[bool, float]:
    """(valid, margin) by fractions of the shortest decimal text of each float."""
    P, D, S, E, Y, C, T = (Fraction(repr(x)) for x in (p, d, s, e, y, c, t))
    tm = P * D / (2 * (S * E + P * Y)) + C
    if float(tm) == t:
        return True, 0.0
    return T >= tm, float(T - tm)


def _exact(p: pd.Series, d: pd.Series, s: pd.Series, e: pd.Series, y: pd.Series, c: pd.Series, t: pd.Series) -> pd.DataFrame:
    """Verdicts of the rows whose inputs are given; null for the others."""
    out = pd.DataFrame({"valid": pd.Series([None] * len(p), dtype=object), "margin": pd.Series([None] * len(p), dtype="float64")})
    near = p.notna().to_numpy().nonzero()[0]
    if len(near):
        found = [exact_verdict(*(float(x.iloc[i]) for x in (p, d, s, e, y, c, t))) for i in near]
        out.loc[near, "valid"], out.loc[near, "margin"] = [v for v, _ in found], [m for _, m in found]
    return out


def piping(pipes: DataFrame) -> DataFrame:
    """Adds violations, t_min, valid, margin and status to rows with the columns of INPUTS (doubles)."""
    t_min = F.try_divide(F.col("P") * F.col("D"), 2 * (F.col("S") * F.col("E") + F.col("P") * F.col("Y"))) + F.col("c")
    rows = pipes.withColumn("violations", violations()).withColumn("_good", F.size("violations") == 0)
    rows = rows.withColumn("t_min", F.when(F.col("_good"), t_min)).withColumn("_m", F.col("t_actual") - F.col("t_min"))
    near = F.col("_good") & (F.abs("_m") <= BAND * F.greatest(F.abs("t_actual"), F.abs("t_min")))
    # all rows pass in one go; those whose sign the doubles settle bring nulls only
    rows = rows.withColumn("_x", F.pandas_udf(_exact, "valid boolean, margin double")(*[F.when(near, F.col(n).cast("double")) for n in INPUTS]))
    valid = F.coalesce(F.col("_x.valid"), F.col("_good") & (F.col("_m") >= 0))
    margin = F.when(~F.col("_good"), FAILED).otherwise(F.coalesce(F.col("_x.margin"), F.col("_m")))
    rows = rows.withColumns({"valid": valid, "margin": margin}).drop("_good", "_m", "_x")
    return rows.withColumn("status", F.when(F.col("valid"), "SAT").otherwise("UNSAT"))


def rational(pipes: DataFrame) -> DataFrame:
    """Adds t_min_rational: the least thickness as a fraction in lowest terms, from the decimal text of the inputs; null where a check fails."""
    good = F.size(violations()) == 0
    return pipes.withColumn("t_min_rational", F.pandas_udf(_fraction, "string")(*[F.when(good, F.col(n).cast("double")) for n in INPUTS[:-1]]))


def _fraction(p: pd.Series, d: pd.Series, s: pd.Series, e: pd.Series, y: pd.Series, c: pd.Series) -> pd.Series:
    def one(*values: float) -> str | None:
        if any(v is None or v != v for v in values):
            return None
        P, D, S, E, Y, C = (Fraction(repr(float(v))) for v in values)
        t = P * D / (2 * (S * E + P * Y)) + C
        return f"{t.numerator}/{t.denominator}"

    return pd.Series([one(*v) for v in zip(p, d, s, e, y, c, strict=True)], dtype=object)


def piping_details(pipes: DataFrame) -> DataFrame:
    """Adds t_pressure, denominator, ratio t/D, thin_wall (t < D/6) and the counterexample's deficit."""
    den = 2 * (F.col("S") * F.col("E") + F.col("P") * F.col("Y"))
    t = F.try_divide(F.col("P") * F.col("D"), den)
    return pipes.withColumns({"denominator": den, "t_pressure": t, "ratio": F.try_divide(F.col("t_actual"), F.col("D")), "thin_wall": t < F.col("D") / 6, "deficit": F.greatest(t + F.col("c") - F.col("t_actual"), F.lit(0.0))})


def vessels(rows: DataFrame, cap: bool = True) -> DataFrame:
    """Adds violation, status, margin, remaining_life, half_life, interval and at_limit; columns t_actual, t_min, P, corrosion_rate.

    The first bad parameter is the only one told. The margin stays t_actual - t_min even where the row fails.
    """
    t, m, p, r = (F.col(c) for c in ("t_actual", "t_min", "P", "corrosion_rate"))
    bad = F.when(~_finite(t) | (t <= 0), "t_actual").when(~_finite(m) | (m <= 0), "t_min").when(~_finite(p) | (p <= 0), "P").when(~_finite(r) | (r <= 0), "corrosion_rate").when(t < m, "t_actual < t_min")
    life = F.when(bad.isNull(), F.try_divide(t - m, r))
    half = life / 2
    return rows.withColumns({"violation": bad, "status": F.when(bad.isNull(), "SAT").otherwise("UNSAT"), "margin": t - m, "remaining_life": life, "half_life": half, "interval": F.when(half.isNotNull(), F.least(half, F.lit(10.0))) if cap else half, "at_limit": bad.isNull() & (t == m)})


#: Remaining life where the rate is not above 0, by surface.
NO_RATE = {"rest": 999.0, "tool": 99.0}


def remaining_life(surface: str) -> Column:
    """The three readings of the same figure: REST (999), the tool (99, floored at 0) and the verifier (null)."""
    life = F.try_divide(F.col("t_actual") - F.col("t_min"), F.col("corrosion_rate"))
    if surface == "rest":
        return F.when(F.col("corrosion_rate") <= 0, NO_RATE["rest"]).otherwise(F.round(life, 2))
    if surface == "tool":
        return F.when(F.col("corrosion_rate") <= 0, NO_RATE["tool"]).otherwise(F.round(F.greatest(life, F.lit(0.0)), 2))
    return F.when(F.col("corrosion_rate") > 0, life)


def steps(pipes: DataFrame, digits: int = 4) -> DataFrame:
    """The five steps of the calculation as rows: step_number, formula, rounded result."""
    pd, den = F.col("P") * F.col("D"), 2 * (F.col("S") * F.col("E") + F.col("P") * F.col("Y"))
    t = F.when(den > 0, F.try_divide(pd, den)).otherwise(0.0)
    made = [("P * D", pd), ("2 * (S*E + P*Y)", den), ("(P*D) / Denom", t), ("t + c", t + F.col("c")), ("t_actual - tm", F.col("t_actual") - t - F.col("c"))]
    lines = F.array(*[F.struct(F.lit(i + 1).alias("step_number"), F.lit(f).alias("formula"), (F.round(v, digits) + F.lit(0.0)).alias("result")) for i, (f, v) in enumerate(made)])
    return pipes.select("*", F.inline(lines))


def stress(pipes: DataFrame) -> DataFrame:
    """The tool's figures: t_min, hoop stress, ratio to S*E, status; t defaults to 0.065 * D."""
    t = F.coalesce("t_actual", 0.065 * F.col("D"))
    t_min = F.col("P") * F.col("D") / (2 * (F.col("S") * F.col("E") + F.col("P") * F.col("Y"))) + F.col("c")
    hoop = F.try_divide(F.col("P") * F.col("D"), 2 * t)
    return pipes.withColumns({"t_used": t, "t_min": t_min, "hoop": hoop, "stress_ratio": F.try_divide(hoop, F.col("S") * F.col("E")), "status": F.when(t >= t_min, "PASS").otherwise("FAIL")})


def vessel_thickness() -> Column:
    """P*R / (S*E - 0.6*P), null where the denominator is not above 0."""
    den = F.col("S") * F.col("E") - 0.6 * F.col("P")
    return F.when(den > 0, F.try_divide(F.col("P") * F.col("R"), den))


def allowable_pressure(years: Column) -> Column:
    """Pressure that the wall left after ``years`` of loss carries: 2*S*E*t / (D - 2*Y*t)."""
    t = F.col("t_actual") - F.col("corrosion_rate") * years - F.col("c")
    return F.when(t > 0, F.try_divide(2 * F.col("S") * F.col("E") * t, F.col("D") - 2 * F.col("Y") * t)).otherwise(0.0)
