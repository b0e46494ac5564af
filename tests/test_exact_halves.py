"""Values that lie exactly between two rounded ones."""

from datetime import datetime

from sparkwright.plans import catalog


def test_halves_of_a_projection(spark, tmp_path):
    """Customers whose projected value is n + 1/2 by fractions in one year; it is rounded up, whatever the order of summation."""
    yearly = {
        570: {1996: 113839.68, 1997: 22695.47, 1998: 56588.93, 1999: 483747.74, 2000: 390513.03, 2001: 329867.78},
        984: {1995: 227366.05, 1996: 434080.73, 1997: 288926.67, 1998: 233067.65, 1999: 462728.36, 2000: 242197.23, 2001: 315725.94},
        9956: {1995: 449258.48, 1996: 386989.7, 1997: 251781.27, 1998: 289226.88, 1999: 372857.65, 2000: 499624.11},
    }
    for turn in (1, -1):
        rows = [(key, value, datetime(year, 6, 1)) for key, values in yearly.items() for year, value in values.items()][::turn]
        spark.createDataFrame(rows, "o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        got = {(r["o_custkey"], r["year"]): r["in_five_years"] for r in catalog.QUERIES["wall_projection"](spark, str(tmp_path)).collect()}
        assert (got[570, 1998], got[984, 1998], got[9956, 1997]) == (429554, 242910, 287050)
