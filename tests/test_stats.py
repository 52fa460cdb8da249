"""Exact, skew-safe statistics against plain Python on a skewed fixture."""

import statistics
from decimal import Decimal

from pyspark.sql import functions as F

from strata.operators.stats import exact_median, latest_per_group, round_ratio, run_stats


def test_exact_median_matches_python_on_hot_group(spark):
    # group 'hot' holds most rows (spread over many range partitions), others are tiny
    hot = [("hot", float(i % 997) + (i % 7) / 10) for i in range(20000)]
    small = [("one", 5.0), ("two", 1.0), ("two", 4.0), ("even", 1.0), ("even", 2.0),
             ("even", 3.0), ("even", 10.0), ("nulls", None)]
    df = spark.createDataFrame(hot + small, "g string, v double").repartition(7)
    got = {r.g: r.median for r in exact_median(df, ["g"], "v", partitions=16).collect()}
    want = {}
    for g in {g for g, _ in hot + small}:
        vals = [v for gg, v in hot + small if gg == g and v is not None]
        if vals:
            want[g] = statistics.median(vals)
    assert got == want


def test_run_stats_single_value_has_zero_spread(spark):
    df = spark.createDataFrame([("a", 2.5), ("b", 1.0), ("b", 3.0)], "g string, v double")
    r = {x.g: x for x in run_stats(df, ["g"], "v").collect()}
    assert r["a"].std_dev == 0.0 and r["a"].variance == 0.0 and r["a"].median == 2.5
    assert r["b"].variance == 2.0 and r["b"].mean == 2.0


def test_round_ratio_half_up(spark):
    df = spark.createDataFrame([(1, 8), (2, 3), (1, 3), (0, 5)], "n long, d long")
    got = [r.x for r in df.select(round_ratio(F.col("n") * 100, F.col("d"), 2).alias("x")).collect()]
    assert got == [Decimal("12.50"), Decimal("66.67"), Decimal("33.33"), Decimal("0.00")]


def test_latest_per_group_ties_are_deterministic(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 3, "z"), (2, 1, "q")],
                               "g int, ts int, v string")
    got = sorted(tuple(r) for r in latest_per_group(df, ["g"], "ts").collect())
    assert got == [(1, 5, "b"), (2, 1, "q")]


def test_median_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(60_000).selectExpr("'g' AS g", "CAST(hash(id) % 100003 AS DOUBLE) AS v")
        want = statistics.median(r.v for r in df.collect())
        assert exact_median(df, ["g"], "v", partitions=16).first().median == want
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_run_stats_cuts_nothing_and_does_not_overflow(spark):
    for kind in ("double", "decimal(18,6)"):
        df = spark.createDataFrame([("a", "0.001"), ("a", "0.004")], "g string, v string").selectExpr("g", f"CAST(v AS {kind}) AS v")
        r = run_stats(df, ["g"], "v").first()
        assert abs(r.mean - 0.0025) < 1e-12 and abs(r.variance - 4.5e-6) < 1e-12 and r.median == 0.0025
    for kind in ("double", "bigint", "decimal(38,0)", "decimal(38,6)"):
        df = spark.createDataFrame([(10**18,), (3 * 10**18,)], "x bigint").selectExpr("'a' AS g", f"CAST(x AS {kind}) AS v")
        r = run_stats(df, ["g"], "v").first()
        assert abs(r.mean / 2e18 - 1) < 1e-9 and abs(r.variance / 2e36 - 1) < 1e-9


def test_round_ratio_of_large_numbers(spark):
    df = spark.createDataFrame([(2**60 + 1, 2**60)], "n long, d long")
    assert df.select(round_ratio(F.col("n"), F.col("d"), 2)).first()[0] == Decimal("1.00")
