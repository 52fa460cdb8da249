"""Run statistics re-aimed over ``events`` (AG-4..AG-7): event type as version, value as
run time, ``error`` events as failures, the day as the run batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.catalog import query
from strata.catalog.common import t
from strata.operators.stats import compare_groups, latest_per_group, outcome_rates, run_stats

_U = "CAST(CAST(value AS DECIMAL(38,6)) * 1000000 AS DECIMAL(38,0))"


def _events(spark, sf):
    """Events with the value as DECIMAL(18,6), which holds the given values without a cut."""
    return t(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,6)"))


@query("ag04_run_stats", f"""
WITH s AS (
  SELECT event_type, count(value) AS n, sum({_U}) AS s1, sum({_U} * {_U}) AS s2,
         min(value) AS min, max(value) AS max, median(value) AS median
  FROM events GROUP BY event_type)
SELECT event_type, n AS count, CAST(s1 AS DOUBLE) / n / 1e6 AS mean, CAST(min AS DECIMAL(18,6)) AS min,
       CAST(max AS DECIMAL(18,6)) AS max,
       CASE WHEN n > 1 THEN sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)
                                 / 1e6 / 1e6) ELSE 0.0 END AS std_dev,
       CASE WHEN n > 1 THEN CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)
                            / 1e6 / 1e6 ELSE 0.0 END AS variance,
       median
FROM s""")
def ag04(spark, sf):
    return run_stats(_events(spark, sf), ["event_type"], "value")


@query("ag05_outcome_rates", """
WITH g AS (
  SELECT CAST(ts AS DATE) AS run_day, count(*) AS total,
         count_if(event_type <> 'error') AS successes,
         sum(CAST(value AS DECIMAL(18,6))) AS total_value, count(value) AS nv
  FROM events GROUP BY ALL)
SELECT run_day, total, successes, total - successes AS failures,
       CAST(CAST((successes * 20000 + greatest(total, 1)) // (greatest(total, 1) * 2) AS DECIMAL(38,0))
            * 0.01 AS DECIMAL(38,2)) AS success_pct,
       CAST(CAST((CAST(coalesce(total_value, 0) * 1000000 AS HUGEINT) * 2 + greatest(nv, 1) * 10000)
                 // (greatest(nv, 1) * 20000) AS DECIMAL(38,0)) * 0.01 AS DECIMAL(38,2)) AS avg_attempts
FROM g""")
def ag05(spark, sf):
    ev = _events(spark, sf).withColumn("run_day", F.to_date("ts"))
    return outcome_rates(ev, ["run_day"], F.col("event_type") != "error", F.col("value"))


@query("ag06_compare_groups", """
WITH g AS (
  SELECT CAST(ts AS DATE) AS run_day,
         CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(38,6)) END) AS DOUBLE)
           / count(CASE WHEN event_type = 'click' THEN value END) AS value_a,
         CAST(sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(38,6)) END) AS DOUBLE)
           / count(CASE WHEN event_type = 'view' THEN value END) AS value_b
  FROM events GROUP BY ALL)
SELECT run_day, value_a, value_b, abs(value_a - value_b) AS value_diff,
       CASE WHEN value_a <> 0 THEN (value_a - value_b) / value_a * 100 END
         AS value_improvement_pct
FROM g""")
def ag06(spark, sf):
    ev = _events(spark, sf).withColumn("run_day", F.to_date("ts"))
    return compare_groups(ev, ["run_day"], "event_type", "click", "view", ["value"])


@query("ag07_latest_per_group", """
SELECT user_id, ts, event_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC,
                           event_type DESC, value DESC, props DESC) = 1""")
def ag07(spark, sf):
    return latest_per_group(t(spark, sf, "events"), ["user_id"], "ts")
