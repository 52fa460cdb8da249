"""Staged SQL steps (PL-4) and the per-target plan shape (PL-5)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.spec import LoadSpec

FINAL = "gold_final_df"


def run_steps(spark: SparkSession, steps: Sequence[tuple[str, str]],
              params: Mapping | None = None, final: str = FINAL) -> DataFrame:
    """PL-4: each step is one SQL statement whose result becomes a temp view named after
    the step, so later steps read earlier ones; the step named ``final`` (default
    ``gold_final_df``) is the result. Views are inlined by Catalyst: the whole chain is
    optimised as one plan. Parameters are bound as literals (``:name``)."""
    out = {}
    for name, sql in steps:
        df = spark.sql(sql, args=dict(params or {}))
        df.createOrReplaceTempView(name)
        out[name] = df
    if final not in out:
        raise ValueError(f"no step named {final}")
    return out[final]


# The six plan shapes, by (several targets, dedupe, stale handling).
SHAPES = {
    (False, False, False): "single",
    (False, True, False): "single_dedupe",
    (False, True, True): "single_dedupe_stale",
    (True, False, False): "multi",
    (True, True, False): "multi_dedupe",
    (True, True, True): "multi_dedupe_stale",
}


def plan_shape(spec: LoadSpec, n_targets: int = 1) -> str:
    """PL-5: the plan shape of ONE target (flags are per target, not OR-ed over all, D7).
    Stale-data handling applies only together with source deduplication."""
    dedupe = spec.source_deduplication
    stale = dedupe and spec.stale_data_handling
    return SHAPES[(n_targets > 1, dedupe, stale)]


def plan_shapes(loads: DataFrame, job: str = "job", target: str = "target_table",
                dedupe: str = "source_deduplication", stale: str = "stale_data_handling") -> DataFrame:
    """PL-5 over a table of load specifications (one row a target): (job, target, n_targets,
    shape). Flags are read as ``LoadSpec`` reads them; a target named twice in a job counts
    once. The number of a job's targets is a partial count, joined back, so a job that holds
    a third of all loads is no single task."""
    on = lambda c: F.upper(F.trim(F.col(c))).isin("Y", "YES", "TRUE", "1")
    several = (loads.select(job, target).distinct().groupBy(F.col(job).alias("__job")).agg(F.count(F.lit(1)).alias("n_targets")))
    deduped = F.coalesce(on(dedupe), F.lit(False))
    shape = F.concat(F.when(F.col("n_targets") > 1, "multi").otherwise("single"), F.when(deduped, "_dedupe").otherwise(""),
                     F.when(deduped & F.coalesce(on(stale), F.lit(False)), "_stale").otherwise(""))
    return (loads.join(several, F.col(job).eqNullSafe(F.col("__job")))
            .select(job, target, "n_targets", shape.alias("shape")))
