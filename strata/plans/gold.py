"""Gold load (PL-2): inputs -> views -> staged SQL -> audit stamp -> conform -> history
snapshot + slice overwrite -> re-read slice -> publish to the serving copy."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from strata.operators.project import conform, with_audit_stamp
from strata.operators.quality import Rule, quarantine_write
from strata.plans.audit import AuditEvent, audit_log
from strata.plans.steps import run_steps
from strata.session import materialize, scratch_path
from strata.sources import fs
from strata.sources.readers import register_inputs, slice_predicate
from strata.sources.versions import read_table
from strata.sources.writers import overwrite_slice, publish_slice, snapshot_slice
from strata.spec import AuditColumns


@dataclass
class GoldJob:
    table_name: str
    steps: Sequence[tuple[str, str]]           # (view name, SQL); last one: gold_final_df
    schema: Sequence[tuple[str, str]]          # target columns and types, in order
    gold_path: str
    slice_values: Mapping[str, object]         # the slice this run replaces
    load_ts: str
    job_id: str
    params: Mapping | None = None
    history_path: str | None = None
    serving_path: str | None = None
    audit_path: str | None = None
    audit: AuditColumns | None = None
    rules: Sequence[Rule] = ()                 # rows that break one are quarantined
    quarantine_path: str | None = None         # where they go (a scratch path if unset)


def run_gold(spark: SparkSession, inputs: Mapping[str, DataFrame], job: GoldJob) -> DataFrame:
    """PL-2. Returns the published serving table (or the gold table without serving).

    Inputs are registered as ``<name>_temp_vw``; the staged SQL must end in
    ``gold_final_df`` and produce exactly the rows of ``slice_values``. The audit columns
    are stamped by the job (the SQL never sets them) with a fixed ``load_ts``.
    """
    audit_log(spark, job.audit_path,
              AuditEvent(job.table_name, job.job_id, "I", "load started", None, job.load_ts))
    try:
        register_inputs(spark, inputs)
        final = run_steps(spark, job.steps, job.params)
        a = job.audit or AuditColumns()
        stamped = with_audit_stamp(final, job.load_ts, job.job_id, a)
        cols = list(job.schema) + [(c, "timestamp_ntz" if t == "timestamp" else t)
                                   for c, t in a.types().items()
                                   if c in (a.created_time, a.created_by, a.updated_time,
                                            a.updated_by)]
        # written once: the slice guard and the slice write both read it, so the staged SQL
        # (joins and aggregates over silver) is evaluated once
        shaped = conform(stamped, cols)
        schema = shaped.schema
        if job.rules:
            shaped, _ = quarantine_write(shaped, job.rules, job.quarantine_path or
                                         scratch_path(spark, f"{job.table_name}-quarantine"))
        else:
            shaped = materialize(shaped)
        audit_log(spark, job.audit_path,
                  AuditEvent(job.table_name, job.job_id, "P", "gold slice prepared", None, job.load_ts))
        if job.history_path and fs.exists(spark, job.gold_path):
            snapshot_slice(spark, read_table(spark, job.gold_path, schema), job.history_path,
                           job.slice_values, job.load_ts)
        overwrite_slice(shaped, job.gold_path, job.slice_values)
        result = read_table(spark, job.gold_path, schema)
        if job.serving_path:
            fresh = result.where(slice_predicate(job.slice_values))
            result = publish_slice(spark, fresh, job.serving_path, job.slice_values)
        n = result.where(slice_predicate(job.slice_values)).count()
    except Exception as e:
        audit_log(spark, job.audit_path, AuditEvent(job.table_name, job.job_id, "F", str(e), None, job.load_ts),
                  because=e)
        raise
    audit_log(spark, job.audit_path,
              AuditEvent(job.table_name, job.job_id, "S", "gold slice published", n, job.load_ts))
    return result
