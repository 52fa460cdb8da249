"""Silver load (PL-1): scan -> dedupe -> project -> stale filter -> schema check ->
quality rules -> upsert / overwrite -> load statistics, with audit events."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.dedupe import dedupe_for
from strata.operators.joins import drop_stale
from strata.operators.project import apply_filters, parse_type, project, with_audit_stamp
from strata.operators.quality import Rule, quarantine_counted, schema_diff
from strata.operators.stats import load_stats
from strata.plans.audit import AuditEvent, audit_log
from strata.plans.steps import plan_shape
from strata.session import materialize, scratch_path
from strata.sources import versions
from strata.sources.readers import read_job_slice, read_target_slice
from strata.sources.writers import (bucketed, buckets_in, check_keys, partition_columns, read_buckets,
                                    restore_table, upsert, upsert_buckets)
from strata.spec import ColumnMapping, LoadSpec


#: Rows whose values do not cast to the target's types (policy 'reject').
REJECTED = Rule("rejected_cast", "NOT _rejected")


@dataclass
class SilverJob:
    load: LoadSpec
    mappings: Sequence[ColumnMapping]
    target_path: str
    load_ts: str
    job_id: str
    rules: Sequence[Rule] = ()
    audit_path: str | None = None
    target_slice: Mapping[str, object] = field(default_factory=dict)
    policy: str = "strict"
    buckets: int = 0                     # > 0: the table lies in so many key buckets, and an
                                         # upsert rewrites only those it touches
    slice_column: str | None = None      # bronze column that names the job (SRC-2)


@dataclass
class SilverResult:
    table: DataFrame
    stats: DataFrame
    quarantined: DataFrame | None
    shape: str
    rules: dict = field(default_factory=dict)   # rule -> (failed, severity, total), counted while writing


def _target_schema(job: SilverJob, audit_cols: Sequence[str]):
    from pyspark.sql import types as T
    fields = [T.StructField(m.target, parse_type(m.target_type)) for m in job.mappings]
    names = {m.target.lower() for m in job.mappings}
    types = job.load.audit.types()
    fields += [T.StructField(c, T.TimestampNTZType() if types[c] == "timestamp"
                             else parse_type(types[c])) for c in audit_cols if c.lower() not in names]
    return T.StructType(fields)


def _base(spark: SparkSession, job: SilverJob, schema) -> versions.Version | None:
    """The version that the load builds on; a plain table is taken over as it lies."""
    if job.buckets:
        return bucketed(spark, job.target_path, schema, job.load.merge_key, job.buckets)
    return versions.adopt(spark, job.target_path, schema, partition_columns(spark, job.target_path))


def _matching_target(spark: SparkSession, job: SilverJob, base: versions.Version, schema, batch: DataFrame) -> DataFrame:
    """The target's rows that the stale filter may need: of a table in key buckets only the
    batch's buckets are read, where the stale join is on the bucket keys (and more)."""
    spec = job.load
    if job.buckets:
        touched = None
        if {k.lower() for k in spec.merge_key} <= {k.lower() for k in spec.target_join_columns}:
            touched = buckets_in(batch, spec.merge_key, job.buckets)
        target = read_buckets(spark, job.target_path, base, schema, touched)
    else:
        target = versions.read(spark, job.target_path, base, schema=schema)
    return read_target_slice(target, job.target_slice) if job.target_slice else target


def run_silver(spark: SparkSession, bronze: DataFrame, job: SilverJob, targets: int = 1) -> SilverResult:
    """PL-1. The shape (dedupe / stale) is chosen from this target's own flags (PL-5).
    The prepared batch is written once before the stale filter and the upsert read it, and
    the load is published by one rename (``versions``): cut off at any point, it leaves the
    old table. Of a target in key buckets only those of the batch are read.

    Order of steps: job slice (SRC-2), dedupe, mapping, stale filter on the source's own
    times, audit stamp of the columns that bronze lacks (PRJ-5, PRJ-6), rules, commit. With
    ``policy='reject'`` rows whose values do not cast go to the quarantine, not the table.
    Merge types: ``upsert`` (on ``merge_key``, which must be set, non-NULL and unique in the
    batch, in the first load too; created time and user stay those of the target's row),
    ``overwrite``, ``append`` (adds files); any other is an error before anything is read.
    """
    spec = job.load
    table, audit = spec.target_table, spec.audit
    audit_log(spark, job.audit_path, AuditEvent(table, job.job_id, "I", "load started", None, job.load_ts))
    try:
        if spec.merge_type not in ("upsert", "append", "overwrite"):
            raise ValueError(f"{table}: unknown merge_type {spec.merge_type!r}")
        if job.buckets and (spec.merge_type != "upsert" or spec.partition_columns):
            raise ValueError(f"{table}: buckets are for upserts without partition columns")
        if spec.merge_type == "upsert" and not spec.merge_key:
            raise ValueError(f"{table}: merge_type 'upsert' needs a merge_key")
        shape = plan_shape(spec, targets)
        restore_table(spark, job.target_path)
        if any(m.join_condition for m in job.mappings):
            raise ValueError(f"{table}: join conditions need the source tables (joined_sources)")
        bronze = apply_filters(bronze, dict.fromkeys(m.filter for m in job.mappings))
        if job.slice_column:
            bronze = read_job_slice(bronze, job.slice_column, job.job_id)
        out = project(dedupe_for(spec, bronze), job.mappings, policy=job.policy,
                      keep=[c for c in audit.all() if c in bronze.columns])
        rejected = "_rejected" in out.columns
        stamped = with_audit_stamp(out, job.load_ts, job.job_id, audit, only_absent=True)
        schema = _target_schema(job, [c for c in audit.all() if c in stamped.columns])
        diff = schema_diff(stamped.select(*[f.name for f in schema.fields if f.name in stamped.columns]),
                           schema)
        problems = diff.where(F.col("issue") != "extra").collect()  # schema metadata only
        if problems:
            raise ValueError(f"{table}: frame does not match target schema: {problems}")
        extra = ["_rejected"] if rejected else []
        batch = stamped.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], *extra)
        base = _base(spark, job, schema)
        stale = shape.endswith("stale") and base is not None
        # the prepared batch is written once: what comes after (the target's reduction, the
        # key check, the upsert) reads it, so dedupe and mapping run once
        if stale:
            batch = materialize(batch)
            target = _matching_target(spark, job, base, schema, batch)
            # a row that cannot be cast is no newer or older than another: it is quarantined
            bad_rows = batch.where("_rejected") if rejected else None
            fresh = batch.where("NOT _rejected") if rejected else batch
            batch = drop_stale(fresh, target, list(spec.target_join_columns), spec.target_audit_column)
            batch = batch.unionByName(bad_rows) if rejected else batch
        bad, results = None, {}
        rules = [*job.rules, *([REJECTED] if rejected else [])]
        if rules:
            batch, bad, results = quarantine_counted(batch, rules, scratch_path(spark, f"{table}-batch"))
            batch, bad = batch.drop("_rejected"), bad.drop("_rejected")
        else:                                     # also after the stale filter: its joins run once
            batch = materialize(batch)
        audit_log(spark, job.audit_path, AuditEvent(table, job.job_id, "P", f"{shape} batch prepared", None, job.load_ts))
        created = [audit.created_time, audit.created_by]
        if spec.merge_type == "upsert":
            check_keys(batch, spec.merge_key)
        if job.buckets:
            committed = upsert_buckets(spark, batch, job.target_path, schema, spec.merge_key, job.buckets, created,
                                       prepared=True)
        else:
            replaces = () if spec.merge_type == "append" else versions.ALL
            if spec.merge_type == "upsert" and base is not None:
                batch = upsert(versions.read(spark, job.target_path, base, schema=schema), batch, spec.merge_key,
                               validate=False, keep=created)
            done = versions.commit(spark, batch, job.target_path, spec.partition_columns, replaces, base)
            committed = versions.read(spark, job.target_path, done, schema=schema)
        stats = load_stats(committed, job.load_ts, audit.created_time, audit.updated_time)
        message, count = f"{shape} load succeeded", committed.count()
    except Exception as e:
        failed = AuditEvent(table, job.job_id, "F", str(e), None, job.load_ts)
        audit_log(spark, job.audit_path, failed, because=e)
        raise
    audit_log(spark, job.audit_path, AuditEvent(table, job.job_id, "S", message, count, job.load_ts))
    return SilverResult(committed, stats, bad, shape, results)


def run_silver_targets(spark: SparkSession, bronze: DataFrame, jobs: Sequence[SilverJob]) -> dict:
    """SNK-6, S4/S6: one bronze frame feeds several silver targets, each with its own keys,
    flags, audit events and statistics. Returns target table -> SilverResult. Each target's
    plan scans bronze itself, pruned to its columns."""
    names = [j.load.target_table for j in jobs]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated target tables: {names}")
    return {j.load.target_table: run_silver(spark, bronze, j, targets=len(jobs)) for j in jobs}
