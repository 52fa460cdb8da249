"""Sinks (SNK-1..SNK-6).

Parquet has no MERGE, so an upsert is a left-anti join plus a union. Loads write the
partitions that they touch into a folder of their own and publish them with one rename
(``versions``), so a lost driver leaves the old table or the new one. Plain Parquet tables
are written in place, with what Spark's commit protocol gives.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import materialize, scratch_path
from strata.sources import fs, versions
from strata.sources.readers import slice_predicate
from strata.spec import TargetSpec


def check_keys(source: DataFrame, keys: Sequence[str]) -> None:
    """Upsert keys must be non-NULL and unique in the source, else a rerun is not
    idempotent. One grouped aggregate (partial aggregation first) proves it."""
    bad = (source.groupBy(*keys).count()
           .where((F.col("count") > 1) | reduce(or_, [F.col(k).isNull() for k in keys]))
           .limit(1).count())
    if bad:
        raise ValueError(f"upsert source has NULL or repeated keys {list(keys)}")


def carry_over(target: DataFrame, source: DataFrame, keys: Sequence[str],
               columns: Sequence[str]) -> DataFrame:
    """The source rows with ``columns`` (created time and user) taken from the target's row
    of the same key, where there is one: an update does not reset them."""
    columns = [c for c in columns if c in target.columns and c in source.columns]
    if not columns:
        return source
    old = target.select(*keys, F.struct(*columns).alias("__old"))
    joined = source.join(old, on=list(keys), how="left")
    return joined.select(*[
        F.when(F.col("__old").isNotNull(), F.col(f"__old.{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c) for c in source.columns])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           validate: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """SNK-1: matched target rows are replaced by the source row (but for the columns in
    ``keep``, which stay the target's), unmatched source rows are inserted, all other
    target rows are kept.

    The anti join shuffles both sides on the keys; AQE splits a skewed target partition
    (left side of a left-anti join).
    """
    keys = list(keys)
    if validate:
        check_keys(source, keys)
    kept = target.join(source.select(*keys), on=keys, how="left_anti")
    source = carry_over(target, source, keys, keep)
    return kept.unionByName(source.select(*target.columns))


def clustered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Lay rows out for a partitioned write with AQE's ``rebalance``: rows are shuffled by
    the partition columns, so a task writes few partition directories (not tasks x values
    small files), and at run time AQE splits a value that holds a third of all rows over
    several tasks and merges small ones to the advisory size. No sampling pass is needed
    (a range repartition would evaluate the whole input twice)."""
    if not partition_by:
        return df
    return df.hint("rebalance", *partition_by)


def restore_table(spark: SparkSession, path: str) -> None:
    """Brings back a table whose last swap was cut off between its two renames: the path is
    missing and the old copy lies beside it. A staging copy that was never swapped in is
    left behind by such a crash too; it is not the table's content and is removed."""
    if fs.exists(spark, path):
        return
    old = fs.siblings(spark, f"{path}.__old-*")
    if len(old) > 1:
        raise IOError(f"{path} is missing and several old copies exist: {old}")
    if old:
        fs.rename(spark, old[0], path)
        for staging in fs.siblings(spark, f"{path}.__staging-*"):
            fs.delete(spark, staging)


def commit_table(spark: SparkSession, df: DataFrame, path: str,
                 partition_by: Sequence[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """Write ``df`` as the new content of ``path``: write a staging copy, then swap it in.

    ``df`` may read ``path`` itself (an upsert does): the old files stay until the new
    copy is complete. A crash before the swap leaves the old table readable, and one
    between its two renames is mended by ``restore_table`` at the next load; not safe for
    concurrent writers. Frames read from the old version are stale after the swap; the
    committed table is returned freshly read, with the types it was written with.
    """
    schema = schema or df.schema
    restore_table(spark, path)
    tag = uuid.uuid4().hex[:12]
    staging, old = f"{path}.__staging-{tag}", f"{path}.__old-{tag}"
    w = clustered(df, partition_by).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(staging)
    if fs.exists(spark, path):
        fs.rename(spark, path, old)
    fs.rename(spark, staging, path)
    fs.delete(spark, old)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


BUCKET = "__bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The key bucket that a row lies in."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucketed(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str],
             buckets: int) -> versions.Version | None:
    """The last version of a table in key buckets (a plain one is taken over as it lies);
    an error where it lies in other buckets than asked for."""
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    layout = {"keys": list(keys), "buckets": buckets}
    base = versions.adopt(spark, path, full, [BUCKET], layout)
    if base is not None and base.options != layout:
        raise ValueError(f"{path} lies in buckets {base.options}, not {layout}")
    return base


def read_buckets(spark: SparkSession, path: str, base: versions.Version, schema: T.StructType,
                 touched: Sequence[int] | None = None) -> DataFrame:
    """The rows of a table in key buckets, or of the buckets ``touched``, without the bucket."""
    only = None if touched is None else {f"{BUCKET}={b}" for b in touched}
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    return versions.read(spark, path, base, only, full).drop(BUCKET)


def buckets_in(df: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    """The buckets that a frame's keys lie in (a list bounded by the number of buckets)."""
    return sorted(r[0] for r in df.select(bucket_of(keys, buckets)).distinct().collect())


def upsert_buckets(spark: SparkSession, source: DataFrame, path: str, schema: T.StructType,
                   keys: Sequence[str], buckets: int, keep: Sequence[str] = (),
                   prepared: bool = False) -> DataFrame:
    """SNK-1 on a table that is laid out in ``buckets`` folders by a hash of its keys: only
    the buckets that the source touches are read and written anew (their list is bounded by
    the number of buckets); the files of the others stay as they are. The new folders are
    published together, on top of the version that was read: a load that was cut off at any
    point leaves the old table, and an upsert that is run again gives the same table. The
    first load creates the table. ``prepared``: the source is written already and its keys
    are proven. Returns the table's rows."""
    batch = source.select(*schema.names)
    if not prepared:
        batch = materialize(batch)
        check_keys(batch, keys)
    base = bucketed(spark, path, schema, keys, buckets)
    merged = batch
    if base is not None:
        old = read_buckets(spark, path, base, schema, buckets_in(batch, keys, buckets))
        merged = upsert(old, batch, keys, validate=False, keep=keep)
    merged = merged.withColumn(BUCKET, bucket_of(keys, buckets))
    done = versions.commit(spark, merged, path, [BUCKET], base=base, written=True,
                           options={"keys": list(keys), "buckets": buckets})
    return read_buckets(spark, path, done, schema)


def write_partitioned(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """SNK-2: overwrite load, partitioned by ``partition_by``. Each load replaces the
    whole table, whatever the session's partition overwrite mode, so partitions that the
    new frame lacks go and its schema is the new frame's (columns may be added between
    loads); it is read back with that schema, which keeps partition column types (no
    inference from directory names)."""
    (clustered(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy(*partition_by).parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Partition columns of a table, in directory order, from its directory names."""
    out, at = [], path
    while True:
        inner = [x.rstrip("/").rsplit("/", 1)[1] for x in fs.siblings(spark, f"{at}/*=*")]
        if not inner:
            return out
        out.append(inner[0].split("=", 1)[0])
        at = f"{at}/*=*"


def overwrite_slice(df: DataFrame, path: str, slice_values: Mapping[str, object],
                    check: bool = True) -> None:
    """SNK-3: replace only the rows of one slice (``col1 = v1 AND col2 = v2``).

    The table is partitioned by the slice columns, so the slice is one partition and the
    other slices are not read or rewritten; an empty input clears the slice. The slice's
    columns must be the table's partition columns (their order in ``slice_values`` does not
    matter). With ``check``, rows outside the slice fail the load before anything is written.

    A new table is a versioned one, and on a versioned table the new slice is published by
    one rename: a load that is cut off leaves the old slice. A plain Parquet table keeps its
    layout and is overwritten in place when the job commits, which is two steps (the old
    partition goes, the new one comes), so a driver lost in between loses the slice;
    ``versions.adopt`` makes it a versioned table without moving files.
    """
    spark = df.sparkSession
    pred = slice_predicate(slice_values)
    if check and not df.where(~F.coalesce(pred, F.lit(False))).isEmpty():
        raise ValueError(f"rows outside slice {dict(slice_values)}")
    base = versions.current(spark, path)
    plain = base is None and fs.exists(spark, path)
    columns = (partition_columns(spark, path) if plain else list(base.partition_by) if base else []) or list(slice_values)
    if sorted(columns) != sorted(slice_values):
        raise ValueError(f"slice columns {list(slice_values)} are not the table's partition "
                         f"columns {columns}")
    if not plain:
        versions.commit(spark, df, path, columns, {slice_folder(spark, columns, slice_values)}, base)
    elif df.isEmpty():
        fs.delete(spark, f"{path}/{slice_folder(spark, columns, slice_values)}")
    else:
        (clustered(df, columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*columns).parquet(path))


def slice_folder(spark: SparkSession, columns: Sequence[str], slice_values: Mapping[str, object]) -> str:
    """A slice's folder below its table. Its name is the one Spark itself writes for these
    values (found through a scratch copy of one row), so no escaping rule is repeated here."""
    row = spark.range(1).select(*[F.lit(slice_values[c]).cast("string").alias(c) for c in columns],
                                F.lit(1).alias("__x"))
    probe = scratch_path(spark, "slice-name")
    row.write.partitionBy(*columns).parquet(probe)
    (found,) = versions.folders(spark, probe, columns)
    fs.delete(spark, probe)
    return found


def snapshot_slice(spark: SparkSession, target: DataFrame, history_path: str,
                   slice_values: Mapping[str, object], load_ts) -> None:
    """SNK-4: before a slice is replaced, its current rows go to a history table with the
    load time (our reading of the reference's history flag). History is partitioned by the
    load time and the slice's columns, and a rerun of a load replaces its own snapshot."""
    snapshot = (target.where(slice_predicate(slice_values))
                .withColumn("load_ts", F.lit(load_ts).cast("timestamp_ntz")))
    (snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("load_ts", *slice_values).parquet(history_path))


def read_history(spark: SparkSession, history_path: str, target_schema: T.StructType) -> DataFrame:
    """The history table with the target's types, and load_ts."""
    schema = T.StructType([*target_schema.fields, T.StructField("load_ts", T.TimestampNTZType())])
    return spark.read.schema(schema).parquet(history_path)


def publish_slice(spark: SparkSession, df: DataFrame, sink_path: str,
                  slice_values: Mapping[str, object]) -> DataFrame:
    """SNK-5: publish a gold slice to the serving copy: the slice is deleted and the
    re-read slice appended (as one published partition). Rerunning gives the same result;
    the copy is read back with the frame's types.
    """
    overwrite_slice(df, sink_path, slice_values, check=True)
    return versions.read_table(spark, sink_path, df.schema)


def fan_out(bronze: DataFrame, targets: Sequence[TargetSpec], build,
            cache: bool = False) -> dict[str, DataFrame]:
    """SNK-6: one bronze frame feeds several targets, each with its own projection, keys,
    dedupe and stale flags. ``build(target_spec, bronze)`` returns the target's frame.

    By default each target's plan scans bronze itself and Catalyst prunes that scan to the
    columns the target reads: at scale two pruned columnar scans are cheaper than caching
    the bronze table. ``cache=True`` persists bronze once (all columns, so dedupe
    tie-breaking and hence every target's result is the same as when it loads alone).
    """
    shared = bronze.persist() if cache and len(targets) > 1 else bronze
    return {t.load.target_table: build(t, shared) for t in targets}


def fan_out_once(bronze: DataFrame, targets: Sequence[TargetSpec], path: str) -> dict[str, DataFrame]:
    """SNK-6 in one pass, for targets without a dedupe of their own: bronze is scanned once
    (all columns that any target reads), each row goes to every target whose filters it
    passes, tagged with the target, and is written once, partitioned by the tag. A target's
    frame reads its own partition and columns alone. A target that dedupes needs a shuffle
    on its keys: ``fan_out`` gives it a plan of its own."""
    from strata.functions.terms import plain_backslashes
    from strata.operators.project import project
    names = [t.load.target_table for t in targets]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated target tables: {names}")
    deduped = [t.load.target_table for t in targets if t.load.source_deduplication or t.load.merge_key]
    if deduped:
        raise ValueError(f"targets with a dedupe of their own: {deduped}")
    frame, made, tags = bronze.select(F.struct(*[F.col(f"`{c}`") for c in bronze.columns]).alias("__row")), [], []
    for i, target in enumerate(targets):
        filters = dict.fromkeys(m.filter for m in target.mappings if m.filter and m.filter.strip())
        passed = reduce(lambda a, b: a & b, [F.coalesce(F.expr(plain_backslashes(f)), F.lit(False)) for f in filters], F.lit(True))
        flat = frame.select("*", *[F.col("__row")[c].alias(c) for c in bronze.columns]).withColumn(f"__in{i}", passed)
        done = ["__row", *made, f"__in{i}"]
        audit = [c for c in target.load.audit.all() if c in bronze.columns] if target.audit_passthrough else []
        out = project(flat, target.mappings, keep=[*audit, *done])
        own = [c for c in out.columns if c not in done]
        frame = out.select(*done, F.struct(*[F.col(f"`{c}`") for c in own]).alias(f"__target{i}"))
        made += [f"__in{i}", f"__target{i}"]
        tags.append(F.when(F.col(f"__in{i}"), F.lit(i)))
    tagged = frame.select(*made, F.explode(F.array_compact(F.array(*tags))).alias("target"))
    rows = tagged.select("target", *[F.when(F.col("target") == i, F.col(f"__target{i}")).alias(f"__target{i}") for i in range(len(targets))])
    rows.write.partitionBy("target").parquet(path)
    back = bronze.sparkSession.read.schema(rows.schema).parquet(path)
    return {name: back.where(F.col("target") == i).select(f"__target{i}.*") for i, name in enumerate(names)}
