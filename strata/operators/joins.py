"""Joins of the mapping model (JN-1..JN-5)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import materialize
from strata.spec import Lookup


def unique_lookup(lookup: DataFrame, keys: Sequence[str], name: str = "lookup") -> DataFrame:
    """The lookup, one row per key; a key that repeats fails the job that reads it (it would
    multiply the main rows). The check is part of the plan: the rows are grouped on the join
    key, so the join needs no further shuffle and no job runs while the plan is built. No
    broadcast hint is given: Spark's byte threshold and AQE decide from measured sizes."""
    rest = [c for c in lookup.columns if c not in keys]
    grouped = lookup.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"),
                                        *[F.first(c).alias(c) for c in rest])
    message = f"lookup {name}: key {list(keys)} is not unique"
    once = F.when(F.col("__n") > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
    return grouped.where(once).select(*lookup.columns)


def _keys(on) -> list[str] | None:
    if isinstance(on, str):
        return [on]
    if isinstance(on, (list, tuple)) and all(isinstance(k, str) for k in on):
        return list(on)
    return None


def declared_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """JN-1: equi-join declared in the mapping; INNER when no type is given.

    NULL keys never match, so for an inner join they are removed on both sides before
    the shuffle (less data moved; Catalyst also infers this), and for a left join only
    on the right side (FIL-2), so no left row is lost.
    """
    how = (how or "inner").strip().lower()
    keys = _keys(on)
    if keys:
        right = right.dropna(subset=keys)
        if how == "inner":
            left = left.dropna(subset=keys)
    return left.join(right, on=on, how=how)


def enrich(df: DataFrame, lookups: Sequence[Lookup], check_unique: bool = True) -> DataFrame:
    """JN-2: chain of LEFT joins onto reference tables.

    Each lookup is pruned to its key and wanted columns first. With ``check_unique`` a
    lookup whose key repeats fails the job (``unique_lookup``).
    """
    out = df
    for lk in lookups:
        keys = _keys(lk.on)
        right = lk.df
        if keys and lk.columns:
            right = right.select(*dict.fromkeys([*keys, *lk.columns]))
        if keys:
            right = right.dropna(subset=keys)
            if check_unique:
                right = unique_lookup(right, keys, lk.name)
        out = out.join(right, on=lk.on, how=lk.how)
    return out


def _floor_for(t: T.DataType) -> Column:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("1970-01-01 00:00:00").cast(t)
    if isinstance(t, T.NumericType):
        return F.lit(0).cast(t)
    return F.lit("1970-01-01 00:00:00")


def drop_stale(src: DataFrame, target: DataFrame, keys: Sequence[str], ts: str,
               target_ts: str | None = None) -> DataFrame:
    """JN-3: keep a source row only if it is newer than the target's row for its key.

    The rule is ``src.ts > COALESCE(target.ts, '1970-01-01 00:00:00')`` with a strict
    ``>`` (equal times are stale), unmatched rows pass when newer than 1970, a NULL time
    never passes and NULL keys never match. Of the target only rows with a key of the source
    count (a semi-join: a small source is broadcast by size, and then only those rows move);
    they are reduced to ``max(ts)`` per key, so repeated target keys do not fan out. The
    output has exactly the source columns. The source is read twice: pass a written one.
    """
    keys = list(keys)
    tts = target_ts or ts
    newest = (target.where(F.col(tts).isNotNull()).select(*keys, tts)
              .join(src.select(*keys), keys, "left_semi")
              .groupBy(*keys).agg(F.max(tts).alias("__target_ts")))
    ts_type = src.schema[ts].dataType
    joined = src.join(newest, on=keys, how="left")
    kept = joined.where(F.col(ts) > F.coalesce(F.col("__target_ts").cast(ts_type),
                                               _floor_for(ts_type)))
    return kept.select(*src.columns)


def coalesce_sources(cols: Sequence[Column | str], to: str | None = None) -> Column:
    """JN-4: several sources feed one target column; the first non-NULL wins."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    if to:
        cs = [c.cast(to) for c in cs]
    return F.coalesce(*cs)


def orphans(df: DataFrame, parent: DataFrame, on, parent_on=None) -> DataFrame:
    """JN-5: rows whose key has no parent row (referential-integrity check)."""
    if parent_on is not None:
        left_keys, right_keys = _keys(on), _keys(parent_on)
        cond = reduce(lambda a, b: a & b,
                      [df[lk] == parent[rk] for lk, rk in zip(left_keys, right_keys)])
        return df.join(parent.select(*right_keys), cond, "left_anti")
    return df.join(parent.select(*_keys(on)), on=on, how="left_anti")


def hierarchy(df: DataFrame, node: str, parent: str) -> DataFrame:
    """JN-5 over all levels: (node, status, root, depth) for every node of a parent-child
    table (node ids non-NULL and unique; a repeated one fails the job).

    ``ok``: the chain of parents ends in a root (no parent), named with its distance.
    ``broken``: it ends in an id that has no row, named with its distance. ``cycle``: the
    node lies on a cycle; ``into_cycle``: its chain runs into one; both named by the cycle's
    smallest member.

    Pointer jumping: each round every open node takes over the node that its target points
    to, so after k rounds 2**k steps are done and a chain of any length needs its logarithm
    of rounds, each a join on the target id (AQE splits a parent that many nodes share).
    When a round settles nobody, what is open runs into cycles.
    """
    ids = unique_lookup(df.select(F.col(node).alias("n"), F.col(parent).alias("p")), ["n"], f"hierarchy {node}")
    known = ids.select(F.col("n").alias("up"), F.lit(True).alias("there"))
    root = F.col("p").isNull()
    state = materialize(ids.join(known, ids["p"] == known["up"], "left").select(
        "n", F.when(root, F.col("n")).otherwise(F.col("p")).alias("at"), F.when(root, 0).otherwise(1).cast("long").alias("steps"),
        F.least("n", "p").alias("least"), F.when(root, "ok").when(F.col("there").isNull(), "broken").alias("status")))
    open_, jumped = state.where("status is null").count(), 1
    while open_:
        up = state.select(F.col("n").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"),
                          F.col("least").alias("least2"), F.col("status").alias("status2"))
        moved = state.where("status is null").join(up, "at").select(
            "n", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"),
            F.least("least", "least2").alias("least"), F.col("status2").alias("status"))
        state = materialize(state.where("status is not null").unionByName(moved))
        left, jumped = state.where("status is null").count(), 2 * jumped
        # what is open once a round settles nobody runs into cycles; it goes on until each has
        # surely gone round its cycle
        if left == open_ and jumped >= left:
            break
        open_ = left
    turning = state.where("status is null").select("n", "at", "least")
    around = turning.select(F.col("at").alias("n")).distinct().withColumn("on", F.lit(True))
    named = turning.select(F.col("n").alias("at"), F.col("least").alias("name"))
    cycles = turning.drop("least").join(named, "at").join(around, "n", "left").select(
        "n", F.when(F.col("on"), "cycle").otherwise("into_cycle").alias("status"), F.col("name").alias("root"),
        F.lit(None).cast("long").alias("depth"))
    ended = state.where("status is not null").select("n", "status", F.col("at").alias("root"), F.col("steps").alias("depth"))
    return ended.unionByName(cycles).withColumnRenamed("n", node)
