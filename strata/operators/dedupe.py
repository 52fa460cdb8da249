"""Latest-record deduplication (WN-1..WN-3) and the year-over-year window (WN-4).

Top-1 per key is written as ``row_number() = 1``. Catalyst turns that into a partial
``WindowGroupLimit`` before the shuffle and a final one after it, so a key that holds a
third of all rows is cut to one row per map task before it is shuffled.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.spec import LoadSpec, order_spec

def order_columns(order) -> list[Column]:
    """Order items as Columns: ``desc`` is NULLS LAST and ``asc`` NULLS FIRST (Spark's
    defaults), written out so every direction is explicit (D1)."""
    out = []
    items = order if isinstance(order, (list, tuple)) else [order]
    for it in items:
        if isinstance(it, Column):
            out.append(it.desc_nulls_last())
            continue
        if isinstance(it, (list, tuple)) and it and isinstance(it[0], Column):
            c, d = it[0], (it[1] if len(it) > 1 else "desc")
        else:
            ((c, d),) = order_spec([it])
            c = F.col(c)
        out.append(c.desc_nulls_last() if d == "desc" else c.asc_nulls_first())
    return out


def _named(order) -> set[str]:
    names = set()
    for it in (order if isinstance(order, (list, tuple)) else [order]):
        if isinstance(it, str):
            names.add(it.split()[0].lower())
        elif isinstance(it, (list, tuple)) and it and isinstance(it[0], str):
            names.add(it[0].lower())
    return names


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def tie_breakers(df: DataFrame, keys: Sequence[str], order) -> list[Column]:
    """All remaining columns, ascending, so the order is total (D2). Arrays and structs are
    ordered as they are; a map by its sorted entries, and what
    holds a map deeper inside by its JSON text."""
    used = {k.lower() for k in keys} | _named(order)
    out = []
    for f in df.schema.fields:
        if f.name.lower() in used:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType) and not _has_map(f.dataType.valueType):
            c = F.array_sort(F.map_entries(c))
        elif _has_map(f.dataType):
            c = F.to_json(F.struct(c))
        out.append(c.asc_nulls_first())
    return out


def latest_by_key(df: DataFrame, keys: Sequence[str], order, ties: str = "all") -> DataFrame:
    """WN-1: one row per key, the first by ``order`` (default direction desc).

    ``ties='all'`` appends every remaining column so equal order values still pick the
    same row on every run; ``ties='none'`` keeps Spark's arbitrary choice.
    """
    spec = order_columns(order)
    if ties == "all":
        spec += tie_breakers(df, keys, order)
    w = Window.partitionBy(*keys).orderBy(*spec)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def dedupe_bronze(df: DataFrame, partition_by: Sequence[str], order_by) -> DataFrame:
    """WN-2: the ``bronze_data`` view restricted to ``ROWNUM = 1``.

    Partition and order columns come from the load metadata, each with its own direction.
    Consumers of the reference's view only read ``ROWNUM = 1``, so the top-1 form (which
    is skew-safe) is what is produced.
    """
    return latest_by_key(df, partition_by, list(order_by) or [])


def dedupe_for(spec: LoadSpec, df: DataFrame) -> DataFrame:
    """WN-3: per-target choice between the configured bronze dedupe and merge-key dedupe."""
    if spec.source_deduplication:
        return dedupe_bronze(df, spec.source_partition_by, spec.source_order_by)
    if not spec.merge_key:
        return df
    return latest_by_key(df, spec.merge_key, list(spec.order_by))


def yoy(df: DataFrame, by: Sequence[str], year: str, value: str,
        out: str = "yoy_change") -> DataFrame:
    """WN-4: total per (by, year) and its change on the previous year.

    The change is NULL when the previous year is missing (``lag`` row must be year-1).
    Rows are aggregated first, so the window sees one row per group and year.
    """
    per_year = df.groupBy(*by, year).agg(F.sum(value).alias("total"))
    w = Window.partitionBy(*by).orderBy(year)
    prev_year = F.lag(year).over(w)
    prev_total = F.lag("total").over(w)
    return per_year.select(
        *by, year, "total",
        F.when(prev_year == F.col(year) - 1, F.col("total") - prev_total).alias(out),
        F.when(prev_year == F.col(year) - 1,
               F.try_divide((F.col("total") - prev_total).cast("double"),
                            prev_total.cast("double")) * 100).alias(out + "_pct"))
