"""Mapping-driven projection (PRJ-1..PRJ-8) and filters (FIL-1..FIL-3).

A list of :class:`ColumnMapping` becomes one projection per dependency level: columns that
read other target columns (PRJ-3) are computed after them, and Catalyst collapses the
stacked ``select``s into one Project. Nothing is evaluated on the driver.
"""

from __future__ import annotations

import re
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.glossary import DEFAULT_DATE_FORMATS, TermContext, apply_term
from strata.functions.terms import TermError, parse_cell, plain_backslashes, term_references
from strata.spec import AuditColumns, ColumnMapping

_SIMPLE_TYPES = {
    "string": T.StringType(), "varchar": T.StringType(), "char": T.StringType(),
    "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "long": T.LongType(), "smallint": T.ShortType(), "tinyint": T.ByteType(),
    "double": T.DoubleType(), "float": T.FloatType(), "real": T.FloatType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(), "decimal": T.DecimalType(10, 0),
}


def parse_type(s: str) -> T.DataType:
    """A mapping's type name (STRING, INT, DECIMAL(18,2), ...) as a Spark type."""
    t = s.strip().lower()
    m = re.match(r"^(decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)$", t)
    if m:
        return T.DecimalType(int(m.group(2)), int(m.group(3) or 0))
    t = re.sub(r"\(.*\)$", "", t).strip()
    if t not in _SIMPLE_TYPES:
        raise TermError(f"unknown data type {s!r}")
    return _SIMPLE_TYPES[t]


def as_mappings(items: Iterable) -> list[ColumnMapping]:
    """Accept ColumnMapping objects or dicts with the same field names."""
    out = []
    for it in items:
        out.append(it if isinstance(it, ColumnMapping) else ColumnMapping(**it))
    return out


def order_by_dependency(mappings: Sequence[ColumnMapping]) -> list[list[ColumnMapping]]:
    """PRJ-3: group mappings into levels; a level reads only sources and earlier levels.

    Raises on a cycle, naming the columns involved.
    """
    by_name = {m.target.lower(): m for m in mappings}
    deps = {}
    for m in mappings:
        refs = set()
        for term in parse_cell(m.transformation):
            refs.update(r.lower() for r in term_references(term))
        deps[m.target.lower()] = {r for r in refs if r in by_name and r != m.target.lower()}
    levels, done = [], set()
    while len(done) < len(by_name):
        ready = [n for n in by_name if n not in done and deps[n] <= done]
        if not ready:
            cycle = sorted(n for n in by_name if n not in done)
            raise TermError(f"circular references among target columns: {cycle}")
        levels.append([by_name[n] for n in ready])
        done.update(ready)
    return levels


def project(df: DataFrame, mappings: Iterable, policy: str = "strict",
            keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-1/2/4 (+PRJ-3, SC-*): one output column per mapping, in mapping order.

    ``policy='strict'`` casts to the target type (a bad value fails the job under ANSI);
    ``policy='reject'`` uses ``try_cast`` and adds a boolean ``_rejected`` column that is
    true when a non-NULL value could not be cast (D3). ``keep`` passes source columns
    through unchanged (e.g. the audit columns, PRJ-5).
    """
    maps = as_mappings(mappings)
    if policy not in ("strict", "reject"):
        raise ValueError("policy must be 'strict' or 'reject'")
    src_types = {f.name.lower(): f.dataType for f in df.schema.fields}
    src_names = {f.name.lower(): f.name for f in df.schema.fields}
    internal = {m.target.lower(): f"__t{i}" for i, m in enumerate(maps)}
    tgt_types = {m.target.lower(): parse_type(m.target_type) for m in maps}
    ok_cols: list[str] = []

    def make_ctx(m: ColumnMapping, current: Column, cur_type) -> TermContext:
        me = m.target.lower()

        def where(name: str) -> str:
            n = name.lower()
            if n in internal and n != me:
                return internal[n]
            if n in src_names:
                return src_names[n]
            raise TermError(f"{m.target}: unknown column {name!r}")

        return TermContext(
            target=m.target, target_type=m.target_type,
            resolve=lambda name: F.col(f"`{where(name)}`"),
            sql_name=lambda name: f"`{where(name)}`",
            dtype=lambda name: (tgt_types[name.lower()] if name.lower() in internal
                                and name.lower() != me else src_types.get(name.lower())),
            current=current, current_type=cur_type, source_format=m.source_format,
            default=m.default, policy=policy)

    def build(m: ColumnMapping) -> list[Column]:
        ttype = tgt_types[m.target.lower()]
        if m.source_field:
            if m.source_field.lower() not in src_names:
                raise TermError(f"{m.target}: source field {m.source_field!r} not in input")
            current = F.col(f"`{src_names[m.source_field.lower()]}`")
            cur_type = src_types[m.source_field.lower()]
            if m.alternates:  # JN-4: several sources, first non-null wins
                alts = [F.col(f"`{src_names[a.lower()]}`").cast(ttype) for a in m.alternates]
                current, cur_type = F.coalesce(current.cast(ttype), *alts), ttype
        else:
            current, cur_type = F.lit(None), None
        for term in parse_cell(m.transformation):
            current, cur_type = apply_term(term, make_ctx(m, current, cur_type))
        name = internal[m.target.lower()]
        if isinstance(ttype, T.DateType) and isinstance(cur_type, T.StringType):
            # text -> DATE: parse by format first ('240305' must not become year 240305)
            fmts = (m.source_format,) if m.source_format else DEFAULT_DATE_FORMATS
            current = F.coalesce(*[F.to_date(F.try_to_timestamp(current, F.lit(f)))
                                   for f in fmts], current.try_cast(ttype) if policy == "reject"
                                 else current.cast(ttype))
        if policy == "strict":
            return [current.cast(ttype).alias(name)]
        ok = f"{name}_ok"
        ok_cols.append(ok)
        casted = current.try_cast(ttype)
        return [casted.alias(name), (current.isNull() | casted.isNotNull()).alias(ok)]

    out = df
    for level in order_by_dependency(maps):
        out = out.select("*", *[c for m in level for c in build(m)])
    cols = [F.col(internal[m.target.lower()]).alias(m.target) for m in maps]
    cols += [F.col(f"`{src_names[k.lower()]}`").alias(k) for k in keep]
    if ok_cols:
        cols.append((~F.coalesce(F.array_min(F.array(*[F.col(c) for c in ok_cols])),
                                 F.lit(True))).alias("_rejected"))
    return out.select(*cols)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of a ``policy='reject'`` projection."""
    return (df.where(~F.col("_rejected")).drop("_rejected"),
            df.where(F.col("_rejected")).drop("_rejected"))


def with_audit_stamp(df: DataFrame, load_ts, job_id: str, audit: AuditColumns | None = None,
                     system_id: int | None = None, reporting_unit_id: int | None = None,
                     created: bool = True, only_absent: bool = False) -> DataFrame:
    """PRJ-6: created/updated time and user set by the job with one fixed ``load_ts`` per
    run (not ``current_timestamp()``), so a rerun produces the same rows. Times are
    zone-less (``timestamp_ntz``), like the source tables. ``only_absent`` leaves columns
    that the frame brings along as they are (PRJ-5)."""
    a = audit or AuditColumns()
    ts = F.lit(load_ts).cast("timestamp_ntz")
    cols = {a.updated_time: ts, a.updated_by: F.lit(job_id)}
    if created:
        cols.update({a.created_time: ts, a.created_by: F.lit(job_id)})
    if system_id is not None:
        cols[a.system_id] = F.lit(system_id).cast("int")
    if reporting_unit_id is not None:
        cols[a.reporting_unit_id] = F.lit(reporting_unit_id).cast("int")
    if only_absent:
        cols = {c: v for c, v in cols.items() if c not in df.columns}
    return df.withColumns(cols)


def conform(df: DataFrame, schema) -> DataFrame:
    """PRJ-7: order and cast columns to the target schema; missing columns are an error."""
    fields = schema.fields if isinstance(schema, T.StructType) else [
        T.StructField(n, parse_type(t) if isinstance(t, str) else t) for n, t in schema]
    have = {c.lower(): c for c in df.columns}
    missing = [f.name for f in fields if f.name.lower() not in have]
    if missing:
        raise ValueError(f"columns missing for target schema: {missing}")
    return df.select(*[F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name)
                       for f in fields])


def expr_with_params(spark: SparkSession, sql: str, params: Mapping | None = None,
                     views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """PRJ-8: run SQL with named parameters bound as literals (never spliced into text)."""
    for name, frame in (views or {}).items():
        frame.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(params or {}))


def apply_filters(df: DataFrame, filters: Iterable[str | Column | None]) -> DataFrame:
    """FIL-1: per-source filters from the mapping, applied before any join. A filter is a SQL
    boolean expression; a backslash in a quoted text of it is a backslash."""
    for f in filters:
        if f is None or (isinstance(f, str) and not f.strip()):
            continue
        df = df.where(F.expr(plain_backslashes(f)) if isinstance(f, str) else f)
    return df


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FIL-2: drop rows with a NULL join key (apply to the lookup side of a LEFT join)."""
    return df.dropna(subset=list(keys))


def keep_castable(df: DataFrame, column: str, to: str) -> DataFrame:
    """FIL-3: keep rows whose value casts to ``to`` (NULL and bad values dropped)."""
    return df.where(F.col(column).try_cast(to).isNotNull())
