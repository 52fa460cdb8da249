"""Scans (SRC-1..SRC-6)."""

from __future__ import annotations

from functools import reduce
from typing import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources import fs, versions
from strata.sources.sheets import load_sheets


def layer_path(root: str, layer: str | None, table: str) -> str:
    """``<root>/<layer>/<table>``; without a layer, the flat ``<root>/<table>.parquet``."""
    return f"{root}/{layer}/{table}" if layer else f"{root}/{table}.parquet"


def read_layer(spark: SparkSession, root: str, layer: str | None, table: str,
               merge_schema: bool = False) -> DataFrame:
    """SRC-1: scan a layer table, versioned or plain. Filters and column pruning reach the
    parquet scan."""
    path = layer_path(root, layer, table)
    if versions.is_versioned(spark, path):
        return versions.read_table(spark, path)
    reader = spark.read
    if merge_schema:
        reader = reader.option("mergeSchema", "true")
    return reader.parquet(path)


def read_job_slice(df: DataFrame, id_col: str, job_id: str) -> DataFrame:
    """SRC-2: rows written by one job: trimmed updater id equals the trimmed job id.

    ``job_id`` is bound as a literal (D11). Pushdown stops at ``trim``; keep job ids
    untrimmed at write time if the scan must prune.
    """
    return df.where(F.trim(F.col(id_col).cast("string")) == F.lit(str(job_id).strip()))


def register_inputs(spark: SparkSession, inputs: Mapping[str, DataFrame],
                    suffix: str = "_temp_vw") -> dict[str, str]:
    """SRC-3: register each named input as ``<name>_temp_vw``; returns name -> view."""
    views = {}
    for name, df in inputs.items():
        view = f"{name}{suffix}"
        df.createOrReplaceTempView(view)
        views[name] = view
    return views


def read_target(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-4: the existing target, or an empty frame with the target schema if its path does
    not exist. Any other error (unreadable files, no rights) is raised."""
    if schema is not None and not fs.exists(spark, path):
        return spark.createDataFrame([], schema)
    return versions.read_table(spark, path, schema)


def slice_predicate(slice_values: Mapping[str, object]) -> Column:
    """``col1 = v1 AND col2 = v2``; a None value matches NULL."""
    preds = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v)
             for c, v in slice_values.items()]
    return reduce(lambda a, b: a & b, preds)


def read_target_slice(df: DataFrame, slice_values: Mapping[str, object]) -> DataFrame:
    """SRC-5: the target rows of one source system / reporting unit (partition-prunable
    when the target is partitioned by those columns)."""
    return df.where(slice_predicate(slice_values))


def load_mapping_sheets(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC-6: mapping sheets as a table, all-blank rows and all-blank columns dropped.

    Sheets arrive as CSV (or JSON lines) files, any number of them, each with its own
    header; every column is text. CSV files are read by one scan (``sheets``), JSON lines by
    Spark's reader, with one aggregate (a count per column) to find the blank columns.
    """
    if fmt == "csv":
        return load_sheets(spark, path)
    rows = spark.read.json(path).dropna(how="all")
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}")
                        for i, c in enumerate(rows.columns)]).first()
    keep = [c for i, c in enumerate(rows.columns) if counts[f"c{i}"] > 0]
    return rows.select(*[F.col(f"`{c}`") for c in keep])
