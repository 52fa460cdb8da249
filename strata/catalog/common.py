"""Shared helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.sources.readers import read_layer

# Fixed run values used by the registered loads (a fixed load time keeps reruns equal).
LOAD_TS = "2024-06-30 12:00:00"
JOB_ID = "job-0001"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given test table."""
    return read_layer(spark, sf_dir, None, name)


# Columns of lineitem after the dedupe key and order column, for tie-breaking in SQL.
LINEITEM_TIES = ("l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
                 "l_returnflag, l_linestatus")


def latest_lineitem_sql(where: str = "") -> str:
    """DuckDB text of WN-1 on lineitem: newest ship date per (order, line), ties broken by
    all remaining columns ascending."""
    ties = ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in LINEITEM_TIES.split(","))
    return (f"SELECT * FROM lineitem {where} QUALIFY row_number() OVER ("
            f"PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, "
            f"{ties}) = 1")
