"""Flagship silver load and the dedupe / projection queries (WN-*, PRJ-*, SRC-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.catalog import query
from strata.catalog.common import JOB_ID, LOAD_TS, latest_lineitem_sql, t
from strata.operators.dedupe import latest_by_key
from strata.operators.joins import enrich
from strata.operators.project import project, with_audit_stamp
from strata.spec import ColumnMapping, Lookup

# The six-column lineitem mapping of the flagship load.
LINEITEM_MAPPING = (
    ColumnMapping("line_id", "STRING",
                  transformation='Concatenate(l_orderkey, "|", l_linenumber)'),
    ColumnMapping("order_key", "BIGINT", "l_orderkey", transformation="Direct"),
    ColumnMapping("extended_price", "DECIMAL(18,2)", "l_extendedprice",
                  transformation="Direct Pull (casts to the target type)"),
    ColumnMapping("ship_year", "STRING",
                  transformation='DateExtraction("l_shipdate", "yyyy")'),
    ColumnMapping("size_class", "STRING",
                  transformation='Conditional("l_quantity > 25", "LARGE", "SMALL")'),
    ColumnMapping("system_id", "INT", transformation="Default Value: 420"),
)


def flagship(spark, sf_dir):
    """lineitem -> latest row per (order, line) -> mapping projection -> audit stamp ->
    order lookup."""
    bronze = t(spark, sf_dir, "lineitem")
    latest = latest_by_key(bronze, ["l_orderkey", "l_linenumber"], ["l_shipdate desc"])
    silver = with_audit_stamp(project(latest, LINEITEM_MAPPING), LOAD_TS, JOB_ID)
    orders = t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), "o_orderstatus", "o_orderpriority")
    return enrich(silver, [Lookup(orders, "order_key", name="orders")])


FLAGSHIP_SQL = f"""
WITH d AS ({latest_lineitem_sql()})
SELECT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS line_id,
       l_orderkey AS order_key,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS extended_price,
       strftime(l_shipdate, '%Y') AS ship_year,
       CASE WHEN l_quantity > 25 THEN 'LARGE' ELSE 'SMALL' END AS size_class,
       CAST(420 AS INTEGER) AS system_id,
       TIMESTAMP '{LOAD_TS}' AS updated_time, '{JOB_ID}' AS updated_by,
       TIMESTAMP '{LOAD_TS}' AS created_time, '{JOB_ID}' AS created_by,
       o.o_orderstatus, o.o_orderpriority
FROM d LEFT JOIN orders o ON d.l_orderkey = o.o_orderkey
"""

query("flagship_silver_lineitem", FLAGSHIP_SQL)(flagship)
