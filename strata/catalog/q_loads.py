"""Loads and sinks (SNK-1..SNK-6) and load statistics (AG-3).

Write queries write under the session's shared folder and return the table as read back,
so the oracle compares final state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.catalog import query
from strata.catalog.common import LOAD_TS, latest_lineitem_sql, t
from strata.operators.dedupe import dedupe_for, latest_by_key
from strata.operators.project import project
from strata.operators.stats import load_stats
from strata.session import materialize, scratch_path
from strata.sources import versions
from strata.sources.writers import (fan_out, fan_out_once, overwrite_slice, publish_slice,
                                    read_history, snapshot_slice, upsert_buckets, write_partitioned)
from strata.spec import ColumnMapping as M
from strata.spec import LoadSpec, TargetSpec

KEYS = ["l_orderkey", "l_linenumber"]
Y2000 = "2000-01-01 00:00:00"
Y1999 = "1999-01-01 00:00:00"


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


@query("snk01_upsert", f"""
WITH d AS ({latest_lineitem_sql()}),
tgt AS (SELECT * FROM d WHERE l_shipdate < TIMESTAMP '{Y2000}'),
src AS (SELECT * REPLACE (l_quantity + 1 AS l_quantity) FROM d
        WHERE l_shipdate >= TIMESTAMP '{Y1999}')
SELECT * FROM tgt WHERE NOT EXISTS (
  SELECT 1 FROM src WHERE src.l_orderkey = tgt.l_orderkey AND src.l_linenumber = tgt.l_linenumber)
UNION ALL SELECT * FROM src""")
def snk01(spark, sf):
    """Target = latest lines shipped before 2000; incoming = lines shipped from 1999 on with
    a changed quantity. Overlapping keys are updated, new keys inserted."""
    # the deduped bronze feeds both loads: cut its lineage once instead of recomputing it
    latest = materialize(latest_by_key(t(spark, sf, "lineitem"), KEYS, ["l_shipdate desc"]))
    path = scratch_path(spark, "snk01")
    first = latest.where(F.col("l_shipdate") < _ts(Y2000))
    upsert_buckets(spark, first, path, latest.schema, KEYS, 16)
    incoming = latest.where(F.col("l_shipdate") >= _ts(Y1999)) \
                     .withColumn("l_quantity", F.col("l_quantity") + 1)
    return upsert_buckets(spark, incoming, path, latest.schema, KEYS, 16)


@query("snk02_write_partitioned", f"SELECT * FROM ({latest_lineitem_sql()}) WHERE l_returnflag <> 'R'")
def snk02(spark, sf):
    """The first load holds everything, the second lacks one return flag: its partitions go."""
    latest = materialize(latest_by_key(t(spark, sf, "lineitem"), KEYS, ["l_shipdate desc"]))
    path, by = scratch_path(spark, "snk02"), ["l_returnflag", "l_linestatus"]
    write_partitioned(latest, path, by)
    return write_partitioned(latest.where("l_returnflag <> 'R'"), path, by)


def _orders_table(spark, sf):
    orders = t(spark, sf, "orders")
    path = scratch_path(spark, "orders_gold")
    versions.commit(spark, orders, path, ["o_orderstatus", "o_orderpriority"])
    return orders, path


SLICE_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_totalprice * 1.1
            ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"""


@query("snk03_overwrite_slice", SLICE_SQL)
def snk03(spark, sf):
    """Replace slice (F, 1-URGENT) with repriced rows, clear slice (P, 5-LOW) with an
    empty input; other slices stay as they were."""
    orders, path = _orders_table(spark, sf)
    current = versions.read_table(spark, path)
    urgent = {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"}   # any order of columns
    repriced = current.where((F.col("o_orderstatus") == "F")
                             & (F.col("o_orderpriority") == "1-URGENT")) \
        .withColumn("o_totalprice", F.col("o_totalprice") * 1.1)
    overwrite_slice(repriced, path, urgent)        # it may read the slice that it replaces
    empty = current.where(F.lit(False))
    overwrite_slice(empty, path, {"o_orderstatus": "P", "o_orderpriority": "5-LOW"})
    return versions.read_table(spark, path)


@query("snk04_snapshot_slice", f"""
SELECT *, TIMESTAMP '{LOAD_TS}' AS load_ts FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'""")
def snk04(spark, sf):
    orders, path = _orders_table(spark, sf)
    current = versions.read_table(spark, path)
    history = scratch_path(spark, "snk04_history")
    snapshot_slice(spark, current, history, {"o_orderstatus": "O", "o_orderpriority": "2-HIGH"},
                   LOAD_TS)
    snapshot_slice(spark, current, history, {"o_orderstatus": "O", "o_orderpriority": "2-HIGH"},
                   LOAD_TS)                      # a rerun of the load changes nothing
    return read_history(spark, history, orders.schema).select(*orders.columns, "load_ts")


@query("snk05_publish_slice", """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'
            THEN CAST(round(o_totalprice) AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority FROM orders""")
def snk05(spark, sf):
    """Publish the gold slice (O, 2-HIGH) to the serving copy twice: same result."""
    orders, serving = _orders_table(spark, sf)
    sl = {"o_orderstatus": "O", "o_orderpriority": "2-HIGH"}
    gold = orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "2-HIGH")) \
                 .withColumn("o_totalprice", F.round("o_totalprice"))
    publish_slice(spark, gold, serving, sl)
    publish_slice(spark, gold, serving, sl)
    return versions.read_table(spark, serving)


@query("snk06_fan_out", f"""
WITH a AS ({latest_lineitem_sql()}),
b AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey
      ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber) = 1)
SELECT 'line_latest' AS target_table,
       CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS item_key,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM a
UNION ALL
SELECT 'part_latest', CAST(l_partkey AS VARCHAR), CAST(l_quantity AS DECIMAL(18,2)) FROM b""")
def snk06(spark, sf):
    """One lineitem bronze feeds two silver targets with their own keys and dedupe."""
    line = TargetSpec(LoadSpec("line_latest", merge_key=tuple(KEYS),
                               order_by=(("l_shipdate", "desc"),)), (
        M("item_key", "STRING", transformation='Concatenate(l_orderkey, "-", l_linenumber)'),
        M("amount", "DECIMAL(18,2)", "l_extendedprice")))
    part = TargetSpec(LoadSpec("part_latest", source_deduplication=True,
                               source_partition_by=("l_partkey",),
                               source_order_by=(("l_shipdate", "desc"), ("l_orderkey", "asc"),
                                                ("l_linenumber", "asc"))), (
        M("item_key", "STRING", "l_partkey"),
        M("amount", "DECIMAL(18,2)", "l_quantity")))

    def build(spec, bronze):
        out = project(dedupe_for(spec.load, bronze), spec.mappings)
        return out.select(F.lit(spec.load.target_table).alias("target_table"), "*")

    outs = fan_out(t(spark, sf, "lineitem"), [line, part], build)
    return outs["line_latest"].unionByName(outs["part_latest"])


@query("snk06_one_pass", """
SELECT 'lines' AS target_table, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS item_key,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem
UNION ALL
SELECT 'returns', upper(l_returnflag), CAST(l_quantity AS DECIMAL(18,2)) FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity > 10""")
def snk06_once(spark, sf):
    """Two targets without a dedupe of their own, one of them filtered, from one scan."""
    lines = TargetSpec(LoadSpec("lines", merge_type="append"), (
        M("item_key", "STRING", transformation='Concatenate(l_orderkey, "-", l_linenumber)'),
        M("amount", "DECIMAL(18,2)", "l_extendedprice")))
    returns = TargetSpec(LoadSpec("returns", merge_type="append"), (
        M("item_key", "STRING", "l_returnflag", transformation="Uppercase", filter="l_returnflag = 'R'"),
        M("amount", "DECIMAL(18,2)", "l_quantity", filter="l_quantity > 10")))
    outs = fan_out_once(t(spark, sf, "lineitem"), [lines, returns], scratch_path(spark, "snk06_once"))
    return reduce(DataFrame.unionByName, [out.select(F.lit(name).alias("target_table"), "*") for name, out in outs.items()])


@query("ag03_load_stats", f"""
SELECT count(*) AS row_count,
       count_if(created_time = TIMESTAMP '{LOAD_TS}') AS inserted,
       count_if(updated_time = TIMESTAMP '{LOAD_TS}' AND created_time < TIMESTAMP '{LOAD_TS}')
         AS updated,
       count_if(updated_time < TIMESTAMP '{LOAD_TS}') AS unchanged
FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '{LOAD_TS}'
                  ELSE o_orderdate END AS created_time,
             CASE WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'O'
                  THEN TIMESTAMP '{LOAD_TS}' ELSE o_orderdate END AS updated_time
      FROM orders)""")
def ag03(spark, sf):
    """Orders as a loaded table: urgent rows inserted by this load, open rows updated."""
    load = _ts(LOAD_TS)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    o = t(spark, sf, "orders").select(
        F.when(urgent, load).otherwise(F.col("o_orderdate")).alias("created_time"),
        F.when(urgent | (F.col("o_orderstatus") == "O"), load)
        .otherwise(F.col("o_orderdate")).alias("updated_time"))
    return load_stats(o, LOAD_TS)
