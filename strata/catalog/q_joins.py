"""Joins (JN-*), scans (SRC-*) and dedupe windows (WN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.catalog import query
from strata.catalog.common import latest_lineitem_sql, t
from strata.operators.dedupe import dedupe_bronze, dedupe_for, latest_by_key, yoy
from strata.operators.joins import (coalesce_sources, declared_join, drop_stale, enrich, hierarchy,
                                    orphans)
from strata.session import scratch_path
from strata.sources.readers import (load_mapping_sheets, read_job_slice, read_layer,
                                    read_target, read_target_slice, register_inputs)
from strata.spec import LoadSpec, Lookup

# ---- joins ------------------------------------------------------------------------


@query("jn01_declared_join", """
SELECT o.o_orderkey, o.o_totalprice, c.c_custkey, c.c_name, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def jn01(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice",
                                      F.col("o_custkey").alias("c_custkey"))
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return declared_join(o, c, "c_custkey")  # no join type declared -> INNER


@query("jn02_enrich", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity,
       o.o_orderstatus, p.p_brand, s.s_name, n.n_name
FROM lineitem l
LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN part p ON p.p_partkey = l.l_partkey
LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def jn02(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                         "l_suppkey", "l_shipdate", "l_quantity")
    orders = t(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    part = t(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    supp = t(spark, sf, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    nation = t(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    out = enrich(li, [
        Lookup(orders, "l_orderkey", ["o_orderstatus"], name="orders"),
        Lookup(part, "l_partkey", ["p_brand"], name="part"),
        Lookup(supp, "l_suppkey", ["s_name", "s_nationkey"], name="supplier"),
        Lookup(nation, "s_nationkey", ["n_name"], name="nation"),
    ])
    return out.drop("s_nationkey")


STALE_SQL = """
WITH tgt AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
     newest AS (SELECT user_id, event_type, max(ts) AS tts FROM tgt GROUP BY ALL)
SELECT e.* FROM events e LEFT JOIN newest n
  ON e.user_id = n.user_id AND e.event_type = n.event_type
WHERE e.ts > COALESCE(n.tts, TIMESTAMP '1970-01-01 00:00:00')"""


@query("jn03_drop_stale", STALE_SQL)
def jn03(spark, sf):
    ev = t(spark, sf, "events")
    target = ev.where(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    return drop_stale(ev, target, ["user_id", "event_type"], "ts")


@query("jn04_coalesce_sources", """
SELECT o_orderkey,
       COALESCE(nullif(o_orderpriority, '5-LOW'), nullif(o_orderstatus, 'F'), 'NONE') AS priority,
       COALESCE(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END,
                CAST(o_custkey AS DOUBLE)) AS amount
FROM orders""")
def jn04(spark, sf):
    o = t(spark, sf, "orders").withColumns({
        "prio_a": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")),
        "prio_b": F.nullif(F.col("o_orderstatus"), F.lit("F")),
        "amount_a": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))})
    return o.select(
        "o_orderkey",
        coalesce_sources(["prio_a", "prio_b", F.lit("NONE")], "string").alias("priority"),
        coalesce_sources(["amount_a", "o_custkey"], "double").alias("amount"))


@query("jn05_orphans", """
SELECT o.* FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment <> 'BUILDING')""")
def jn05(spark, sf):
    parent = t(spark, sf, "customer").where(F.col("c_mktsegment") != "BUILDING")
    return orphans(t(spark, sf, "orders"), parent, "o_custkey", "c_custkey")


# ---- scans ------------------------------------------------------------------------


@query("src01_read_layer", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2000-01-01 00:00:00'""")
def src01(spark, sf):
    li = read_layer(spark, sf, None, "lineitem")
    return li.where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) \
             .select("l_orderkey", "l_linenumber", "l_quantity")


@query("src02_job_slice", """
SELECT * FROM events WHERE trim(CAST(user_id AS VARCHAR)) = '42'""")
def src02(spark, sf):
    return read_job_slice(t(spark, sf, "events"), "user_id", " 42 ")


@query("src03_register_inputs", """
SELECT c.c_mktsegment, count(*) AS n_orders,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""")
def src03(spark, sf):
    v = register_inputs(spark, {"src03_orders": t(spark, sf, "orders"),
                                "src03_customer": t(spark, sf, "customer")})
    return spark.sql(f"""
        SELECT c.c_mktsegment, count(*) AS n_orders,
               CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
        FROM {v['src03_orders']} o JOIN {v['src03_customer']} c ON o.o_custkey = c.c_custkey
        GROUP BY c.c_mktsegment""")


@query("src04_read_target", "SELECT * FROM orders")
def src04(spark, sf):
    orders = t(spark, sf, "orders")
    path = scratch_path(spark, "src04")
    absent = read_target(spark, path, orders.schema)  # no table yet: empty, typed
    orders.write.parquet(path)
    present = read_target(spark, path, orders.schema)
    return absent.unionByName(present)


@query("src05_read_target_slice", """
SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def src05(spark, sf):
    return read_target_slice(t(spark, sf, "orders"),
                             {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


SHEET_SQL = """
WITH sheet AS (
  SELECT CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_name || '_' || CAST(p_partkey AS VARCHAR) END
           AS "Target Column",
         CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END AS "Source Table",
         CASE WHEN p_type IN ('PROMO', 'SMALL') THEN NULL
              WHEN p_size > 25 THEN 'Uppercase' ELSE 'Direct' END AS "Transformation"
  FROM part)
SELECT * FROM sheet
WHERE "Target Column" IS NOT NULL OR "Source Table" IS NOT NULL OR "Transformation" IS NOT NULL"""


PARTS_TREE_SQL = """
WITH RECURSIVE n AS (
  SELECT p_partkey AS node, CASE WHEN p_partkey % 97 < 4 THEN p_partkey + 1 WHEN p_partkey % 97 = 4 THEN p_partkey - 4
                                 WHEN p_partkey > 3 THEN p_partkey // 3 END AS parent
  FROM part WHERE p_partkey % 41 <> 7),
w AS (SELECT node, node AS spot, 0 AS depth, [node] AS path FROM n
      UNION ALL SELECT w.node, n.parent, depth + 1, list_append(path, n.parent) FROM w JOIN n ON n.node = w.spot
      WHERE n.parent IS NOT NULL AND NOT list_contains(path, n.parent)),
e AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth DESC) = 1),
x AS (SELECT e.*, n.node IS NULL AS missing, n.parent, list_position(path, n.parent) AS back FROM e LEFT JOIN n ON n.node = e.spot)
SELECT node, CASE WHEN missing THEN 'broken' WHEN parent IS NULL THEN 'ok' WHEN back = 1 THEN 'cycle' ELSE 'into_cycle' END AS status,
       CASE WHEN missing OR parent IS NULL THEN spot ELSE list_min(path[back:]) END AS root,
       CASE WHEN missing OR parent IS NULL THEN CAST(depth AS BIGINT) END AS depth
FROM x"""


@query("jn05_hierarchy", PARTS_TREE_SQL)
def jn05_hierarchy(spark, sf):
    """Parts as a tree (a third of a part's key is its parent's) with rings of five parts,
    chains that run into them, and parents that are missing."""
    k = F.col("p_partkey")
    up = F.when(k % 97 < 4, k + 1).when(k % 97 == 4, k - 4).when(k > 3, F.floor(k / 3)).cast("bigint")
    tree = t(spark, sf, "part").where(k % 41 != 7).select(k.cast("bigint").alias("node"), up.alias("parent"))
    return hierarchy(tree, "node", "parent")


@query("src06_load_mapping_sheets", SHEET_SQL)
def src06(spark, sf):
    """Mapping sheet rows derived from ``part`` are written as CSV (with an all-blank
    column and all-blank rows) and loaded back through ``load_mapping_sheets``."""
    p = t(spark, sf, "part")
    promo = F.col("p_type") == "PROMO"
    sheet = p.select(
        F.when(~promo, F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string")))
        .alias("Target Column"),
        F.when(~promo, F.col("p_brand")).alias("Source Table"),
        F.lit(None).cast("string").alias("Notes"),
        F.when(F.col("p_type").isin("PROMO", "SMALL"), F.lit(None))
        .when(F.col("p_size") > 25, F.lit("Uppercase")).otherwise(F.lit("Direct"))
        .alias("Transformation"))
    path = scratch_path(spark, "src06")
    sheet.write.option("header", "true").csv(path)
    return load_mapping_sheets(spark, path)


# ---- windows ----------------------------------------------------------------------


@query("wn01_latest_by_key", latest_lineitem_sql())
def wn01(spark, sf):
    return latest_by_key(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                         ["l_shipdate desc"])


@query("wn02_dedupe_bronze", f"""
SELECT * FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_partkey, l_suppkey
  ORDER BY l_shipdate DESC NULLS LAST, l_quantity ASC NULLS FIRST,
           l_orderkey ASC NULLS FIRST, l_linenumber ASC NULLS FIRST,
           l_extendedprice ASC NULLS FIRST, l_discount ASC NULLS FIRST, l_tax ASC NULLS FIRST,
           l_returnflag ASC NULLS FIRST, l_linestatus ASC NULLS FIRST) = 1""")
def wn02(spark, sf):
    spec = LoadSpec.from_metadata("parts_latest", {
        "source_deduplication": "Y", "source_partitionBy_columns": "l_partkey, l_suppkey",
        "source_orderBy_columns": "l_shipdate desc, l_quantity asc"})
    return dedupe_bronze(t(spark, sf, "lineitem"), spec.source_partition_by,
                         spec.source_order_by)


@query("wn03_dedupe_for", """
SELECT * FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_partkey ASC NULLS FIRST,
  l_suppkey ASC NULLS FIRST, l_linenumber ASC NULLS FIRST, l_quantity ASC NULLS FIRST,
  l_extendedprice ASC NULLS FIRST, l_discount ASC NULLS FIRST, l_tax ASC NULLS FIRST,
  l_returnflag ASC NULLS FIRST, l_linestatus ASC NULLS FIRST) = 1""")
def wn03(spark, sf):
    spec = LoadSpec.from_metadata("orders_latest", {
        "merge_key": "l_orderkey", "source_deduplication": "N"}, order_by="l_shipdate desc")
    return dedupe_for(spec, t(spark, sf, "lineitem"))


@query("wn04_yoy", """
WITH per_year AS (
  SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total
  FROM lineitem GROUP BY ALL),
w AS (SELECT *, lag(ship_year) OVER (PARTITION BY l_returnflag ORDER BY ship_year) AS py,
             lag(total) OVER (PARTITION BY l_returnflag ORDER BY ship_year) AS pt FROM per_year)
SELECT l_returnflag, ship_year, CAST(total AS DECIMAL(38,2)) AS total,
       CAST(CASE WHEN py = ship_year - 1 THEN total - pt END AS DECIMAL(38,2)) AS yoy_change,
       CASE WHEN py = ship_year - 1 THEN CAST(total - pt AS DOUBLE) / CAST(pt AS DOUBLE) * 100
       END AS yoy_change_pct
FROM w""")
def wn04(spark, sf):
    li = t(spark, sf, "lineitem").select(
        "l_returnflag", F.year("l_shipdate").alias("ship_year"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    out = yoy(li, ["l_returnflag"], "ship_year", "amount")
    return out.select("l_returnflag", "ship_year",
                      F.col("total").cast("decimal(38,2)").alias("total"),
                      F.col("yoy_change").cast("decimal(38,2)").alias("yoy_change"),
                      "yoy_change_pct")
