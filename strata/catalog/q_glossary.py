"""Glossary terms (SC-1..SC-23) and projection/filter items (PRJ-*, FIL-*).

Each query maps a test table through a small mapping. Where a term needs input the
tables lack (padding, NULLs, text dates, bad numbers), a stand-in column is derived from
the table's own values first; the term itself always runs through ``project``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.catalog import query
from strata.catalog.common import JOB_ID, LOAD_TS, t
from strata.functions.glossary import mixed_coalesce, null_if_negative, null_safe
from strata.operators.project import (apply_filters, conform, drop_null_keys,
                                      expr_with_params, keep_castable, project,
                                      with_audit_stamp)
from strata.sources.readers import register_inputs
from strata.spec import AuditColumns, ColumnMapping as M


def _padded_customer(spark, sf):
    c = t(spark, sf, "customer")
    return c.withColumn("padded", F.concat(F.lit("\t "), F.col("c_mktsegment"), F.lit(" \n")))


@query("sc01_direct", """
SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS retail_price,
       CAST(p_size AS VARCHAR) AS size_text, p_name AS part_name FROM part""")
def sc01(spark, sf):
    return project(t(spark, sf, "part"), [
        M("retail_price", "DECIMAL(18,2)", "p_retailprice", transformation="Direct"),
        M("size_text", "STRING", "p_size", transformation="Direct Pull"),
        M("part_name", "STRING", "p_name", transformation="direct (copy)"),
    ], keep=["p_partkey"])


@query("sc02_concatenate", """
SELECT c_custkey,
       c_name || '|' || nullif(c_mktsegment, 'MACHINERY') || '|' || CAST(c_nationkey AS VARCHAR)
         AS cust_label,
       c_name || CAST(c_nationkey AS VARCHAR) AS name_nation FROM customer""")
def sc02(spark, sf):
    c = t(spark, sf, "customer").withColumn(
        "segment", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")))
    return project(c, [
        M("cust_label", "STRING",
          transformation='Concatenate(c_name, "|", segment, "|", c_nationkey)'),
        M("name_nation", "STRING", transformation="Concatenate(c_name, c_nationkey)"),
    ], keep=["c_custkey"])


@query("sc03_uppercase", "SELECT p_partkey, upper(p_name) AS name_upper FROM part")
def sc03(spark, sf):
    return project(t(spark, sf, "part"), [M("name_upper", "STRING", "p_name",
                                            transformation="Uppercase")], keep=["p_partkey"])


@query("sc04_lowercase", "SELECT p_partkey, lower(p_brand) AS brand_lower FROM part")
def sc04(spark, sf):
    return project(t(spark, sf, "part"), [M("brand_lower", "STRING", "p_brand",
                                            transformation="lowercase")], keep=["p_partkey"])


@query("sc05_titlecase", """
SELECT p_partkey,
       array_to_string(list_transform(string_split(lower(p_name), ' '),
                                      lambda w: upper(w[1:1]) || w[2:]), ' ') AS name_title,
       array_to_string(list_transform(string_split(lower(p_type), ' '),
                                      lambda w: upper(w[1:1]) || w[2:]), ' ') AS type_title
FROM part""")
def sc05(spark, sf):
    return project(t(spark, sf, "part"), [
        M("name_title", "STRING", "p_name", transformation="titlecase"),
        M("type_title", "STRING", "p_type", transformation="TitleCase"),
    ], keep=["p_partkey"])


@query("sc06_substring", """
SELECT c_custkey, substring(c_name, 2, 4) AS name_part,
       substring(c_mktsegment, 1, 3) AS seg3 FROM customer""")
def sc06(spark, sf):
    return project(t(spark, sf, "customer"), [
        M("name_part", "STRING", "c_name", transformation="Substring(2, 4)"),
        M("seg3", "STRING", "c_mktsegment", transformation="Substring(1,3) (first three)"),
    ], keep=["c_custkey"])


@query("sc07_substring_col", """
SELECT c_custkey, c_mktsegment || '-' || CAST(c_custkey AS VARCHAR) AS cust_code,
       substring(c_mktsegment || '-' || CAST(c_custkey AS VARCHAR), 1, 3) AS cust_prefix,
       substring(c_name, 10, 9) AS name_digits FROM customer""")
def sc07(spark, sf):
    return project(t(spark, sf, "customer"), [
        M("cust_code", "STRING", transformation='Concatenate(c_mktsegment, "-", c_custkey)'),
        M("cust_prefix", "STRING", transformation='Substring_col("cust_code", 1, 3)'),
        M("name_digits", "STRING", transformation="Substring_col(c_name, 10, 9)"),
    ], keep=["c_custkey"])


@query("sc08_replace", """
SELECT p_partkey, replace(p_brand, '#', 'No.') AS brand_no,
       replace(CAST(p_retailprice AS VARCHAR), '.', ',') AS price_comma FROM part""")
def sc08(spark, sf):
    p = t(spark, sf, "part").withColumn("price_text", F.col("p_retailprice").cast("string"))
    return project(p, [
        M("brand_no", "STRING", "p_brand", transformation='replace("#", "No.")'),
        M("price_comma", "STRING", "price_text", transformation='replace(".", ",")'),
    ], keep=["p_partkey"])


@query("sc09_trim", """
SELECT c_custkey, regexp_replace(E'\\t ' || c_mktsegment || E' \\n', '^\\s+|\\s+$', '', 'g')
       AS segment_trimmed FROM customer""")
def sc09(spark, sf):
    return project(_padded_customer(spark, sf), [
        M("segment_trimmed", "STRING", "padded", transformation="Trim")], keep=["c_custkey"])


@query("sc10_trimsymbols", """
SELECT s_suppkey, regexp_replace(s_name, '[^\\p{L}\\p{N}]', '', 'g') AS name_clean,
       regexp_replace(CAST(s_acctbal AS VARCHAR), '[^\\p{L}\\p{N}]', '', 'g') AS bal_digits
FROM supplier""")
def sc10(spark, sf):
    s = t(spark, sf, "supplier").withColumn("bal_text", F.col("s_acctbal").cast("string"))
    return project(s, [
        M("name_clean", "STRING", transformation='trimsymbols("s_name")'),
        M("bal_digits", "STRING", "bal_text", transformation="trimsymbols"),
    ], keep=["s_suppkey"])


@query("sc11_trimtrailingzeros", """
SELECT s_suppkey, regexp_replace(s_name, '0+$', '') AS name_rtrim,
       regexp_replace(CAST(s_suppkey AS VARCHAR), '0+$', '') AS key_rtrim FROM supplier""")
def sc11(spark, sf):
    s = t(spark, sf, "supplier").withColumn("key_text", F.col("s_suppkey").cast("string"))
    return project(s, [
        M("name_rtrim", "STRING", transformation='trimtrailingzeros("s_name")'),
        M("key_rtrim", "STRING", transformation="trimtrailingzeros(key_text)"),
    ], keep=["s_suppkey"])


@query("sc12_trimleadingzeros", """
SELECT s_suppkey, substring(s_name, 10, 9) AS code,
       regexp_replace(substring(s_name, 10, 9), '^0+', '') AS code_num FROM supplier""")
def sc12(spark, sf):
    return project(t(spark, sf, "supplier"), [
        M("code", "STRING", transformation='Substring_col("s_name", 10, 9)'),
        M("code_num", "STRING", transformation='trimleadingzeros("code")'),
    ], keep=["s_suppkey"])


@query("sc13_dateformatting", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day,
       strftime(o_orderdate, '%d/%m/%Y') AS order_day_eu FROM orders""")
def sc13(spark, sf):
    return project(t(spark, sf, "orders"), [
        M("order_day", "STRING", "o_orderdate", transformation='DateFormatting("yyyy-mm-dd")'),
        M("order_day_eu", "STRING", "o_orderdate", transformation='DateFormatting("dd/mm/yyyy")'),
    ], keep=["o_orderkey"])


# Two-digit years parse as 2000-2099 (Spark's rule), hence '20' || text in the oracle.
@query("sc14_datecalculation", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       CAST(l_shipdate AS DATE) - 20 AS ship_minus_20,
       CAST(l_shipdate AS DATE) + 30 AS ship_plus_30,
       CAST(try_strptime('20' || CASE WHEN l_returnflag = 'R' THEN 'bad'
                                      ELSE strftime(l_shipdate, '%y%m%d') END,
                         '%Y%m%d') AS DATE) - 20 AS text_minus_20
FROM lineitem""")
def sc14(spark, sf):
    li = t(spark, sf, "lineitem").withColumn(
        "ship_text", F.when(F.col("l_returnflag") == "R", F.lit("bad"))
        .otherwise(F.date_format("l_shipdate", "yyMMdd")))
    return project(li, [
        M("ship_minus_20", "DATE", "l_shipdate", transformation="DateCalculation(-20)"),
        M("ship_plus_30", "DATE", "l_shipdate", transformation="DateCalculation(30)"),
        M("text_minus_20", "DATE", "ship_text", "STRING", transformation="DateCalculation(-20)",
          source_format="yyMMdd"),
    ], keep=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])


@query("sc15_dateextraction", """
SELECT o_orderkey, strftime(o_orderdate, '%Y') AS order_year,
       strftime(o_orderdate, '%m') AS order_month FROM orders""")
def sc15(spark, sf):
    return project(t(spark, sf, "orders"), [
        M("order_year", "STRING", transformation='DateExtraction("o_orderdate", "yyyy")'),
        M("order_month", "STRING", transformation='DateExtraction("o_orderdate", "MM")'),
    ], keep=["o_orderkey"])


@query("sc16_numericcalculation", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       l_extendedprice * (1 - l_discount) AS net_price,
       TRY_CAST(CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END
                AS DOUBLE) * 2 AS double_qty
FROM lineitem""")
def sc16(spark, sf):
    li = t(spark, sf, "lineitem").withColumn(
        "qty_text", F.when(F.col("l_returnflag") == "N", F.lit("n/a"))
        .otherwise(F.col("l_quantity").cast("string")))
    return project(li, [
        M("net_price", "DOUBLE",
          transformation="NumericCalculation(l_extendedprice * (1 - l_discount))"),
        M("double_qty", "DOUBLE", transformation="NumericCalculation(qty_text * 2)"),
    ], keep=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])


@query("sc17_conditional", """
SELECT o_orderkey,
       CASE WHEN o_totalprice > 200000 THEN 'HIGH' ELSE 'LOW' END AS price_band,
       CASE WHEN TRY_CAST(CASE o_orderstatus WHEN 'F' THEN '1,234' WHEN 'P' THEN 'abc'
                               ELSE CAST(round(o_totalprice / 250) AS VARCHAR) END AS DOUBLE)
                 > 1000 THEN 'US' ELSE 'IND' END AS currency,
       CASE WHEN o_orderstatus = 'F' THEN 'here' ELSE 'there' END AS place,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN 'odd' ELSE 'plain' END AS mark
FROM orders""")
def sc17(spark, sf):
    """Conditions over numbers, text numbers, and texts that hold backslashes and quotes."""
    o = t(spark, sf, "orders").withColumn("folder", F.concat(F.lit("C:\\temp\\"), "o_orderstatus")).withColumn(
        "note", F.when(F.col("o_orderstatus") == "F", "it's \\'x'").when(F.col("o_orderstatus") == "O", 'a "b" \\').otherwise("it"),
    ).withColumn(
        "amount_text", F.when(F.col("o_orderstatus") == "F", F.lit("1,234"))
        .when(F.col("o_orderstatus") == "P", F.lit("abc"))
        .otherwise(F.round(F.col("o_totalprice") / 250).cast("string")))
    return project(o, [
        M("price_band", "STRING",
          transformation='Conditional("o_totalprice > 200000", "HIGH", "LOW")'),
        M("currency", "STRING", transformation='Conditional("amount_text > 1000", "US", "IND")'),
        M("place", "STRING", transformation="Conditional(\"folder = 'C:\\temp\\F'\", \"here\", \"there\")"),
        M("mark", "STRING", transformation=(
            "Conditional('note = \"it''s \\''x''\" or note = \"a \"\"b\"\" \\\"', \"odd\", \"plain\")")),
    ], keep=["o_orderkey"])


@query("sc18_casewhen", """
SELECT p_partkey,
       CASE WHEN p_size > 40 THEN 'XL' WHEN p_size > 20 THEN 'L' WHEN p_size > 10 THEN 'M'
            ELSE 'S' END AS size_band,
       CASE WHEN p_type = 'SMALL' THEN 'small' END AS small_flag,
       CASE WHEN p_size > 40 THEN 'root' WHEN p_size > 20 THEN 'quoted' ELSE 'none' END AS path_kind
FROM part""")
def sc18(spark, sf):
    p = t(spark, sf, "part").withColumn("path", F.when(F.col("p_size") > 40, "\\\\srv\\n").when(F.col("p_size") > 20, "o'neil\\").otherwise("x"))
    return project(p, [
        M("size_band", "STRING", transformation=(
            'CaseWhen("p_size > 40", "XL", "p_size > 20", "L", "p_size > 10", "M", "S")')),
        M("small_flag", "STRING", transformation="CaseWhen(\"p_type = 'SMALL'\", \"small\")"),
        M("path_kind", "STRING", transformation=(
            "CaseWhen(\"path = '\\\\srv\\n'\", \"root\", \"path = 'o''neil\\'\", \"quoted\", \"none\")")),
    ], keep=["p_partkey"])


@query("sc19_nullhandling", """
SELECT c_custkey,
       COALESCE(nullif(c_mktsegment, 'BUILDING'), nullif(c_name, c_name), 'NONE') AS segment,
       COALESCE(nullif(c_mktsegment, 'BUILDING'), 'PL') AS company_code
FROM customer""")
def sc19(spark, sf):
    c = t(spark, sf, "customer").withColumns({
        "seg_a": F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")),
        "seg_b": F.lit(None).cast("string")})
    return project(c, [
        M("segment", "STRING", transformation='NullHandling("seg_a", "seg_b", "NONE")'),
        M("company_code", "STRING", transformation='NullHandling(seg_a, "PL")'),
    ], keep=["c_custkey"])


@query("sc20_default", """
SELECT n_nationkey, CAST(420 AS INTEGER) AS system_id, 'PL' AS company,
       'Y' AS active_flag, CAST(2.50 AS DECIMAL(18,2)) AS rate FROM nation""")
def sc20(spark, sf):
    return project(t(spark, sf, "nation"), [
        M("system_id", "INT", transformation="Default Value: 420 (Uses the hardcoded value 420)"),
        M("company", "STRING", transformation="Default Value: 'PL'"),
        M("active_flag", "STRING", transformation="Default", default="Y"),
        M("rate", "DECIMAL(18,2)", transformation="Default Value: 2.50"),
    ], keep=["n_nationkey"])


def _orders_with_audit(spark, sf, audit: AuditColumns):
    """Orders with six audit columns derived from the row (stand-in bronze)."""
    o = t(spark, sf, "orders")
    return o.withColumns({
        audit.system_id: F.lit(7), audit.reporting_unit_id: F.col("o_custkey").cast("int"),
        audit.created_time: F.col("o_orderdate"),
        audit.created_by: F.concat(F.lit("loader-"), F.col("o_orderstatus")),
        audit.updated_time: F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"),
        audit.updated_by: F.lit("loader")})


_AUDIT_SQL = """CAST(o_custkey AS INTEGER) AS reporting_unit_id, CAST(7 AS INTEGER) AS system_id,
       o_orderdate AS created_time,
       'loader-' || o_orderstatus AS created_by, o_orderdate + INTERVAL 1 DAY AS updated_time,
       'loader' AS updated_by"""


@query("sc21_etl_audit_column", f"""
SELECT o_orderkey, o_orderstatus AS status,
       CAST(o_custkey AS INTEGER) AS reporting_unit_id, CAST(7 AS INTEGER) AS system_id,
       CAST(o_orderdate AS TIMESTAMP) AS created_time, 'loader-' || o_orderstatus AS created_by,
       CAST(o_orderdate + INTERVAL 1 DAY AS TIMESTAMP) AS updated_time, 'loader' AS updated_by
FROM orders""")
def sc21(spark, sf):
    a = AuditColumns()
    types = a.types()
    maps = [M("status", "STRING", "o_orderstatus")]
    maps += [M(c, "TIMESTAMP_NTZ" if types[c] == "timestamp" else types[c], c,
               transformation="ETL Audit Column") for c in a.all()]
    return project(_orders_with_audit(spark, sf, a), maps, keep=["o_orderkey"])


@query("sc22_multistep", """
SELECT c_custkey,
       substring(upper(regexp_replace(E'\\t ' || c_mktsegment || E' \\n', '^\\s+|\\s+$', '', 'g')),
                 1, 5) AS seg5,
       regexp_replace(lower(substring(c_name, 10, 9)), '^0+', '') AS name_num
FROM customer""")
def sc22(spark, sf):
    return project(_padded_customer(spark, sf), [
        M("seg5", "STRING", "padded", transformation="Trim; Uppercase; Substring(1, 5)"),
        M("name_num", "STRING", "c_name",
          transformation="Substring(10, 9); lowercase; trimleadingzeros"),
    ], keep=["c_custkey"])


@query("sc23_mixed_coalesce", """
SELECT o_orderkey,
       COALESCE(CAST(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END
                     AS DECIMAL(18,2)),
                TRY_CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 'abc'
                              ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END
                         AS DECIMAL(18,2))) AS quantity
FROM orders""")
def sc23(spark, sf):
    o = t(spark, sf, "orders").withColumns({
        "value_number": F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")),
        "value_text": F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("abc"))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))})
    return o.select("o_orderkey", mixed_coalesce(F.col("value_number"), F.col("value_text"),
                                                 "decimal(18,2)").alias("quantity"))


# ---- projection items -------------------------------------------------------------

ORDER_MAPPING = (
    M("order_id", "BIGINT", "o_orderkey"),
    M("customer_id", "STRING", "o_custkey", transformation="Direct"),
    M("status", "STRING", "o_orderstatus", transformation="lowercase"),
    M("order_year", "INT", transformation='DateExtraction("o_orderdate", "yyyy")'),
    M("total", "DECIMAL(18,2)", "o_totalprice"),
)


@query("prj01_project", """
SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       lower(o_orderstatus) AS status, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS order_year,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders""")
def prj01(spark, sf):
    return project(t(spark, sf, "orders"), ORDER_MAPPING)


@query("prj02_rename_cast", """
SELECT c_custkey, c_name AS customer_name, CAST(c_nationkey AS BIGINT) AS nation_id,
       CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer""")
def prj02(spark, sf):
    return project(t(spark, sf, "customer"), [
        M("c_custkey", "BIGINT", "c_custkey"),
        M("customer_name", "STRING", "c_name"),
        M("nation_id", "BIGINT", "c_nationkey"),
        M("balance", "DECIMAL(18,2)", "c_acctbal"),
    ])


@query("prj03_dependency_order", """
SELECT p_partkey, upper(p_brand) AS brand,
       upper(p_brand) || '|' || p_type || '|' || CAST(p_size AS VARCHAR) AS part_code,
       substring(upper(p_brand) || '|' || p_type || '|' || CAST(p_size AS VARCHAR), 1, 8)
         AS part_code_short,
       lower(substring(upper(p_brand) || '|' || p_type || '|' || CAST(p_size AS VARCHAR), 1, 8))
         AS part_code_lower
FROM part""")
def prj03(spark, sf):
    # Declared out of order on purpose: each column reads the one listed after it.
    return project(t(spark, sf, "part"), [
        M("part_code_lower", "STRING", transformation='Substring_col("part_code_short", 1, 50); lowercase'),
        M("part_code_short", "STRING", transformation='Substring_col(part_code, 1, 8)'),
        M("part_code", "STRING", transformation='Concatenate(brand, "|", p_type, "|", p_size)'),
        M("brand", "STRING", "p_brand", transformation="uppercase"),
    ], keep=["p_partkey"])


@query("prj04_blank_is_direct", """
SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS nation, s_acctbal FROM supplier""")
def prj04(spark, sf):
    return project(t(spark, sf, "supplier"), [
        M("s_suppkey", "BIGINT", "s_suppkey", transformation=""),
        M("s_name", "STRING", "s_name", transformation="   "),
        M("nation", "STRING", "s_nationkey", transformation=None),
        M("s_acctbal", "DOUBLE", "s_acctbal"),
    ])


@query("prj05_audit_passthrough", f"""
SELECT o_orderkey AS order_id, lower(o_orderstatus) AS status, {_AUDIT_SQL} FROM orders""")
def prj05(spark, sf):
    a = AuditColumns()
    return project(_orders_with_audit(spark, sf, a), [
        M("order_id", "BIGINT", "o_orderkey"),
        M("status", "STRING", "o_orderstatus", transformation="lowercase"),
    ], keep=list(a.all()))


@query("prj06_audit_stamp", f"""
SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       lower(o_orderstatus) AS status, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS order_year,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total,
       TIMESTAMP '{LOAD_TS}' AS updated_time, '{JOB_ID}' AS updated_by,
       TIMESTAMP '{LOAD_TS}' AS created_time, '{JOB_ID}' AS created_by,
       CAST(420 AS INTEGER) AS system_id, CAST(1 AS INTEGER) AS reporting_unit_id
FROM orders""")
def prj06(spark, sf):
    return with_audit_stamp(project(t(spark, sf, "orders"), ORDER_MAPPING), LOAD_TS, JOB_ID,
                            system_id=420, reporting_unit_id=1)


@query("prj07_conform", """
SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderkey AS order_id,
       CAST(o_custkey AS INTEGER) AS customer_id, o_orderpriority AS priority FROM orders""")
def prj07(spark, sf):
    o = t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ORDER_ID"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"),
        "o_orderstatus")
    return conform(o, [("total", "DECIMAL(18,2)"), ("order_id", "BIGINT"),
                       ("customer_id", "INT"), ("priority", "STRING")])


@query("prj08_params", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_totalprice > 250000.0""")
def prj08(spark, sf):
    views = register_inputs(spark, {"orders_prj08": t(spark, sf, "orders")})
    return expr_with_params(
        spark, f"SELECT o_orderkey, o_custkey, o_totalprice FROM {views['orders_prj08']} "
               "WHERE o_orderstatus = :status AND o_totalprice > :min_price",
        {"status": "O", "min_price": 250000.0})


# ---- filters ----------------------------------------------------------------------

@query("fil01_source_filters", """
SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM orders o JOIN customer c
  ON o.o_custkey = c.c_custkey
WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND c.c_mktsegment <> 'BUILDING'""")
def fil01(spark, sf):
    o = apply_filters(t(spark, sf, "orders"), ["o_orderpriority IN ('1-URGENT', '2-HIGH')", ""])
    c = apply_filters(t(spark, sf, "customer"), ["c_mktsegment <> 'BUILDING'"])
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select("o_orderkey", "o_totalprice", "c_name")


@query("fil02_drop_null_keys", """
SELECT c_custkey, c_name, nation_key FROM (
  SELECT c_custkey, c_name, nullif(c_nationkey, 3) AS nation_key FROM customer)
WHERE nation_key IS NOT NULL""")
def fil02(spark, sf):
    c = t(spark, sf, "customer").select(
        "c_custkey", "c_name", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation_key"))
    return drop_null_keys(c, ["nation_key"])


@query("fil03_keep_castable", """
SELECT o_orderkey, amount_text FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'abc'
                          ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount_text
  FROM orders)
WHERE TRY_CAST(amount_text AS DECIMAL(18,2)) IS NOT NULL""")
def fil03(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") == "P", F.lit("abc"))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount_text"))
    return keep_castable(o, "amount_text", "decimal(18,2)")


@query("fil04_null_if_negative", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer""")
def fil04(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", null_if_negative(F.col("c_acctbal")).alias("balance"))


@query("fil05_null_safe", """
SELECT c_custkey,
       COALESCE(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0) + 100 AS balance_plus,
       CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END AS ratio
FROM customer""")
def fil05(spark, sf):
    c = t(spark, sf, "customer")
    return c.select(
        "c_custkey",
        (null_safe(null_if_negative(F.col("c_acctbal")), 0) + 100).alias("balance_plus"),
        F.try_divide(F.col("c_acctbal"), F.col("c_nationkey")).alias("ratio"))
