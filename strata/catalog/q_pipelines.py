"""End-to-end loads (PL-1..PL-4) and the audit trail (AU-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.catalog import query
from strata.catalog.common import JOB_ID, LOAD_TS, t
from strata.catalog.q_emissions import (ACTIVITY_SQL, DEFAULTS_SQL, FACTORS_SQL, SCOPE_RULES,
                                        SCOPES_SQL, UNITS_SQL, activity, defaults, factors)
from strata.operators.emissions import unit_table
from strata.operators.project import with_audit_stamp
from strata.operators.quality import rule_negative
from strata.plans.audit import read_audit
from strata.plans.documents import load_document
from strata.plans.emissions import EmissionsJob, run_emissions
from strata.plans.gold import GoldJob, run_gold
from strata.plans.silver import SilverJob, run_silver
from strata.plans.steps import plan_shapes, run_steps
from strata.session import scratch_path
from strata.sources import versions
from strata.sources.readers import register_inputs
from strata.spec import ColumnMapping as M
from strata.spec import LoadSpec

FIRST_LOAD_TS = "2024-01-16 00:00:00"
SPLIT = "2024-01-16 00:00:00"
LATE_TS = "2024-07-01 00:00:00"

EVENT_MAPPING = (
    M("user_id", "BIGINT", "user_id"),
    M("event_type", "STRING", "event_type"),
    M("ts", "TIMESTAMP_NTZ", "ts"),
    M("amount", "DECIMAL(18,2)", "value", transformation="Direct"),
    M("kind", "STRING", transformation='Conditional("value > 50", "HIGH", "LOW")'),
)
EVENT_LOAD = LoadSpec.from_metadata("user_events", {
    "merge_key": "user_id, event_type", "merge_type": "upsert",
    "source_deduplication": "Y", "source_partitionBy_columns": "user_id, event_type",
    "source_orderBy_columns": "ts desc", "stale_data_handling": "Y",
    "target_join_columns": "user_id, event_type", "target_audit_columns": "ts"})


def _two_loads(spark, sf):
    """First load: events before the split; second load: all events (stale rows of the
    second batch are dropped, newer ones upserted)."""
    ev = t(spark, sf, "events")
    path, audit = scratch_path(spark, "pl01_target"), scratch_path(spark, "pl01_audit")
    rules = [rule_negative("amount", "negative_amount")]
    first = SilverJob(EVENT_LOAD, EVENT_MAPPING, path, FIRST_LOAD_TS, JOB_ID, rules, audit)
    run_silver(spark, ev.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")), first)
    second = SilverJob(EVENT_LOAD, EVENT_MAPPING, path, LOAD_TS, JOB_ID, rules, audit)
    result = run_silver(spark, ev, second)
    return result, audit


LATEST_EVENTS = """latest AS (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY ts DESC NULLS LAST, event_id ASC NULLS FIRST, value ASC NULLS FIRST,
             props ASC NULLS FIRST) = 1)"""


@query("pl01_run_silver", f"""WITH {LATEST_EVENTS}
SELECT user_id, event_type, ts, CAST(value AS DECIMAL(18,2)) AS amount,
       CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS kind,
       CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = latest.user_id
                         AND e.event_type = latest.event_type AND e.ts < TIMESTAMP '{SPLIT}')
            THEN TIMESTAMP '{FIRST_LOAD_TS}' ELSE TIMESTAMP '{LOAD_TS}' END AS created_time,
       '{JOB_ID}' AS created_by,
       CASE WHEN ts >= TIMESTAMP '{SPLIT}' THEN TIMESTAMP '{LOAD_TS}'
            ELSE TIMESTAMP '{FIRST_LOAD_TS}' END AS updated_time,
       '{JOB_ID}' AS updated_by
FROM latest""")
def pl01(spark, sf):
    """Silver load of events keyed by (user, event type): bronze dedupe, mapping, stale
    filter against the target, quality quarantine, upsert, twice."""
    result, _ = _two_loads(spark, sf)
    return result.table


@query("pl01_load_stats", f"""
WITH k AS (SELECT user_id, event_type, min(ts) < TIMESTAMP '{SPLIT}' AS old, max(ts) >= TIMESTAMP '{SPLIT}' AS new
           FROM events GROUP BY ALL)
SELECT count(*) AS row_count, count_if(NOT old) AS inserted, count_if(old AND new) AS updated,
       count_if(NOT new) AS unchanged FROM k""")
def pl01_stats(spark, sf):
    """What the second load did: keys it inserted, updated and left as they were."""
    result, _ = _two_loads(spark, sf)
    return result.stats


SINGLE_LOAD = LoadSpec.from_metadata("user_latest", {"merge_key": "user_id", "merge_type": "upsert"},
                                     order_by="ts desc, event_id")
SINGLE_MAPPING = (M("user_id", "BIGINT", "user_id"), M("last_ts", "TIMESTAMP_NTZ", "ts"),
                  M("last_type", "STRING", "event_type"))


@query("pl01_single_key", f"""
WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id
           ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST, event_type ASC NULLS FIRST,
                    value ASC NULLS FIRST, props ASC NULLS FIRST) = 1)
SELECT user_id, ts AS last_ts, event_type AS last_type,
       CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = l.user_id AND e.ts < TIMESTAMP '{SPLIT}')
            THEN TIMESTAMP '{FIRST_LOAD_TS}' ELSE TIMESTAMP '{LOAD_TS}' END AS created_time, 'one' AS created_by,
       TIMESTAMP '{LOAD_TS}' AS updated_time, 'one' AS updated_by FROM l""")
def pl01_single(spark, sf):
    """Upsert on one key column, twice; the second load updates every user it sees."""
    ev = t(spark, sf, "events")
    path = scratch_path(spark, "pl01_single")
    run_silver(spark, ev.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")),
               SilverJob(SINGLE_LOAD, SINGLE_MAPPING, path, FIRST_LOAD_TS, "one"))
    return run_silver(spark, ev, SilverJob(SINGLE_LOAD, SINGLE_MAPPING, path, LOAD_TS, "one")).table


APPEND_LOAD = LoadSpec.from_metadata("event_log", {"merge_type": "append", "partition_columns": "event_type"})
APPEND_MAPPING = (M("event_id", "BIGINT", "event_id"), M("event_type", "STRING", "event_type"),
                  M("amount", "DECIMAL(18,2)", "value"))


@query("pl01_append", f"""
SELECT event_id, event_type, CAST(value AS DECIMAL(18,2)) AS amount,
       l AS created_time, 'app' AS created_by, l AS updated_time, 'app' AS updated_by
FROM (SELECT *, CASE WHEN ts < TIMESTAMP '{SPLIT}' THEN TIMESTAMP '{FIRST_LOAD_TS}'
                     ELSE TIMESTAMP '{LOAD_TS}' END AS l FROM events)""")
def pl01_append(spark, sf):
    """Two appends to a partitioned table: the first one's files stay as they are."""
    ev = t(spark, sf, "events")
    path, split = scratch_path(spark, "pl01_append"), F.lit(SPLIT).cast("timestamp_ntz")
    run_silver(spark, ev.where(F.col("ts") < split),
               SilverJob(APPEND_LOAD, APPEND_MAPPING, path, FIRST_LOAD_TS, "app"))
    return run_silver(spark, ev.where(~F.coalesce(F.col("ts") < split, F.lit(False))),
                      SilverJob(APPEND_LOAD, APPEND_MAPPING, path, LOAD_TS, "app")).table


REJECT_LOAD = LoadSpec.from_metadata("part_sizes", {"merge_key": "part_id", "merge_type": "upsert"})
REJECT_MAPPING = (M("part_id", "BIGINT", "part_id"), M("size_no", "INT", "word"))


def _reject_source(spark, sf):
    """Parts with a text column that is a number only for some brands."""
    return t(spark, sf, "part").select("p_partkey", F.substring_index("p_brand", "#", -1).alias("digits"), "p_type") \
        .select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_type").startswith("S"), F.col("p_type"))
                .otherwise(F.col("digits")).alias("word"))


_REJECT_SQL = """(SELECT p_partkey, CASE WHEN p_type LIKE 'S%' THEN p_type ELSE split_part(p_brand, '#', -1) END AS word
FROM part)"""


@query("pl01_reject", f"""
SELECT CAST(p_partkey AS BIGINT) AS part_id, TRY_CAST(word AS INTEGER) AS size_no, 'table' AS went FROM {_REJECT_SQL}
WHERE word IS NULL OR TRY_CAST(word AS INTEGER) IS NOT NULL
UNION ALL SELECT CAST(p_partkey AS BIGINT), NULL, 'quarantine' FROM {_REJECT_SQL}
WHERE word IS NOT NULL AND TRY_CAST(word AS INTEGER) IS NULL""")
def pl01_reject(spark, sf):
    """Policy 'reject': values that do not cast go to the quarantine, the rest is loaded."""
    job = SilverJob(REJECT_LOAD, REJECT_MAPPING, scratch_path(spark, "pl01_reject"), LOAD_TS, "rej", policy="reject")
    got = run_silver(spark, _reject_source(spark, sf), job)
    columns = ["part_id", "size_no"]
    return got.table.select(*columns, F.lit("table").alias("went")).unionByName(
        got.quarantined.select(*columns, F.lit("quarantine").alias("went")))


STALE_LOAD = LoadSpec.from_metadata("order_state", {
    "merge_key": "order_id", "merge_type": "upsert", "source_deduplication": "Y",
    "source_partitionBy_columns": "o_orderkey", "source_orderBy_columns": "updated_time desc",
    "stale_data_handling": "Y", "target_join_columns": "order_id", "target_audit_columns": "updated_time"})
STALE_MAPPING = (M("order_id", "BIGINT", "o_orderkey"), M("price", "DECIMAL(18,2)", "o_totalprice"))


@query("pl01_stale_bronze_time", f"""
SELECT CAST(o_orderkey AS BIGINT) AS order_id,
       CAST(o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS price,
       TIMESTAMP '{FIRST_LOAD_TS}' AS created_time, 'st' AS created_by,
       o_orderdate + CASE WHEN o_orderpriority = '1-URGENT' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS updated_time,
       'st' AS updated_by FROM orders""")
def pl01_stale(spark, sf):
    """Bronze brings its own updated time and no other audit column: the second batch (urgent
    orders a day newer, the others a day older) changes the urgent ones only."""
    orders = t(spark, sf, "orders")
    first = orders.withColumn("updated_time", F.col("o_orderdate").cast("timestamp_ntz"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    second = first.withColumns({
        "updated_time": F.when(urgent, F.expr("updated_time + interval 1 day"))
        .otherwise(F.expr("updated_time - interval 1 day")),
        "o_totalprice": F.col("o_totalprice") + 1})
    path = scratch_path(spark, "pl01_stale")
    run_silver(spark, first, SilverJob(STALE_LOAD, STALE_MAPPING, path, FIRST_LOAD_TS, "st"))
    return run_silver(spark, second, SilverJob(STALE_LOAD, STALE_MAPPING, path, LOAD_TS, "st")).table


@query("au01_audit_log", f"""
SELECT 'user_events' AS table_name, '{JOB_ID}' AS job_id, status, message,
       CAST(row_count AS BIGINT) AS row_count, started_at, 'UTC' AS zone
FROM (
  SELECT 'I' AS status, 'load started' AS message, NULL AS row_count,
         TIMESTAMP '{FIRST_LOAD_TS}' AS started_at
  UNION ALL SELECT 'P', 'single_dedupe_stale batch prepared', NULL, TIMESTAMP '{FIRST_LOAD_TS}'
  UNION ALL SELECT 'S', 'single_dedupe_stale load succeeded',
         (SELECT count(DISTINCT (user_id, event_type)) FROM events
          WHERE ts < TIMESTAMP '{SPLIT}'), TIMESTAMP '{FIRST_LOAD_TS}'
  UNION ALL SELECT 'I', 'load started', NULL, TIMESTAMP '{LOAD_TS}'
  UNION ALL SELECT 'P', 'single_dedupe_stale batch prepared', NULL, TIMESTAMP '{LOAD_TS}'
  UNION ALL SELECT 'S', 'single_dedupe_stale load succeeded',
         (SELECT count(DISTINCT (user_id, event_type)) FROM events), TIMESTAMP '{LOAD_TS}'
  UNION ALL SELECT 'I', 'load started', NULL, TIMESTAMP '{LATE_TS}'
  UNION ALL SELECT 'F', 'user_events: unknown merge_type ''merge''', NULL, TIMESTAMP '{LATE_TS}')""")
def au01(spark, sf):
    """Two loads that succeed, and one that is refused: all four statuses."""
    _, audit = _two_loads(spark, sf)
    bad = SilverJob(LoadSpec("user_events", merge_key=("user_id",), merge_type="merge"), EVENT_MAPPING,
                    scratch_path(spark, "au01_refused"), LATE_TS, JOB_ID, audit_path=audit)
    try:
        run_silver(spark, t(spark, sf, "events"), bad)
    except ValueError:
        pass                                      # the log says so
    return read_audit(spark, audit)


@query("pl05_plan_shapes", """
WITH l AS (SELECT p_brand AS job, p_name AS target_table,
                  CASE WHEN p_size % 3 = 0 THEN ' y ' WHEN p_size % 3 = 1 THEN 'N' END AS dedupe,
                  CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE '' END AS stale FROM part
           UNION ALL SELECT 'solo ' || s_suppkey, 'supplier_dim', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'no' END,
                  CASE WHEN s_suppkey % 4 = 0 THEN '1' END FROM supplier),
n AS (SELECT job, count(DISTINCT target_table) AS n_targets FROM l GROUP BY job)
SELECT job, target_table, n_targets,
       CASE WHEN n_targets > 1 THEN 'multi' ELSE 'single' END
       || CASE WHEN coalesce(upper(trim(dedupe)) IN ('Y', 'TRUE'), false) THEN '_dedupe'
                    || CASE WHEN coalesce(upper(trim(stale)) IN ('Y', '1'), false) THEN '_stale' ELSE '' END
               ELSE '' END AS shape
FROM l JOIN n USING (job)""")
def pl05(spark, sf):
    """A table of load specifications: parts as the targets of their brand's job, suppliers
    as jobs of one target."""
    size, key = F.col("p_size"), F.col("s_suppkey")
    parts = t(spark, sf, "part").select(
        F.col("p_brand").alias("job"), F.col("p_name").alias("target_table"),
        F.when(size % 3 == 0, " y ").when(size % 3 == 1, "N").alias("source_deduplication"),
        F.when(size % 2 == 0, "Y").otherwise("").alias("stale_data_handling"))
    solo = t(spark, sf, "supplier").select(
        F.concat(F.lit("solo "), key.cast("string")).alias("job"), F.lit("supplier_dim").alias("target_table"),
        F.when(key % 2 == 0, "true").otherwise("no").alias("source_deduplication"),
        F.when(key % 4 == 0, "1").alias("stale_data_handling"))
    return plan_shapes(parts.unionByName(solo))


OLD_CUTOFF = "1998-01-01 00:00:00"
GOLD_TS0 = "2024-01-01 00:00:00"
GOLD_SLICE = {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}
GOLD_SCHEMA = (("o_orderstatus", "string"), ("o_orderpriority", "string"),
               ("c_mktsegment", "string"), ("order_count", "bigint"),
               ("total_price", "decimal(38,2)"))
_TOTALS = """SELECT o.o_orderstatus, o.o_orderpriority, c.c_mktsegment, count(*) AS order_count,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_price
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"""


@query("pl02_run_gold", f"""
WITH old AS ({_TOTALS.format(orders="orders", customer="customer")}
             WHERE o.o_orderdate < TIMESTAMP '{OLD_CUTOFF}' GROUP BY ALL),
new AS ({_TOTALS.format(orders="orders", customer="customer")}
        WHERE o.o_orderstatus = 'O' AND o.o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT *, TIMESTAMP '{GOLD_TS0}' AS created_time, 'init' AS created_by,
       TIMESTAMP '{GOLD_TS0}' AS updated_time, 'init' AS updated_by
FROM old WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
UNION ALL
SELECT *, TIMESTAMP '{LOAD_TS}', '{JOB_ID}', TIMESTAMP '{LOAD_TS}', '{JOB_ID}' FROM new""")
def pl02(spark, sf):
    """Gold table of order totals per status/priority/segment: an older state is in place
    (and served); this run recomputes slice (O, 1-URGENT) with staged SQL, snapshots the
    old slice to history, overwrites the slice and publishes it."""
    orders, customer = t(spark, sf, "orders"), t(spark, sf, "customer")
    gold_path, serving = scratch_path(spark, "pl02_gold"), scratch_path(spark, "pl02_serving")
    register_inputs(spark, {"pl02_old_orders": orders.where(
        F.col("o_orderdate") < F.lit(OLD_CUTOFF).cast("timestamp_ntz")), "pl02_customer": customer})
    old = spark.sql(_TOTALS.format(orders="pl02_old_orders_temp_vw",
                                   customer="pl02_customer_temp_vw") + " GROUP BY ALL")
    old = with_audit_stamp(old, GOLD_TS0, "init")
    for path in (gold_path, serving):
        versions.commit(spark, old, path, ["o_orderstatus", "o_orderpriority"])
    job = GoldJob(
        table_name="order_totals",
        steps=[("slice_totals", _TOTALS.format(orders="orders_temp_vw", customer="customer_temp_vw")
                + " WHERE o.o_orderstatus = :status AND o.o_orderpriority = :priority"
                  " GROUP BY ALL"),
               ("gold_final_df", "SELECT * FROM slice_totals")],
        schema=GOLD_SCHEMA, gold_path=gold_path, slice_values=GOLD_SLICE, load_ts=LOAD_TS,
        job_id=JOB_ID, params={"status": "O", "priority": "1-URGENT"},
        history_path=scratch_path(spark, "pl02_history"), serving_path=serving,
        audit_path=scratch_path(spark, "pl02_audit"))
    return run_gold(spark, {"orders": orders, "customer": customer}, job)


@query("pl03_run_emissions", f"""WITH {ACTIVITY_SQL}, {UNITS_SQL}, {FACTORS_SQL},
{DEFAULTS_SQL}, {SCOPES_SQL},
f AS (SELECT a.* REPLACE (COALESCE(a.emission_factor, d.default_factor) AS emission_factor,
                          COALESCE(a.scope_category, r.scope) AS scope_category)
      FROM activity a LEFT JOIN defaults d ON a.fuel_type = d.fuel_type
      LEFT JOIN scope_rules r ON a.fuel_type = r.fuel_type),
k AS (SELECT f.*, CAST(f.energy_consumption * u.to_kwh AS DECIMAL(18,6)) AS energy_kwh
      FROM f LEFT JOIN units u ON f.energy_unit = u.unit),
c AS (SELECT k.*, CAST(CAST(k.energy_kwh AS DECIMAL(38,6)) * x.factor AS DECIMAL(18,6)) AS co2e
      FROM k LEFT JOIN factors x ON k.fuel_type = x.fuel_type)
SELECT scope_category, reporting_period, CAST(sum(co2e) AS DECIMAL(38,6)) AS total_emissions,
       CAST(sum(emission_factor) AS DOUBLE) / count(emission_factor) AS avg_emission_factor,
       count(*) AS record_count
FROM c GROUP BY ALL""")
def pl03(spark, sf):
    return _emissions(spark, sf).summary


def _emissions(spark, sf):
    job = EmissionsJob(
        target_path=scratch_path(spark, "pl03_emissions"), processed_at=LOAD_TS,
        factor_source="IPCC_2023", units=unit_table(spark), factors=factors(spark),
        default_factors=defaults(spark),
        scope_rules=spark.createDataFrame(list(SCOPE_RULES), "fuel_type string, scope string"),
        source_table="lineitem", key_cols=["l_orderkey", "l_linenumber"])
    return run_emissions(spark, activity(spark, sf), job)


@query("pl03_emissions_report", f"""WITH {ACTIVITY_SQL}, {SCOPES_SQL},
f AS (SELECT a.*, COALESCE(a.scope_category, r.scope) AS scope FROM activity a
      LEFT JOIN scope_rules r ON a.fuel_type = r.fuel_type),
n AS (SELECT count(*) AS total_records, count_if(emissions_value < 0) AS negative_emissions,
             count_if(emission_factor < 0.1 OR emission_factor > 3.0) AS factor_n,
             count_if(energy_consumption > 1000000) AS energy_n,
             count_if(scope NOT IN ('Scope1', 'Scope2', 'Scope3')) AS scope_n FROM f)
SELECT total_records, negative_emissions, factor_n AS invalid_emission_factors, energy_n AS excessive_energy_consumption,
       scope_n AS invalid_scopes,
       CAST(CAST(negative_emissions > 0 AS INT) + CAST(factor_n > 0 AS INT) + CAST(energy_n > 0 AS INT)
            + CAST(scope_n > 0 AS INT) AS INTEGER) AS failed_checks,
       negative_emissions + factor_n + energy_n = 0 AS compliant,
       'IPCC_2023' AS emission_factor_source FROM n""")
def pl03_report(spark, sf):
    """The load's quality report: the results of the checks that also made the stamp."""
    return _emissions(spark, sf).report


STEP_SQL = (
    ("line_revenue", "SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * "
                     "(1 - CAST(l_discount AS DECIMAL(18,2)))) AS revenue FROM {lineitem} "
                     "GROUP BY l_orderkey"),
    ("order_revenue", "SELECT o.o_custkey, r.revenue FROM {orders} o JOIN line_revenue r "
                      "ON o.o_orderkey = r.l_orderkey WHERE o.o_orderdate >= {since}"),
    ("gold_final_df", "SELECT c.c_mktsegment, count(*) AS orders, "
                      "CAST(sum(x.revenue) AS DECIMAL(38,4)) AS revenue FROM order_revenue x "
                      "JOIN {customer} c ON x.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"),
)


@query("pl04_run_steps", "WITH " + ",\n".join(
    f"{n} AS ({s.format(lineitem='lineitem', orders='orders', customer='customer', since=chr(39) + '1997-01-01' + chr(39))})"
    for n, s in STEP_SQL[:2]) + "\n" + STEP_SQL[2][1].format(customer="customer"))
def pl04(spark, sf):
    v = register_inputs(spark, {"pl04_lineitem": t(spark, sf, "lineitem"),
                                "pl04_orders": t(spark, sf, "orders"),
                                "pl04_customer": t(spark, sf, "customer")})
    steps = [(n, s.format(lineitem=v["pl04_lineitem"], orders=v["pl04_orders"],
                          customer=v["pl04_customer"], since="CAST(:since AS TIMESTAMP_NTZ)"))
             for n, s in STEP_SQL]
    return run_steps(spark, steps, {"since": "1997-01-01"})


ORDER_DOCUMENT = {
    "target_table": "big_orders",
    "source_tables": [{"name": "orders"}, {"name": "customer"}],
    "parameters": {"merge_key": "o_orderkey", "merge_type": "upsert"},
    "column_mapping": {
        "o_orderkey": {"target_datatype": "BIGINT", "sources": {
            "source_table": "orders", "source_field": "o_orderkey", "transformation": "Direct",
            "filter": "o_totalprice > 1000"}},
        "status": {"target_datatype": "STRING", "sources": [
            {"source_table": "orders", "source_field": "o_orderstatus", "transformation": "Lowercase"}]},
        "segment": {"target_datatype": "STRING", "sources": {
            "source_table": "customer", "source_field": "c_mktsegment",
            "join_condition": "LEFT JOIN customer ON orders.o_custkey = customer.c_custkey",
            "filter": "c_mktsegment <> 'BUILDING'"}},
        "year": {"target_datatype": "INT", "sources": {
            "source_table": "orders", "transformation": 'DateExtraction("o_orderdate", "yyyy")'}}}}


@query("pl06_from_document", f"""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, lower(o_orderstatus) AS status, c_mktsegment AS segment,
       CAST(year(o_orderdate) AS INTEGER) AS year, TIMESTAMP '{LOAD_TS}' AS created_time, 'doc' AS created_by,
       TIMESTAMP '{LOAD_TS}' AS updated_time, 'doc' AS updated_by
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey
WHERE o_totalprice > 1000""")
def pl06(spark, sf):
    """A load as its mapping document declares it: filters, a left join, terms, and upsert."""
    tables = {"orders": t(spark, sf, "orders"), "customer": t(spark, sf, "customer")}
    return load_document(spark, ORDER_DOCUMENT, tables, scratch_path(spark, "pl06"), LOAD_TS, "doc").table
