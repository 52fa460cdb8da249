"""Emissions calculations (EN-*), summaries (AG-1/2) and the year-over-year trend.

Activity rows are derived from ``lineitem`` (quantity as energy, return flag as scope,
ship year as reporting period); unit, factor, default and scope-rule tables are small
input tables given inline (their values are inputs, not in the reference).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from strata.catalog import query
from strata.catalog.common import t
from strata.operators.emissions import (emissions_summary, fill_factor, footprint_by_unit,
                                        round_report, scope_of, to_co2e, to_kwh, to_utc,
                                        unit_table, with_lineage)

FUEL_FACTORS = (("electricity", Decimal("0.4")), ("natural_gas", Decimal("0.2")),
                ("diesel", Decimal("0.27")))
DEFAULT_FACTORS = (("electricity", Decimal("0.5")), ("natural_gas", Decimal("0.25")),
                   ("biogas", Decimal("0.1")), ("diesel", Decimal("1.2")))
SCOPE_RULES = (("electricity", "Scope2"), ("natural_gas", "Scope1"), ("diesel", "Scope1"),
               ("biogas", "Scope3"))


def activity(spark, sf):
    li = t(spark, sf, "lineitem")
    rf, ln = F.col("l_returnflag"), F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.concat(F.lit("BU-"), F.col("l_suppkey").cast("string")).alias("business_unit"),
        (F.col("l_quantity") * 25000).cast("decimal(18,6)").alias("energy_consumption"),
        F.when(ln == 7, "therm").when(rf == "A", "MWh").when(rf == "N", "kWh")
        .otherwise("GJ").alias("energy_unit"),
        F.when(F.col("l_tax") == 0, "biogas").when(F.col("l_discount") > 0.08, "diesel")
        .when(F.col("l_linestatus") == "O", "electricity").otherwise("natural_gas")
        .alias("fuel_type"),
        F.when(ln == 6, F.lit(None)).when(ln == 5, "Scope9").when(rf == "A", "Scope1")
        .when(rf == "N", "Scope2").otherwise("Scope3").alias("scope_category"),
        F.date_format("l_shipdate", "yyyy").alias("reporting_period"),
        F.when(F.col("l_discount") == 0, F.lit(None))
        .otherwise((F.col("l_tax") * 50).cast("decimal(18,6)")).alias("emission_factor"),
        ((F.col("l_quantity") - 5) * F.col("l_tax") * 1000).cast("decimal(18,6)")
        .alias("emissions_value"))


ACTIVITY_SQL = """activity AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         'BU-' || CAST(l_suppkey AS VARCHAR) AS business_unit,
         CAST(l_quantity * 25000 AS DECIMAL(18,6)) AS energy_consumption,
         CASE WHEN l_linenumber = 7 THEN 'therm' WHEN l_returnflag = 'A' THEN 'MWh'
              WHEN l_returnflag = 'N' THEN 'kWh' ELSE 'GJ' END AS energy_unit,
         CASE WHEN l_tax = 0 THEN 'biogas' WHEN l_discount > 0.08 THEN 'diesel'
              WHEN l_linestatus = 'O' THEN 'electricity' ELSE 'natural_gas' END AS fuel_type,
         CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 5 THEN 'Scope9'
              WHEN l_returnflag = 'A' THEN 'Scope1' WHEN l_returnflag = 'N' THEN 'Scope2'
              ELSE 'Scope3' END AS scope_category,
         strftime(l_shipdate, '%Y') AS reporting_period,
         CASE WHEN l_discount = 0 THEN NULL
              ELSE CAST(l_tax * 50 AS DECIMAL(18,6)) END AS emission_factor,
         CAST((l_quantity - 5) * l_tax * 1000 AS DECIMAL(18,6)) AS emissions_value
  FROM lineitem)"""

UNITS_SQL = """units(unit, to_kwh) AS (VALUES ('kWh', CAST(1 AS DECIMAL(18,12))),
  ('MWh', CAST(1000 AS DECIMAL(18,12))), ('GJ', CAST(277.777777777778 AS DECIMAL(18,12))))"""
FACTORS_SQL = """factors(fuel_type, factor) AS (VALUES
  ('electricity', CAST(0.4 AS DECIMAL(18,6))), ('natural_gas', CAST(0.2 AS DECIMAL(18,6))),
  ('diesel', CAST(0.27 AS DECIMAL(18,6))))"""
DEFAULTS_SQL = """defaults(fuel_type, default_factor) AS (VALUES
  ('electricity', CAST(0.5 AS DECIMAL(18,6))), ('natural_gas', CAST(0.25 AS DECIMAL(18,6))),
  ('biogas', CAST(0.1 AS DECIMAL(18,6))), ('diesel', CAST(1.2 AS DECIMAL(18,6))))"""
SCOPES_SQL = """scope_rules(fuel_type, scope) AS (VALUES ('electricity', 'Scope2'),
  ('natural_gas', 'Scope1'), ('diesel', 'Scope1'), ('biogas', 'Scope3'))"""
KWH_SQL = "CAST(a.energy_consumption * u.to_kwh AS DECIMAL(18,6))"


def _lookup(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def factors(spark):
    return _lookup(spark, FUEL_FACTORS, "fuel_type string, factor decimal(18,6)")


def defaults(spark):
    return _lookup(spark, DEFAULT_FACTORS, "fuel_type string, default_factor decimal(18,6)")


@query("en01_to_kwh", f"""
WITH {ACTIVITY_SQL}, {UNITS_SQL}
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate, a.energy_unit,
       a.energy_consumption, {KWH_SQL} AS energy_kwh
FROM activity a LEFT JOIN units u ON a.energy_unit = u.unit""")
def en01(spark, sf):
    a = activity(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                   "l_shipdate", "energy_unit", "energy_consumption")
    return to_kwh(a, "energy_consumption", "energy_unit", unit_table(spark))


@query("en02_to_co2e", f"""
WITH {ACTIVITY_SQL}, {UNITS_SQL}, {FACTORS_SQL},
k AS (SELECT a.*, {KWH_SQL} AS energy_kwh FROM activity a
      LEFT JOIN units u ON a.energy_unit = u.unit)
SELECT k.l_orderkey, k.l_linenumber, k.l_partkey, k.l_suppkey, k.l_shipdate, k.fuel_type,
       k.energy_kwh, CAST(CAST(k.energy_kwh AS DECIMAL(38,6)) * f.factor AS DECIMAL(18,6)) AS co2e
FROM k LEFT JOIN factors f ON k.fuel_type = f.fuel_type""")
def en02(spark, sf):
    a = activity(spark, sf)
    k = to_kwh(a, "energy_consumption", "energy_unit", unit_table(spark)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "fuel_type",
        "energy_kwh")
    return to_co2e(k, "energy_kwh", "fuel_type", factors(spark))


@query("en03_fill_factor", f"""
WITH {ACTIVITY_SQL}, {DEFAULTS_SQL}
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate, a.fuel_type,
       COALESCE(a.emission_factor, d.default_factor) AS emission_factor
FROM activity a LEFT JOIN defaults d ON a.fuel_type = d.fuel_type""")
def en03(spark, sf):
    a = activity(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                   "l_shipdate", "fuel_type", "emission_factor")
    return fill_factor(a, "fuel_type", "emission_factor", defaults(spark))


@query("en04_scope_of", f"""
WITH {ACTIVITY_SQL}, {SCOPES_SQL}
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate, a.fuel_type,
       COALESCE(a.scope_category, r.scope) AS scope_category
FROM activity a LEFT JOIN scope_rules r ON a.fuel_type = r.fuel_type""")
def en04(spark, sf):
    a = activity(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                   "l_shipdate", "fuel_type", "scope_category")
    rules = _lookup(spark, SCOPE_RULES, "fuel_type string, scope string")
    return scope_of(a, "scope_category", "fuel_type", rules)


@query("en05_round_report", f"""
WITH {ACTIVITY_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       CAST(round(emissions_value, 2) AS DECIMAL(38,2)) AS emissions_value,
       CAST(round(emission_factor, 2) AS DECIMAL(38,2)) AS emission_factor
FROM activity""")
def en05(spark, sf):
    a = activity(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                   "l_shipdate", "emissions_value", "emission_factor")
    return round_report(a, ["emissions_value", "emission_factor"], 2)


@query("en06_to_utc", """
SELECT event_id, user_id,
       CASE event_type WHEN 'click' THEN 'America/New_York' WHEN 'view' THEN 'Europe/Berlin'
            WHEN 'purchase' THEN 'Asia/Kolkata' WHEN 'signup' THEN 'Australia/Sydney'
            ELSE 'UTC' END AS tz,
       CAST(timezone('UTC', timezone(
         CASE event_type WHEN 'click' THEN 'America/New_York' WHEN 'view' THEN 'Europe/Berlin'
              WHEN 'purchase' THEN 'Asia/Kolkata' WHEN 'signup' THEN 'Australia/Sydney'
              ELSE 'UTC' END, ts)) AS TIMESTAMP) AS ts
FROM events""")
def en06(spark, sf):
    ev = t(spark, sf, "events")
    tz = (F.when(F.col("event_type") == "click", "America/New_York")
          .when(F.col("event_type") == "view", "Europe/Berlin")
          .when(F.col("event_type") == "purchase", "Asia/Kolkata")
          .when(F.col("event_type") == "signup", "Australia/Sydney").otherwise("UTC"))
    return to_utc(ev.select("event_id", "user_id", tz.alias("tz"), "ts"), "ts", "tz")


@query("en07_with_lineage", f"""
WITH {ACTIVITY_SQL}
SELECT l_orderkey, l_linenumber, emissions_value, 'lineitem' AS lineage_source,
       CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS lineage_key,
       'energy_x_factor' AS lineage_method
FROM activity""")
def en07(spark, sf):
    a = activity(spark, sf).select("l_orderkey", "l_linenumber", "emissions_value")
    return with_lineage(a, "lineitem", ["l_orderkey", "l_linenumber"], "energy_x_factor")


@query("ag01_emissions_summary", f"""
WITH {ACTIVITY_SQL}
SELECT scope_category, reporting_period,
       CAST(sum(emissions_value) AS DECIMAL(38,6)) AS total_emissions,
       CAST(sum(emission_factor) AS DOUBLE) / count(emission_factor) AS avg_emission_factor,
       count(*) AS record_count
FROM activity GROUP BY ALL""")
def ag01(spark, sf):
    return emissions_summary(activity(spark, sf))


@query("ag02_footprint_by_unit", f"""
WITH {ACTIVITY_SQL}, {UNITS_SQL}, {FACTORS_SQL},
k AS (SELECT a.*, {KWH_SQL} AS energy_kwh FROM activity a
      LEFT JOIN units u ON a.energy_unit = u.unit),
c AS (SELECT k.business_unit, CAST(CAST(k.energy_kwh AS DECIMAL(38,6)) * f.factor AS DECIMAL(18,6)) AS co2e
      FROM k LEFT JOIN factors f ON k.fuel_type = f.fuel_type)
SELECT business_unit, CAST(sum(co2e) AS DECIMAL(38,6)) AS footprint, count(*) AS record_count
FROM c GROUP BY business_unit""")
def ag02(spark, sf):
    a = activity(spark, sf)
    k = to_kwh(a, "energy_consumption", "energy_unit", unit_table(spark))
    return footprint_by_unit(to_co2e(k, "energy_kwh", "fuel_type", factors(spark)))
