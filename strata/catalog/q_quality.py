"""Data-quality queries (DQ-1..DQ-11) over customer, orders and the lineitem activity."""

from __future__ import annotations

from strata.catalog import query
from strata.catalog.common import LOAD_TS, t
from strata.catalog.q_emissions import ACTIVITY_SQL, activity
from strata.catalog.q_glossary import ORDER_MAPPING
from strata.operators.emissions import unit_table
from strata.operators.project import project
from strata.operators.quality import (quality_report, quarantine, required_report,
                                      rule_in_set, rule_max, rule_negative, rule_period,
                                      rule_range, rule_results, rule_units, run_rules,
                                      schema_report, with_quality_stamp, with_unit_flag)


def emission_rules():
    return [rule_negative("emissions_value"), rule_range("emission_factor"),
            rule_max("energy_consumption"), rule_in_set("scope_category"),
            rule_period("reporting_period", "yyyy", "1996-01-01", "2000-12-31")]


# Validity predicates of ``emission_rules`` in SQL (a NULL predicate is not a failure).
FAIL_SQL = {
    "negative_emissions": "emissions_value < 0",
    "invalid_emission_factors": "(emission_factor < 0.1 OR emission_factor > 3.0)",
    "excessive_energy_consumption": "energy_consumption > 1000000",
    "invalid_scopes": "NOT scope_category IN ('Scope1', 'Scope2', 'Scope3')",
    "invalid_reporting_period": (
        "NOT (try_strptime(reporting_period, '%Y') IS NOT NULL AND "
        "try_strptime(reporting_period, '%Y') >= TIMESTAMP '1996-01-01' AND "
        "try_strptime(reporting_period, '%Y') <= TIMESTAMP '2000-12-31')"),
}
SEVERITY = {"invalid_scopes": "warn"}


def _fails(rule_id):
    return f"COALESCE({FAIL_SQL[rule_id]}, false)"


RULES_SQL = f"""WITH {ACTIVITY_SQL}
""" + "\nUNION ALL\n".join(
    f"SELECT '{r}' AS rule_id, '{SEVERITY.get(r, 'error')}' AS severity, "
    f"count_if({_fails(r)}) AS failed, count(*) AS total FROM activity" for r in FAIL_SQL)


@query("dq01_schema_diff", """
SELECT 'region' AS "column", 'missing' AS issue, 'string' AS expected, CAST(NULL AS VARCHAR) AS actual,
       CAST(0 AS BIGINT) AS filled
UNION ALL SELECT 'customer_id', 'type_changed', 'bigint', 'string', count(o_custkey) FROM orders
UNION ALL SELECT 'order_year', 'extra', NULL, 'int', count(o_orderdate) FROM orders""")
def dq01(spark, sf):
    """Projected orders against a target schema: the columns that differ, and how many rows
    have a value in them."""
    df = project(t(spark, sf, "orders"), ORDER_MAPPING)
    return schema_report(df, [("order_id", "BIGINT"), ("customer_id", "BIGINT"),
                              ("status", "STRING"), ("total", "DECIMAL(18,2)"),
                              ("region", "STRING")])


@query("dq02_run_rules", RULES_SQL)
def dq02(spark, sf):
    return run_rules(activity(spark, sf), emission_rules())


@query("dq02_quarantine", f"""WITH {ACTIVITY_SQL}
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         list_filter([{", ".join(f"CASE WHEN {_fails(r)} THEN '{r}' END" for r in FAIL_SQL)}],
                     lambda x: x IS NOT NULL) AS failed_rules
  FROM activity) WHERE len(failed_rules) > 0""")
def dq02q(spark, sf):
    a = activity(spark, sf)
    _, bad = quarantine(a, emission_rules())
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                      "failed_rules")


@query("dq03_rule_negative", """
SELECT 'negative_balance' AS rule_id, 'error' AS severity,
       count_if(COALESCE(c_acctbal < 0, false)) AS failed, count(*) AS total FROM customer""")
def dq03(spark, sf):
    return run_rules(t(spark, sf, "customer"), [rule_negative("c_acctbal", "negative_balance")])


def _single(rule_id):
    return (f"WITH {ACTIVITY_SQL}\nSELECT '{rule_id}' AS rule_id, "
            f"'{SEVERITY.get(rule_id, 'error')}' AS severity, count_if({_fails(rule_id)}) "
            f"AS failed, count(*) AS total FROM activity")


@query("dq04_rule_range", _single("invalid_emission_factors"))
def dq04(spark, sf):
    return run_rules(activity(spark, sf), [rule_range("emission_factor")])


@query("dq05_rule_max", _single("excessive_energy_consumption"))
def dq05(spark, sf):
    return run_rules(activity(spark, sf), [rule_max("energy_consumption")])


@query("dq06_required_columns", f"""WITH {ACTIVITY_SQL}
SELECT 'emissions_value' AS required_column, true AS present, count(emissions_value) AS filled FROM activity
UNION ALL SELECT 'emission_factor', false, CAST(0 AS BIGINT)
UNION ALL SELECT 'scope_category', true, count(scope_category) FROM activity
UNION ALL SELECT 'reporting_period', true, count(reporting_period) FROM activity""")
def dq06(spark, sf):
    """Required GHG fields against the activity frame without its factor column: which are
    there, and in how many rows they are filled."""
    a = activity(spark, sf).drop("emission_factor")
    return required_report(a, ["emissions_value", "emission_factor", "scope_category",
                               "reporting_period"])


@query("dq07_rule_in_set", _single("invalid_scopes"))
def dq07(spark, sf):
    return run_rules(activity(spark, sf), [rule_in_set("scope_category")])


@query("dq08_rule_period", _single("invalid_reporting_period"))
def dq08(spark, sf):
    return run_rules(activity(spark, sf),
                     [rule_period("reporting_period", "yyyy", "1996-01-01", "2000-12-31")])


@query("dq09_quality_stamp", f"""WITH {ACTIVITY_SQL},
fails AS (SELECT {" + ".join(f"CASE WHEN count_if({_fails(r)}) > 0 THEN 1 ELSE 0 END"
                             for r in FAIL_SQL)} AS failed_checks,
                 {" AND ".join(f"count_if({_fails(r)}) = 0" for r in FAIL_SQL
                               if r not in SEVERITY)} AS compliant
          FROM activity)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, emissions_value,
       TIMESTAMP '{LOAD_TS}' AS processing_timestamp, 'IPCC_2023' AS emission_factor_source,
       CAST(100 - fails.failed_checks AS INTEGER) AS quality_score,
       fails.compliant AS ghg_compliance_status, 'FY2024' AS reporting_period
FROM activity, fails""")
def dq09(spark, sf):
    a = activity(spark, sf)
    results = rule_results(a, emission_rules())
    out = a.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                   "emissions_value")
    return with_quality_stamp(out, results, LOAD_TS, "IPCC_2023", "FY2024")


@query("dq10_quality_report", f"""WITH {ACTIVITY_SQL},
c AS (SELECT count(*) AS total_records,
             {", ".join(f"count_if({_fails(r)}) AS {r}" for r in FAIL_SQL)} FROM activity)
SELECT *, {" + ".join(f"CASE WHEN {r} > 0 THEN 1 ELSE 0 END" for r in FAIL_SQL)}
          AS failed_checks,
       {" AND ".join(f"{r} = 0" for r in FAIL_SQL if r not in SEVERITY)} AS compliant
FROM c""")
def dq10(spark, sf):
    return quality_report(activity(spark, sf), emission_rules(),
                          ["emissions_value", "emission_factor", "scope_category",
                           "reporting_period"])


@query("dq11_rule_units", f"""WITH {ACTIVITY_SQL}
SELECT 'unknown_energy_unit' AS rule_id, 'error' AS severity,
       count_if(energy_unit NOT IN ('kWh', 'MWh', 'GJ')) AS failed, count(*) AS total
FROM activity""")
def dq11(spark, sf):
    a = activity(spark, sf)
    rule, known = rule_units("energy_unit", unit_table(spark))
    return run_rules(with_unit_flag(a, "energy_unit", known), [rule])
