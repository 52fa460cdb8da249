"""Emissions load (PL-3): read -> one-pass quality rules -> energy / CO2e transform ->
compliance -> quality stamp -> partitioned overwrite -> summary and quality report."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.emissions import (emissions_summary, fill_factor, scope_of, to_co2e,
                                        to_kwh, with_lineage)
from strata.operators.quality import (Rule, compliance, counted_results, quality_constants, rule_counts,
                                      rule_in_set, rule_max, rule_negative, rule_range)
from strata.sources import versions

# Fields a GHG load must carry.
REQUIRED_FIELDS = ("emissions_value", "emission_factor", "scope_category", "reporting_period")


@dataclass
class EmissionsJob:
    target_path: str
    processed_at: str
    factor_source: str
    units: DataFrame
    factors: DataFrame
    default_factors: DataFrame | None = None
    scope_rules: DataFrame | None = None
    source_table: str = "bronze"
    key_cols: Sequence[str] = ()


@dataclass
class EmissionsResult:
    table: DataFrame
    summary: DataFrame
    report: DataFrame


def default_rules() -> list[Rule]:
    return [rule_negative("emissions_value"), rule_range("emission_factor"),
            rule_max("energy_consumption")]


def run_emissions(spark: SparkSession, source: DataFrame, job: EmissionsJob) -> EmissionsResult:
    """PL-3 over an activity frame (business_unit, energy_consumption, energy_unit,
    fuel_type, scope_category, reporting_period, emission_factor, ...).

    The transformed rows get ``emissions_value`` = CO2e from kWh x fuel factor, lineage
    and the quality stamp, and are written partitioned by reporting period and scope.
    The rows are read once and written once: all checks (the value/factor/energy checks on the
    source values, carried along under private names, and the scope check on the transformed
    rows) are counted by the tasks that write, and the part of the stamp that follows from
    them stands in the version file that publishes the load, as it is one value for all rows.
    """
    df = source.withColumns({"__src_value": F.col("emissions_value"),
                             "__src_factor": F.col("emission_factor")})
    if job.default_factors is not None:
        df = fill_factor(df, "fuel_type", "emission_factor", job.default_factors)
    if job.scope_rules is not None:
        df = scope_of(df, "scope_category", "fuel_type", job.scope_rules)
    df = to_kwh(df, "energy_consumption", "energy_unit", job.units)
    df = to_co2e(df, "energy_kwh", "fuel_type", job.factors, out="emissions_value")
    df = with_lineage(df, job.source_table, job.key_cols or ["business_unit"], "kwh_x_factor")
    checks = [rule_negative("__src_value"), rule_range("__src_factor"),
              rule_max("energy_consumption"), rule_in_set("scope_category")]
    df = df.withColumns({"processing_timestamp": F.lit(job.processed_at).cast("timestamp_ntz"),
                         "emission_factor_source": F.lit(job.factor_source)})
    private = ["__src_value", "__src_factor"]
    missing = [c for c in REQUIRED_FIELDS if c not in df.columns]
    base = versions.current(spark, job.target_path)
    version, counts = versions.commit_measured(
        spark, df, job.target_path, ["reporting_period", "scope_category"], versions.ALL, base,
        measures=versions.Measures(rule_counts(checks), private,
                                   lambda seen: quality_constants(counted_results(checks, seen), missing)))
    results = counted_results(checks, counts)           # one entry per rule (config-sized)
    written = versions.read(spark, job.target_path, version)
    summary = emissions_summary(written)
    report = report_of(spark, results, missing)
    return EmissionsResult(written, summary, report.withColumn(
        "emission_factor_source", F.lit(job.factor_source)))


def report_of(spark: SparkSession, results: dict, missing: Sequence[str]) -> DataFrame:
    """The quality report (one row, as DQ-10) of the rule results that also made the stamp."""
    total = max((n for _, _, n in results.values()), default=0)
    failed = {rule: n for rule, (n, _, _) in results.items()}
    row = (total, *failed.values(), sum(n > 0 for n in failed.values()), compliance(results, missing))
    schema = ", ".join(["total_records bigint", *(f"{rule} bigint" for rule in failed),
                        "failed_checks int", "compliant boolean"])
    return spark.createDataFrame([row], schema)
