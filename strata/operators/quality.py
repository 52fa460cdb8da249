"""Data-quality rules (DQ-1..DQ-11).

A rule is a named validity predicate. All configured rules run in ONE aggregate over the
table (``count_if`` per rule) instead of one job per check; the result is unpivoted with
``stack`` into one row per rule. A NULL predicate value is not a failure (D8); add an
explicit not-null rule where NULL must fail. Quarantine is a filter on the same predicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources import fs

# Thresholds of the emissions checks.
MIN_EMISSION_FACTOR = 0.1
MAX_EMISSION_FACTOR = 3.0
MAX_ENERGY_CONSUMPTION = 1_000_000  # kWh
# Allowed scope categories.
VALID_SCOPES = ("Scope1", "Scope2", "Scope3")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    valid: Column | str          # predicate that holds for a valid row (SQL text allowed)
    severity: str = "error"      # "error" fails compliance, "warn" does not

    def valid_col(self) -> Column:
        return F.expr(self.valid) if isinstance(self.valid, str) else self.valid

    def failed_col(self) -> Column:
        """True when the row breaks the rule; NULL predicate counts as passing."""
        return ~F.coalesce(self.valid_col(), F.lit(True))


def rule_negative(col: str, rule_id: str = "negative_emissions") -> Rule:
    """DQ-3: value must not be negative."""
    return Rule(rule_id, ~(F.col(col) < 0))


def rule_range(col: str, lo: float = MIN_EMISSION_FACTOR, hi: float = MAX_EMISSION_FACTOR,
               rule_id: str = "invalid_emission_factors") -> Rule:
    """DQ-4: value within [lo, hi] (bounds valid)."""
    return Rule(rule_id, ~((F.col(col) < lo) | (F.col(col) > hi)))


def rule_max(col: str, hi: float = MAX_ENERGY_CONSUMPTION,
             rule_id: str = "excessive_energy_consumption") -> Rule:
    """DQ-5: value not above ``hi``."""
    return Rule(rule_id, ~(F.col(col) > hi))


def rule_in_set(col: str, allowed: Sequence = VALID_SCOPES, rule_id: str = "invalid_scopes",
                severity: str = "warn") -> Rule:
    """DQ-7: value among ``allowed``; a warning that does not fail compliance. NULL is
    not counted (``NULL IN (...)`` is NULL)."""
    return Rule(rule_id, F.col(col).isin(list(allowed)), severity)


def rule_not_null(col: str, rule_id: str | None = None) -> Rule:
    return Rule(rule_id or f"{col}_not_null", F.col(col).isNotNull())


def rule_period(col: str, fmt: str = "yyyy", start=None, end=None,
                rule_id: str = "invalid_reporting_period") -> Rule:
    """DQ-8: reporting period parses with ``fmt`` and lies in [start, end] when given. A
    present but unparseable period fails; NULL is left to a not-null rule."""
    parsed = F.try_to_timestamp(F.col(col).cast("string"), F.lit(fmt))
    ok = F.when(F.col(col).isNull(), F.lit(None)).otherwise(parsed.isNotNull())
    if start is not None:
        ok = ok & (parsed >= F.lit(start).cast("timestamp"))
    if end is not None:
        ok = ok & (parsed <= F.lit(end).cast("timestamp"))
    return Rule(rule_id, ok)


def rule_units(col: str, units: DataFrame, unit_col: str = "unit",
               rule_id: str = "unknown_energy_unit") -> tuple[Rule, DataFrame]:
    """DQ-11: energy rows must carry a known unit.

    Returns the rule and the frame to run it on: the unit table is joined (left, on the
    unit name) to flag known units; the unit table is broadcast behind a size check.
    """
    known = units.select(F.col(unit_col).alias("__unit"), F.lit(True).alias("__known_unit"))
    return Rule(rule_id, F.col(col).isNull() | F.col("__known_unit").isNotNull()), known


def with_unit_flag(df: DataFrame, col: str, known: DataFrame) -> DataFrame:
    """Flag rows whose unit is in the unit table (de-duplicated first, so the left join
    cannot multiply rows)."""
    units = known.dropDuplicates(["__unit"])
    return df.join(units, df[col] == units["__unit"], "left").drop("__unit")


def run_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """DQ-2: failing-row count per rule, one pass over ``df``.

    Output: rule_id, severity, failed, total - one row per rule.
    """
    aggs = [F.count(F.lit(1)).alias("__total")]
    aggs += [F.count_if(r.failed_col()).alias(f"__r{i}") for i, r in enumerate(rules)]
    one = df.agg(*aggs)
    pairs = ", ".join(f"'{r.rule_id}', '{r.severity}', __r{i}" for i, r in enumerate(rules))
    return one.select(F.expr(f"stack({len(rules)}, {pairs}) AS (rule_id, severity, failed)"),
                      F.col("__total").alias("total"))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (passing, quarantined); quarantined rows carry ``failed_rules``."""
    ids = F.array_compact(F.array(*[F.when(r.failed_col(), F.lit(r.rule_id))
                                    for r in rules]))
    tagged = df.withColumn("failed_rules", ids)
    return (tagged.where(F.size("failed_rules") == 0).drop("failed_rules"),
            tagged.where(F.size("failed_rules") > 0))


def quarantine_write(df: DataFrame, rules: Sequence[Rule], path: str) -> tuple[DataFrame, DataFrame]:
    """Single-pass split for large tables: each row is tagged once and written to
    ``<path>/quarantined=false|true`` (the filter-based split evaluates the rule predicates
    in both the filter and the projection). Returns (passing, quarantined) as read back."""
    return quarantine_counted(df, rules, path)[:2]


def quarantine_counted(df: DataFrame, rules: Sequence[Rule], path: str) -> tuple[DataFrame, DataFrame, dict]:
    """``quarantine_write``, and the rules' results (as ``rule_results``), counted by the
    tasks that write: no further pass."""
    ids = F.array_compact(F.array(*[F.when(r.failed_col(), F.lit(r.rule_id))
                                    for r in rules]))
    tagged = df.withColumn("failed_rules", ids) \
        .withColumn("quarantined", F.size("failed_rules") > 0)
    seen, counts = Observation(), {"__total": F.count(F.lit(1))}
    counts |= {f"__r{i}": F.count_if(F.array_contains("failed_rules", r.rule_id)) for i, r in enumerate(rules)}
    (tagged.observe(seen, *[c.alias(name) for name, c in counts.items()])
     .write.mode("overwrite").partitionBy("quarantined").parquet(path))
    spark = df.sparkSession
    some = fs.siblings(spark, f"{path}/quarantined=*")          # without a row nothing is observed
    schema = tagged.schema
    back = spark.read.schema(schema).parquet(path)
    return (back.where(~F.col("quarantined")).drop("failed_rules", "quarantined"),
            back.where(F.col("quarantined")).drop("quarantined"),
            counted_results(rules, seen.get if some else dict.fromkeys(counts, 0)))


def schema_diff(df: DataFrame, target: T.StructType | Iterable[tuple[str, str]]) -> DataFrame:
    """DQ-1: names and types of ``df`` against the target schema: one row per missing,
    extra or type-changed column (empty when they match). Schemas are metadata, so this
    compares on the driver and returns a small frame."""
    from strata.operators.project import parse_type
    fields = target.fields if isinstance(target, T.StructType) else [
        T.StructField(n, parse_type(t) if isinstance(t, str) else t) for n, t in target]
    want = {f.name.lower(): f for f in fields}
    have = {f.name.lower(): f for f in df.schema.fields}
    rows = []
    for k, f in want.items():
        if k not in have:
            rows.append((f.name, "missing", f.dataType.simpleString(), None))
        elif have[k].dataType != f.dataType:
            rows.append((f.name, "type_changed", f.dataType.simpleString(),
                         have[k].dataType.simpleString()))
    for k, f in have.items():
        if k not in want:
            rows.append((f.name, "extra", None, f.dataType.simpleString()))
    schema = "column string, issue string, expected string, actual string"
    return df.sparkSession.createDataFrame(rows, schema)


def required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """DQ-6: required columns absent from ``df`` (a missing one fails compliance)."""
    have = {c.lower() for c in df.columns}
    rows = [(c,) for c in required if c.lower() not in have]
    return df.sparkSession.createDataFrame(rows, "missing_column string")


def schema_report(df: DataFrame, target: T.StructType | Iterable[tuple[str, str]]) -> DataFrame:
    """DQ-1 over the rows: the columns that differ from the target schema, each with the
    number of rows in which it is filled (0 for a missing one), from one aggregate."""
    return _with_filled(df, schema_diff(df, target), "column")


def required_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """DQ-6 over the rows: every required column, whether the frame has it, and the number of
    rows in which it is filled; compliant loads have every one present and filled."""
    have = {c.lower() for c in df.columns}
    rows = df.sparkSession.createDataFrame([(c, c.lower() in have) for c in required],
                                           "required_column string, present boolean")
    return _with_filled(df, rows, "required_column")


def _with_filled(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds ``filled``, the count of non-NULL values of the named column, to metadata rows."""
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c.lower()}', `{c}`" for c in df.columns)
    counts = one.select(F.expr(f"stack({len(df.columns)}, {pairs}) AS (__name, __filled)"))
    out = rows.join(counts, F.lower(F.col(key)) == F.col("__name"), "left")
    return out.select(*rows.columns, F.coalesce("__filled", F.lit(0)).cast("bigint").alias("filled"))


def rule_results(df: DataFrame, rules: Sequence[Rule]) -> dict:
    """Run the rules once and return {rule_id: failed} plus severity per rule. The result
    has one entry per configured rule (bounded by configuration, not by data)."""
    out = {}
    for row in run_rules(df, rules).collect():
        out[row["rule_id"]] = (row["failed"], row["severity"], row["total"])
    return out


def rule_counts(rules: Sequence[Rule]) -> dict:
    """The rules as aggregates by name, to be counted while a load is written (DQ-2)."""
    return {"__total": F.count(F.lit(1))} | {f"__r{i}": F.count_if(r.failed_col()) for i, r in enumerate(rules)}


def counted_results(rules: Sequence[Rule], counts: dict) -> dict:
    """What ``rule_results`` gives, of counts that were taken by ``rule_counts``."""
    return {r.rule_id: (counts[f"__r{i}"], r.severity, counts["__total"]) for i, r in enumerate(rules)}


def compliance(results: dict, missing_required: Sequence[str] = ()) -> bool:
    """Compliant when no required column is missing and no error-severity rule fails."""
    return not missing_required and all(
        failed == 0 for failed, sev, _ in results.values() if sev == "error")


def quality_constants(results: dict, missing_required: Sequence[str] = ()) -> dict:
    """The stamp's columns that follow from the checks: one value for all rows of a load."""
    failed = sum(1 for n, _, _ in results.values() if n > 0)
    return {"quality_score": (100 - failed, "int"),
            "ghg_compliance_status": (compliance(results, missing_required), "boolean")}


def with_quality_stamp(df: DataFrame, results: dict, processed_at, factor_source: str,
                       reporting_period: str | None = None,
                       missing_required: Sequence[str] = ()) -> DataFrame:
    """DQ-9: stamp each row with processing time, factor source, period, quality score and
    compliance. Score = 100 - number of failed checks (D6: the reference subtracts the
    number of checks, a constant)."""
    score = quality_constants(results, missing_required)
    cols = {
        "processing_timestamp": F.lit(processed_at).cast("timestamp_ntz"),
        "emission_factor_source": F.lit(factor_source),
        **{c: F.lit(value).cast(kind) for c, (value, kind) in score.items()},
    }
    if reporting_period is not None:
        cols["reporting_period"] = F.lit(reporting_period)
    return df.withColumns(cols)


def quality_report(df: DataFrame, rules: Sequence[Rule],
                   required: Sequence[str] = ()) -> DataFrame:
    """DQ-10: one row: failing count per check, total records, failed checks and
    compliance - all from one aggregate over ``df``."""
    missing = [c for c in required if c.lower() not in {x.lower() for x in df.columns}]
    counts = [F.count_if(r.failed_col()).alias(r.rule_id) for r in rules]
    one = df.agg(F.count(F.lit(1)).alias("total_records"), *counts)
    errors = [F.col(r.rule_id) for r in rules if r.severity == "error"]
    failed = reduce(lambda a, b: a + b,
                    [F.when(F.col(r.rule_id) > 0, 1).otherwise(0) for r in rules], F.lit(0))
    ok = reduce(lambda a, b: a & b, [c == 0 for c in errors], F.lit(not missing))
    return one.select("*", failed.alias("failed_checks"), ok.alias("compliant"))
