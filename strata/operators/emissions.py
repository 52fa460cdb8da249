"""Emissions calculations (EN-1..EN-7) and summaries (AG-1, AG-2).

Unit and factor tables are lookups (a row per unit / fuel type; a repeated key is refused,
as it would multiply emissions); every calculation is a DECIMAL expression, cast to DECIMAL(18,6).
They have a row for each of a handful of names that the activities share, so a shuffle on the
name would deal all activities to as many tasks: the lookups are broadcast instead, and the
activities stay where they are.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.joins import unique_lookup

RESULT = "decimal(18,6)"
# Energy units to kWh. 1 GJ = 1 / 0.0036 kWh (physical constant, not in the
# reference); 1 MWh = 1000 kWh.
UNIT_TO_KWH = (
    ("kWh", Decimal("1")),
    ("MWh", Decimal("1000")),
    ("GJ", Decimal("277.777777777778")),
)


def unit_table(spark: SparkSession, units=UNIT_TO_KWH) -> DataFrame:
    return spark.createDataFrame(list(units), "unit string, to_kwh decimal(18,12)")


def _lookup(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A lookup of few rows, one per key (checked), for a join that leaves the main rows in place."""
    return F.broadcast(unique_lookup(rows, [key], name))


def to_kwh(df: DataFrame, value: str, unit: str, units: DataFrame,
           out: str = "energy_kwh") -> DataFrame:
    """EN-1: energy in kWh via the unit table; an unknown unit gives NULL."""
    u = _lookup(units.select(F.col("unit").alias("__unit"), "to_kwh"), "__unit", "units")
    j = df.join(u, df[unit] == u["__unit"], "left")
    return j.withColumn(out, (F.col(value) * F.col("to_kwh")).cast(RESULT)) \
            .drop("__unit", "to_kwh")


def fill_factor(df: DataFrame, fuel: str, factor: str, defaults: DataFrame) -> DataFrame:
    """EN-3: a missing factor takes the fuel type's default (defaults: fuel_type,
    default_factor)."""
    d = _lookup(defaults.select(F.col("fuel_type").alias("__fuel"), "default_factor"),
                "__fuel", "default factors")
    j = df.join(d, df[fuel] == d["__fuel"], "left")
    return j.withColumn(factor, F.coalesce(F.col(factor), F.col("default_factor"))) \
            .drop("__fuel", "default_factor")


def to_co2e(df: DataFrame, energy: str, fuel: str, factors: DataFrame,
            out: str = "co2e") -> DataFrame:
    """EN-2: CO2e = energy x factor of the fuel type (factors: fuel_type, factor), as
    DECIMAL(18,6). Factor values are an input table, not constants."""
    f = _lookup(factors.select(F.col("fuel_type").alias("__fuel"), F.col("factor").alias("__factor")),
                "__fuel", "factors")
    j = df.join(f, df[fuel] == f["__fuel"], "left")
    return j.withColumn(out, (F.col(energy) * F.col("__factor")).cast(RESULT)) \
            .drop("__fuel", "__factor")


def scope_of(df: DataFrame, scope: str, fuel: str, rules: DataFrame) -> DataFrame:
    """EN-4: keep a given scope category; derive a missing one from the fuel type via the
    rule table (fuel_type, scope)."""
    r = _lookup(rules.select(F.col("fuel_type").alias("__fuel"), F.col("scope").alias("__scope")),
                "__fuel", "scope rules")
    j = df.join(r, df[fuel] == r["__fuel"], "left")
    return j.withColumn(scope, F.coalesce(F.col(scope), F.col("__scope"))) \
            .drop("__fuel", "__scope")


def round_report(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """EN-5: round reported decimals half-up to ``digits`` places."""
    return df.withColumns({c: F.round(F.col(c), digits).cast(f"decimal(38,{digits})")
                           for c in cols})


def to_utc(df: DataFrame, ts: str, tz: str, out: str | None = None) -> DataFrame:
    """EN-6: a local wall-clock time in zone ``tz`` (column) as UTC wall-clock time."""
    return df.withColumn(out or ts, F.to_utc_timestamp(F.col(ts), F.col(tz))
                         .cast("timestamp_ntz"))


def with_lineage(df: DataFrame, source_table: str, key_cols: Sequence[str],
                 method: str) -> DataFrame:
    """EN-7: lineage on each calculated row: source table, source key, method."""
    return df.withColumns({
        "lineage_source": F.lit(source_table),
        "lineage_key": F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]),
        "lineage_method": F.lit(method)})


def emissions_summary(df: DataFrame, value: str = "emissions_value",
                      factor: str = "emission_factor") -> DataFrame:
    """AG-1: per scope and period: total emissions (exact DECIMAL sum), average factor,
    record count."""
    return df.groupBy("scope_category", "reporting_period").agg(
        F.sum(F.col(value).cast(RESULT)).cast("decimal(38,6)").alias("total_emissions"),
        (F.sum(F.col(factor).cast(RESULT)).cast("double") / F.count(factor))
        .alias("avg_emission_factor"),
        F.count(F.lit(1)).alias("record_count"))


def footprint_by_unit(df: DataFrame, unit: str = "business_unit",
                      value: str = "co2e") -> DataFrame:
    """AG-2: carbon footprint (sum of CO2e) per business unit."""
    return df.groupBy(unit).agg(
        F.sum(F.col(value).cast(RESULT)).cast("decimal(38,6)").alias("footprint"),
        F.count(F.lit(1)).alias("record_count"))
