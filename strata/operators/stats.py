"""Load and run statistics (AG-3..AG-7).

Sums are taken in DECIMAL (exact, order-independent) and ratios derived from them, so a
rerun with a different partitioning returns the same digits. Every aggregate is
algebraic (partial aggregation before the shuffle) except the median, which is computed
by counting over range-partitioned values so no group's values sit in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import materialize


def load_stats(df: DataFrame, load_ts, created: str = "created_time",
               updated: str = "updated_time") -> DataFrame:
    """AG-3: rows in the table and how this load (``load_ts``) touched them."""
    ts = F.lit(load_ts).cast("timestamp_ntz")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(created) == ts).alias("inserted"),
        F.count_if((F.col(updated) == ts) & (F.col(created) < ts)).alias("updated"),
        F.count_if(F.col(updated) < ts).alias("unchanged"))


def round_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """``num / den`` rounded half away from zero to ``digits`` places as DECIMAL(38, digits),
    by DECIMAL division, so every partitioning gives the same digits."""
    quotient = num.cast("decimal(38,10)") / den.cast("decimal(20,0)")
    return F.round(quotient, digits).cast(f"decimal(38,{digits})")


def exact_median(df: DataFrame, by: Sequence[str], value: str,
                 partitions: int | None = None) -> DataFrame:
    """Exact median of ``value`` per group, skew-safe.

    1. count rows per (group, value) - partial aggregation shrinks repeats;
    2. range-partition by (group, value) so a large group is spread over many tasks, and
       take running counts inside each (group, task);
    3. per (group, task) totals (a small table) give each task's rank offset;
    4. the rows holding rank floor((n+1)/2) and floor(n/2)+1 give the median.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__m"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: both branches below must see the same ranges, also when Spark would
    # compute the shuffle twice or run a lost task again
    ranged = materialize(counts.repartitionByRange(n, *by, value)
                         .withColumn("__p", F.spark_partition_id()))
    local = Window.partitionBy(*by, "__p").orderBy(value) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.withColumn("__cum", F.sum("__m").over(local))
    per_task = ranged.groupBy(*by, "__p").agg(F.sum("__m").alias("__pn"))
    before = Window.partitionBy(*by).orderBy("__p") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_task = per_task.select(
        *by, "__p", (F.sum("__pn").over(before) - F.col("__pn")).alias("__off"),
        F.sum("__pn").over(Window.partitionBy(*by)).alias("__n"))
    j = ranged.join(per_task, [*by, "__p"])
    hi = F.col("__off") + F.col("__cum")
    lo = hi - F.col("__m") + 1
    k1 = F.floor((F.col("__n") + 1) / 2)
    k2 = F.floor(F.col("__n") / 2) + 1
    picked = j.where(((k1 >= lo) & (k1 <= hi)) | ((k2 >= lo) & (k2 <= hi)))
    return picked.groupBy(*by).agg(
        ((F.max(F.when((k1 >= lo) & (k1 <= hi), F.col(value))).cast("double")
          + F.max(F.when((k2 >= lo) & (k2 <= hi), F.col(value))).cast("double")) / 2)
        .alias("median"))


def run_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """AG-4: count, mean, median, min, max, sample stddev and variance per group.

    Values are taken as they are. For a DECIMAL column the sums of the unscaled values u and
    u^2 are exact, so mean and variance do not depend on the partitioning; where those sums
    leave 38 digits, and for other column types, Spark's double-precision aggregates stand
    in. Standard deviation and variance are 0 for a single value (not NULL).
    """
    by = list(by)
    v, kind = F.col(value), df.schema[value].dataType
    n = F.count(v)
    mean, var = F.avg(v.cast("double")), F.var_samp(v.cast("double"))
    if isinstance(kind, T.DecimalType):
        unit = 10 ** kind.scale
        u = (v.cast(f"decimal(38,{kind.scale})") * F.lit(unit).cast("decimal(38,0)")).cast("decimal(38,0)")
        s1, s2 = F.try_sum(u), F.try_sum(F.try_multiply(u, u).try_cast("decimal(38,0)"))
        spread = F.try_subtract(F.try_multiply(n.cast("decimal(20,0)"), s2), F.try_multiply(s1, s1))
        mean = F.coalesce(s1.cast("double") / n / float(unit), mean)
        var = F.coalesce(spread.cast("double") / (n * (n - 1)).cast("double") / float(unit) / float(unit), var)
    basic = df.groupBy(*by).agg(
        n.alias("count"), F.when(n > 0, mean).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.when(n > 1, F.sqrt(var)).otherwise(F.lit(0.0)).alias("std_dev"),
        F.when(n > 1, var).otherwise(F.lit(0.0)).alias("variance"))
    return basic.join(exact_median(df, by, value), by, "left")


def outcome_rates(df: DataFrame, by: Sequence[str], success: Column,
                  attempts: Column | None = None) -> DataFrame:
    """AG-5: total, successes, failures, success % (denominator at least 1) and average
    attempts, both rounded half-up to 2 places."""
    total = F.count(F.lit(1))
    ok = F.count_if(success)
    cols = [total.alias("total"), ok.alias("successes"), (total - ok).alias("failures"),
            round_ratio(ok * 100, F.greatest(total, F.lit(1)), 2).alias("success_pct")]
    if attempts is not None:
        total_of = F.coalesce(F.sum(attempts.cast("decimal(28,10)")), F.lit(0).cast("decimal(38,10)"))
        cols.append(round_ratio(total_of, F.greatest(F.count(attempts), F.lit(1)), 2)
                    .alias("avg_attempts"))
    return df.groupBy(*by).agg(*cols)


def compare_groups(df: DataFrame, by: Sequence[str], version: str, a: str, b: str,
                   metrics: Sequence[str]) -> DataFrame:
    """AG-6: per group, mean of each metric under version ``a`` and ``b``, their absolute
    difference and percent improvement ``(a - b) / a * 100``; one pass (conditional
    aggregation), NULL when ``a`` is missing or zero."""
    cols = []
    for m in metrics:
        kind = df.schema[m].dataType           # exact sums of DECIMAL metrics, none cut
        dec = F.col(m).cast(f"decimal(38,{kind.scale})" if isinstance(kind, T.DecimalType) else "double")
        for tag, ver in (("a", a), ("b", b)):
            hit = F.col(version) == ver
            cols.append((F.sum(F.when(hit, dec)).cast("double")
                         / F.count(F.when(hit, F.col(m)))).alias(f"{m}_{tag}"))
    out = df.groupBy(*by).agg(*cols)
    extra = []
    for m in metrics:
        ca, cb = F.col(f"{m}_a"), F.col(f"{m}_b")
        extra += [F.abs(ca - cb).alias(f"{m}_diff"),
                  (F.try_divide(ca - cb, ca) * 100).alias(f"{m}_improvement_pct")]
    return out.select("*", *extra)


def latest_per_group(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """AG-7: the newest row per group; equal times are broken by the other columns
    (largest first), so the pick is deterministic. One ``max(struct)`` aggregate with
    partial aggregation, so a large group is reduced before the shuffle."""
    by = list(by)
    rest = [c for c in df.columns if c not in by and c != ts]
    picked = df.groupBy(*by).agg(F.max(F.struct(ts, *rest)).alias("__s"))
    return picked.select(*by, *[F.col(f"__s.{c}").alias(c) for c in [ts, *rest]])
