"""Connected components of a link table, as Spark joins and partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.session import materialize


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps whose results are written: it
    does so when the driver's JVM collects the plans that nobody holds any more, which else
    may be long after (spark.cleaner.periodicGC.interval is half an hour)."""
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(v, c): for every vertex of the links (a, b), the smallest vertex it can reach; with
    ``rounds``, a smaller one that it can reach by the end of so many rounds.

    Each round takes the least label among a vertex and its neighbours, then follows that
    label one step further, until no label changes. A hub's links meet their label in a
    shuffle join, which adaptive execution splits; minima are combined before the shuffle.
    Each round is written with checkpoint(), so a lost executor costs one round at most.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.filter("a <> b")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("v"), F.least("a", "m").alias("c")))
    while rounds is None or rounds > 0:
        rounds = rounds and rounds - 1
        near = (both.join(labels.withColumnRenamed("v", "b"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m")))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        further = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        after = materialize(step.join(further, "c")
                            .select("v", "old", F.least("c", "cc").alias("c")))
        if after.filter("c <> old").isEmpty():
            return after.select("v", "c")
        labels = after.select("v", "c")
    return labels
