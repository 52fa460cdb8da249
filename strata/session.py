"""Session helpers: a local session for tests/bench, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "strata", extra: dict | None = None) -> SparkSession:
    """A local-mode session configured like the cluster one (AQE on, UI off, UTC)."""
    parts = shuffle_partitions or (8 if cores == "*" else int(cores))
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.driver.bindAddress", "127.0.0.1")
         .config("spark.driver.memory", os.environ.get("STRATA_DRIVER_MEMORY", "16g"))
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")   # with the frames that read them
         .config("spark.sql.sources.partitionOverwriteMode", "dynamic"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must exist (a machine-local folder would not be visible to
    other executors). Only a local-mode session without it gets a fresh temporary folder,
    which also becomes its checkpoint dir.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strata-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new, unique path under the shared folder for one write."""
    return f"{shared_dir(spark)}/strata/{purpose}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: an eager, reliable ``checkpoint()`` into the shared checkpoint folder.

    Used where several jobs read one derived frame (a parsed corpus), so each plan starts
    from the written copy instead of re-deriving it; a lost executor re-reads the files.

    A checkpoint keeps the size that Spark estimated for its plan, and a join's estimate is
    the product of its sides'. Where each round joins the frames of the round before, the
    digits of that number would double or triple every round and fill the driver's memory.
    An estimate beyond that of a source of unknown size says no more than that one does
    (neither is broadcast), so it is forgotten here.
    """
    spark = df.sparkSession
    shared_dir(spark)
    df = df.checkpoint(eager=True)
    plan = df._jdf.logicalPlan()
    try:
        known = plan.stats().sizeInBytes() < 2**63 - 1       # spark.sql.defaultSizeInBytes
    except ValueError:                            # more digits than Python reads
        known = False
    if known:
        return df
    jvm = spark.sparkContext._jvm
    session = df._jdf.sparkSession()
    # the same rows, partitioning and order; no estimate
    plan = plan.copy(*[plan.productElement(i) for i in range(plan.productArity())],
                     session, jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), spark)
