"""Incremental silver load: bronze files arriving in a folder are loaded micro-batch by
micro-batch through the same silver plan (dedupe, mapping, stale filter, upsert).

``foreachBatch`` delivers each micro-batch at least once; the upsert on the merge key and
the strict stale filter make a replayed batch leave the table unchanged, so the target
ends in the same state as one batch load of all files. Progress is kept in a checkpoint
location under the shared folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strata.plans.silver import SilverJob, run_silver


def incremental_silver(spark: SparkSession, source_path: str, schema: T.StructType,
                       job: SilverJob, checkpoint: str, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream, whose progress is kept in ``checkpoint`` (the same folder at every
    start, so a restarted query goes on where it stopped); returns the StreamingQuery (``availableNow`` processes what is
    there and stops; otherwise it keeps polling the folder)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)

    def load(batch: DataFrame, batch_id: int) -> None:
        run_silver(batch.sparkSession, batch, job)

    writer = (stream.writeStream.foreachBatch(load)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()
