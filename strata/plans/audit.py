"""Audit trail of loads (AU-1): typed events appended to a parquet table.

An event is written when a load starts (I), when its batch is prepared and the table is about
to change (P), on success (S) and on failure (F, before the error is re-raised). Events are a handful of rows per load; the log is read back as a
DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession

AUDIT_SCHEMA = ("table_name string, job_id string, status string, message string, "
                "row_count bigint, started_at timestamp_ntz, zone string")
# Audit statuses.
STATUSES = {"I": "in progress", "P": "processing", "S": "succeeded", "F": "failed"}


@dataclass(frozen=True)
class AuditEvent:
    table_name: str
    job_id: str
    status: str
    message: str
    row_count: int | None
    started_at: object
    zone: str = "UTC"


def append_audit(spark: SparkSession, path: str, events: Iterable[AuditEvent]) -> None:
    """Append events (status I/P/S/F) to the audit table at ``path``."""
    import datetime as dt

    rows = []
    for e in events:
        if e.status not in STATUSES:
            raise ValueError(f"audit status must be one of {sorted(STATUSES)}")
        ts = e.started_at if isinstance(e.started_at, dt.datetime) else \
            dt.datetime.fromisoformat(str(e.started_at))
        rows.append((e.table_name, e.job_id, e.status, e.message, e.row_count, ts, e.zone))
    spark.createDataFrame(rows, AUDIT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def audit_log(spark: SparkSession, path: str | None, event: AuditEvent,
              because: Exception | None = None) -> None:
    """Appends one event as it happens. When the load failed (``because``), trouble with the
    log is noted on the load's own error, which is the one to see."""
    if not path:
        return
    try:
        append_audit(spark, path, [event])
    except Exception as e:
        if because is None:
            raise
        because.add_note(f"the audit event could not be written either: {e}")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)
