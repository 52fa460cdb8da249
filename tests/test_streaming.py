"""The streamed silver load ends in the same state as the batch load of all files."""

from strata.catalog.q_pipelines import EVENT_LOAD, EVENT_MAPPING
from strata.plans.silver import SilverJob, run_silver
from strata.sources.versions import read_table
from strata.streaming.incremental import incremental_silver

TDATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, scratch):
    ev = spark.read.parquet(f"{TDATA}/events.parquet")
    src = scratch("stream_src")
    # two arrival batches, the second also replays some rows of the first
    ev.where("ts < '2024-01-16'").write.parquet(f"{src}/part=1")
    ev.where("ts >= '2024-01-10'").write.parquet(f"{src}/part=2")
    streamed = scratch("stream_target")
    job = SilverJob(EVENT_LOAD, EVENT_MAPPING, streamed, "2024-06-30 12:00:00", "job-s")
    q = incremental_silver(spark, f"{src}/*", ev.schema, job, scratch("ckpt"), max_files_per_trigger=1)
    q.awaitTermination(300)
    batch = scratch("batch_target")
    run_silver(spark, ev, SilverJob(EVENT_LOAD, EVENT_MAPPING, batch, "2024-06-30 12:00:00", "job-s"))
    cols = ["user_id", "event_type", "ts", "amount", "kind"]
    got = sorted(tuple(r) for r in read_table(spark, streamed).select(*cols).collect())
    want = sorted(tuple(r) for r in read_table(spark, batch).select(*cols).collect())
    assert got == want and len(got) > 0


def test_failed_load_writes_f_event(spark, scratch):
    import pytest

    from strata.plans.audit import read_audit
    from strata.spec import LoadSpec
    ev = spark.read.parquet(f"{TDATA}/events.parquet")
    audit = scratch("audit_fail")
    bad = SilverJob(LoadSpec("no_key", merge_type="upsert"), EVENT_MAPPING, scratch("t"),
                    "2024-06-30 12:00:00", "job-f", audit_path=audit)
    with pytest.raises(ValueError, match="merge_key"):
        run_silver(spark, ev, bad)
    got = sorted((r.status, r.table_name) for r in read_audit(spark, audit).collect())
    assert got == [("F", "no_key"), ("I", "no_key")]
