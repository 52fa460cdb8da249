"""Properties of loads: upsert twice = once, stale filter idempotent, slice isolation."""

import pytest
from pyspark.sql import functions as F

from strata.operators.dedupe import latest_by_key
from strata.operators.joins import drop_stale
from strata.plans.audit import read_audit
from strata.plans.silver import SilverJob, run_silver, run_silver_targets
from strata.sources.versions import read_table
from strata.sources.writers import (check_keys, commit_table, overwrite_slice, publish_slice,
                                    restore_table, upsert, write_partitioned)
from strata.spec import ColumnMapping as M
from strata.spec import LoadSpec

TDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def latest(spark):
    li = spark.read.parquet(f"{TDATA}/lineitem.parquet")
    return latest_by_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate desc"])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dedupe_one_row_per_key(latest):
    assert latest.count() == latest.select("l_orderkey", "l_linenumber").distinct().count()


def test_ties_in_nested_columns_are_broken(spark):
    rows_ = [(1, [2, 1], {"b": 1}), (1, [1, 9], {"z": 1}), (1, [1, 9], {"a": 3, "y": 0})]
    for order in (rows_, rows_[::-1]):
        df = spark.createDataFrame(order, "k int, a array<int>, m map<string,int>").repartition(3)
        assert latest_by_key(df, ["k"], []).first().m == {"a": 3, "y": 0}


def test_upsert_twice_equals_once(spark, latest, scratch):
    path = scratch("upsert")
    keys = ["l_orderkey", "l_linenumber"]
    base = commit_table(spark, latest.where("l_shipdate < '2000-01-01'"), path)
    src = latest.where("l_shipdate >= '1999-01-01'").withColumn("l_tax", F.lit(0.5))
    once = commit_table(spark, upsert(base, src, keys), path)
    once_rows = rows(once)
    assert len(once_rows) == latest.count()
    twice = commit_table(spark, upsert(spark.read.parquet(path), src, keys), path)
    assert rows(twice) == once_rows


def test_upsert_rejects_repeated_or_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    for bad in (df, df.where("k IS NULL"), df.where("k = 1")):
        with pytest.raises(ValueError, match="NULL or repeated keys"):
            check_keys(bad, ["k"])
    check_keys(df.where("v = 'a'"), ["k"])
    check_keys(df.where("k = 1"), ["k", "v"])


def test_stale_filter_on_its_own_output_is_empty(spark):
    ev = spark.read.parquet(f"{TDATA}/events.parquet")
    target = ev.where("ts < '2024-01-16'")
    passed = drop_stale(ev, target, ["user_id", "event_type"], "ts")
    newest = latest_by_key(passed, ["user_id", "event_type"], ["ts desc"])
    assert drop_stale(newest, newest, ["user_id", "event_type"], "ts").count() == 0
    assert passed.where("ts < '2024-01-16'").count() == 0 or target.count() == 0


def test_stale_rule_edges(spark):
    src = spark.createDataFrame(
        [(1, "2024-01-02 00:00:00"), (1, "2024-01-01 00:00:00"), (2, None), (None, "2024-01-05 00:00:00"),
         (3, "1969-12-31 00:00:00")], "k int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    tgt = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2023-01-01 00:00:00")],
                                "k int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = sorted((str(r.k), str(r.ts)) for r in drop_stale(src, tgt, ["k"], "ts").collect())
    # equal time is stale, NULL time never passes, NULL key never matches, pre-1970 fails
    assert out == [("1", "2024-01-02 00:00:00"), ("None", "2024-01-05 00:00:00")]


def test_slice_overwrite_isolation_and_clear(spark, scratch):
    orders = spark.read.parquet(f"{TDATA}/orders.parquet")
    path = scratch("slices")
    orders.write.partitionBy("o_orderstatus", "o_orderpriority").parquet(path)
    schema = orders.schema
    before = spark.read.schema(schema).parquet(path)
    others = rows(before.where("NOT (o_orderstatus = 'F' AND o_orderpriority = '2-HIGH')"))
    staged = scratch("slice_stage")
    before.where("o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'") \
        .withColumn("o_totalprice", F.lit(1.0)).write.parquet(staged)
    overwrite_slice(spark.read.parquet(staged), path, {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"})
    after = spark.read.schema(schema).parquet(path)
    assert rows(after.where("NOT (o_orderstatus = 'F' AND o_orderpriority = '2-HIGH')")) == others
    assert {r.o_totalprice for r in after.where("o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'")
            .collect()} == {1.0}
    overwrite_slice(after.where(F.lit(False)), path, {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"})
    assert spark.read.schema(schema).parquet(path) \
        .where("o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'").count() == 0


def test_slice_guard_rejects_rows_outside(spark, scratch):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "s string, v int")
    with pytest.raises(ValueError):
        overwrite_slice(df, scratch("guard"), {"s": "A"})


def test_slice_values_keep_their_names_and_types(spark, scratch):
    df = spark.createDataFrame([("001", "x/y =%", 1), ("002", "plain", 2)], "v string, n string, x int")
    path = scratch("typed")
    df.write.partitionBy("v", "n").parquet(path)
    odd = {"n": "x/y =%", "v": "001"}                    # in another order than the directories
    out = publish_slice(spark, df.where("v = '001'").withColumn("x", F.lit(7)), path, odd)
    assert rows(out) == [("001", "x/y =%", 7), ("002", "plain", 2)]
    overwrite_slice(df.where(F.lit(False)), path, odd)
    assert rows(spark.read.schema(df.schema).parquet(path).select(*df.columns)) == [("002", "plain", 2)]
    with pytest.raises(ValueError, match="partition"):
        overwrite_slice(df.where("v = '002'"), path, {"v": "002"})


def test_overwrite_drops_old_partitions(spark, scratch):
    df = spark.createDataFrame([(2020, 1), (2021, 2)], "y int, x int")
    path = scratch("static")
    write_partitioned(df, path, ["y"])
    assert rows(write_partitioned(df.where("y = 2021"), path, ["y"])) == [(2021, 2)]


def test_table_survives_a_crash_between_the_renames(spark, scratch):
    from strata.sources import fs
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = scratch("crash")
    commit_table(spark, df, path)
    fs.rename(spark, path, f"{path}.__old-0123456789ab")  # what a lost driver leaves behind
    df.limit(0).write.parquet(f"{path}.__staging-0123456789ab")
    job = SilverJob(LoadSpec("t", merge_key=("k",)), [M("k", "INT", "k"), M("v", "STRING", "v")],
                    path, "2024-01-01 00:00:00", "j")
    with pytest.raises(ValueError):
        run_silver(spark, df, SilverJob(LoadSpec("t", merge_key=("k",), merge_type="merge"), job.mappings, path,
                                        job.load_ts, "j"))
    restore_table(spark, path)
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    assert not fs.siblings(spark, f"{path}.__*")


def silver(spark, path, frame, key="k", **kw):
    spec = LoadSpec("t", merge_key=(key,) if key else (), merge_type=kw.pop("merge_type", "upsert"))
    return run_silver(spark, frame, SilverJob(spec, [M("k", "INT", "k"), M("v", "INT", "v")], path,
                                              kw.pop("ts", "2024-01-01 00:00:00"), "j", **kw))


def test_silver_refuses_what_it_does_not_know(spark, scratch):
    df = spark.createDataFrame([(1, 1)], "k int, v int")
    path = scratch("merge_type")
    silver(spark, path, df)
    with pytest.raises(ValueError, match="merge_type"):
        silver(spark, path, df, merge_type="merge")
    assert read_table(spark, path).count() == 1
    with pytest.raises(ValueError, match="NULL or repeated"):
        silver(spark, scratch("null_key"), spark.createDataFrame([(None, 1)], "k int, v int"))
    with pytest.raises(ValueError, match="one column"):
        LoadSpec.from_metadata("t", {"target_audit_columns": "a, b"})


def test_silver_statistics_of_an_upsert(spark, scratch):
    path = scratch("stats")
    silver(spark, path, spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"))
    out = silver(spark, path, spark.createDataFrame([(2, 5), (3, 3)], "k int, v int"), ts="2024-02-01 00:00:00")
    assert tuple(out.stats.first()) == (3, 1, 1, 1)
    assert {r.k: (r.v, str(r.created_time)[:7]) for r in out.table.collect()} == {
        1: (1, "2024-01"), 2: (5, "2024-01"), 3: (3, "2024-02")}


def test_upsert_leaves_untouched_buckets_alone(spark, scratch):
    import os
    path = scratch("buckets")
    local = path.removeprefix("file://").removeprefix("file:")

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(local) for f in names if f.endswith(".parquet")}

    silver(spark, path, spark.range(200).selectExpr("CAST(id AS INT) AS k", "0 AS v"), buckets=8)
    before = files()
    out = silver(spark, path, spark.createDataFrame([(5, 1), (500, 2)], "k int, v int"), ts="2024-02-01 00:00:00", buckets=8)
    assert tuple(out.stats.first()) == (201, 1, 1, 199)
    assert len({f.rsplit("/", 2)[1] for f in before - files()}) <= 2 and before & files()
    again = silver(spark, path, spark.createDataFrame([(5, 1), (500, 2)], "k int, v int"), ts="2024-02-01 00:00:00", buckets=8)
    assert tuple(again.stats.first()) == (201, 1, 1, 199)


def test_append_keeps_old_files(spark, scratch):
    import os
    path = scratch("append")
    silver(spark, path, spark.createDataFrame([(1, 1)], "k int, v int"), key=None, merge_type="append")
    local = path.removeprefix("file://").removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(local) for f in names if f.endswith(".parquet")}
    before = files()
    silver(spark, path, spark.createDataFrame([(1, 1)], "k int, v int"), key=None, merge_type="append")
    assert before < files()
    assert read_table(spark, path).count() == 2


def test_rejected_values_are_quarantined(spark, scratch):
    df = spark.createDataFrame([(1, "7"), (2, "x"), (3, None)], "k int, v string")
    out = silver(spark, scratch("reject"), df, policy="reject")
    assert {r.k: r.v for r in out.table.collect()} == {1: 7, 3: None}
    assert [(r.k, r.failed_rules) for r in out.quarantined.collect()] == [(2, ["rejected_cast"])]


def test_audit_start_is_seen_before_the_load_fails(spark, scratch):
    audit = scratch("audit")
    with pytest.raises(ValueError):
        silver(spark, scratch("audited"), spark.createDataFrame([(1, 1)], "k int, v int"), merge_type="x", audit_path=audit)
    assert sorted(r.status for r in read_audit(spark, audit).collect()) == ["F", "I"]


def test_mapping_filter_is_applied_and_joins_are_refused(spark, scratch):
    df = spark.createDataFrame([(1, 1), (2, 9)], "k int, v int")
    job = SilverJob(LoadSpec("t", merge_type="append"), [M("k", "INT", "k", filter="v > 5")], scratch("filter"),
                    "2024-01-01 00:00:00", "j")
    assert [r.k for r in run_silver(spark, df, job).table.collect()] == [2]
    job.mappings = [M("k", "INT", "k", join_condition="a.x = b.x")]
    with pytest.raises(ValueError, match="join"):
        run_silver(spark, df, job)


def test_several_targets_and_the_job_slice(spark, scratch):
    df = spark.createDataFrame([(1, 1, "j "), (2, 2, "other"), (1, 3, "j")], "k int, v int, updater string")
    one = SilverJob(LoadSpec("one", merge_key=("k",), order_by=(("v", "desc"),)), [M("k", "INT", "k"), M("v", "INT", "v")],
                    scratch("one"), "2024-01-01 00:00:00", "j", slice_column="updater")
    two = SilverJob(LoadSpec("two", merge_type="append", source_deduplication=True, source_partition_by=("k",),
                             source_order_by=(("v", "asc"),)), [M("k", "INT", "k"), M("v", "INT", "v")],
                    scratch("two"), "2024-01-01 00:00:00", "j")
    out = run_silver_targets(spark, df, [one, two])
    assert rows(out["one"].table.select("k", "v")) == [(1, 3)] and out["one"].shape == "multi"
    assert rows(out["two"].table.select("k", "v")) == [(1, 1), (2, 2)] and out["two"].shape == "multi_dedupe"


def test_quarantine_write_matches_filter_split(spark, scratch):
    from strata.operators.quality import quarantine, quarantine_write, rule_max, rule_negative
    df = spark.createDataFrame([(1, -1.0), (2, 5.0), (3, 50.0), (4, None)], "id int, v double")
    rules = [rule_negative("v"), rule_max("v", 10)]
    good1, bad1 = quarantine(df, rules)
    good2, bad2 = quarantine_write(df, rules, scratch("quarantine"))
    assert sorted(r.id for r in good1.collect()) == sorted(r.id for r in good2.collect()) == [2, 4]
    assert sorted((r.id, tuple(r.failed_rules)) for r in bad2.collect()) == \
        sorted((r.id, tuple(r.failed_rules)) for r in bad1.collect())
