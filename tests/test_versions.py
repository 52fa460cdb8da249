"""Versioned tables: loads that are cut off, two writers, plain tables, what is read."""

import os

import pytest
from pyspark.sql import functions as F

from strata.operators.joins import drop_stale
from strata.plans.silver import SilverJob, run_silver
from strata.sources import fs, versions
from strata.sources.writers import (bucketed, buckets_in, overwrite_slice, publish_slice, read_buckets,
                                    upsert_buckets)
from strata.spec import ColumnMapping as M
from strata.spec import LoadSpec

SCHEMA = "k int, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, n=40, v="old"):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit(v).alias("v"))


def test_a_load_cut_off_between_partitions_leaves_the_old_table(spark, scratch, monkeypatch):
    """One bucket's task fails after the others are written, then the driver is lost after
    all of them and before the rename, then right after it."""
    path, frame = scratch("cut"), table(spark)
    upsert_buckets(spark, frame, path, frame.schema, ["k"], 4)
    old, new = rows(frame), table(spark, 60, "new")
    bad = new.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        upsert_buckets(spark, bad, path, frame.schema, ["k"], 4, prepared=True)
    assert rows(versions.read_table(spark, path).select("k", "v")) == old
    whole = versions.publish

    def lost_before(*_):
        raise KeyboardInterrupt

    def lost_after(*args):
        whole(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "publish", lost_before)
    with pytest.raises(KeyboardInterrupt):
        upsert_buckets(spark, new, path, frame.schema, ["k"], 4)
    assert rows(versions.read_table(spark, path).select("k", "v")) == old
    monkeypatch.setattr(versions, "publish", lost_after)
    with pytest.raises(KeyboardInterrupt):
        upsert_buckets(spark, new, path, frame.schema, ["k"], 4)
    monkeypatch.undo()
    assert rows(versions.read_table(spark, path).select("k", "v")) == rows(new)
    # the next load finds its way, and what was left behind can go
    upsert_buckets(spark, table(spark, 60, "again"), path, frame.schema, ["k"], 4)
    assert versions.vacuum(spark, path) >= 8
    assert rows(versions.read_table(spark, path).select("k", "v")) == rows(table(spark, 60, "again"))
    assert versions.vacuum(spark, path) == 0


@pytest.mark.parametrize("lost", [True, False])
def test_a_slice_overwrite_that_is_cut_off(spark, scratch, monkeypatch, lost):
    df = spark.createDataFrame([("a/b", 1, 1), ("c", 2, 2)], "p string, q int, x int")
    path = scratch("slice")
    versions.commit(spark, df, path, ["p", "q"])
    new = df.where("q = 1").withColumn("x", F.lit(9))
    if lost:
        monkeypatch.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            publish_slice(spark, new, path, {"q": 1, "p": "a/b"})
        monkeypatch.undo()
        assert rows(versions.read_table(spark, path)) == rows(df)
    assert rows(publish_slice(spark, new, path, {"q": 1, "p": "a/b"})) == [("a/b", 1, 9), ("c", 2, 2)]
    # its own old rows may be read, and an empty input clears
    own = versions.read_table(spark, path).where("q = 1").withColumn("x", F.col("x") + 1)
    overwrite_slice(own, path, {"p": "a/b", "q": 1})
    assert rows(versions.read_table(spark, path)) == [("a/b", 1, 10), ("c", 2, 2)]
    overwrite_slice(own.limit(0), path, {"p": "a/b", "q": 1})
    assert rows(versions.read_table(spark, path)) == [("c", 2, 2)]
    overwrite_slice(own.limit(0), path, {"p": "c", "q": 2})
    assert rows(versions.read_table(spark, path)) == [] and versions.read_table(spark, path).columns == df.columns


def test_two_writers(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    path = scratch("two")
    base = versions.commit(spark, df, path, ["k"])
    one, two = df.where("k = 1").withColumn("v", F.lit("one")), df.where("k = 2").withColumn("v", F.lit("two"))
    versions.commit(spark, one, path, ["k"], base=base, written=True)
    versions.commit(spark, two, path, ["k"], base=base, written=True)     # another partition: on top
    assert rows(versions.read_table(spark, path)) == [(1, "one"), (2, "two")]
    with pytest.raises(versions.ConcurrentLoad):
        versions.commit(spark, one, path, ["k"], base=base, written=True)
    with pytest.raises(versions.ConcurrentLoad):
        versions.commit(spark, one, path, ["k"], versions.ALL, base)
    with pytest.raises(FileExistsError):
        versions.publish(spark, path, versions.Version(1, df.schema, ("k",), ()))
    versions.commit(spark, df, path, ["k"], base=base)                    # an append never clashes
    assert versions.read_table(spark, path).count() == 4
    assert rows(versions.read(spark, path, base)) == rows(df)             # an old version still reads
    with pytest.raises(ValueError, match="partitioned"):
        versions.commit(spark, df, path, ["v"], base=base)


def test_a_plain_table_is_taken_over_where_it_lies(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    path = scratch("plain")
    df.write.partitionBy("k").parquet(path)
    versions.adopt(spark, path, df.schema, ["k"])
    overwrite_slice(df.where("k = 2").withColumn("v", F.lit("new")), path, {"k": 2})
    assert rows(versions.read_table(spark, path).select("k", "v")) == [(1, "a"), (2, "new")]
    flat = scratch("flat")
    df.write.parquet(flat)
    job = SilverJob(LoadSpec("t", merge_key=("k",)), [M("k", "INT", "k"), M("v", "STRING", "v")], flat, "2024-01-01 00:00:00", "j")
    out = run_silver(spark, spark.createDataFrame([(2, "z"), (3, "c")], SCHEMA), job)
    assert rows(out.table.select("k", "v")) == [(1, "a"), (2, "z"), (3, "c")]


def test_columns_may_be_added_but_not_change(spark, scratch):
    path = scratch("wider")
    versions.commit(spark, spark.createDataFrame([(1, "a")], SCHEMA), path)
    versions.commit(spark, spark.createDataFrame([(2, 5)], "k int, w int"), path)
    assert rows(versions.read_table(spark, path).where("k = 2")) == [(2, None, 5)]
    with pytest.raises(ValueError, match="column k"):
        versions.commit(spark, spark.createDataFrame([("x",)], "k string"), path)


def test_other_buckets_are_refused(spark, scratch):
    path, frame = scratch("layout"), table(spark)
    upsert_buckets(spark, frame, path, frame.schema, ["k"], 4)
    with pytest.raises(ValueError, match="buckets"):
        upsert_buckets(spark, frame, path, frame.schema, ["k"], 8)


def scanned(df):
    """Files that the plan's scans read."""
    return {f for f in df.inputFiles()}


def test_the_stale_filter_reads_the_batchs_buckets_alone(spark, scratch):
    """Few keys touch few of 16 buckets; the target is reduced by their keys before it is grouped."""
    path = scratch("stale")
    frame = spark.range(400).selectExpr("CAST(id AS INT) AS k", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts")
    upsert_buckets(spark, frame, path, frame.schema, ["k"], 16)
    batch = spark.createDataFrame([(5,), (6,)], "k int").selectExpr("k", "TIMESTAMP_NTZ'2024-02-01 00:00:00' AS ts")
    base = bucketed(spark, path, frame.schema, ["k"], 16)
    touched = buckets_in(batch, ["k"], 16)
    assert 1 <= len(touched) <= 2
    target = read_buckets(spark, path, base, frame.schema, touched)
    assert {f.split("__bucket=")[1].split("/")[0] for f in scanned(target)} == {str(b) for b in touched}
    out = drop_stale(batch, target, ["k"], "ts")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi")    # the reduction lies below
    assert rows(out.select("k")) == [(5,), (6,)]


def test_a_bucketed_silver_load_reads_only_touched_buckets(spark, scratch, monkeypatch):
    import strata.plans.silver as silver
    path, seen = scratch("silver"), []
    spec = LoadSpec.from_metadata("t", {
        "merge_key": "k", "merge_type": "upsert", "source_deduplication": "Y", "source_partitionBy_columns": "k",
        "source_orderBy_columns": "ts desc", "stale_data_handling": "Y", "target_join_columns": "k",
        "target_audit_columns": "ts"})

    def load(sql, ts):
        job = SilverJob(spec, [M("k", "INT", "k"), M("ts", "TIMESTAMP_NTZ", "ts")], path, ts, "j", buckets=16)
        return run_silver(spark, spark.sql(sql), job)

    load("SELECT CAST(id AS INT) AS k, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts FROM range(300)", "2024-01-01 00:00:00")
    whole = silver.drop_stale
    monkeypatch.setattr(silver, "drop_stale", lambda src, target, *a: seen.append(scanned(target)) or whole(src, target, *a))
    out = load("SELECT * FROM VALUES (7, TIMESTAMP_NTZ'2024-03-01 00:00:00'), (8, TIMESTAMP_NTZ'2023-03-01 00:00:00') AS v(k, ts)",
               "2024-03-01 00:00:00")
    assert tuple(out.stats.first()) == (300, 0, 1, 299)          # the older row is stale
    assert len({f.split("__bucket=")[1].split("/")[0] for f in seen[0]}) <= 2
    assert os.path.basename(path) and not fs.siblings(spark, f"{path}/_versions/.draft-*")


def counted(spark, df):
    """The frame, and a counter of the rows of it that were made."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(note, df.schema), seen


def test_rules_are_counted_while_a_load_is_written(spark, scratch):
    """The emissions load evaluates its source once; its report and stamp come from that pass."""
    from strata.catalog.q_emissions import activity, defaults, factors
    from strata.operators.emissions import unit_table
    from strata.operators.quality import rule_in_set, rule_max, rule_negative, rule_range, rule_results
    from strata.plans.emissions import EmissionsJob, run_emissions
    source = activity(spark, "/root/testdata/sf0.001")
    n, (frame, seen) = source.count(), counted(spark, source)
    job = EmissionsJob(scratch("emissions"), "2024-06-30 12:00:00", "IPCC", unit_table(spark), factors(spark), defaults(spark))
    out = run_emissions(spark, frame, job)
    assert seen.value == n
    want = rule_results(source, [rule_negative("emissions_value"), rule_range("emission_factor"), rule_max("energy_consumption"),
                                 rule_in_set("scope_category")])
    report = out.report.first().asDict()
    assert {k: report[k] for k in want} == {k: v[0] for k, v in want.items()} and report["total_records"] == n
    stamp = out.table.select("quality_score", "ghg_compliance_status").distinct().collect()
    assert [tuple(r) for r in stamp] == [(100 - sum(v[0] > 0 for v in want.values()), report["compliant"])]
    assert out.table.where("processing_timestamp is null").count() == 0
    # a second load replaces the first, an empty one clears it
    again = run_emissions(spark, source.limit(50), job)
    assert again.table.count() == 50
    none = run_emissions(spark, source.limit(0), job)
    assert none.table.count() == 0 and none.report.first().total_records == 0


def test_quarantine_counts_its_rules_in_the_write(spark, scratch):
    from strata.operators.quality import quarantine_counted, rule_max, rule_negative
    df, seen = counted(spark, spark.createDataFrame([(1, -1.0), (2, 5.0), (3, 50.0), (4, None)], "id int, v double"))
    rules = [rule_negative("v"), rule_max("v", 10)]
    good, bad, results = quarantine_counted(df, rules, scratch("counted"))
    assert seen.value == 4 and {k: (v[0], v[2]) for k, v in results.items()} == {r.rule_id: (1, 4) for r in rules}
    assert good.count() == bad.count() == 2
    *_, empty = quarantine_counted(df.where("id > 9").limit(0), rules, scratch("counted_none"))
    assert {v[2] for v in empty.values()} == {0}


def test_constants_of_loads(spark, scratch):
    path = scratch("constants")
    df = spark.createDataFrame([(1, 3, "x"), (2, -4, "y")], "k int, v int, w string")

    def load(frame, label):
        measures = versions.Measures({"n": F.count(F.lit(1)), "low": F.min("v")}, ["v"],
                                     lambda seen: {"label": (label, "string"), "low": (seen["low"], "int")})
        return versions.commit_measured(spark, frame, path, ["k"], measures=measures)[1]

    assert load(df, "a") == {"n": 2, "low": -4} and load(df.where("k = 1"), "b") == {"n": 1, "low": 3}
    assert rows(versions.read_table(spark, path)) == [(1, "x", "a", -4), (1, "x", "b", 3), (2, "y", "a", -4)]
