"""Join helpers and sources."""

import pytest

from strata.operators.joins import declared_join, enrich, orphans
from strata.sources.readers import load_mapping_sheets, read_job_slice, read_target
from strata.spec import Lookup


def test_enrich_rejects_repeated_lookup_keys(spark):
    main = spark.createDataFrame([(1,), (2,)], "k int")
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        enrich(main, [Lookup(dup, "k", ["v"], name="dup")]).collect()
    uniq = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    got = sorted((r.k, r.v) for r in enrich(main, [Lookup(uniq, "k", ["v"])]).collect())
    assert got == [(1, "a"), (2, None)]


def test_left_join_keeps_rows_with_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,)], "k int")
    right = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    assert declared_join(left, right, "k", "left").count() == 2
    assert declared_join(left, right, "k").count() == 1  # INNER by default


def test_orphans(spark):
    child = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, parent int")
    parent = spark.createDataFrame([(10,)], "pid int")
    assert sorted(r.id for r in orphans(child, parent, "parent", "pid").collect()) == [2, 3]


def test_read_target_absent_is_empty_and_typed(spark, scratch):
    schema = "a int, b string"
    df = read_target(spark, scratch("absent"), spark.createDataFrame([], schema).schema)
    assert df.count() == 0 and df.columns == ["a", "b"]


def test_job_slice_trims_both_sides(spark):
    df = spark.createDataFrame([(" job-1 ",), ("job-2",), (None,)], "by string")
    assert read_job_slice(df, "by", "job-1  ").count() == 1


def test_mapping_sheet_drops_blank_rows_and_columns(spark, scratch):
    path = scratch("sheet")
    spark.createDataFrame([("a", None, "x"), (None, None, None), ("b", None, None)],
                          "`Target Column` string, Notes string, Transformation string") \
        .coalesce(1).write.option("header", "true").csv(path)
    df = load_mapping_sheets(spark, path)
    assert df.columns == ["Target Column", "Transformation"] and df.count() == 2


def test_mapping_sheets_written_by_other_programs(spark, scratch):
    import os
    path = scratch("sheets")
    local = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(local)
    with open(f"{local}/one.csv", "w") as f:
        f.write('Target Column,Transformation\r\na,"Concatenate(x, ""|"", y)"\r\nb,"two\nlines"\r\n,\r\n')
    with open(f"{local}/two.csv", "w") as f:
        f.write("Transformation,Source Table,Target Column\nDirect,orders,c\n")
    df = load_mapping_sheets(spark, path)
    got = sorted((r["Target Column"], r["Transformation"], r["Source Table"]) for r in df.collect())
    assert got == [("a", 'Concatenate(x, "|", y)', None), ("b", "two\nlines", None), ("c", "Direct", "orders")]


def test_a_thousand_sheets_in_one_scan(spark, scratch):
    import os
    path = scratch("many")
    local = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(local)
    for i in range(1000):
        with open(f"{local}/s{i:04}.csv", "w") as f:
            f.write(f"Target Column,own {i % 300},{'TRANSFORMATION' if i % 2 else 'Transformation'}\nt{i},v{i},Direct\n")
    df = load_mapping_sheets(spark, path)
    assert df.columns[:3] == ["Target Column", "own 0", "Transformation"] and len(df.columns) == 302
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and "Union" not in plan
    got = {r["Target Column"]: r for r in df.collect()}
    assert len(got) == 1000 and got["t717"]["own 117"] == "v717" and got["t717"]["own 118"] is None
    assert {r.Transformation for r in got.values()} == {"Direct"}


def test_sheet_texts():
    from strata.sources.sheets import parse_sheet
    assert parse_sheet('\ufeffa,,a,B\r\n1,2\r\n\r\n"",x,"q""q","l1\r\nl2",more\r\n') == (
        ["a0", "_c1", "a2", "B"], [["1", "2", None, None], ["", "x", 'q"q', "l1\nl2"]])
    assert parse_sheet(None) == parse_sheet("") == ([], []) and parse_sheet("a,b") == (["a", "b"], [])


def test_sheets_without_rows(spark, scratch):
    import os
    path = scratch("none")
    local = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(local)
    for name, text in (("a.csv", "x,y\n"), ("b.csv", "")):
        with open(f"{local}/{name}", "w") as f:
            f.write(text)
    assert load_mapping_sheets(spark, path).columns == []


def test_repeated_emission_lookup_is_refused(spark):
    from strata.operators.emissions import to_kwh, unit_table
    df = spark.createDataFrame([(1, "kWh")], "v int, u string").selectExpr("CAST(v AS DECIMAL(18,6)) AS v", "u")
    twice = unit_table(spark).union(unit_table(spark))
    assert to_kwh(df, "v", "u", unit_table(spark)).count() == 1
    with pytest.raises(Exception, match="not unique"):
        to_kwh(df, "v", "u", twice).collect()


def test_hierarchy_of_chains_rings_and_gaps(spark):
    import random

    from strata.operators.joins import hierarchy
    rng = random.Random(8)
    up = {i: None if i < 3 else rng.randrange(i) for i in range(200)}
    up |= {300 + i: 300 + (i + 1) % 7 for i in range(7)} | {400: 400} | {500 + i: 499 + i for i in range(1, 60)} | {500: 303}
    up |= {600: 999, 601: 600, 602: 601} | {700 + i: 701 + i for i in range(100)}          # a long chain into a gap
    want = {}
    for n in up:
        path, at = [n], up[n]
        while at is not None and at in up and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            want[n] = ("ok", path[-1], len(path) - 1)
        elif at not in up:
            want[n] = ("broken", at, len(path))
        else:
            ring = path[path.index(at):]
            want[n] = ("cycle" if at == n else "into_cycle", min(ring), None)
    df = spark.createDataFrame(list(up.items()), "id int, boss int").repartition(5)
    got = {r.id: (r.status, r.root, r.depth) for r in hierarchy(df, "id", "boss").collect()}
    assert got == want
    assert hierarchy(df.limit(0), "id", "boss").collect() == []
    with pytest.raises(Exception, match="not unique"):
        hierarchy(df.unionByName(df), "id", "boss").collect()
    assert [tuple(r) for r in hierarchy(df.where("id = 400"), "id", "boss").collect()] == [(400, "cycle", 400, None)]


def test_one_pass_fan_out(spark, scratch):
    from strata.sources.writers import fan_out_once
    from strata.spec import ColumnMapping as M
    from strata.spec import LoadSpec, TargetSpec
    df = spark.createDataFrame([(1, "a", "u"), (2, "b", None), (3, None, "u")], "k int, v string, updated_by string")
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    one = TargetSpec(LoadSpec("one", merge_type="append"), (M("v", "STRING", "v", transformation="Uppercase"), M("id", "STRING", transformation="Concatenate(v, k)")))
    two = TargetSpec(LoadSpec("two", merge_type="append"), (M("k", "BIGINT", "k", filter="k > 1"),), audit_passthrough=False)
    none = TargetSpec(LoadSpec("none", merge_type="append"), (M("k", "INT", "k", filter="v = 'x\\y'"),))
    outs = fan_out_once(df.mapInArrow(note, df.schema), [one, two, none], scratch("once"))
    assert seen.value == 3
    assert sorted(map(str, outs["one"].collect())) == sorted(map(str, spark.createDataFrame(
        [("A", "A1", "u"), ("B", "B2", None), (None, None, "u")], "v string, id string, updated_by string").collect()))
    assert sorted(r.k for r in outs["two"].collect()) == [2, 3] and outs["two"].columns == ["k"]
    assert outs["none"].collect() == []
    with pytest.raises(ValueError, match="dedupe"):
        fan_out_once(df, [TargetSpec(LoadSpec("d", merge_key=("k",)), one.mappings)], scratch("refused"))
