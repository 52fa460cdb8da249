"""Steps whose tasks must not grow with their input: what each task holds, reads or repeats."""

import random

import pytest
from pyspark.sql import functions as F

from strata.sources import sheets


def sheet_texts():
    rng = random.Random(3)
    cell = lambda: rng.choice(["", '""', "x", "два", '"a,b"', '"l1\nl2"', '"l1\r\nl2\r\nl3"', '"q""q\n\n"', " y "])
    body = lambda end, n: end.join(",".join(cell() for _ in range(rng.randint(1, 4))) for _ in range(n))
    return {"a": "k,v,w\n" + body("\n", 900) + "\n", "b": "﻿V,K\r\n" + body("\r\n", 700),
            "c": "k,k\r1,2\r3,4\r", "d": 'k,v\n1,"open\n', "e": 'k,v\n1,"open', "f": "", "g": "\n\nk\n\n5\n"}


def test_sheets_cut_line_by_line_are_those_cut_whole(spark, scratch):
    import os
    texts, path = sheet_texts(), scratch("lines")
    local = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(local)
    for name, text in texts.items():
        with open(f"{local}/{name}.csv", "w", newline="", encoding="utf-8") as f:
            f.write(text)
    want = {}
    for name, text in texts.items():
        names, rows = sheets.parse_sheet(text)
        want |= {(name, i): (names, cells) for i, cells in enumerate(rows)}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")   # a sheet's lines come from many splits
    try:
        got = sheets.read_sheets(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(got) == len(want)
    assert {(r.sheet.rsplit("/", 1)[1][:-4], r.row): (r.names, r.cells) for r in got} == want


def test_rows_of_a_sheet_leave_before_all_of_it_is_read():
    import pyarrow as pa
    read = []

    def lines():
        for i in range(50):
            read.append(i)
            values = ["k,v"] if i == 0 else [f"{i},x"] * 1000
            yield pa.RecordBatch.from_pydict({"sheet": ["s"] * len(values), "value": values, "size": [0] * len(values)})

    made = sheets._parsed(lines())
    first = next(made)
    assert len(read) < 10 and first.num_rows < 10_000
    assert first.num_rows + sum(b.num_rows for b in made) == 49_000


@pytest.mark.parametrize("step", ["to_kwh", "to_co2e", "fill_factor", "scope_of"])
def test_activities_are_not_dealt_by_unit_or_fuel(spark, step):
    from strata.catalog.q_emissions import SCOPE_RULES, defaults, factors
    from strata.operators import emissions as em
    odd = F.col("id") % 2 == 1
    df = spark.range(10).select(F.when(odd, "kWh").otherwise("GJ").alias("unit"), F.when(odd, "diesel").otherwise("?").alias("fuel"), F.lit(2).cast("decimal(18,6)").alias("energy"),
                                F.lit(None).cast("decimal(18,6)").alias("factor"), F.lit(None).cast("string").alias("scope"))
    rules = spark.createDataFrame(list(SCOPE_RULES), "fuel_type string, scope string")
    out = {"to_kwh": lambda: em.to_kwh(df, "energy", "unit", em.unit_table(spark)),
           "to_co2e": lambda: em.to_co2e(df, "energy", "fuel", factors(spark)),
           "fill_factor": lambda: em.fill_factor(df, "fuel", "factor", defaults(spark)),
           "scope_of": lambda: em.scope_of(df, "scope", "fuel", rules)}[step]()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.count() == 10


def test_documents_of_one_small_file_are_read_by_many_tasks(spark, scratch):
    from strata.catalog.q_lint import mapping_docs, mapping_rows
    sf = scratch("parts")
    spark.range(400).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n"), "id").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
                            F.lit("SMALL").alias("p_type"), F.lit(5).alias("p_size")).coalesce(1).write.parquet(f"{sf}/part.parquet")
    docs = mapping_docs(spark, sf)
    tasks = docs.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in tasks) == 400
    assert mapping_rows(spark, sf).select(F.spark_partition_id()).distinct().count() == len(tasks)


def test_a_cell_is_searched_once_for_unknown_terms(spark):
    from strata.operators.lint import unknown_terms
    rows = spark.createDataFrame([(1, "t", "c", 1, "Trim; Frob(a)"), (2, "t", "c", 1, "Trim"), (3, "t", "c", 1, None)],
                                 "doc_id int, target_table string, target_column string, source_ord int, transformation string")
    out = unknown_terms(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("default\\s*value") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "t", "c", 1, 2, "Frob(...)")]


def test_the_upsert_reads_what_the_stale_filter_has_written(spark, scratch, monkeypatch):
    from strata.plans.silver import SilverJob, run_silver
    from strata.sources import versions
    from strata.spec import ColumnMapping as M
    from strata.spec import LoadSpec
    load = LoadSpec.from_metadata("t", {"merge_key": "k", "merge_type": "upsert", "stale_data_handling": "Y", "source_deduplication": "Y",
                                        "source_partitionBy_columns": "k", "source_orderBy_columns": "updated_time desc",
                                        "target_join_columns": "k", "target_audit_columns": "updated_time"})
    mapping, path, joins = (M("k", "BIGINT", "k"), M("v", "STRING", "v")), scratch("stale"), []
    commit = versions.commit

    def seen(spark, df, *a, **b):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return commit(spark, df, *a, **b)

    monkeypatch.setattr(versions, "commit", seen)
    batch = lambda *rows: spark.createDataFrame(rows, "k long, v string, u string").select(
        "k", "v", F.col("u").cast("timestamp_ntz").alias("updated_time"))
    run_silver(spark, batch((1, "a", "2024-01-02"), (2, "b", "2024-01-02")), SilverJob(load, mapping, path, "2024-01-16 00:00:00", "j"))
    got = run_silver(spark, batch((1, "old", "2024-01-01"), (2, "new", "2024-01-03"), (3, "c", "2024-01-01")),
                     SilverJob(load, mapping, path, "2024-01-17 00:00:00", "j")).table
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "a"), (2, "new"), (3, "c")]
    assert joins == [0, 2]                        # the anti join and the one for the created columns


def test_sources_are_imputed_from_documents_parsed_once(spark, scratch):
    from strata.catalog import QUERIES
    sf, size = scratch("imputed"), F.col("id").cast("int")
    part = spark.range(3, 16).select(F.when(size != 15, F.col("id")).alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("B}#]}").alias("p_brand"),
                                     F.lit("SMALL").alias("p_type"), size.alias("p_size"))
    part.unionByName(part.where("p_size = 6")).coalesce(1).write.parquet(f"{sf}/part.parquet")
    out = QUERIES["ml11_impute_sources"](spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "MapType(StringType,StringType" not in plan
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan   # what is joined grows with the documents
    rows = out.collect()
    assert len(rows) == 11 * 4 + 3                # two copies of 6; one row each of 13 (no JSON), 14 (no mapping) and the part without a key
    audit = {r.doc_id: r for r in rows if r.transformation == "ETL Audit Column"}
    assert sorted(audit) == list(range(3, 13)) and {r.source_table for r in audit.values()} == {"src_b}_]}"}
    assert {r.doc_id for r in rows if r.source_desc} == {4, 6, 8, 10, 12}


def test_a_document_is_one_text_without_repeated_work(spark, scratch):
    from strata.catalog.q_lint import mapping_docs
    sf = scratch("texts")
    spark.createDataFrame([(1, "n", 'B"}#]}', "S}}", 13), (2, "n", None, "S", 14), (3, None, "B", None, 5), (None, "n", "B", "S", 5)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{sf}/part.parquet")
    docs = mapping_docs(spark, sf)
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") == 3   # head and two entries; the third is constant
    got = {r.doc_id: r.doc for r in docs.collect()}
    cm = (',"column_mapping":{"col_%d_name":{"target_datatype":"STRING",%s"sources":{"source_table":"%s","source_field":"p_name","source_datatype":"STRING","transformation":"%s"}},'
          '"col_%d_price":{"target_datatype":"DECIMAL(18,2)","sources":[{"source_table":"%s","source_field":"p_retailprice","transformation":"Direct"},'
          '{"source_table":"","source_field":"p_size","transformation":""}]},"audit_%d":{"target_datatype":"STRING","sources":{"source_table":"","transformation":"ETL Audit Column"}}')
    b = r'src_b\"}_]}'
    assert got == {1: '{"target_table":"dim_s}}","source_tables":[{"name":"%s"}]' % b + cm % (1, '"target_desc":"n",', b, "Trim", 1, b, 1),
                   2: '{"target_table":"dim_s","source_tables":[{}]}', None: None,
                   3: '{"source_tables":[{"name":"src_b"}]' + cm % (3, "", "src_b", "Uppercase", 3, "src_b", 3) + "}}"}
