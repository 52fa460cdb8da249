"""Loads from mapping documents and sheet rows."""

import pytest

from strata.plans.documents import (MappingError, joined_sources, load_document, mappings_of,
                                    mappings_of_rows)


def entry(kind="INT", **source):
    return {"target_datatype": kind, "sources": source}


@pytest.fixture
def tables(spark):
    return {"a": spark.createDataFrame([(1, 10, 7), (2, 3, None), (3, 30, 9)], "id int, v int, b_id int"),
            "b": spark.createDataFrame([(7, 70, 1), (8, 80, 2)], "id int, w int, v int")}


def test_filter_and_join_of_a_mapping_are_applied(spark, scratch, tables):
    doc = {"target_table": "t", "parameters": {"merge_type": "append"}, "source_tables": [{"name": "a"}, {"name": "b"}],
           "column_mapping": {
               "id": entry(source_table="a", source_field="id", filter="v > 5"),
               "w": entry(source_table="b", source_field="w", join_condition="left join b on a.b_id = b.id"),
               "bv": entry(source_table="b", source_field="v")}}
    out = load_document(spark, doc, tables, scratch("doc"), "2024-01-01 00:00:00", "j").table
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, 70, 1), (3, None, None)]
    doc["column_mapping"]["w"]["sources"]["join_condition"] = "a.b_id = b.id"
    frame, _ = joined_sources(tables, mappings_of(doc))
    assert frame.count() == 1 and "b__v" in frame.columns


def test_several_sources_are_alternates(tables):
    frame, maps = joined_sources(tables, mappings_of({"column_mapping": {"x": {"target_datatype": "INT", "sources": [
        {"source_table": "a", "source_field": "b_id"}, {"source_table": "a", "source_field": "v"}]}}}))
    assert (maps[0].source_field, maps[0].alternates) == ("b_id", ("v",))


def test_sheet_rows_make_the_same_mappings():
    row = {"target_column": "x", "target_datatype": "INT", "source_table": "a", "source_field": "v"}
    assert mappings_of_rows([row]) == mappings_of({"column_mapping": {"x": entry(source_table="a", source_field="v")}})


@pytest.mark.parametrize("doc", [
    {"column_mapping": []}, {"column_mapping": {}, "colour": 1},
    {"column_mapping": {"x": {"target_datatype": "INT", "sources": {"source_feild": "v"}}}},
    {"column_mapping": {"x": {"sources": [{"transformation": "Trim"}, {"transformation": "Uppercase"}]}}}])
def test_what_a_document_may_not_hold(doc):
    with pytest.raises(MappingError):
        mappings_of(doc)


def test_sources_that_do_not_fit(tables):
    def sources(**kw):
        return joined_sources(tables, mappings_of({"column_mapping": {"i": entry(source_table="a", source_field="id"),
                                                                      "x": entry(**kw)}}))
    for bad in (dict(source_table="b", source_field="w"), dict(source_table="c", source_field="w"),
                dict(source_table="a", source_field="nope")):
        with pytest.raises(MappingError):
            sources(**bad)
