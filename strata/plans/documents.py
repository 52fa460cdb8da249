"""From a mapping document to a load: the path from what an analyst writes (mapping JSON, or
sheet rows) to ``ColumnMapping`` objects, one joined source frame, and a silver load.

A document is configuration (one per target table): ``target_table``, ``source_tables``,
``parameters`` (load metadata), and ``column_mapping`` with the sources of each target
column. Every field is used or refused: an unknown one is an error, not ignored.
"""

from __future__ import annotations

import json
import re
from typing import Any, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.terms import plain_backslashes
from strata.operators.project import apply_filters
from strata.plans.silver import SilverJob, SilverResult, run_silver
from strata.spec import ColumnMapping, LoadSpec

# The field names of a mapping document; descriptions say nothing to a load,
# and the workflow text is prose.
DOCUMENT = {"target_table", "source_tables", "parameters", "column_mapping", "workflow_logic"}
COLUMN = {"target_datatype", "target_desc", "sources"}
SOURCE = {"source_table", "source_field", "source_datatype", "source_desc", "transformation",
          "join_condition", "filter"}
JOIN = re.compile(r"^\s*(?:(?P<how>inner|left|right|full)?(?:\s+outer)?\s*(?:join)?(?:\s+[\w.]+)?\s+on\s+)?(?P<cond>.+)$",
                  re.IGNORECASE | re.DOTALL)


class MappingError(ValueError):
    """A mapping document that cannot be loaded as it stands."""


def _text(value: Any) -> str:
    return "" if value is None else str(value).strip()


def _known(given: Mapping, allowed: set, where: str) -> None:
    extra = sorted(set(given) - allowed)
    if extra:
        raise MappingError(f"{where}: unknown fields {extra}")


def mappings_of(document: Mapping | str) -> list[ColumnMapping]:
    """The column mappings of a document, in its order. A column's further sources are
    alternates (first non-NULL wins); they may not have a transformation of their own."""
    doc = json.loads(document) if isinstance(document, str) else document
    _known(doc, DOCUMENT, "document")
    if not isinstance(doc.get("column_mapping"), Mapping):
        raise MappingError("column_mapping must be a dictionary")
    out = []
    for target, entry in doc["column_mapping"].items():
        _known(entry, COLUMN, target)
        sources = entry.get("sources") or {}
        sources = [sources] if isinstance(sources, Mapping) else list(sources)
        for s in sources:
            _known(s, SOURCE, target)
        first, rest = (sources or [{}])[0], sources[1:]
        if any(_text(s.get("transformation")) not in ("", _text(first.get("transformation"))) for s in rest):
            raise MappingError(f"{target}: several sources with transformations of their own")
        out += [ColumnMapping(
            target=target, target_type=_text(entry.get("target_datatype")) or "string",
            source_field=_text(s.get("source_field")) or None, source_table=_text(s.get("source_table")) or None,
            source_type=_text(s.get("source_datatype")) or None, transformation=_text(s.get("transformation")),
            join_condition=_text(s.get("join_condition")) or None, filter=_text(s.get("filter")) or None)
            for s in [first, *rest]]
    return out


def mappings_of_rows(rows: Iterable[Mapping]) -> list[ColumnMapping]:
    """The same from sheet rows (dicts with the column's name under ``target_column``)."""
    columns: dict[str, dict] = {}
    for row in rows:
        target = _text(row.get("target_column"))
        if not target:
            raise MappingError("a sheet row names no target_column")
        _known(row, SOURCE | {"target_column", "target_datatype", "target_desc"}, target)
        entry = columns.setdefault(target, {"target_datatype": row.get("target_datatype"), "sources": []})
        entry["sources"].append({k: row.get(k) for k in SOURCE})
    return mappings_of({"column_mapping": columns})


def joined_sources(tables: Mapping[str, DataFrame], mappings: Sequence[ColumnMapping],
                   main: str | None = None) -> tuple[DataFrame, list[ColumnMapping]]:
    """FIL-1, JN-1: the frame that the mappings read, and the mappings in its column names.

    ``main`` (by default the first table that a mapping names) is joined with every other
    table that mappings name, by their declared condition and type (INNER when none is
    given). Each table's filters apply before the join. A column of another table that is
    also one of the frame's gets the name ``<table>__<column>``.
    """
    used = list(dict.fromkeys(m.source_table for m in mappings if m.source_table))
    main = main or (used[0] if used else next(iter(tables)))
    absent = [t for t in [main, *used] if t not in tables]
    if absent:
        raise MappingError(f"source tables without data: {absent}")

    def source(name: str) -> DataFrame:
        filters = dict.fromkeys(m.filter for m in mappings if m.filter and (m.source_table or main) == name)
        return apply_filters(tables[name], filters).alias(name)

    frame, names = source(main), {c: f"`{main}`.`{c}`" for c in tables[main].columns}
    place = {(main, c): c for c in tables[main].columns}
    for t in used:
        if t == main:
            continue
        conditions = list(dict.fromkeys(m.join_condition for m in mappings if m.source_table == t and m.join_condition))
        if len(conditions) != 1:
            raise MappingError(f"source table {t} needs one join condition, it has {conditions}")
        found = JOIN.match(conditions[0])
        frame = frame.join(source(t), F.expr(plain_backslashes(found["cond"])), (found["how"] or "inner").lower())
        for c in tables[t].columns:
            place[t, c] = c if c not in names else f"{t}__{c}"
            names[place[t, c]] = f"`{t}`.`{c}`"
    if any(m.join_condition and (m.source_table or main) == main for m in mappings) and len(used) < 2:
        raise MappingError("a join condition without a second source table")
    out: dict[str, ColumnMapping] = {}
    for m in mappings:
        field = m.source_field
        if field:
            at = {c.lower(): v for (t, c), v in place.items() if t == (m.source_table or main)}
            if field.lower() not in at:
                raise MappingError(f"{m.target}: {m.source_table or main} has no column {field!r}")
            field = at[field.lower()]
        if m.target in out:
            if not field:
                raise MappingError(f"{m.target}: a further source without a field")
            old = out[m.target]
            out[m.target] = ColumnMapping(**{**vars(old), "alternates": (*old.alternates, field)})
        else:
            done = {"source_field": field, "filter": None, "join_condition": None}
            out[m.target] = ColumnMapping(**{**vars(m), **done})
    return frame.select(*[F.expr(text).alias(c) for c, text in names.items()]), list(out.values())


def load_document(spark: SparkSession, document: Mapping | str, tables: Mapping[str, DataFrame], target_path: str,
                  load_ts: str, job_id: str, **options) -> SilverResult:
    """Runs the silver load that a mapping document declares over the named source tables.
    ``options`` are further fields of ``SilverJob`` (rules, audit path, policy, ...)."""
    doc = json.loads(document) if isinstance(document, str) else document
    target = _text(doc.get("target_table"))
    if not target:
        raise MappingError("target_table is empty or missing")
    declared = [_text(s.get("name")) for s in doc.get("source_tables") or ()]
    maps = mappings_of(doc)
    if declared:
        strange = sorted({m.source_table for m in maps if m.source_table} - set(declared))
        if strange:
            raise MappingError(f"undeclared source tables: {strange}")
    frame, maps = joined_sources(tables, maps, declared[0] if declared else None)
    spec = LoadSpec.from_metadata(target, doc.get("parameters") or {})
    return run_silver(spark, frame, SilverJob(spec, maps, target_path, load_ts, job_id, **options))
