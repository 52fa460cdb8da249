"""Registered queries: one per inventory item, each with its DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the given test tables; the oracle is
ANSI SQL over the same tables as views. Importing the submodules fills the registries.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _bigint_counts(sql: str) -> str:
    """DuckDB types ``count_if`` as HUGEINT; Spark's is BIGINT. Wrap each call in a cast
    so the oracle's schema matches (values are unchanged)."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k, quoted = 0, j + len("count_if"), False
        while k < len(sql):
            if sql[k] == "'":
                quoted = not quoted          # '' inside a literal toggles twice
            elif quoted:
                pass
            elif sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its oracle (omit for rows-only checks)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _bigint_counts(sql)
        return fn
    return deco


def load_all() -> None:
    from strata.catalog import (  # noqa: F401
        q_core, q_glossary, q_joins, q_loads, q_quality, q_emissions, q_stats, q_lint,
        q_text, q_pipelines)
