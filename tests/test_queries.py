"""Every registered query against its DuckDB oracle on the smallest test tables, plus the
driver's entry smoke check."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return norm(tuple(v.asDict().values()))
    return v


_DUCK = {"TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint",
         "HUGEINT": "hugeint", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string",
         "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def duck_type(t):
    t = str(t)
    if t.endswith("[]"):
        return f"array<{duck_type(t[:-2])}>"
    if t.startswith("DECIMAL"):
        return t.lower().replace(" ", "")
    return _DUCK.get(t, t.lower())


def canon(cols, rows):
    order = sorted(cols)
    idx = [cols.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "line_id" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert rows and len(set(df.columns)) == len(df.columns)
        return
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dtypes = {d[0]: duck_type(d[1]) for d in cur.description}
    assert stypes == dtypes
    assert canon(df.columns, rows) == canon(dcols, cur.fetchall())
