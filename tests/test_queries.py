"""Every query against the SQL that states it, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from placespark.operators import search as operators
from placespark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    frame = catalog.queries()[name](spark, sf)
    names = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(names).collect()), key=str)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(r[columns.index(c)] for c in names) for r in found.fetchall()), key=str)
    assert len(got) == len(want) and all(same(x, y) for r, s in zip(got, want, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["clause_search", "sloppy_phrase_match", "sloppier_phrase_match"])
def test_equal_texts_are_indexed_once(spark, sf, tmp_path, monkeypatch, name):
    c, seen = duckdb.connect(), []
    c.execute(f"CREATE TABLE part AS SELECT p_partkey + 1000 * i AS p_partkey, * EXCLUDE (p_partkey, i) FROM (SELECT * FROM read_parquet('{sf}/part.parquet') WHERE p_partkey < 60), range(5) r(i)")
    c.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    postings = operators.postings
    monkeypatch.setattr(operators, "postings", lambda docs, *a, **k: seen.append(docs.count()) or postings(docs, *a, **k))
    frame = catalog.queries()[name](spark, str(tmp_path))
    got = sorted(tuple(r) for r in frame.collect())
    found = c.execute(f"SELECT {', '.join(frame.columns)} FROM ({catalog.oracle_sql()[name]})")
    want = sorted(found.fetchall())
    assert len(got) == len(want) > 0 and all(same(x, y) for r, s in zip(got, want, strict=True) for x, y in zip(r, s, strict=True))
    assert seen and max(seen) <= 60
