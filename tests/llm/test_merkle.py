import hashlib
import random
from binascii import crc32
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from placespark.llm import merkle, queries

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, pos int, level int, n int, id string, cur string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(hashes, arity=8):
    """The root, and for each leaf its steps (before, after)."""
    steps, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        for own, i in zip(steps, at, strict=True):
            lo = i - i % arity
            own.append((level[lo:i], level[i + 1 : lo + arity]))
        level = [digest(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], steps


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: digest(*map(field, (r[0], r[3], r[2], r[4], text)))
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    langs = {}
    for r in rows:
        own = leaf(r, r[1])
        bad = leaf(r, lower(r[1])) if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 else own
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, own, bad, r[0]))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: climb([y[2] for y in sorted(langs[x])]) for x in order}
    root, tops = climb([built[x][0] for x in order]) if order else ("", [])
    out = []
    for x, top in zip(order, tops, strict=True):
        for (_, _, own, bad, i), steps in zip(sorted(langs[x]), built[x][1], strict=True):
            folded, proof = bad, []
            for left, right in steps + top:
                folded, proof = digest(*left, folded, *right), proof + left + right
            out.append((i, own, built[x][0], root, digest(*proof), folded, folded == root))
    return Counter(out)


def report(spark, rows):
    frame = spark.createDataFrame([(*r, "h", 3, 2, 1, "x", "y") for r in rows], DOC)
    return Counter(tuple(r) for r in merkle.manifest_report(frame).collect())


def test_query_equals_sql_and_brute_force(spark, sf):
    got = queries.op13_merkle(spark, sf)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    found = c.execute(queries.OP13_SQL)
    names = [d[0] for d in found.description]
    rows = got.select(names).collect()
    assert Counter(tuple(r) for r in rows) == Counter(found.fetchall())
    docs = c.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    assert Counter(tuple(r[n] for n in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in rows) == brute(docs)


@pytest.mark.parametrize(("near", "leap"), [(1 << 14, 3), (4, 3), (0, 1), (30, 2)])
def test_trees_of_odd_sizes(spark, monkeypatch, near, leap):
    monkeypatch.setattr(merkle, "NEAR", near)
    monkeypatch.setattr(merkle, "LEAP", leap)
    rng = random.Random(near)
    sizes = {None: 9, "": 1, "de": 8, "en": 600, "fr": 65, "ü": 2, "Z": 1, "x'y": 7, "+": 3, "-": 5, "日": 1}
    rows = [(rng.choice([i, i, None, -i]), rng.choice(["Some Text", "lower", "", None, "É ÄB", "x" * 5000]), lang, rng.choice(["s", None, ""]), rng.choice([1, None])) for lang, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    assert report(spark, rows) == brute(rows)


def test_few_rows(spark):
    for rows in ([(1, "A", "en", "s", 1)], [(1, "A", None, None, None)] * 2, [(i, "Ab", "en", "s", 2) for i in range(8)], [(9, "A", "en", "s", 1), (9, "A", "de", "s", 1)]):
        assert report(spark, rows) == brute(rows)
    assert report(spark, []) == Counter()


def test_many_languages(spark):
    rows = [(i, "T", f"l{i % 100}", "s", 1) for i in range(150)]
    assert report(spark, rows) == brute(rows)


def test_edges(spark, edges):
    rows = [tuple(r) for r in edges.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(tuple(r) for r in merkle.manifest_report(edges).collect()) == brute(rows)


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("g"))
    found = merkle.numbered(rows.repartition(13), "g", ["k"]).collect()
    for g in ("a", None):
        own = sorted((r.pos, r.k) for r in found if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
        assert {r.n for r in found if r.g == g} == {len(own)}
