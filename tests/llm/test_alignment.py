import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placespark.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "b", " ", "\n", "\t", "\r", " ", "é", "日", "🙂", "'s", "'ll", "12", "  ", "<s>", "</s>", "<0x41>", "<|endoftext|>", "▁", "\x1c", "\u0085", "　", "\x00", "<unk>", "é", "ﬁ", "...", "word", " the", "ا"]


@pytest.fixture(scope="module")
def v():
    return alignment.vocabularies(A, B)


def whole(v, text):
    """A's and B's ids of a whole text, encoded at once; none where the bytes don't come back."""
    if not text:
        return [], []
    a, b, raw = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text), (" " + text).encode()
    fine = b"".join(v.a_bytes[i] for i in a) == raw == b"".join(v.b_bytes[i] for i in b)
    return (a, b) if fine else ([], [])


def brute(v, text):
    a, b = whole(v, text)
    places = [[], []]
    for k, (ids, entries) in enumerate(((a, v.a_bytes), (b, v.b_bytes))):
        end = 0
        for i in ids:
            end += len(entries[i])
            places[k].append(end)
    groups, i, j = [], 0, 0
    after = [{end: n for n, end in enumerate(p, 1)} for p in places]
    for end in sorted(set(after[0]) & set(after[1])):
        i2, j2 = after[0][end], after[1][end]
        groups.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return len(a), len(b), len(groups), hashlib.sha256(text.encode()).hexdigest() if a else "", [(x[-1], y[-1]) for x, y in groups]


def report(v, texts):
    rows = [brute(v, t) for t in texts]
    count = Counter(link for r in rows for link in r[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(*r[:3], r[2], sum(count[x] == best[x[1]] for x in r[4]), sum(count[x] for x in r[4]), r[3]) for r in rows]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_brute_force(spark, sf, v):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(docs, report(v, [r.text for r in docs]), strict=True)}
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in queries.op11_alignment(spark, sf).collect()} == want


def test_odd_texts_in_short_runs(spark, v, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(30))) for _ in range(800)]
    store = alignment.Pieces(v)
    monkeypatch.setattr(alignment, "RUN", 40)
    monkeypatch.setattr(alignment, "KEPT", 50)
    batch = alignment.Batch(store, len(texts))
    for i, t in enumerate(texts):
        if t:
            batch.put(i, t)
    rows = list(zip(*[c.to_pylist() for c in batch.arrays()], strict=True))
    size = len(v.b_bytes)
    for text, row in zip(texts, rows, strict=True):
        want = brute(v, text)
        assert row[:4] == want[:4]
        links = Counter({(i, int(v.identity[i])): n for i, n in zip(row[4], row[5], strict=True)}) + Counter({divmod(p, size): n for p, n in zip(row[6], row[7], strict=True)})
        assert links == Counter(want[4])


def test_identity_links_are_groups_of_one_token_each(v):
    text = "The quick brown fox, naïve and 12,345 times unbelievably antidisestablishmentarian."
    a, b = whole(v, text)
    store = alignment.Pieces(v)
    batch = alignment.Batch(store, 1)
    batch.put(0, text)
    exact = batch.arrays()[4].to_pylist()[0]
    assert exact and all(v.a_bytes[i] == v.b_bytes[v.identity[i]] for i in exact)
    assert set(exact) <= set(a) and {int(v.identity[i]) for i in exact} <= set(b)


def test_counts_stay_within_the_bound(spark, sf, v):
    linked = alignment.linked_texts(spark.read.parquet(f"{sf}/documents.parquet"), A, B)
    pairs = alignment.pair_counts(linked, A, B)
    assert pairs.count() == pairs.dropDuplicates(["a_id", "b_id"]).count() < v.linkable() < 1_000_000
    assert all(v.a_bytes[r.a_id].endswith(v.b_bytes[r.b_id]) or v.b_bytes[r.b_id].endswith(v.a_bytes[r.a_id]) for r in pairs.limit(500).collect())


def test_edges(spark, edges, nothing, v):
    rows = alignment.alignment_report(edges.select("*", F.lit(5).alias("n_a")), A, B).collect()
    assert len(rows) == edges.count()
    texts = [r.text for r in edges.select("text").collect()]
    assert sorted((r[1:] for r in rows), key=str) == sorted(report(v, texts), key=str)
    assert [tuple(r)[1:] for r in rows if r.doc_id in (1, 2)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert alignment.alignment_report(nothing, A, B).count() == 0


def test_a_mark_in_a_text_leaves_it_without_tokens(v):
    batch = alignment.Batch(alignment.Pieces(v), 3)
    for i, t in enumerate(["fine text", "one ▁ two", "fine"]):
        batch.put(i, t)
    assert [n > 0 for n in batch.arrays()[0].to_pylist()] == [True, False, True]
    assert isinstance(batch.arrays()[3], pa.Array)
