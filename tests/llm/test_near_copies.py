import random

import numpy as np

import corpus_pipeline
from placespark.llm import near_copies, text
from placespark.llm.text import mix


def test_stage_drops_copies_by_similarity(spark, sf):
    rng = random.Random(4)
    rows, similar = [], []
    for i in range(150):
        words = [f"w{rng.randrange(100_000)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(10, 190), rng.randrange(1, 9)):
            other[at] = "changed"
        a, b = ({tuple(w[j : j + 5]) for j in range(196)} for w in (words, other))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        similar.append(len(a & b) / len(a | b) >= 0.8)
    assert 20 < sum(similar) < 130
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {x for i, s in enumerate(similar) for x in ([2 * i] if s else [2 * i, 2 * i + 1])}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert want <= kept and len(kept - want) <= 0.05 * sum(similar)  # the sketch misses few of those just over 0.8


def test_blocks_and_edges(spark, edges, nothing):
    same = [(i, " ".join(f"w{j}" for j in range(100)) + f" end{i}") for i in range(40)] + [(100, None), (101, "x y"), (102, "X  y")]
    docs = spark.createDataFrame(same, "doc_id bigint, text string")
    for most in (20_000, 10):  # long anchors in blocks too
        assert sorted(r.doc_id for r in near_copies.one_of_each_group(docs, block_bytes=2000, most=most).collect()) == [0, 100, 101]
    kept = near_copies.one_of_each_group(edges)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edges.columns and sorted(i for i in ids if i) == [1, 4, 5, 6, 7, 8] and ids.count(None) == 1
    assert near_copies.one_of_each_group(nothing).count() == 0


def test_fingerprints_are_majorities(spark):
    rng = np.random.default_rng(1)
    rows = np.sort(rng.integers(0, 4, 1500))
    hashes = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    got = near_copies.wide_fingerprints(rows, hashes)
    for r in range(4):
        for word in range(near_copies.WORDS):
            mixed = [int(x) for x in mix(hashes[rows == r] + np.uint64(word * near_copies._GOLDEN & (1 << 64) - 1))]
            assert int(got[r, word]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed))


def test_recall_beside_brute_force(spark):
    """Pairs of every similarity from 0.8 on; the sketch may miss few of those just over it and links none below it."""
    rng = random.Random(9)
    rows, similar = [], []
    for i in range(600):
        words = [f"w{rng.randrange(10_000)}" for _ in range(120)]
        other = list(words)
        for at in rng.sample(range(5, 115), rng.randrange(1, 5)):
            other[at] = "changed"
        a, b = ({tuple(w[j : j + 5]) for j in range(116)} for w in (words, other))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        similar.append(len(a & b) / len(a | b) >= 0.8)
    kept = {r.doc_id for r in near_copies.one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    dropped = [2 * i + 1 not in kept for i in range(600)]
    assert all(2 * i in kept for i in range(600)) and not any(d and not s for d, s in zip(dropped, similar, strict=True))
    assert sum(dropped) >= 0.97 * sum(similar) and sum(similar) > 100


def test_words_longer_than_a_piece(monkeypatch):
    data = np.frombuffer(b"ab " * 50 + b"x" * 200 + b" ab xy", np.uint8)
    bounds = text.word_bounds(data, np.array([0, len(data)]), text.NON_SPACE)[:2]
    whole = text.span_hashes(data, *bounds)
    monkeypatch.setattr(text, "PIECE_BYTES", 16)
    text._powers.cache_clear()
    assert (text.span_hashes(data, *bounds) == whole).all() and len(set(whole.tolist())) == 3
    monkeypatch.undo()
    text._powers.cache_clear()
