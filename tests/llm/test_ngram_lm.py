import collections
import math
import re
import zlib

import numpy as np
import zstandard

from placespark.llm import ngram_lm
from placespark.llm.elias_fano import Bits, EliasFano, Level, mapped


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 50), (1000, 1 << 40), (3000, (1 << 63) - 1)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        held = EliasFano(mapped(EliasFano.pack(values)))
        assert held.n == n
        if n:
            assert (held[np.arange(n)] == values).all()
            asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64)])
            place, known = held.find(asked), set(values.tolist())
            assert all((p >= 0) == (x in known) and (p < 0 or values[p] == x) for p, x in zip(place, asked.tolist(), strict=True))


def test_level_finds_pairs():
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 300, (2000, 2))})
    context, word = np.array(pairs).T
    level = Level(mapped(Level.pack(context, word, np.arange(len(pairs)), np.zeros(len(pairs)))))
    asked = rng.integers(0, 320, (3000, 2))
    where = {p: i for i, p in enumerate(pairs)}
    assert level.find(asked[:, 0], asked[:, 1]).tolist() == [where.get((a, b), -1) for a, b in asked.tolist()]
    assert (level.codes == np.arange(len(pairs))).all()


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def naive(docs, order, min_context=1):
    """The same model from plain dictionaries, unquantised."""
    train = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in docs]
    counts = [collections.Counter() for _ in range(order + 1)]
    for (_, text), is_train in zip(docs, train, strict=True):
        if is_train:
            w = ["<s>", *tokens(text), "</s>"]
            counts[1].update(w)
            for k in range(2, order + 1):
                counts[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    n = sum(counts[1].values()) - counts[1]["<s>"]
    v = len(counts[1]) - bool(counts[1]["<s>"])
    out = []
    for _, text in docs:
        w = ["<s>", *tokens(text), "</s>"]
        base = score = 0.0
        for i in range(1, len(w)):
            p = (counts[1][w[i]] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, min(order, i + 1) + 1):
                context = w[i - k + 1] if k == 2 else tuple(w[i - k + 1 : i])
                c = counts[k - 1][context]
                if c < min_context:
                    continue
                m = ngram_lm.MASS * c**ngram_lm.POWER
                p = (counts[k][tuple(w[i - k + 1 : i + 1])] + m * p) / (c + m)
            score += math.log10(p)
        out.append((len(w) - 1, sum(counts[1][x] > 0 for x in w[1:]), n, base, score))
    return out


def test_equals_a_naive_model(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    train = ~ngram_lm.is_held_out(frame["doc_id"])
    for order, more in ((3, {}), (2, {"min_context": 2}), (3, {"chunk_tokens": 5000, "shard_tokens": 4000, "min_context": 2}), (4, {"chunk_tokens": 9000, "shard_tokens": 1000})):
        rows = {r.doc_id: r for r in ngram_lm.lm_scores(frame, train, order=order, **more).collect()}
        for (doc_id, _), (n, known, total, base, score) in zip(docs, naive(docs, order, more.get("min_context", 1)), strict=True):
            r = rows[doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert abs(r.base_score - base) < 1e-6 * (1 + abs(base)) and abs(r.score - score) < 2e-3 * n + 1e-3


def test_probabilities_add_up(spark):
    """After a context, over all known words, the end and one unknown."""
    docs = [(i, t) for i, t in enumerate(["a b a c a b", "b a c c", "a b b a", "c a b"] * 3)]
    asked = [(1000, "a"), *[(1001 + i, f"a {w}") for i, w in enumerate(["a", "b", "c", "zzz"])]]
    frame = spark.createDataFrame(docs + asked, "doc_id bigint, text string")
    rows = {r.doc_id: r.score for r in ngram_lm.lm_scores(frame, frame["doc_id"] < 1000, order=2, min_context=2).collect()}
    # P(first a) P(end | a) and P(first a) P(w | a) P(end | w); ends and first words come from the counts
    total, v = 12 + sum(len(t.split()) for _, t in docs), 4
    p1 = {w: (c + 0.5) / (total + 0.5 * (v + 1)) for w, c in [("a", sum(t.split().count("a") for _, t in docs)), ("b", sum(t.split().count("b") for _, t in docs)), ("c", sum(t.split().count("c") for _, t in docs)), ("end", 12), ("zzz", 0)]}
    count = {w: sum(t.split().count(w) for _, t in docs) for w in "abc"}
    ends = {w: sum(t.split()[-1] == w for _, t in docs) for w in "abc"}

    def given(w, n):
        m = ngram_lm.MASS * count[w] ** ngram_lm.POWER
        return (n + m * p1["end"]) / (count[w] + m)

    first = 10 ** rows[1000] / given("a", ends["a"])
    shares = [given("a", ends["a"])]
    for i, w in enumerate(["a", "b", "c", "zzz"]):
        shares.append(10 ** rows[1001 + i] / first / (given(w, ends[w]) if w != "zzz" else p1["end"]))
    assert abs(sum(p1.values()) - 1) < 1e-9 and abs(sum(shares) - 1) < 2e-3


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ngram_lm.lm_scores(docs, ~ngram_lm.is_held_out(docs["doc_id"])).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)


def test_edges(spark, edges, nothing):
    rows = ngram_lm.lm_scores(edges, ~ngram_lm.is_held_out(edges["doc_id"])).collect()
    assert len(rows) == edges.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert ngram_lm.lm_scores(nothing, nothing["doc_id"] > 0).count() == 0
    untrained = ngram_lm.lm_scores(edges, edges["doc_id"] < 0).collect()
    assert {(r.train_tokens, r.n_known) for r in untrained} == {(0, 0)}
    silent = edges.where("text is null or text = ''")
    assert all(r.n_tokens == 1 for r in ngram_lm.lm_scores(silent, silent["made"] == 1).collect())


def test_query_has_three_levels_and_contexts_seen_once(spark, tmp_path):
    from placespark.llm import queries

    doc_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1)
    spark.createDataFrame([(doc_id, "a b c")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = queries.op4_ngram_lm(spark, str(tmp_path)).collect()
    p1 = 1.5 / (4 + 0.5 * 5)
    p2 = (1 + ngram_lm.MASS * p1) / (1 + ngram_lm.MASS)
    p3 = (1 + ngram_lm.MASS * p2) / (1 + ngram_lm.MASS)
    assert abs(r.base_score - 4 * math.log10(p1)) < 1e-9 and abs(r.score - math.log10(p2) - 3 * math.log10(p3)) < 5e-3


def test_string_ids(spark):
    rows = spark.createDataFrame([(f"d{i}" if i else None, "one two three one two") for i in range(12)], "doc_id string, text string")
    got = ngram_lm.lm_scores(rows, ~ngram_lm.is_held_out(rows["doc_id"]))
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["None", *[f"d{i}" for i in range(1, 12)]])


def test_lookups_of_many_read_through_and_equal_those_of_few(monkeypatch):
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (7, 3), (4000, 50), (4000, 1 << 40), (4000, (1 << 64) - 1)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        held = EliasFano(mapped(EliasFano.pack(values)))
        asked = np.sort(np.concatenate([np.unique(values), rng.integers(0, top, n, dtype=np.uint64)]))
        few = [held.find(asked[i : i + 1 + n // 100]) for i in range(0, len(asked), 1 + n // 100)]
        with monkeypatch.context() as m:
            m.setattr(Bits, "_select", None)  # no selection for each one asked for
            many = held.find(asked)
            assert (held.every() == values).all()
        known = set(values.tolist())
        for place in (many, np.concatenate(few)):
            assert [p >= 0 for p in place.tolist()] == [x in known for x in asked.tolist()]
            assert (values[place[place >= 0]] == asked[place >= 0]).all()


def test_payloads_hold_the_bytes_that_numbers_need():
    for values, kind, most in (([], np.int64, 0), ([0] * 50, np.uint32, 0), ([1, 255] * 50, np.int64, 1), ([3, 256] * 50, np.uint32, 2), ([-1, 5], np.int64, 8), ([(1 << 64) - 1, 0], np.uint64, 8)):
        data = ngram_lm.packed(np.array(values, kind), kind)
        assert ngram_lm.unpacked(data, kind).tolist() == values and ngram_lm.unpacked(data, kind).dtype == kind
        assert len(zstandard.ZstdDecompressor().decompress(data)) <= 9 + most * len(values)


def test_distinct_pairs_of_small_and_large_numbers():
    rng = np.random.default_rng(4)
    for n, contexts, words in ((0, 1, 1), (1, 1, 1), (3000, 40, 30), (3000, 1 << 40, 1 << 20), (3000, 1 << 62, 1 << 62)):
        pool = rng.integers(0, (contexts, words), (n // 2 + 1, 2))
        context, word = (np.ascontiguousarray(x) for x in pool[rng.integers(0, len(pool), n)].T)
        own, of, which = ngram_lm.distinct(context, word)
        assert list(zip(own.tolist(), of.tolist(), strict=True)) == sorted(set(zip(context.tolist(), word.tolist(), strict=True)))
        assert (own[which] == context).all() and (of[which] == word).all()
