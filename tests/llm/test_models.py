"""Token counts, quality and toxicity."""

import math
import re
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from placespark.llm import quality, token_count, toxicity
from placespark.llm.text import LOWER, text_blocks

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " ", "  a  b ", "日本語x", "\n\n a\n", "🙂🙂 🙂", "<unk><unk>x", "<s>a</s>", "▁a▁▁b", "é̃", "\x00\x01 a", "x" * 3000]


def test_counts_equal_the_tokenizer(spark, sf):
    vocabulary = token_count.vocabulary_of(PIECES)
    whole = Tokenizer(models.Unigram(vocabulary, 0, False))
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for most in (500_000, 10):
        counter = token_count.UnigramCounter(vocabulary, most=most)
        assert [counter.count(t) for t in texts] == [len(whole.encode("▁" + t.replace(" ", "▁")).ids) for t in texts]


def test_names_of_control_and_byte_pieces_are_text():
    counter = token_count.UnigramCounter(token_count.vocabulary_of(PIECES))
    assert counter.count("</s>") > 1 and counter.count("<0x0A>") > 1


def test_ties_keep_the_first():
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abab", -4.0), ("▁", -1.0), ("ba", -2.0)]
    whole, counter = Tokenizer(models.Unigram(vocabulary, 0, False)), token_count.UnigramCounter(vocabulary)
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice("ab c") for _ in range(rng.randrange(12)))
        assert counter.count(t) == len(whole.encode("▁" + t.replace(" ", "▁")).ids)


def test_token_count_edges(spark, edges, nothing):
    out = token_count.with_token_count(edges, PIECES)
    assert out.columns == [*edges.columns, "n_tokens"] and out.count() == edges.count()
    assert {r.n_tokens for r in out.where("text is null").collect()} == {0}
    assert token_count.with_token_count(nothing, PIECES).count() == 0


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    return (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_report(docs).join(labels, "doc_id").toPandas()
    good = rows["quality"].values == 1
    assert auc(rows["score"].values, good) > 0.93 and rows["keep"][good].mean() > 0.95 and rows["keep"][~good].mean() < 0.5


def test_em_finds_accurate_labellers():
    rng = random.Random(3)
    counts: dict[int, int] = {}
    for _ in range(3000):
        good = rng.random() < 0.7
        votes = [(2 if good == (rng.random() < a) else 0) if rng.random() < 0.8 else 1 for a in (0.95, 0.9, 0.9, 0.85, 0.6, 0.55, 0.9, 0.8)]
        p = int(quality.pattern_of(np.array([votes]))[0])
        counts[p] = counts.get(p, 0) + 1
    _, right = quality.posteriors(counts)
    assert right[0] > 0.9 and abs(right[4] - 0.6) < 0.07 and abs(right[5] - 0.55) < 0.07


def test_quality_edges(spark, edges, nothing):
    rows = quality.quality_report(edges).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_report(nothing).count() == 0


def labelled(n=900, seed=1):
    rng = random.Random(seed)
    syllables = ["the", "on", "er", "in", "at", "ing", "sha", "lo", "mi", "ta"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    common = [word() for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(common) if rng.random() < 0.8 else word() for _ in range(rng.randrange(20, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "stupid", "pathetic", "worthless"]))
        docs.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def machine(spark):
    docs, labels = labelled()
    return toxicity.train(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def scores(spark, machine, texts):
    rows = toxicity.with_score(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), machine).collect()
    return [r.score for r in sorted(rows)]


def test_toxic_texts_are_told_apart(spark, machine):
    docs, labels = labelled(300, 5)
    s, y = np.array(scores(spark, machine, [t for _, t in docs])), np.array([t == 1 for _, t in labels])
    assert auc(s, y) > 0.99 and ((s >= toxicity.THRESHOLD) == y).mean() > 0.97


def test_inserted_characters_and_gaps(spark, machine):
    clean, plain, inserted, apart, letter, split = scores(spark, machine, ["the loing shata on the ering", "you idiot the stupid on", "you id.iot the stu-pid on", "you i d i o t the s t u p i d on", "you idxiot the stupxid on", "you idi ot the stu pid on"])
    assert clean < 0.5 and plain > 0.9 and min(inserted, apart, letter, split) > clean + 0.2


def triples(chars):
    """Weights of a window's subsequences, by hand."""
    found: dict[tuple, float] = {}
    for i in range(min(toxicity.WIDTH, len(chars))):
        for j in range(i + 1, min(i + toxicity.SPAN, len(chars))):
            for k in range(j + 1, min(i + toxicity.SPAN, len(chars))):
                key = (chars[i], chars[j], chars[k])
                found[key] = found.get(key, 0) + toxicity.DECAY ** (k - i - 2)
    return found


def test_kernel_and_table_equal_brute_force():
    rng = random.Random(4)
    windows = [bytes(rng.randrange(5) for _ in range(rng.randrange(3, toxicity.WIDTH + toxicity.SPAN))) for _ in range(40)]
    codes, w = toxicity.features(windows), toxicity.weights()
    by_hand = [triples(x) for x in windows]
    for i in (0, 7):
        want = [sum(v * by_hand[i].get(k, 0) for k, v in x.items()) for x in by_hand]
        assert np.allclose(toxicity.kernel_column(codes, codes[i], w), want, rtol=1e-5)
    table, bias, values = toxicity.fit(windows[:20], windows[20:], landmarks=16)
    got = [sum(v * table[k[0] << 12 | k[1] << 6 | k[2]] for k, v in x.items()) + bias for x in by_hand[20:]]
    assert np.allclose(got, values, atol=1e-3)
    chars = np.concatenate([np.concatenate([np.frombuffer(x, np.uint8).astype(np.int32), np.full(toxicity.SPAN - 1, toxicity.BETWEEN, np.int32)]) for x in windows])
    size = np.array([len(x) for x in windows])
    start = np.cumsum(size + toxicity.SPAN - 1) - size - toxicity.SPAN + 1
    best, place = toxicity.window_values(chars, start, start + size, table)
    for n, x in enumerate(windows):
        every = [sum(v * table[k[0] << 12 | k[1] << 6 | k[2]] for k, v in triples(x[at : at + toxicity.WIDTH + toxicity.SPAN - 1]).items()) for at in range(len(x))]
        assert abs(best[n] - max(every)) < 1e-3 and abs(every[place[n] - start[n]] - max(every)) < 1e-3


def test_sentences_by_hand():
    texts = ["One two. THREE!\nfour\n\n five a b c d six", "", "x", "...", "a.b.c ok? i d", "è no\u00a0w"]
    want = ["one two", "three", "four", "five abcd six", "abc ok", "i d"]
    table = pa.array(texts)
    (_, _, data, offsets), = text_blocks(table)
    chars, start, end, doc = toxicity.sentences(LOWER[data], offsets)
    letters = dict(zip(toxicity.CLASSES[[*range(97, 123), 32]].tolist(), "abcdefghijklmnopqrstuvwxyz ", strict=True))
    got = ["".join(letters.get(c, "?") for c in chars[a:b].tolist()) for a, b in zip(start, end, strict=True)]
    assert [g.strip() for g in got[:-1]] == want and all(g[0] == " " for g in got) and doc.tolist() == [0, 0, 0, 0, 4, 4, 5]
    assert all((chars[b : b + toxicity.SPAN - 1] == toxicity.BETWEEN).all() and b + toxicity.SPAN - 1 <= len(chars) for b in end)


def test_toxicity_edges(spark, edges, nothing):
    docs, labels = labelled(200)
    l = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 1), (6, 0)], "doc_id bigint, toxic int")
    d = spark.createDataFrame(docs, "doc_id bigint, text string").unionByName(edges.select("doc_id", "text"))
    rows = toxicity.toxicity_report(d, l).collect()
    assert len(rows) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.toxicity_report(nothing, l).count() == 0
    assert len({r.score for r in toxicity.toxicity_report(edges, l.limit(0)).collect()}) == 1
    kept = toxicity.drop_toxic(edges, l)
    assert kept.columns == edges.columns and kept.count() == edges.count()


def brute_quality(text, weights):
    """The scorer word by word: hashed word, shape, and shapes of two neighbours, averaged."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    if not words:
        return 1 / (1 + math.exp(-weights[-1]))
    mask = (1 << 64) - 1
    mix = lambda h: int(quality.mix(np.array([h & mask], np.uint64))[0])
    total, before, last = 0.0, 7, None
    for w in words:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        own = int(quality.span_hashes(np.frombuffer(low, np.uint8), np.array([0]), np.array([len(low)]))[0])
        kinds = [sum(97 <= c <= 122 for c in w), sum(65 <= c <= 90 for c in w), sum(48 <= c <= 57 for c in w), sum(c >= 128 for c in w)]
        shape = min(len(w), 15)
        for n in [*kinds, len(w) - sum(kinds)]:
            shape = shape * 3 + min(n, 2)
        shape = mix(shape + 1)
        pair = mix(before * 31 + shape + (low == last))
        total += sum(float(weights[x % quality.DIMENSIONS]) for x in (own, shape, pair))
        before, last = shape, low
    return 1 / (1 + math.exp(-(total / (3 * len(words)) + weights[-1])))


def test_scorer_equals_brute_force(spark, sf):
    weights = np.random.default_rng(3).normal(size=quality.DIMENSIONS + 1).astype(np.float32) * 30
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.with_quality(docs, weights).collect():
        assert math.isclose(r.score, brute_quality(texts[r.doc_id], weights), rel_tol=1e-6, abs_tol=1e-9)


def test_copies_score_alike_wherever_they_stand(spark):
    weights = np.random.default_rng(4).normal(size=quality.DIMENSIONS + 1) * 30
    texts = ["The same text, copied.", "other WORDS 12 stand here", "x", "The same text, copied.", "", None, "The same text, copied.", "x"]
    scores = {}
    for order, parts in ((1, 1), (-1, 1), (1, 3), (-1, 8)):
        frame = spark.createDataFrame([(t,) for t in texts[::order]], "text string").repartition(parts) if parts > 1 else spark.createDataFrame([(t,) for t in texts[::order]], "text string").coalesce(1)
        for r in quality.with_quality(frame, weights).collect():
            scores.setdefault(r.text, set()).add(r.score)
    assert len(scores) == 5 and all(len(s) == 1 for s in scores.values())
