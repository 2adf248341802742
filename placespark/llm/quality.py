"""Quality by weak labels: heuristic labellers vote, expectation-maximisation finds how right each is, and the posterior
labels train a hashed linear scorer.

Every text gets a vote (bad, none, good) from each labeller. What the estimation needs of the corpus is how often each
pattern of votes occurs: at most 3 ** 8 counts, over all documents. EM fits, for each class, each labeller's vote
probabilities, beginning with the majority; it gives every pattern a posterior. The scorer sees hashed words, shapes of
words and pairs of shapes, averaged over the text; it is fitted by gradient steps to the posteriors of a sample of about
`most` texts (a parameter), chosen by their hashes and one of each copy, whole, by the counts of their features; it scores all.

Null and empty texts have no words: most labellers don't vote, and the scorer gives its bias. With no documents there
are no rows. Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placespark.llm.tables import arrow_map
from placespark.llm.text import LOWER, NON_SPACE, mix, ragged, span_hashes, text_blocks, word_bounds

LABELLERS = ["symbols", "repeats", "neighbours", "capitals", "word length", "marks", "lines", "length"]
#: Below the first a labeller votes good, above the second bad ("length" the other way round).
BOUNDS = [(0.08, 0.14), (0.12, 0.2), (0.05, 0.2), (0.12, 0.3), (0.15, 0.35), (0.04, 0.12), (0.15, 0.4), (8, 30)]
BAD, NONE, GOOD = 0, 1, 2
DIMENSIONS = 1 << 16
MOST = 6000
ROUNDS = 200
_C = np.arange(256)
_LOW, _UP, _DIGIT, _OTHER = (_C >= 97) & (_C <= 122), (_C >= 65) & (_C <= 90), (_C >= 48) & (_C <= 57), _C >= 128


def _mean(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, values, minlength=n) / np.maximum(1, np.bincount(of, minlength=n))


def votes_of(texts: pa.Array) -> np.ndarray:
    """Votes (rows, labellers)."""
    out = np.full((len(texts), len(LABELLERS)), NONE, np.int64)
    for lo, hi, raw, offsets in text_blocks(texts):
        n = hi - lo
        if not len(raw):
            continue
        start, end, doc = word_bounds(raw, offsets, NON_SPACE)
        hashes = span_hashes(LOWER[raw], start, end)
        of = np.searchsorted(offsets, np.arange(len(raw)), "right") - 1
        solid = NON_SPACE[raw]
        letters = (_LOW | _UP | _OTHER)[raw]
        words = np.bincount(doc, minlength=n)
        symbols = _mean((solid & ~letters & ~_DIGIT[raw]).astype(float)[solid], of[solid], n)
        capitals = _mean(_UP[raw[letters]].astype(float), of[letters], n)
        _, place, counts = np.unique(mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
        top = np.zeros(n)
        np.maximum.at(top, doc[place], counts)
        repeats = top / np.maximum(1, words)
        same = np.zeros(len(doc))
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        size = (end - start).astype(float)
        inner = np.concatenate([[0], np.cumsum(letters | _DIGIT[raw])])
        bare = (inner[end] == inner[start]).astype(float)
        line_start, line_end, line_doc = word_bounds(raw, offsets, _C != 10)
        _, line_place = np.unique(mix(span_hashes(raw, line_start, line_end) ^ mix(line_doc.astype(np.uint64) + np.uint64(1))), return_index=True)
        lines = np.bincount(line_doc, minlength=n)
        again = 1 - np.bincount(line_doc[line_place], minlength=n) / np.maximum(1, lines)
        odd = _mean(((size < 2) | (size > 14)).astype(float), doc, n)
        values = [symbols, repeats, _mean(same, doc, n), capitals, odd, _mean(bare, doc, n), np.where(lines > 1, again, np.nan)]
        for k, value in enumerate(values):
            good, bad = BOUNDS[k]
            ok = words >= (20 if k in (1, 2) else 1)
            out[lo:hi, k] = np.where(ok & (value > bad), BAD, np.where(ok & (value < good), GOOD, NONE))
        few, many = BOUNDS[-1]
        out[lo:hi, -1] = np.where((words > 0) & (words < few), BAD, np.where(words >= many, GOOD, NONE))
    return out


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def posteriors(counts: dict[int, int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every pattern of votes, and the labellers' accuracies among their votes."""
    n = len(LABELLERS)
    if not counts:
        return np.full(3**n, 0.5), np.full(n, 0.5)
    patterns = np.array(sorted(counts), np.int64)
    weights = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(n) % 3
    balance = (votes - NONE).sum(axis=1)
    good = np.clip(0.5 + 0.25 * np.where((votes == BAD).any(axis=1), np.minimum(balance - n / 2, -1), balance) / n * 2, 0.05, 0.95)
    for _ in range(rounds):
        tables = []
        for share in (1 - good, good):
            own = weights * share
            tables.append(np.array([[own[votes[:, k] == v].sum() + 1.0 for v in range(3)] for k in range(n)]))
        prior = np.array([(weights * (1 - good)).sum() + 1, (weights * good).sum() + 1])
        logs = [np.log(p) + np.log(t / t.sum(axis=1, keepdims=True))[np.arange(n), votes].sum(axis=1) for p, t in zip(prior / prior.sum(), tables, strict=True)]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done = np.abs(new - good).max() < 1e-6
        good = new
        if done:
            break
    right = [(weights * (np.where(votes[:, k] == GOOD, good, 0) + np.where(votes[:, k] == BAD, 1 - good, 0))).sum() / max(1.0, weights[votes[:, k] != NONE].sum()) for k in range(n)]
    table = np.full(3**n, 0.5)
    table[patterns] = good
    return table, np.array(right)


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in a row, and how many each has."""
    found, counts = [], np.zeros(len(texts), np.int64)
    for lo, hi, raw, offsets in text_blocks(texts):
        start, end, doc = word_bounds(raw, offsets, NON_SPACE)
        if not len(doc):
            continue
        words = span_hashes(LOWER[raw], start, end)
        shape = np.minimum(end - start, 15).astype(np.uint64)
        for kind in (_LOW, _UP, _DIGIT, _OTHER, ~(_LOW | _UP | _DIGIT | _OTHER)):
            sums = np.concatenate([[0], np.cumsum(kind[raw])])
            shape = shape * np.uint64(3) + np.minimum(sums[end] - sums[start], 2).astype(np.uint64)
        shape = mix(shape + np.uint64(1))
        before = np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), np.uint64(7), np.concatenate([[np.uint64(7)], shape[:-1]]))
        repeat = np.concatenate([[False], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]).astype(np.uint64)
        pair = mix(before * np.uint64(31) + shape + repeat)
        found.append(np.stack([words, shape, pair], axis=1).ravel() % np.uint64(DIMENSIONS))
        counts[lo:hi] = 3 * np.bincount(doc, minlength=hi - lo)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)).astype(np.int64), counts


def counted_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features of all texts in a row, how often each stands in its text, and how many distinct ones each text has."""
    places, n = features_of(texts)
    keys, times = np.unique(np.repeat(np.arange(len(n)), n) * DIMENSIONS + places, return_counts=True)
    return keys % DIMENSIONS, times, np.bincount(keys // DIMENSIONS, minlength=len(n))


def _fit(places: np.ndarray, times: np.ndarray, sizes: np.ndarray, target: np.ndarray, rounds: int) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer of averaged features, by adaptive gradient steps; sizes[i] of the places are those of row i."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    share = times / np.maximum(1, np.bincount(of, times, minlength=len(sizes)))[of]
    w, scale = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(of, w[places] * share, minlength=len(sizes)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(sizes)
        step = np.append(np.bincount(places, error[of] * share, minlength=DIMENSIONS), error.sum()) + 1e-7 * w
        scale += step * step
        w -= 0.3 * step / np.sqrt(scale)
    return w


def train(documents: DataFrame, text: str = "text", most: int = MOST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the patterns and the scorer's weights."""
    votes = documents.select(F.col(text).alias("text"), F.lit(1).alias("one"))
    patterns = arrow_map(votes, {"texts": F.col("text")}, "pattern int", lambda t: [pa.array(pattern_of(votes_of(t)).astype(np.int32))], keep=["one"])
    counts = {r[0]: r[1] for r in patterns.groupBy("pattern").count().collect()}
    table, _ = posteriors(counts)
    hashed = votes.select("text", F.xxhash64("text").alias("place"))
    share = min(1.0, most / max(1, sum(counts.values())))
    sample = hashed.where(F.pmod("place", F.lit(1 << 30)) < int(share * (1 << 30)))

    def features(texts: pa.Array) -> list[pa.Array]:
        places, times, n = counted_features(texts)
        return [pa.array(pattern_of(votes_of(texts)).astype(np.int32)), ragged(places, n, pa.int32()), ragged(times, n, pa.int32())]

    rows = arrow_map(sample, {"texts": F.col("text")}, "pattern int, places array<int>, times array<int>", features, keep=["place"]).dropDuplicates(["place"]).toArrow()
    if not rows.num_rows:
        return table, np.zeros(DIMENSIONS + 1)
    places, times = (rows.column(c).combine_chunks() for c in ("places", "times"))
    sizes = places.value_lengths().to_numpy(zero_copy_only=False)
    return table, _fit(places.flatten().to_numpy(), times.flatten().to_numpy(), sizes, table[rows.column("pattern").to_numpy()], rounds)


def with_quality(documents: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """documents (or its columns keep) with name: the scorer's score from 0 to 1."""
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(texts: pa.Array) -> list[pa.Array]:
        w = shared.value
        places, counts = features_of(texts)
        z = np.bincount(np.repeat(np.arange(len(counts)), counts), w[places], minlength=len(counts)) / np.maximum(1, counts) + w[-1]
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]

    return arrow_map(documents, {"texts": F.col(text)}, f"{name} double", score, keep)


def quality_report(documents: DataFrame) -> DataFrame:
    """(doc_id, score, keep) of every document."""
    rows = documents.select("doc_id", "text")
    return with_quality(rows, train(rows)[1], keep=["doc_id"]).withColumn("keep", F.col("score") >= 0.5)
