"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks, trained on labelled sentences.

A text falls into sentences (at a line's end, and at . ! ? before white space); of a sentence the letters and digits stay, with one
space before each word, and three or more single letters in a row become one word. Instances are the sentences' windows of WIDTH
places. A window's features are the subsequences of three characters that begin in it and span up to SPAN, each weighing DECAY
to the power of the characters it skips; the kernel of two windows is the product of their features. Inserted characters and
gaps lower a match but don't break it, and a match may run over words.

Rows are labelled, windows aren't, so a toxic row is a bag with a toxic window somewhere: the machine is trained in rounds on
the row's window that the last machine found most toxic, against the clean rows' most toxic sentences and those of earlier rounds near the margin; the first round takes
the log odds of the subsequences in toxic and clean rows. Landmarks are chosen among all these windows by pivoted Cholesky
steps. The features being linear in the subsequences' weights, the machine becomes one table of weights, so a text costs
its subsequences, whatever the number of landmarks. A text's score is a logistic function of its two most toxic
sentences, fitted to a fifth of the rows, which the machine isn't trained on.

Labels are learnt from at most `most` rows of each class, those of least hash of the id, among training rows; conflicting
labels of an id count as toxic, rows without label or id teach nothing; repeated rows of an id teach once. With one class only,
every score is that class's smoothed share. Null and empty texts have no sentences and get the score of a text with none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.llm.tables import arrow_map, written
from placespark.llm.text import LOWER, NON_SPACE, text_blocks, word_bounds

DECAY = 0.5
SPAN = 8
WIDTH = 16
MOST = 3000
LANDMARKS = 256
CANDIDATES = 3000
CALIBRATING = 20
ROUNDS = 6
THRESHOLD = 0.7
NONE = -2.0
FAR = -1.3

_CODES = np.arange(256)
#: 64 character classes: a-z, 0-9, everything else in ASCII, bytes of other characters by their low bits, what lies between sentences.
CLASSES = np.where((_CODES >= 97) & (_CODES <= 122), _CODES - 97, np.where((_CODES >= 48) & (_CODES <= 57), _CODES - 22, np.where(_CODES < 128, 36, 37 + _CODES % 26))).astype(np.int32)
BETWEEN = 63
_SOLID = (_CODES >= 128) | ((_CODES >= 97) & (_CODES <= 122)) | ((_CODES >= 48) & (_CODES <= 57))
_STOP = np.isin(_CODES, [ord(c) for c in ".!?"])
_PAIRS = [(j, k, DECAY ** (k - 2.0)) for k in range(2, SPAN) for j in range(1, k)]
_DIGITS = np.arange(1 << 18)
#: Subsequences that lie in one sentence.
INSIDE = (_DIGITS & 63 != BETWEEN) & (_DIGITS >> 6 & 63 != BETWEEN) & (_DIGITS >> 12 != BETWEEN)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Character classes of lower-cased data's sentences with SPAN - 1 places between, and start, end and text number of each."""
    start, end, doc = word_bounds(data, offsets, NON_SPACE)
    if not len(doc):
        return np.zeros(0, np.int32), start, end, doc
    solid = np.concatenate([[0], np.cumsum(_SOLID[data])])
    size = solid[end] - solid[start]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(len(doc), bool)  # whether a sentence begins at the word
    new[1:] = (doc[1:] != doc[:-1]) | _STOP[data[end[:-1] - 1]] | (lines[start[1:]] > lines[start[:-1]])
    single = size == 1
    follows = np.zeros(len(doc), bool)  # a single letter after another one of its sentence
    follows[1:] = single[1:] & single[:-1] & ~new[1:]
    third = np.zeros(len(doc), bool)
    third[2:] = follows[2:] & follows[1:-1]
    run = third.copy()
    run[:-1] |= third[1:]  # second or later letter of a run of three or more
    keep = size > 0
    gap = np.where(keep, np.where(run, 0, 1), 0)
    sentence = np.cumsum(new) - 1
    length = np.bincount(sentence, gap + size).astype(np.int64)
    to = np.cumsum(length + SPAN - 1) - length
    out = np.full(int(to[-1] + length[-1] + SPAN - 1) if len(to) else 0, BETWEEN, np.int32)
    before = np.cumsum(gap + size) - size  # letters and spaces before each word, over all sentences
    at = before - np.repeat(np.cumsum(length) - length, np.bincount(sentence)) + to[sentence]
    out[at[gap > 0] - 1] = CLASSES[32]
    letters = np.flatnonzero(_SOLID[data])
    out[np.arange(len(letters)) + np.repeat(at - (np.cumsum(size) - size), size)] = CLASSES[data[letters]]
    own = np.flatnonzero(length > 2)
    return out, to[own], to[own] + length[own], doc[np.flatnonzero(new)][own]


def begun(chars: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each place the sum of table over the subsequences that begin there, by their weights."""
    n = len(chars) - SPAN + 1
    if n <= 0:
        return np.zeros(len(chars))
    out = np.zeros(len(chars), np.float32)
    first = chars[:n] << 12
    for j in range(1, SPAN - 1):
        two = first | chars[j : j + n] << 6
        for k in range(j + 1, SPAN):
            out[:n] += np.float32(DECAY ** (k - 2.0)) * table[two | chars[k : k + n]]
    return out


def window_values(chars: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's highest value of a window, and where that begins."""
    sums = np.concatenate([[0.0], np.cumsum(begun(chars, table), dtype=np.float64)])
    size = end - start
    cut = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(cut - start, size)
    value = sums[np.minimum(place + WIDTH, np.repeat(end, size))] - sums[place]
    best = np.maximum.reduceat(value, cut)
    hits = np.flatnonzero(value == np.repeat(best, size))
    of = np.repeat(np.arange(len(size)), size)[hits]
    return best, place[hits[np.unique(of, return_index=True)[1]]]


def two_highest(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, and the places of their highest and second highest value; -1 for no second."""
    order = np.lexsort([-value, doc])
    rows, first = np.unique(doc[order], return_index=True)
    second = np.minimum(first + 1, len(order) - 1)
    has = (first + 1 < len(order)) & (doc[order[second]] == rows)
    return rows, order[first], np.where(has, order[second], -1)


def highest_two(texts: pa.Array, table: np.ndarray, bias: float, windows: list | None = None) -> np.ndarray:
    """The values of each text's two most toxic sentences, from NONE to 1; NONE where there is none. Their windows are added to windows as (row, classes)."""
    out = np.full((len(texts), 2), NONE)
    for lo, _, data, offsets in text_blocks(texts):
        chars, start, end, doc = sentences(LOWER[data], offsets)
        if not len(doc):
            continue
        value, place = window_values(chars, start, end, table)
        rows, first, second = two_highest(doc, value)
        out[lo + rows, 0] = np.clip(value[first] + bias, NONE, 1.0)
        has = second >= 0
        out[lo + rows[has], 1] = np.clip(value[second[has]] + bias, NONE, 1.0)
        if windows is not None:
            for row, a in [*zip(rows, first, strict=True), *zip(rows[has], second[has], strict=True)]:
                stop = min(int(end[a]), int(place[a]) + WIDTH + SPAN - 1)
                windows.append((lo + int(row), chars[place[a] : stop].astype(np.uint8).tobytes()))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, calibrates) of at most `most` training rows of each class; of several rows of an id the one of least text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calibrates"))


def _odds(rows: DataFrame) -> np.ndarray:
    """Table of log odds of each subsequence in toxic against clean rows; the counts are at most one for each subsequence."""

    def counted(batches):
        counts = np.zeros((2, 1 << 18), np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in text_blocks(batch.column("text")):
                chars, start, end, doc = sentences(LOWER[data], offsets)
                for row in np.unique(doc).tolist():
                    own = chars[start[doc == row][0] : end[doc == row][-1] + SPAN - 1]
                    counts[int(toxic[lo + row]), np.unique(_codes(own[None, :], len(own) - SPAN + 1))] += 1
        code = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(counts[1, code]), pa.array(counts[0, code])], names=["code", "n1", "n0"])

    found = rows.mapInArrow(counted, "code bigint, n1 bigint, n0 bigint").groupBy("code").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toArrow()
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = (found.column(c).to_numpy().astype(float) for c in ("n1", "n0"))
    table = np.zeros(1 << 18)
    p1, p0 = (n1 + 1) / (sizes[1] + 2), (n0 + 1) / (sizes[0] + 2)
    table[found.column("code").to_numpy()] = np.log(p1 * (1 - p0) / (p0 * (1 - p1))) / np.sqrt(1 / (n1 + 1) + 1 / (n0 + 1))
    table[~INSIDE] = 0
    return table / 10


def _codes(chars: np.ndarray, width: int) -> np.ndarray:
    """Codes of the subsequences that begin in the first width places of each row (rows, width * len(_PAIRS))."""
    chars = chars.astype(np.int32)
    columns = [chars[:, :width] << 12 | chars[:, j : j + width] << 6 | chars[:, k : k + width] for j, k, _ in _PAIRS]
    return np.concatenate(columns, axis=1)


def features(windows: list[bytes]) -> np.ndarray:
    """Codes (windows, WIDTH * len(_PAIRS)) of the windows' subsequences; weights() has their weights."""
    chars = np.full((len(windows), WIDTH + SPAN - 1), BETWEEN, np.uint8)
    for row, window in zip(chars, windows, strict=True):
        row[: len(window)] = np.frombuffer(window, np.uint8)
    return _codes(chars, WIDTH)


def weights() -> np.ndarray:
    return np.repeat(np.array([w for _, _, w in _PAIRS], np.float32), WIDTH)


def kernel_column(codes: np.ndarray, one: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The kernel of every row with one of them."""
    dense = np.zeros(1 << 18, np.float32)
    np.add.at(dense, one, w)
    dense[~INSIDE] = 0
    out = np.empty(len(codes))
    for at in range(0, len(codes), 4096):
        out[at : at + 4096] = dense[codes[at : at + 4096]] @ w
    return out


def _landmarks(codes: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, candidates: int) -> np.ndarray:
    """Rows of the landmarks: of `candidates` rows of each class those that the ones before explain least (pivoted Cholesky)."""
    chosen = []
    for sign in (1, -1):
        own = np.flatnonzero(y == sign)
        own = own[:: -(-len(own) // candidates)]
        some = codes[own]
        left = np.array([(np.bincount(np.unique(c, return_inverse=True)[1], w * INSIDE[c]) ** 2).sum() for c in some])
        scale, factors = left.max(initial=0.0), np.zeros((n // 2, len(own)))
        for k in range(min(n // 2, len(own))):
            i = int(left.argmax())
            if left[i] <= 1e-6 * scale:
                break
            column = kernel_column(some, some[i], w) - factors[:k].T @ factors[:k, i]
            factors[k] = column / np.sqrt(left[i])
            left = np.maximum(left - factors[k] ** 2, 0)
            left[i] = 0
            chosen.append(own[i])
    return np.array(chosen)


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton's method on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active]
        new = np.linalg.solve(keep + a.T @ (a * c[:, None]), a.T @ (c * y[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * (w + new)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slightly regularised logistic regression by Newton's method; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-2, 1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(keep + x.T @ (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]), x.T @ (cost * (y - p)) - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(positive: list[bytes], negative: list[bytes], landmarks: int = LANDMARKS, strength: float = 100.0, candidates: int = CANDIDATES) -> tuple[np.ndarray, float, np.ndarray]:
    """Table of weights and bias of the machine that tells the windows apart, and its values of the negative ones."""
    codes, w = features(positive + negative), weights()
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    chosen = _landmarks(codes, y, w, landmarks, candidates)
    kernel = np.stack([kernel_column(codes, codes[i], w) for i in chosen], axis=1)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    cost = np.where(y > 0, 1 / len(positive), 2 / max(1, len(negative))) * strength
    slope, bias = _machine(kernel @ root, y, cost)
    table = np.zeros(1 << 18)
    for i, share in zip(chosen, root @ slope, strict=True):
        np.add.at(table, codes[i], share * w)
    table[~INSIDE] = 0
    return table, bias, (kernel @ root @ slope + bias)[len(positive) :]


def train(documents: DataFrame, labels: DataFrame, most: int = MOST, landmarks: int = LANDMARKS, rounds: int = ROUNDS, candidates: int = CANDIDATES, calibrating: int = CALIBRATING) -> dict:
    """The machine: table, bias and the logistic function's weights; all of a bounded size.

    It is taught by at most `most` rows of each class, and its landmarks are chosen among `candidates` of their windows. The rows held
    back from teaching calibrate it; if a class has fewer than `calibrating` of them, the taught rows do too.
    """
    rows = written(training_rows(documents, labels, most))
    spark = documents.sparkSession
    shares = {(r[0], r[1]): r[2] for r in rows.groupBy("toxic", "calibrates").count().collect()}
    n1, n0 = (sum(n for (c, _), n in shares.items() if c == toxic) for toxic in (1, 0))
    constant = (n1 + 1) / (n1 + n0 + 2)
    taught = rows.where("not calibrates")
    if not shares.get((1, False)) or not shares.get((0, False)):
        return {"constant": constant}

    def found(table: np.ndarray, bias: float, df: DataFrame) -> pa.Table:
        """(toxic, first, second, windows) of each row: at most 2 * most rows, with two windows each."""
        model = spark.sparkContext.broadcast(table.astype(np.float32))

        def highest(texts: pa.Array) -> list[pa.Array]:
            windows: list = []
            top = highest_two(texts, model.value, bias, windows)
            by_row: list[list[bytes]] = [[] for _ in range(len(texts))]
            for row, window in windows:
                by_row[row].append(window)
            return [pa.array(top[:, 0]), pa.array(top[:, 1]), pa.array(by_row, pa.list_(pa.binary()))]

        return arrow_map(df, {"texts": F.col("text")}, "first double, second double, windows array<binary>", highest, keep=["toxic"]).toArrow()

    table, bias = _odds(taught), 0.0
    hard: set[bytes] = set()
    for _ in range(rounds):
        now = found(table, bias, taught).to_pylist()
        positive = sorted({r["windows"][0] for r in now if r["toxic"] and r["windows"]})
        negative = sorted((hard | {w for r in now if not r["toxic"] for w in r["windows"]}) - set(positive))
        if not positive or not negative:
            return {"constant": constant}
        table, bias, values = fit(positive, negative, landmarks, candidates=candidates)
        hard = {w for w, v in zip(negative, values.tolist(), strict=True) if v > FAR}  # others have no say in the machine
    model = {"table": table.astype(np.float32), "bias": bias}
    judged = rows.where("calibrates") if min(shares.get((c, True), 0) for c in (0, 1)) >= calibrating else rows
    known = found(table, bias, judged)
    model["weights"] = _logistic(np.stack([known.column("first").to_numpy(), known.column("second").to_numpy()], axis=1), known.column("toxic").to_numpy().astype(float))
    return model


def with_score(documents: DataFrame, model: dict, text: str | Column = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """documents (or its columns keep) with name: the score from 0 to 1. text: a column, or the path of a kept one."""
    if "constant" in model:
        return documents.select(*(documents.columns if keep is None else keep), F.lit(float(model["constant"])).alias(name))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> list[pa.Array]:
        m = shared.value
        top = highest_two(texts, m["table"], m["bias"])
        return [pa.array(1 / (1 + np.exp(-np.clip(top @ m["weights"][:2] + m["weights"][2], -30, 30))))]

    return arrow_map(documents, {"texts": text}, f"{name} double", score, keep)


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document by a machine trained on its labelled training rows."""
    scored = with_score(documents.select("doc_id", "text"), train(documents, labels), F.col("text"), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those whose score reaches THRESHOLD."""
    rows = documents.select(F.struct("*").alias("doc"))
    return with_score(rows, train(documents, labels), "doc.text", keep=["doc"]).where(F.col("score") < THRESHOLD).select("doc.*")
