"""Benchmark decontamination by winnowing.

Every window of WINDOW item words keeps the k-gram of least hash (the last of equals); a text keeps those of its own
windows by the same rule. Two windows of the same words therefore keep the same k-gram, so a join of the kept k-grams
finds every shared window; each hit is then extended to all windows that hold the k-gram, and those are compared word
for word. Items of fewer words are one window each: there the k-gram is the whole window.

The benchmark is a stated query set. It is broadcast in blocks of at most block_chars characters (one item alone may be longer),
each of which is one more pass over the documents; between passes the state is written to the shared folder, so that a
task never holds more than one block. Nothing is shuffled, so no key can be hot.

Nulls and empty texts have no words: n_words 0, not contaminated; null item texts are no windows. Items with null ids
count for n_hit but can't be listed; ids of any type are listed as strings. Repeated rows of documents are judged one by
one; repeated item ids count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.llm.tables import arrow_map, written
from placespark.llm.text import ALNUM, LOWER, gram_hashes, ragged, span_hashes, text_blocks, word_bounds

WINDOW = 10
GRAM = 5
BLOCK_CHARS = 8_000_000
OUTPUTS = "n_words bigint, hits array<bigint>, items array<string>"


def kept_grams(grams: np.ndarray, doc: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Positions of the k-grams that the windows inside one text keep."""
    n, span = len(doc) - window + 1, window - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        lower = grams[j : j + n] <= least
        least[lower] = grams[j : j + n][lower]
        place[lower] = np.flatnonzero(lower) + j
    return np.unique(place[doc[:n] == doc[window - 1 :]])


class ItemWindows:
    """Windows of some items: by length their kept k-grams, hashes and words, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, gram: int):
        found: dict[int, dict[bytes, tuple[int, set]]] = {}
        grams: dict[int, set[int]] = {}
        ids = [i for i, _ in items]
        for lo, _, data, offsets in text_blocks(pa.array([t for _, t in items], pa.string())):
            data = LOWER[data]
            start, end, doc = word_bounds(data, offsets, ALNUM)
            hashes = span_hashes(data, start, end)
            for row in range(len(offsets) - 1):
                a, b = np.searchsorted(doc, [row, row + 1])
                size = min(window, int(b - a))
                if not size:
                    continue
                k = gram if size == window else size
                own = gram_hashes(hashes[a:b], k)
                grams.setdefault(size, set()).update(own[kept_grams(own, doc[a:b], size, k)].tolist())
                whole = gram_hashes(hashes[a:b], size)
                for i, h in enumerate(whole.tolist()):
                    words = b" ".join(data[s:e].tobytes() for s, e in zip(start[a + i : a + i + size], end[a + i : a + i + size], strict=True))
                    found.setdefault(size, {}).setdefault(words, (h, set()))[1].add(ids[lo + row])
        self.sizes = []
        for size, windows in sorted(found.items()):
            order = sorted(windows.items(), key=lambda x: x[1][0])
            hashes = np.array([h for _, (h, _) in order], np.uint64)
            self.sizes.append((size, gram if size == window else size, np.array(sorted(grams[size]), np.uint64), hashes, [w for w, _ in order], [i for _, (_, i) in order]))


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    return (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == values)


def match_batch(texts: pa.Array, windows: ItemWindows, window: int) -> tuple[np.ndarray, list[np.ndarray], list[set]]:
    """For each text: number of words, hit words' places and items found."""
    n_words, hits, items = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)] * len(texts), [set() for _ in range(len(texts))]
    for lo, hi, data, offsets in text_blocks(texts):
        data = LOWER[data]
        start, end, doc = word_bounds(data, offsets, ALNUM)
        n_words[lo:hi] = np.bincount(doc, minlength=hi - lo)
        hashes = span_hashes(data, start, end)
        hit = np.zeros(len(doc) + 1, np.int64)
        for size, k, kept, window_hashes, words, owners in windows.sizes:
            if len(doc) < size:
                continue
            grams = gram_hashes(hashes, k)
            place = kept_grams(grams, doc, size, k)
            place = place[member(grams[place], kept)]
            if not len(place):
                continue
            near = np.unique((place[:, None] - np.arange(size - k + 1)).ravel())
            near = near[(near >= 0) & (near + size <= len(doc))]
            near = near[doc[near] == doc[near + size - 1]]
            whole = gram_hashes(hashes, size)[near]
            for s, h in zip(near.tolist(), whole.tolist(), strict=True):
                at, own = int(np.searchsorted(window_hashes, np.uint64(h))), None
                while at < len(words) and int(window_hashes[at]) == h:
                    own = own or b" ".join(data[a:b].tobytes() for a, b in zip(start[s : s + size], end[s : s + size], strict=True))
                    if words[at] == own:
                        hit[s] += 1
                        hit[s + size] -= 1
                        items[lo + int(doc[s])] |= owners[at]
                        break
                    at += 1
        covered = np.flatnonzero(np.cumsum(hit)[:-1])
        if len(covered):
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            for row in np.unique(doc[covered]).tolist():
                own = covered[(covered >= first[row]) & (covered < first[row + 1])]
                hits[lo + row] = own - first[row]
    return n_words, hits, items


def matcher(windows: Broadcast, window: int):
    """One pass: adds what this block of items hits to what earlier blocks did."""

    def run(texts: pa.Array, hits: pa.Array, items: pa.Array) -> list[pa.Array]:
        n_words, new_hits, new_items = match_batch(texts, windows.value, window)
        old_hits, old_items = hits.to_pylist(), items.to_pylist()
        all_hits = [np.union1d(a, np.array(b or [], np.int64)) for a, b in zip(new_hits, old_hits, strict=True)]
        all_items = [sorted({x for x in a if x is not None} | set(b or [])) for a, b in zip(new_items, old_items, strict=True)]
        places = ragged(np.concatenate([*all_hits, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(x) for x in all_hits]), pa.int64())
        return [pa.array(n_words), places, pa.array(all_items, pa.list_(pa.string()))]

    return run


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> list[DataFrame]:
    """The benchmark's rows in parts of about block_chars characters."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, gram: int = GRAM, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None) -> DataFrame:
    """documents' columns (or those in keep) with n_words, hits (places of hit words) and items (ids of items with shared windows)."""
    spark = documents.sparkSession
    columns = documents.columns if keep is None else keep
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(1))
    apart = text.split(".")[0] not in columns  # a kept text is read from its row
    held = ["row", "own_text"] if apart else ["row"]
    state = documents.select(whole.alias("row"), *([F.col(text).alias("own_text")] if apart else []), F.lit(None).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("hits"), F.array().cast("array<string>").alias("items"))
    blocks = item_blocks(benchmark, item_id, item_text, block_chars)
    for i, block in enumerate(blocks):
        windows = spark.sparkContext.broadcast(ItemWindows([(r[0], r[1]) for r in block.collect()], window, gram))
        last = i == len(blocks) - 1
        state = arrow_map(state, {"texts": F.col("own_text") if apart else f"row.{text}", "old_hits": F.col("hits"), "old_items": F.col("items")}, OUTPUTS, matcher(windows, window), keep=["row"] if last else held)
        state = state if last else written(state)
    return state.select(*[F.col("row")[c].alias(c) for c in columns], "n_words", "hits", "items")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of find_contamination for each document."""
    found = find_contamination(documents, benchmark, keep=["doc_id"])
    return found.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that share a window with the benchmark."""
    rows = documents.select(F.struct("*").alias("doc"))
    return find_contamination(rows, benchmark, text="doc.text", keep=["doc"]).where(F.size("hits") == 0).select("doc.*")
