"""SimHash near-duplicates, found by anchor-point covering.

Fingerprint: 64 bits, each set if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles.
Texts link if their fingerprints differ in at most `threshold` bits.

The 64 bits are cut into parts; two linked fingerprints differ in at most threshold // parts bits of some part. The
anchors of a part are a covering code of radius 1: Hamming's [15, 11] code on its low bits, all patterns on the rest.
A fingerprint's home is the anchor within radius 1; it is also replicated to every anchor within 1 + threshold // parts,
so that each linked pair meets at a home of one of them. At an anchor only the links of a spanning forest are given out,
not all pairs; fingerprints are distinct there, so exact copies meet nowhere. An anchor with more than `most` members is
compared block by block in tasks of their own.

Null texts and texts without words have fingerprint 0 and link like any other. One row for each row of the documents,
repeated ones too; a null doc_id takes no part in the minimum (all null: null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from placespark.llm.components import connected_components
from placespark.llm.tables import arrow_map, fitting_partitions, written
from placespark.llm.text import LOWER, NON_SPACE, text_blocks, word_bounds

SEED = 42
LOW_BITS = 15
PIECE = 1 << 16


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space between, and each word's start and end there."""
    size = end - start
    to = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    inside = NON_SPACE[data]
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
    return out.tobytes(), to, to + size


def fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """The fingerprints (uint64) of texts."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi, data, offsets in text_blocks(texts):
        data = LOWER[data]
        start, end, doc = word_bounds(data, offsets, NON_SPACE)
        if not len(doc):
            continue
        joined, start, end = joined_words(data, start, end)
        words = np.bincount(doc, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(words)])
        full = np.arange(max(0, len(doc) - shingle + 1))
        full = full[doc[full] == doc[full + shingle - 1]] if len(full) else full
        short = np.flatnonzero((words > 0) & (words < shingle))
        a, b, of = np.concatenate([start[full], start[first[short]]]), np.concatenate([end[full + shingle - 1], end[first[short + 1] - 1]]), np.concatenate([doc[full], short])
        order = np.argsort(of, kind="stable")
        a, b, of = a[order], b[order], of[order]
        ones = np.zeros((hi - lo, 64), np.int64)
        for at in range(0, len(of), PIECE):
            cut = slice(at, at + PIECE)
            h = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(a[cut].tolist(), b[cut].tolist(), strict=True)), np.uint64, len(of[cut]))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows, begin = np.unique(of[cut], return_index=True)
            ones[rows] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        counts = np.bincount(of, minlength=hi - lo)
        out[lo:hi] = ((2 * ones > counts[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def with_fingerprint(documents: DataFrame, shingle: int = 4, text: str = "text", name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """documents (or its columns keep) with the fingerprint as a signed bigint."""
    return arrow_map(documents, {"texts": F.col(text)}, f"{name} bigint", lambda t: [pa.array(fingerprints(t, shingle).view(np.int64))], keep)


class Anchors:
    """The covering codes of the parts of a fingerprint."""

    def __init__(self, threshold: int, parts: int):
        self.tolerance = threshold // parts
        edges = [64 * i // parts for i in range(parts + 1)]
        self.parts = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.masks = []
        for _, width in self.parts:
            if width < LOW_BITS:
                raise ValueError("a part needs 15 bits or more")
            by = [[] for _ in range(16)]
            for weight in range(self.tolerance + 2):
                for bits in combinations(range(width), weight):
                    by[self._syndrome_of(bits)].append(sum(1 << b for b in bits))
            self.masks.append([np.array(x, np.uint64) for x in by])

    @staticmethod
    def _syndrome_of(bits: tuple[int, ...]) -> int:
        s = 0
        for b in bits:
            s ^= b + 1 if b < LOW_BITS else 0
        return s

    @staticmethod
    def syndromes(x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.uint64)
        for b in range(LOW_BITS):
            s ^= ((x >> np.uint64(b)) & np.uint64(1)) * np.uint64(b + 1)
        return s

    def _part(self, prints: np.ndarray, part: int) -> np.ndarray:
        lo, width = self.parts[part]
        return (prints >> np.uint64(lo)) & np.uint64((1 << width) - 1)

    def key(self, part: int, value: np.ndarray) -> np.ndarray:
        return (value * np.uint64(len(self.parts)) + np.uint64(part)).view(np.int64)

    def home(self, prints: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which prints have their home at the anchor of the same place in key."""
        part = key % len(self.parts)
        out = np.zeros(len(prints), bool)
        for p in np.unique(part).tolist():
            x = self._part(prints, p)
            s = self.syndromes(x)
            own = self.key(p, np.where(s > 0, x ^ (np.uint64(1) << (np.maximum(s, 1) - np.uint64(1))), x))
            out |= (part == p) & (own == key)
        return out

    def replicas_and_homes(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, index of the print, whether it is at home) of every anchor that each print goes to."""
        keys, who, home = [], [], []
        for p in range(len(self.parts)):
            x = self._part(prints, p)
            s = self.syndromes(x)
            for syndrome, masks in enumerate(self.masks[p]):
                own = np.flatnonzero(s == np.uint64(syndrome))
                if len(own):
                    keys.append(self.key(p, (x[own][:, None] ^ masks).ravel()))
                    who.append(np.repeat(own, len(masks)))
                    home.append(np.tile(np.arange(len(masks)) == 0, len(own)))  # masks begin with the one to the code word within radius 1
        none = np.zeros(0, np.int64)
        return (np.concatenate(keys), np.concatenate(who), np.concatenate(home)) if keys else (none, none, none.astype(bool))

    def replicas(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, index of the print) of every anchor that each print goes to."""
        return self.replicas_and_homes(prints)[:2]


def forest(left: np.ndarray, right: np.ndarray, prints: np.ndarray, threshold: int, cells: int = 1 << 21) -> list[tuple[int, int]]:
    """Spanning forest (places in prints) of the links between places left and right."""
    root = np.arange(len(prints))
    step = max(1, cells // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        i, j = np.nonzero(np.bitwise_count(prints[rows][:, None] ^ prints[right][None, :]) <= threshold)
        i, j = rows[i], right[j]
        i, j = i[i != j], j[i != j]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    own = np.flatnonzero(root != np.arange(len(prints)))
    return list(zip(own.tolist(), root[own].tolist(), strict=True))


def runs(batches: Iterator[pa.RecordBatch], most: int, columns: list[str], keys: int | None = None, whole: bool = False) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Runs of equal keys (the first `keys` columns; all but the last by default) as arrays; True for pieces of a run that is longer than most.

    whole: the finished runs of a batch come together, as one piece; keys is then 1.
    """
    keys = 1 if whole else len(columns) - 1 if keys is None else keys
    held: list[np.ndarray] | None = None
    long = False
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        change = np.zeros(len(now[0]), bool)
        for c in now[:keys]:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change)])
        if whole and not long:
            sizes = np.diff(cuts)
            if len(sizes) and sizes.max() <= most:
                yield False, [c[: cuts[-1]] for c in now]
                cuts = cuts[-1:]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if long or b - a > 1:
                yield long or b - a > most, [c[a:b] for c in now]
            long = False
        held = [c[cuts[-1] :] for c in now]
        if long or len(held[0]) > most:
            yield True, held
            held, long = [c[-1:] for c in held], True  # the key only; its row has been given out and is the same again
    if held is not None and (long or len(held[0]) > 1):
        yield long, held


def links_of(prints: DataFrame, threshold: int = 4, parts: int = 3, most: int = 20_000, rows_a_task: int = 2_000_000) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (column fingerprint) as all pairs within threshold bits do."""
    anchors = Anchors(threshold, parts)
    prints = prints.select("fingerprint").distinct()

    def replicate(batches):
        for batch in batches:
            x = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 4096):
                key, who = anchors.replicas(x[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x[at : at + 4096][who].view(np.int64))], names=["anchor", "fingerprint"])

    def compare(batches):
        for long, (key, value) in runs(batches, most, ["anchor", "fingerprint"]):
            if long:
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(key), pa.array(np.ones(len(key), bool))], names=["a", "b", "later"])
                continue
            x = value.view(np.uint64)
            home = np.flatnonzero(anchors.home(x, key))
            if len(home) and (found := forest(home, np.arange(len(x)), x, threshold)):
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(value[i]), pa.array(value[j]), pa.array(np.zeros(len(i), bool))], names=["a", "b", "later"])

    replicated = prints.mapInArrow(replicate, "anchor bigint, fingerprint bigint")
    # a row read twice at the edge of a long run is the same row again; distinct() below removes it
    met = replicated.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a bigint, b bigint, later boolean")
    met = written(met)
    later = met.where("later").select(F.col("b").alias("anchor"), F.col("a").alias("fingerprint")).distinct()
    found = met.where("not later").select("a", "b")
    n_later = later.count()
    if n_later:
        found = found.unionByName(_in_blocks(written(later), threshold, most, fitting_partitions(prints.sparkSession, n_later, rows_a_task)))
    return found


def _in_blocks(members: DataFrame, threshold: int, most: int, tasks: int) -> DataFrame:
    """Links within long anchors: members in blocks, each pair of blocks in a group of its own."""
    blocks = members.groupBy("anchor").agg(F.ceil(F.count("*") / (most // 2)).cast("int").alias("n"))
    dealt = members.join(blocks, "anchor").withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("n")).cast("int"))
    pairs = dealt.select("anchor", "block", "fingerprint", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fingerprint")

    def compare(batches):
        for _, (_, _, _, value) in runs(batches, 1 << 62, ["anchor", "i", "j", "fingerprint"]):
            x = np.unique(value).view(np.uint64)
            every = np.arange(len(x))
            if found := forest(every, every, x, threshold):
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(x[i].view(np.int64)), pa.array(x[j].view(np.int64))], names=["a", "b"])

    return pairs.repartition(tasks, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, *, shingle: int = 4, threshold: int = 4, parts: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of doc_id, fingerprint (signed bigint) and component_id (the least doc_id reachable over links) for each document."""
    prints = written(with_fingerprint(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle, keep=["doc_id"]))
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    return prints.join(component_ids(classes, links_of(prints, threshold, parts)), "fingerprint").select("doc_id", "fingerprint", "component_id")


def component_ids(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(fingerprint, component_id) for classes (fingerprint, least_id) under the links."""
    nodes = connected_components(links)
    least = nodes.join(classes, nodes["node"] == classes["fingerprint"]).groupBy("component").agg(F.min("least_id").alias("of_component"))
    linked = nodes.join(least, "component").select(F.col("node").alias("fingerprint"), "of_component")
    return classes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("of_component", "least_id").alias("component_id"))


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
