"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates: a set's fingerprint has WORDS times 64 bits. Each word of it is cut into parts whose anchors are those of simhash
(Hamming's covering code, replicated within the covering radius plus 1), so two sets meet at an anchor if some part of
some word differs in one bit or less. They are candidates if CHECKED bits of the other words differ in at most MOST_BITS; an anchor
gives only a spanning forest of its candidates. Confirmed links: the candidates reachable from each other are compared by
their sets, in blocks of about block_bytes of text, each pair of blocks a group of its own; blocks too give a spanning forest
only. Equal sets are one candidate. SimHash is a sketch, so some pairs just over 0.8 never meet; the README has the recall.

Null texts and texts without words have the empty set; shorter texts are one shingle. A null doc_id is the least wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placespark.llm.components import connected_components, spanning
from placespark.llm.simhash import Anchors, runs
from placespark.llm.tables import arrow_map, fitting_partitions, written
from placespark.llm.text import LOWER, NON_SPACE, gram_hashes, mix, ragged, span_hashes, text_blocks, word_bounds

SHINGLE = 5
WORDS = 4
PARTS = 3
CHECKED = 101
MOST_BITS = 22
BLOCK_BYTES = 1 << 20
ROWS_A_TASK = 2_000_000
PAIRS = 1 << 20
_GOLDEN = 0x9E3779B97F4A7C15
_LOW = CHECKED - 64
#: Eight bits as the low bits of eight bytes, so that one sum counts eight bits.
_LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of texts the number of its first, and row (from there) and hash of the distinct shingles, by row."""
    for lo, hi, data, offsets in text_blocks(texts):
        data = LOWER[data]
        start, end, doc = word_bounds(data, offsets, NON_SPACE)
        if not len(doc):
            continue
        h = span_hashes(data, start, end)
        words = np.bincount(doc, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(words)])[:-1]
        rows, found = [], []
        for n in range(1, SHINGLE + 1):
            at = np.arange(max(0, len(h) - n + 1)) if n == SHINGLE else first[words == n]
            at = at[doc[at] == doc[at + n - 1]]
            rows.append(doc[at])
            found.append(gram_hashes(h, n)[at])
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        rows, found = rows[order], found[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
        yield lo, rows[new], found[new]


def wide_fingerprints(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(sets, WORDS) of uint64 for hashes by ascending row: a bit is set if over half of the set's mixed hashes have it."""
    counts = np.bincount(rows)
    counts = counts[counts > 0]
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(len(rows)) - np.repeat(first, counts)
    cuts = np.flatnonzero(place % 255 == 0)  # eight counters of a byte hold 255 at most
    begin = np.searchsorted(cuts, first)
    out = np.zeros((len(counts), WORDS), np.uint64)
    for word in range(WORDS):
        mixed = mix(hashes + np.uint64(word * _GOLDEN & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            lanes = np.add.reduceat(_LANES[mixed[:, byte]], cuts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(lanes, begin, axis=0, dtype=np.int64)
            value = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little")[:, 0]
            out[:, word] |= value.astype(np.uint64) << np.uint64(8 * byte)
    return out


def sketched(texts: pa.Array) -> list[pa.Array]:
    """A key of each text's set, and its fingerprint (no words for an empty set)."""
    key, counts, prints = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), []
    for lo, rows, hashes in shingle_sets(texts):
        own, begin = np.unique(rows, return_index=True)
        key[lo + own] = np.add.reduceat(mix(hashes), begin)
        counts[lo + own] = WORDS
        prints.append(wide_fingerprints(rows, hashes).ravel())
    return [pa.array(key.view(np.int64)), ragged(np.concatenate([*prints, np.zeros(0, np.uint64)]).view(np.int64), counts, pa.int64())]


def replicated(keys: np.ndarray, prints: np.ndarray, anchors: Anchors) -> Iterator[pa.RecordBatch]:
    """(place, member, checked): the anchor above 37 bits of one other word, the key with its last bit for "at home", another word."""
    low = np.uint64((1 << _LOW) - 1)
    for word in range(WORDS):
        anchor, who, home = anchors.replicas_and_homes(prints[:, word])
        place = (anchor.view(np.uint64) * np.uint64(WORDS) + np.uint64(word)) << np.uint64(_LOW)
        place |= (prints[:, (word + 2) % WORDS] & low)[who]
        member = (keys[who] & ~np.uint64(1)) | home
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (place, member, prints[:, (word + 1) % WORDS][who])], names=["place", "member", "checked"])


def _close(i: np.ndarray, j: np.ndarray, low: np.ndarray, checked: np.ndarray) -> np.ndarray:
    return np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(checked[i] ^ checked[j]) <= MOST_BITS


def _homes_with_members(first: np.ndarray, home: np.ndarray, low: np.ndarray, checked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of a place at home and any place of the same anchor; first: where each anchor begins, and the end."""
    size = np.diff(first)
    of = np.repeat(np.arange(len(size)), size)
    homes = np.flatnonzero(home & (size[of] > 1))
    many = size[of[homes]]
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + PAIRS, PAIRS), "left")
    for a, b in zip(cuts, np.append(cuts[1:], len(homes)), strict=True):
        own, n = homes[a:b], many[a:b]
        i = np.repeat(own, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first[of[own]], n)
        ok = _close(i, j, low, checked)
        yield i[ok], j[ok]


def _least_forest(member: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of places whose roots are of least key, so that anchors agree on them; none from a key to itself."""
    order = np.argsort(member >> 1, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    i, j = spanning(len(order), ((rank[i], rank[j]) for i, j in pairs))
    i, j = order[i], order[j]
    ok = member[i] >> 1 != member[j] >> 1
    return i[ok], j[ok]


def met_at_anchors(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of each anchor's candidates from rows sorted by place; the members of anchors with more
    than most come back as they are, as later."""
    names = ["a", "b", "checked", "later"]
    for long, (anchor, place, member, checked) in runs(_with_anchor(batches), most, ["anchor", "place", "member", "checked"], whole=True):
        if long:
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(member), pa.array(checked), pa.array(np.ones(len(place), bool))], names=names)
            continue
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
        low, value = place.view(np.uint64) & np.uint64((1 << _LOW) - 1), checked.view(np.uint64)
        i, j = _least_forest(member, _homes_with_members(first, (member & 1) > 0, low, value))
        yield pa.RecordBatch.from_arrays([pa.array(member[i] | 1), pa.array(member[j] | 1), pa.array(np.zeros(len(i), np.int64)), pa.array(np.zeros(len(i), bool))], names=names)


def _with_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.column("place").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(place >> _LOW), *batch.columns], names=["anchor", "place", "member", "checked"])


def candidate_links(prints: DataFrame, most: int = 20_000, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Links (a, b) of keys, with the last bit set, that connect prints (key, prints) as all candidates do."""
    anchors = Anchors(2 * PARTS - 1, PARTS)

    def replicate(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            words = batch.column("prints").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
            for at in range(0, len(keys), 1024):
                yield from replicated(keys[at : at + 1024], words[at : at + 1024], anchors)

    rows = prints.where(F.size("prints") == WORDS).mapInArrow(replicate, "place bigint, member bigint, checked bigint")
    rows = rows.repartition(F.shiftright("place", _LOW)).sortWithinPartitions("place")
    met = written(rows.mapInArrow(lambda batches: met_at_anchors(batches, most), "a bigint, b bigint, checked bigint, later boolean"))
    found = met.where("not later").select("a", "b")
    later = met.where("later").select(F.shiftright("a", _LOW).alias("anchor"), F.col("a").alias("place"), F.col("b").alias("member"), "checked").distinct()
    n_later = later.count()
    return found.unionByName(_in_blocks(written(later), most, fitting_partitions(prints.sparkSession, n_later, rows_a_task))) if n_later else found


def _in_blocks(members: DataFrame, most: int, tasks: int) -> DataFrame:
    """Links within long anchors: members in blocks, each pair of blocks in a group of its own."""
    counts = members.groupBy("anchor").agg(F.ceil(F.count("*") / (most // 2)).cast("int").alias("n"))
    dealt = members.join(counts, "anchor").withColumn("block", F.pmod(F.xxhash64("member"), F.col("n")).cast("int"))
    pairs = dealt.select("anchor", "block", "place", "member", "checked", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "place", "member", "checked")

    def compare(batches):
        for _, (_, _, _, place, member, checked) in runs(batches, 1 << 62, ["anchor", "i", "j", "place", "member", "checked"], keys=3):
            low, value = place.view(np.uint64) & np.uint64((1 << _LOW) - 1), checked.view(np.uint64)
            i, j = _least_forest(member, _homes_with_members(np.array([0, len(place)]), (member & 1) > 0, low, value))
            yield pa.RecordBatch.from_arrays([pa.array(member[i] | 1), pa.array(member[j] | 1)], names=["a", "b"])

    return pairs.repartition(tasks, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(compare, "a bigint, b bigint")


def forest(of: np.ndarray, hashes: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between n sets: each set not yet reached is compared with all such that share a hash."""
    size = np.bincount(of, minlength=n)
    terms, term = np.unique(hashes, return_inverse=True)
    order = np.argsort(term, kind="stable")
    holders = of[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
    first = np.concatenate([[0], np.cumsum(size)])
    new, links = np.ones(n, bool), []
    for root in range(n):
        if not new[root]:
            continue
        new[root] = False
        queue = [root]
        while queue and new.any():
            x = queue.pop()
            own = term[first[x] : first[x + 1]]
            a, count = begin[own], begin[own + 1] - begin[own]
            places = np.repeat(a - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            common = np.bincount(holders[places], minlength=n)
            near = np.flatnonzero(new & (9 * common >= 4 * (size + size[x])) & (common > 0))  # Jaccard 0.8: common >= 0.8 (a + b - common)
            new[near] = False
            links += [(x, y) for y in near.tolist()]
            queue += near.tolist()
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group (candidates, i, j) of rows sorted by it; a group is two blocks of text at most."""
    names = ["candidates", "i", "j"]
    held: list[pa.RecordBatch] = []

    def links(group: pa.Table) -> pa.RecordBatch:
        key = group.column("key").to_numpy()
        sets = [(lo + rows, hashes) for lo, rows, hashes in shingle_sets(group.column("text").combine_chunks())]
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        of, hashes = (np.concatenate(x) for x in zip(none, *sets, strict=True))
        found = np.array(forest(of, hashes, len(key)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(key[found[:, 0]]), pa.array(key[found[:, 1]])], names=["a", "b"])

    last = None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            now = tuple(int(c[a]) for c in columns)
            if held and now != last:
                yield links(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield links(pa.Table.from_batches(held))


def confirmed_links(rows: DataFrame, classes: DataFrame, candidates: DataFrame, block_bytes: int, text: str = "doc.text") -> DataFrame:
    """Links (a, b) of keys that connect classes (key, number) as all similar pairs among the reachable candidates do."""
    groups = connected_components(candidates)
    members = classes.join(groups, F.col("key").bitwiseOR(F.lit(1)) == F.col("node")).select("key", "number", F.col("component").alias("candidates"))
    members = members.join(rows.select("number", F.col(text).alias("text")), "number").select("key", "candidates", "text")
    blocks = members.groupBy("candidates").agg(F.ceil(F.sum(F.octet_length("text")) / block_bytes).cast("int").alias("n"))
    dealt = members.join(blocks, "candidates").withColumn("block", F.pmod(F.xxhash64("key"), F.greatest(F.col("n"), F.lit(1))).cast("int"))
    pairs = dealt.select("candidates", "block", "key", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1)).alias("other"))
    pairs = pairs.select("candidates", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "text")
    return written(pairs.repartition("candidates", "i", "j").sortWithinPartitions("candidates", "i", "j").mapInArrow(_compare, "a bigint, b bigint"))


def one_of_each_group(documents: DataFrame, block_bytes: int = BLOCK_BYTES, most: int = 20_000) -> DataFrame:
    """documents with one row of each group of near copies: that of least doc_id, one of equal rows of it."""
    rows = documents.select(F.struct("*").alias("doc"), "doc_id", F.monotonically_increasing_id().alias("number"))
    rows = written(arrow_map(rows, {"texts": "doc.text"}, "key bigint, prints array<bigint>", sketched))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "number")).alias("least")
    classes = written(rows.groupBy("key").agg(least, F.first("prints").alias("prints")).withColumn("number", F.col("least.number")))
    nodes = connected_components(confirmed_links(rows, classes, candidate_links(classes, most), block_bytes))
    grouped = classes.join(nodes, classes["key"] == nodes["node"], "left").groupBy(F.coalesce("component", "key").alias("group")).agg(F.min("least").alias("least"))
    return rows.join(grouped.select(F.col("least.number").alias("number")), "number", "left_semi").select("doc.*")
