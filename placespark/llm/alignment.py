"""Alignment of two tokenizers' ids: where tokens of both end at the same byte, their ids are linked, and links are counted.

A is a byte-level BPE file of the `tokenizers` library, B a SentencePiece model with byte fallback. A text with a space before it is
encoded by both without special tokens (their names inside texts are plain text). Bytes at which a token of A and one of B end cut the
tokens into groups; each cut links the last ids of its group.

Identity map: for every id of A the id of B with the same bytes, made once of the vocabularies. A link of such ids is a group of one
token on each side, so it needs no pair: each task counts those in a vector as long as A's vocabulary. Only links of other groups are
counted as pairs in a shuffle. One of two linked ids' bytes ends with the other's, so that there are no more different pairs than
suffixes of vocabulary entries: `linkable` of them, whatever the corpus; the counts are sent to every task on that ground.

Texts are cut where neither tokenizer can see over the cut (a space or line end after something that isn't white space), and each
distinct piece is encoded once while it stays in a bounded cache; pieces put together give the ids of whole texts (test).

Null and empty texts, and texts whose tokens don't have the bytes of the text (B may normalise, or know no such character), have no
tokens: zeros and an empty hash. Repeated rows count each. No documents: no rows. Other columns travel in one struct, so names can't clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placespark.llm.tables import arrow_map, written
from placespark.llm.text import ragged

#: A worker forgets the pieces it used least when it holds more than these, or more bytes of them.
KEPT, BYTES = 3 << 17, 1 << 23
#: Texts are handled in runs of about so many characters, so that a batch needs little beside its texts.
RUN = 1 << 20
#: No longer piece outlives a forgetting.
LONGEST = 64
#: A piece: white space and what follows it up to a space or line end; white space of other kinds stays inside.
PIECE = re.compile(r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")
MARK = "▁"
ARRAYS = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, exact array<int>, exact_n array<int>, pairs array<bigint>, pairs_n array<int>"


def byte_letters() -> dict[str, int]:
    """Byte-level BPE's letter of every byte: printable Latin-1 stands for itself, the rest for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        whole = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: No piece holds a mark after something else, or a line end: B can't see over a cut.
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in whole)
        self.space = self.b.piece_to_id(MARK)
        ids = {}
        for i, x in enumerate(self.b_bytes):
            if x not in ids or self.b.is_byte(ids[x]):
                ids[x] = i
        self.identity = np.array([ids.get(x, -1) for x in self.a_bytes], np.int64)

    def linkable(self) -> int:
        """How many pairs of ids can be linked at most: one's bytes end with the other's."""
        counts = []
        for entries in (self.a_bytes, self.b_bytes):
            found: dict[bytes, int] = {}
            for x in entries:
                found[x] = found.get(x, 0) + 1
            counts.append(found)
        a, b = counts
        ends = lambda own, other: sum(n * other.get(x[i:], 0) for x, n in own.items() for i in range(1, len(x)))
        return ends(a, b) + ends(b, a) + sum(n * b.get(x, 0) for x, n in a.items())

    def pieces(self, text: str) -> Iterator[str]:
        return (m.group() for m in PIECE.finditer(" " + text)) if self.cuts else iter([" " + text])

    def encoded(self, pieces: list[str]) -> list[tuple[list[int], list[int]]]:
        """A's and B's ids of every piece; B writes a space before each text itself."""
        b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        b = [[self.space] if p == " " else ids if p[0] == " " else ids[1:] for p, ids in zip(pieces, b, strict=True)]
        return [(e.ids, ids) for e, ids in zip(self.a.encode_batch_fast(pieces, add_special_tokens=False), b, strict=True)]


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def groups_of(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of two sequences of the same bytes end a group, given the bytes of each token."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    return np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())


class Pieces:
    """What each distinct piece adds to its text: ids on both sides, written groups (each with its ';'), and its links as pairs."""

    def __init__(self, v: Vocabularies) -> None:
        self.v = v
        self.a_size, self.b_size = (np.array([len(x) for x in entries], np.int64) for entries in (v.a_bytes, v.b_bytes))
        self.names = pa.array([f"{i}{end}" for n, ends in ((len(v.a_bytes), ",|"), (len(v.b_bytes), ",;")) for i in range(n) for end in ends])
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.bytes = 0
        self.written = pa.array([], pa.string())
        self.sizes = np.zeros((0, 3), np.int64)
        self.fine, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)
        self.links, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keep the half that is used most, and of it nothing used once; long pieces go."""
        stay = np.flatnonzero(self.uses > max(1, np.median(self.uses)))
        names = list(self.place)
        stay = stay[[len(names[i]) <= LONGEST for i in stay.tolist()]] if len(stay) else stay
        n = self.sizes[stay, 2]
        self.links, self.offsets = self.links[ranges(self.offsets[stay], n)], np.concatenate([[0], np.cumsum(n)])
        self.written = self.written.take(pa.array(stay))
        self.sizes, self.fine, self.uses = self.sizes[stay], self.fine[stay], np.zeros(len(stay), np.int64)
        self.place = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.bytes = sum(len(p.encode()) for p in self.place)

    def add(self, pieces: list[str]) -> None:
        """Encode pieces that aren't kept. All of them are one sequence of tokens on each side, as tokens end where pieces do."""
        v, encoded, n = self.v, self.v.encoded(pieces), len(pieces)
        fine = np.ones(n, bool)
        text = "".join(pieces).encode()
        if any(b"".join([entries[i] for ids in encoded for i in ids[side]]) != text for side, entries in enumerate((v.a_bytes, v.b_bytes))):
            fine = np.array([b"".join([v.a_bytes[i] for i in a]) == p.encode() == b"".join([v.b_bytes[i] for i in b]) for p, (a, b) in zip(pieces, encoded, strict=True)])
            encoded = [ids if ok else ([], []) for ids, ok in zip(encoded, fine.tolist(), strict=True)]
        (a, a_of), (b, b_of) = ((np.fromiter(chain.from_iterable(ids[k] for ids in encoded), np.int64), np.repeat(np.arange(n), [len(ids[k]) for ids in encoded])) for k in (0, 1))
        a_last, b_last = groups_of(a, b, self.a_size[a], self.b_size[b])
        a_before, b_before = (np.concatenate([[0], np.cumsum(last)]) for last in (a_last, b_last))
        a_ends, b_ends = (np.concatenate([[0], np.flatnonzero(last) + 1]) for last in (a_last, b_last))
        # a group's ids of A stand before its ids of B
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_ends[a_before[:-1]]] = 2 * a + a_last
        order[np.arange(len(b)) + a_ends[b_before[:-1] + 1]] = 2 * len(v.a_bytes) + 2 * b + b_last
        names = self.names.take(pa.array(order))
        sizes = np.stack([np.bincount(a_of, minlength=n), np.bincount(b_of, minlength=n), np.bincount(a_of[a_last], minlength=n)], axis=1)
        cuts = np.frombuffer(names.buffers()[1], np.int32)[: len(order) + 1][np.concatenate([[0], np.cumsum(sizes[:, 0] + sizes[:, 1])])]
        written = pa.StringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(cuts)), names.buffers()[2])
        self.place.update(zip(pieces, range(len(self.fine), len(self.fine) + n), strict=True))
        self.bytes += len(text)
        self.written = pa.concat_arrays([self.written, written])
        self.sizes, self.fine = np.concatenate([self.sizes, sizes]), np.concatenate([self.fine, fine])
        self.uses = np.concatenate([self.uses, np.zeros(n, np.int64)])
        self.links = np.concatenate([self.links, a[a_last] * len(v.b_bytes) + b[b_last]])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes[:, 2])])

    def places(self, pieces: list[str]) -> np.ndarray:
        """Where each piece is kept; new ones are encoded together."""
        if len(self.place) > KEPT or self.bytes > BYTES:
            self.forget()
        at = list(map(self.place.get, pieces))
        if None in at:
            self.add(list(dict.fromkeys(p for p, i in zip(pieces, at, strict=True) if i is None)))
            at = [self.place[p] for p in pieces]
        at = np.array(at, np.int64)
        self.uses += np.bincount(at, minlength=len(self.uses))
        return at


@lru_cache(maxsize=2)
def kept_pieces(a_path: str, b_path: str) -> Pieces:
    return Pieces(vocabularies(a_path, b_path))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, of = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(of, np.concatenate(counts), minlength=len(found)).astype(np.int64)


class Batch:
    """The texts of a batch, handled in runs of about RUN characters: one of several texts, or a part of a long one."""

    def __init__(self, store: Pieces, n: int) -> None:
        self.store, self.sizes, self.fine = store, np.zeros((n, 3), np.int64), np.ones(n, bool)
        self.hashes: list = [None] * n
        self.all = len(store.v.a_bytes) * len(store.v.b_bytes)
        self.keys, self.counts = [], []
        self.reset()

    def reset(self) -> None:
        self.pieces, self.texts, self.lengths, self.characters = [], [], [], 0

    def put(self, i: int, text: str) -> None:
        pieces = self.store.v.pieces(text)
        while own := list(islice(pieces, RUN // 4)):
            self.pieces += own
            self.texts.append(i)
            self.lengths.append(len(own))
            self.characters += len(text) if len(own) < RUN // 4 else sum(map(len, own))
            if self.characters >= RUN:
                self.end_run()

    def end_run(self) -> None:
        if not self.pieces:
            return
        store, texts = self.store, np.array(self.texts)
        at = store.places(self.pieces)
        of = np.repeat(texts, self.lengths)
        for k in range(3):
            self.sizes[:, k] += np.bincount(of, store.sizes[at, k], minlength=len(self.sizes)).astype(np.int64)
        self.fine[of[~store.fine[at]]] = False
        written = store.written.take(pa.array(at))
        offsets = np.frombuffer(written.buffers()[1], np.int32)[np.concatenate([[0], np.cumsum(self.lengths)])].tolist()
        content = memoryview(written.buffers()[2] or b"")
        for i, lo, hi in zip(self.texts, offsets, offsets[1:], strict=False):
            if lo < hi:
                if self.hashes[i] is None:
                    self.hashes[i] = hashlib.sha256()
                else:
                    self.hashes[i].update(b";")
                self.hashes[i].update(content[lo : hi - 1])
        n = store.sizes[at, 2]
        keys, counts = np.unique(np.repeat(of, n) * self.all + store.links[ranges(store.offsets[at], n)], return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        if len(self.keys) > 16:
            self.keys, self.counts = ([x] for x in _summed(self.keys, self.counts))
        self.reset()

    def arrays(self) -> list[pa.Array]:
        """The columns of ARRAYS."""
        self.end_run()
        n, v = len(self.sizes), self.store.v
        keys, counts = _summed(self.keys, self.counts)
        of, pair = keys // self.all, keys % self.all
        keep = self.fine[of]
        of, pair, counts = of[keep], pair[keep], counts[keep]
        exact = v.identity[pair // len(v.b_bytes)] == pair % len(v.b_bytes)
        self.sizes[~self.fine] = 0
        hashes = [h.hexdigest() if h is not None and ok else "" for h, ok in zip(self.hashes, self.fine.tolist(), strict=True)]
        own, other = np.bincount(of[exact], minlength=n), np.bincount(of[~exact], minlength=n)
        lists = [ragged(pair[exact] // len(v.b_bytes), own, pa.int32()), ragged(counts[exact], own, pa.int32()), ragged(pair[~exact], other, pa.int64()), ragged(counts[~exact], other, pa.int32())]
        return [*[pa.array(self.sizes[:, k]) for k in range(3)], pa.array(hashes, pa.string()), *lists]


def linked_texts(documents: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """own (a struct of documents' columns, or of keep) with each text's sizes, groups_sha256, and its counted links: `exact` ids of A with
    exact_n, and other `pairs` (A's id times B's vocabulary, and B's id) with pairs_n."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in (documents.columns if keep is None else keep)]).alias("own"), F.col(text).alias("text"))

    def link(texts: pa.Array) -> list[pa.Array]:
        batch = Batch(kept_pieces(a_path, b_path), len(texts))
        for i, one in enumerate(texts):
            if text := one.as_py():
                batch.put(i, text)
        return batch.arrays()

    return arrow_map(rows, {"texts": F.col("text")}, ARRAYS, link, keep=["own"])


def pair_counts(linked: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, n, is_best) of every pair of ids linked in linked_texts' rows; is_best: no id of A is linked with b_id more often."""
    v = vocabularies(a_path, b_path)
    size_a, size_b, identity = len(v.a_bytes), len(v.b_bytes), v.identity

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size_a, np.int64)
        for batch in batches:
            ids, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("exact", "exact_n"))
            counts += np.bincount(ids, n, minlength=size_a).astype(np.int64)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(identity[seen]), pa.array(counts[seen])], names=["a_id", "b_id", "n"])

    exact = linked.select("exact", "exact_n").mapInArrow(vectors, "a_id bigint, b_id bigint, n bigint")
    exact = exact.groupBy("a_id").agg(F.first("b_id").alias("b_id"), F.sum("n").alias("n"))
    other = linked.select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pairs_n").alias("n"))
    pairs = exact.unionByName(other.select(F.floor(F.col("pair") / size_b).alias("a_id"), (F.col("pair") % size_b).alias("b_id"), "n"))
    best = pairs.groupBy("b_id").agg(F.max("n").alias("best"))
    return pairs.join(best, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("best")).alias("is_best"))


def alignment_report(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Links are pairs of tokens that end together: one for each group. n_best of them are of a pair that is the most frequent of its
    id of B; count_sum adds up the counts of their pairs over the whole corpus.
    """
    spark = documents.sparkSession
    linked = written(linked_texts(documents, a_path, b_path, keep=["doc_id"]))
    found = written(pair_counts(linked, a_path, b_path)).toArrow()  # not more than `linkable` rows
    size_b = len(vocabularies(a_path, b_path).b_bytes)
    a, b, n, best = (found.column(c).to_numpy() for c in ("a_id", "b_id", "n", "is_best"))
    order = np.argsort(a * size_b + b)
    shared = spark.sparkContext.broadcast(((a * size_b + b)[order], n[order], best[order]))

    def counted(ids: pa.Array, ids_n: pa.Array, pairs: pa.Array, pairs_n: pa.Array) -> list[pa.Array]:
        identity = vocabularies(a_path, b_path).identity
        keys, counts, best = shared.value
        sums, bests = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for own, own_n, exact in ((ids, ids_n, True), (pairs, pairs_n, False)):
            key = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            times = own_n.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, key * size_b + identity[key] if exact else key)
            places = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))])
            for out, value in ((sums, times * counts[at]), (bests, times * best[at])):
                total = np.concatenate([[0], np.cumsum(value)])
                out += total[places[1:]] - total[places[:-1]]
        return [pa.array(bests), pa.array(sums)]

    inputs = {n: n for n in ("exact", "exact_n", "pairs", "pairs_n")}
    report = arrow_map(linked, inputs, "n_best bigint, count_sum bigint", counted)
    return report.select(F.col("own.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
