"""Language-model scores by an n-gram trie in Elias-Fano levels, counted, stored and queried in shards.

Texts become chunks of about chunk_tokens tokens: their distinct word hashes and each token's place among them. Level by
level, every chunk sends its distinct n-grams with their training counts to shards (pre-aggregated, so a hot word is one
key of a chunk); a shard adds them up, packs its level of the trie into mapped bytes, looks up every chunk's n-grams and
answers. Level 1 gives words their numbers and counts; level k keys are (number of the k-1-gram before, word). A key goes
to the shard of its context; contexts counted more than hot times (so at most tokens / hot of them) are dealt by the
whole n-gram instead. Numbers have 64 bits, and there are as many shuffle tasks as shards. Contexts need a count of min_context.
In a chunk, words and contexts are ranks among its own, so that an n-gram and its place make one number to sort, while that has 63 bits or fewer.

Probabilities: P1(w) = (c + 0.5) / (N + 0.5 (V + 1)), c, N and V from the training tokens, one end token a text included.
Pk(w | context) = c(context, w) / (c(context) + m) + m / (c(context) + m) * Pk-1(w), m = MASS * c(context) ** POWER (the
kinds of words after a context grow so), or Pk-1(w) without such a context; they add up to 1 over the known words and one unknown. Both terms are quantised to 1/QUANTUM of a decade.

Null and empty texts are one end token; their score and base_score are those of it. Without training rows N is 0 and
all tokens are unknown. A null id counts as training. Repeated rows are counted and scored each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.llm.elias_fano import EliasFano, Level, mapped
from placespark.llm.tables import discard, written
from placespark.llm.text import LOWER, NON_SPACE, mix, span_hashes, text_blocks, word_bounds

ORDER = 3
MASS = 4.0
POWER = 0.75
MIN_CONTEXT = 1
QUANTUM = 4000
CHUNK_TOKENS = 1_500_000
SHARD_TOKENS = 1_000_000
BEGIN, END, FIRST = 0, 1, 2

_PROBABILITIES = np.concatenate([[0.0], 10.0 ** (-np.arange(65535) / QUANTUM)])

CHUNK = "chunk bigint, doc_ids array<string>, train array<boolean>, sizes array<bigint>, vocabulary binary, tokens binary, n_train bigint"
ASKED = "shard int, chunk bigint, keys binary, counts binary"
SCORE = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
ANSWER = "chunk bigint, shard int, level int, numbers binary, codes binary, backoffs binary, types bigint, hot array<bigint>, hot_counts array<bigint>"


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(values: np.ndarray, kind) -> bytes:
    """Numbers, byte places apart (as many as the greatest needs, said by the first byte), compressed."""
    values = np.ascontiguousarray(values, kind)
    used = -(-int(values.view(f"u{values.itemsize}").max(initial=0)).bit_length() // 8)
    out = np.empty(1 + used * len(values), np.uint8)
    out[0] = used
    out[1:].reshape(used, len(values))[:] = values.view(np.uint8).reshape(-1, values.itemsize).T[:used]
    if not used:  # only zeros: how many there are
        out = np.frombuffer(b"\0" + len(values).to_bytes(8, "little"), np.uint8)
    return _zstd()[0].compress(out)


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(_zstd()[1].decompress(data), np.uint8)
    used = int(flat[0])
    if not used:
        return np.zeros(int.from_bytes(flat[1:].tobytes(), "little"), kind)
    places = flat[1:].reshape(used, -1)
    out = np.zeros((places.shape[1], kind.itemsize), np.uint8)
    for i in range(used):
        out[:, i] = places[i]
    return out.view(kind).ravel()


def split(number: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder."""
    quotient = number // shards
    return quotient, number - quotient * shards


def pack_keys(context: np.ndarray, word: np.ndarray, shards: int) -> bytes:
    """Ascending (context, word): contexts by the differences of their quotients and by remainders, words as they are."""
    quotient, remainder = split(context, shards)
    return packed(np.concatenate([np.diff(quotient, prepend=np.int64(0)), remainder, word]), np.int64)


def unpack_keys(data: bytes, shards: int) -> tuple[np.ndarray, np.ndarray]:
    quotient, remainder, word = np.split(unpacked(data, np.int64), 3)
    return np.cumsum(quotient) * shards + remainder, word


def pack_words(words: np.ndarray) -> bytes:
    return packed(np.diff(words, prepend=np.uint64(0)), np.uint64)


def unpack_words(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def pack_places(place: np.ndarray) -> bytes:
    """Ascending places, -1 for none, by their differences; 0 stands for none."""
    has = place >= 0
    steps = np.zeros(len(place), np.int64)
    steps[has] = np.diff(place[has], prepend=np.int64(-1))
    return packed(steps, np.int64)


def unpack_places(data: bytes) -> np.ndarray:
    steps = unpacked(data, np.int64)
    return np.where(steps > 0, np.cumsum(steps) - 1, -1)


def firsts(ascending: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return new


def distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (context, word) in order, and which of them stands at each place. Neither is negative."""
    n, bits, places = len(context), int(word.max(initial=0)).bit_length(), max(0, len(context) - 1).bit_length()
    both = int(context.max(initial=0)).bit_length() + bits
    if both <= 63:
        pair = context.astype(np.int64) << bits | word
        if both + places <= 63:  # sorting the places along inside the numbers is the faster way
            pair = np.sort(pair << places | np.arange(n))
            order, pair = pair & ((1 << places) - 1), pair >> places
        else:
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
        new = firsts(pair)
        pair = pair[new]
        context, word = pair >> bits, pair & ((1 << bits) - 1)
    else:
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = firsts(context) | firsts(word)
        context, word = context[new], word[new]
    which = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    which[order] = np.cumsum(new) - 1
    return context, word, which


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def chunked(documents: DataFrame, train: Column, text: str, doc_id: str, chunk_tokens: int) -> DataFrame:
    """The documents' tokens as chunks; a chunk ends with the text that fills it."""

    def cut(batches):
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids, train = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                data = LOWER[data]
                start, end, doc = word_bounds(data, offsets, NON_SPACE)
                held.append((ids[lo:hi], train[lo:hi], np.bincount(doc, minlength=hi - lo), span_hashes(data, start, end)))
                n += len(doc) + hi - lo
                if n >= chunk_tokens:
                    yield _chunk((part << 32) + number, held)
                    number, held, n = number + 1, [], 0
        if held:
            yield _chunk((part << 32) + number, held)

    rows = documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), train.alias("train"))
    return rows.mapInArrow(cut, CHUNK)


def _chunk(number: int, held: list) -> pa.RecordBatch:
    ids, train = ([y for x in held for y in x[i]] for i in (0, 1))
    sizes = np.concatenate([x[2] for x in held])
    coded = pa.array(np.concatenate([x[3] for x in held])).dictionary_encode()
    words, tokens = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    often = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")  # frequent words get small numbers, which compress well
    place = np.empty(len(often), np.uint32)
    place[often] = np.arange(len(often))
    words, tokens = words[often], place[tokens]
    n_train = int((sizes + 1)[np.array(train, bool)].sum())
    rows = [[number], [ids], [train], [sizes.tolist()], [words.tobytes()], [packed(tokens, np.uint32)], [n_train]]
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["chunk", "doc_ids", "train", "sizes", "vocabulary", "tokens", "n_train"])


def _by_shard(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places by shard, in their order; the shards that have any, and where in the first each one's begin."""
    small = shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard
    order = np.argsort(small, kind="stable")  # 16 bits are sorted by counting
    first = np.flatnonzero(firsts(small[order]))
    return order, shard[order[first]], first


def _asked(chunk: int, shard: np.ndarray, counts: np.ndarray, pack) -> pa.RecordBatch:
    """Rows of ASKED: the keys (as pack gives those of some places) and counts of each shard."""
    order, shards, first = _by_shard(shard)
    own = np.split(order, first[1:]) if len(first) else []
    columns = [pa.array(shards.astype(np.int32)), pa.array(np.full(len(shards), chunk, np.int64)), pa.array([pack(o) for o in own], pa.binary()), pa.array([packed(counts[o], np.uint32) for o in own], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "chunk", "keys", "counts"])


def _answer(rows: list[tuple]) -> pa.Table:
    names = ["chunk", "shard", "level", "numbers", "codes", "backoffs", "types", "hot", "hot_counts"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _counts(table: pa.Table) -> np.ndarray:
    return np.concatenate([unpacked(c, np.uint32) for c in table.column("counts").to_pylist()]).astype(np.int64)


def mass(counts: np.ndarray) -> np.ndarray:
    """What a context of these counts leaves to the shorter one, in counts."""
    return MASS * np.maximum(counts, 1) ** POWER


def by_count(f: Callable, counts: np.ndarray) -> np.ndarray:
    """f of each count, from a table where that is shorter."""
    top = int(counts.max(initial=0))
    return f(np.arange(top + 1))[counts] if top < len(counts) else f(counts)


def left_over(counts: np.ndarray) -> np.ndarray:
    """The share of probability that a context of these counts leaves to the shorter one."""
    m = mass(counts)
    return m / (counts + m)


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes from 1 of probabilities; 0 stands for 0."""
    return np.clip(np.rint(-np.log10(p) * QUANTUM) + 1, 1, 65535).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    return _PROBABILITIES[codes]


def _words_answered(shards: int, hot: int):
    """Level 1: a shard's words get numbers, which come back from 1 with 0 for none; counts come back as they are, in place of codes."""

    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack_words(k) for k in table.column("keys").to_pylist()]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        new = firsts(every[order])
        asked, which = every[order[new]], np.empty(len(every), np.int64)
        which[order] = np.cumsum(new) - 1
        sums = np.bincount(which, _counts(table), minlength=len(asked)).astype(np.int64)
        words, sums = asked[sums > 0], sums[sums > 0]
        shard = table.column("shard")[0].as_py()
        held = EliasFano(mapped(EliasFano.pack(words)))
        number = np.empty(len(words), np.int64)
        number[np.argsort(-sums, kind="stable")] = np.arange(len(words)) * shards + shard + FIRST  # frequent words have small numbers, which compress well
        found = held.find(asked)  # each word once, whatever the number of chunks
        numbers, counts, seen = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.flatnonzero(found >= 0)
        numbers[seen], counts[seen] = number[found[seen]] + 1, sums[found[seen]]
        rows, at = [], 0
        for chunk, own in zip(table.column("chunk").to_pylist(), keys, strict=True):
            some, at = which[at : at + len(own)], at + len(own)
            rows.append((chunk, shard, 1, packed(numbers[some], np.int64), packed(counts[some], np.int64), None, None, None, None))
        often = np.flatnonzero(sums > hot)
        rows.append((-1, shard, 1, None, None, None, len(words), number[often].tolist(), sums[often].tolist()))
        return _answer(rows)

    return answer


def _grams_answered(level: int, shards: int, hot: int, hot_counts, last: bool, min_context: int):
    """Level 2 and on: a shard's level of the trie, packed, mapped and asked."""

    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack_keys(k, shards) for k in table.column("keys").to_pylist()]
        *asked, which = distinct(*(np.concatenate(x) for x in zip(*keys, strict=True)))  # each n-gram once, whatever the number of chunks
        sums = np.bincount(which, _counts(table), minlength=len(asked[0])).astype(np.int64)
        context, word, sums = asked[0][sums > 0], asked[1][sums > 0], sums[sums > 0]
        shard = table.column("shard")[0].as_py()
        new = firsts(context)
        contexts, rank = context[new], np.cumsum(new) - 1
        total = np.bincount(rank, sums, minlength=len(contexts)).astype(np.int64)
        far = np.array(sorted(hot_counts.value.items()), np.int64).reshape(-1, 2)
        if len(far) and len(contexts):
            at = np.minimum(np.searchsorted(contexts, far[:, 0]), len(contexts) - 1)
            here = contexts[at] == far[:, 0]
            total[at[here]] = far[here, 1]
        codes = quantised(sums / by_count(lambda c: c + mass(c), total)[rank])
        backoffs = by_count(lambda c: quantised(left_over(c)), sums)
        trie = Level(mapped(Level.pack(context, word, codes, backoffs)))
        found = trie.find(*asked)
        codes, backoffs, known = np.zeros(len(found), np.uint16), np.zeros(len(found), np.uint16), np.full(len(found), -1)
        seen = np.flatnonzero(found >= 0)
        codes[seen], backoffs[seen], known[seen] = trie.codes[found[seen]], trie.backoffs[found[seen]], np.where(sums[found[seen]] >= min_context, found[seen], -1)
        rows, at = [], 0
        for chunk, (own, _) in zip(table.column("chunk").to_pylist(), keys, strict=True):
            some, at = which[at : at + len(own)], at + len(own)
            rows.append((chunk, shard, level, None if last else pack_places(known[some]), packed(codes[some], np.uint16), None if last else packed(backoffs[some], np.uint16), None, None, None))
        often = np.flatnonzero(sums > hot)
        rows.append((-1, shard, level, None, None, None, len(sums), (often * shards + shard).tolist(), sums[often].tolist()))
        return _answer(rows)

    return answer


def in_order(order: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """The parts' values, one after the other, at the places that order names."""
    values = np.concatenate([np.zeros(0, np.uint16), *parts])
    out = np.empty(len(order), values.dtype)
    out[order] = values
    return out


def ranked(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number's rank (-1 where it is negative), and which stands at each rank; numbers from 0 differ."""
    order = np.flatnonzero(numbers >= 0)
    bits = len(numbers).bit_length()
    if int(numbers.max(initial=0)).bit_length() + bits <= 63:  # as in distinct
        order = np.sort(numbers[order] << bits | order) & ((1 << bits) - 1)
    else:
        order = order[np.argsort(numbers[order])]
    rank = np.full(len(numbers), -1, np.int32)
    rank[order] = np.arange(len(order))
    return rank, order


class Chunk:
    """A chunk with the answers of some levels: for each token (BEGIN and END around each text) what is known of it.

    Words and contexts go by their ranks among the chunk's, in order of their numbers, -1 for unknown ones; tables by rank
    have the rest, with the unknown's in the last row. So whole chunks are sorted and gathered by small numbers. With
    sums (all training tokens and their kinds) p is each token's probability by these levels.
    """

    def __init__(self, row: dict, answers: list[dict], shards: int, hot: list[set], n_texts: int, min_context: int, sums: tuple[int, int] | None = None):
        self.number, self.train = row["chunk"], np.array(row["train"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.last = np.cumsum(self.sizes + 2) - 1
        self.first = self.last - self.sizes - 1
        size = int((self.sizes + 2).sum())
        inner = np.ones(size, bool)
        inner[self.first] = inner[self.last] = False
        by_level: dict[int, dict[int, dict]] = {}
        for a in answers:
            by_level.setdefault(a["level"], {})[a["shard"]] = a
        numbers, counts = (unpacked(by_level[1][-1][c], np.int64) for c in ("numbers", "codes"))
        rank, order = ranked(numbers - 1)
        rank[order] += FIRST
        self.word = np.full(size, BEGIN, np.int32)
        self.word[inner], self.word[self.last] = rank[unpacked(row["tokens"], np.uint32)], END
        self.words = np.concatenate([[BEGIN, END], numbers[order] - 1])
        self.counts = np.concatenate([[n_texts, n_texts], counts[order], [0]])
        if sums:
            self.p1 = (self.counts + 0.5) / (sums[0] + 0.5 * (sums[1] + 1))
            self.total, self.p = sums[0], self.p1[self.word]
        # what stands before each token, as a context
        context = np.arange(len(self.counts), dtype=np.int32)
        context[-1] = -1
        self.node = np.where(self.counts >= min_context, context, np.int32(-1))[self.word]
        self.node[self.last] = -1
        self.contexts, self.backoffs = self.words, left_over(self.counts)
        self.shards, self.hot, self.level = shards, hot, 1
        for level in sorted(by_level):
            if level > 1:
                self._step(by_level[level], sums is not None)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the next level's n-grams, the distinct ones in order (contexts, words), and which each place has."""
        place = np.flatnonzero((self.node[:-1] >= 0) & (self.word[1:] >= END)) + 1
        context, word, which = distinct(self.node[place - 1], self.word[place])
        return place, self.contexts[context], self.words[word], which

    def shard_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A number's remainder is the shard that gave it, so contexts are spread as well as what came before them."""
        shard = split(context, self.shards)[1]
        if self.hot[self.level - 1]:
            hot = np.flatnonzero(np.isin(context, np.array(sorted(self.hot[self.level - 1]), np.int64)))
            shard[hot] = (mix(mix(context[hot].astype(np.uint64)) ^ word[hot].astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64)
        return shard

    def _step(self, answers: dict[int, dict], scored: bool) -> None:
        place, context, word, which = self.keys()
        order, shards, _ = _by_shard(self.shard_of(context, word))
        own = [answers[s] for s in shards.tolist()]
        if scored:
            after = np.flatnonzero(self.node[:-1] >= 0) + 1  # unknown words too
            self.p[after] *= self.backoffs[self.node[after - 1]]
            self.p[place] += probability(in_order(order, [unpacked(a["codes"], np.uint16) for a in own]))[which]
        self.node, self.level = np.full(len(self.word), -1, np.int32), self.level + 1
        if any(a["numbers"] is None for a in own):  # no level follows
            return
        number = in_order(order, [np.where(x >= 0, x * self.shards + s, -1) for s, x in zip(shards.tolist(), (unpack_places(a["numbers"]) for a in own), strict=True)])
        rank, known = ranked(number)
        self.contexts, self.node[place] = number[known], rank[which]
        self.node[self.last] = -1
        if scored:
            self.backoffs = probability(in_order(order, [unpacked(a["backoffs"], np.uint16) for a in own])[known])

    def asked(self) -> pa.RecordBatch:
        place, context, word, which = self.keys()
        trained = np.repeat(self.train, self.sizes + 2)
        return _asked(self.number, self.shard_of(context, word), np.bincount(which, trained[place], minlength=len(word)), lambda own: pack_keys(context[own], word[own], self.shards))

    def scores(self, ids: list[str]) -> pa.RecordBatch:
        base, score, known = np.log10(self.p1)[self.word], np.log10(self.p), (self.counts > 0).astype(np.int64)[self.word]
        base[self.first] = score[self.first] = known[self.first] = 0
        columns = [pa.array(ids, pa.string()), pa.array(~self.train), pa.array(self.sizes + 1), *(pa.array(x) for x in (np.add.reduceat(known, self.first), np.full(len(self.sizes), self.total), np.add.reduceat(base, self.first), np.add.reduceat(score, self.first)))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _lexicon(shards: int):
    """The numbers and counts of a chunk's words, from its vocabulary and the shards' answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by_shard, rows = {a["shard"]: a for a in right.to_pylist()}, []
        for c in left.to_pylist():
            words = np.frombuffer(c["vocabulary"], np.uint64)
            place = np.argsort(words, kind="stable")
            order, found, _ = _by_shard(word_shard(words[place], shards))
            own = [by_shard[s] for s in found.tolist()]
            numbers, counts = (in_order(place[order], [unpacked(a[x], np.int64) for a in own]) for x in ("numbers", "codes"))
            rows.append((c["chunk"], -1, 1, packed(numbers, np.int64), packed(counts, np.int64), None, None, None, None))
        return _answer(rows)

    return run


def word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (words % np.uint64(shards)).astype(np.int64)


def lm_scores(documents: DataFrame, train: Column, *, order: int = ORDER, min_context: int = MIN_CONTEXT, text: str = "text", doc_id: str = "doc_id", chunk_tokens: int = CHUNK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document; train says which ones teach."""
    spark = documents.sparkSession
    chunks = written(chunked(documents, train, text, doc_id, chunk_tokens))
    row = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x + 1)), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0))).first()
    total, tokens, n_texts = int(row[0]), int(row[1]), int(row[2])
    shards = max(1, -(-tokens // shard_tokens))
    hot = shard_tokens

    def words_asked(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = np.frombuffer(r["vocabulary"], np.uint64)
                of = np.repeat(np.array(r["train"], bool), r["sizes"])
                counts, place = np.bincount(unpacked(r["tokens"], np.uint32), of, minlength=len(words)), np.argsort(words, kind="stable")
                words, counts = words[place], counts[place]
                yield _asked(r["chunk"], word_shard(words, shards), counts, lambda own, words=words: pack_words(words[own]))

    def of_chunks(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
        return left.repartition(shards, "chunk").groupBy("chunk").cogroup(right.where("chunk >= 0").repartition(shards, "chunk").groupBy("chunk")).applyInArrow(work, schema)

    words = written(chunks.select("chunk", "train", "sizes", "vocabulary", "tokens").mapInArrow(words_asked, ASKED).repartition(shards, "shard").groupBy("shard").applyInArrow(_words_answered(shards, hot), ANSWER))
    types = int(words.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]) + (n_texts > 0)

    def hot_of(table: DataFrame) -> dict[int, int]:
        """Contexts of more than `hot` counts: at most tokens / hot."""
        return {i: c for r in table.where("chunk < 0").select("hot", "hot_counts").collect() for i, c in zip(r[0], r[1], strict=True)}

    counts = hot_of(words) | ({BEGIN: n_texts} if n_texts > hot else {})
    answers = written(of_chunks(chunks.select("chunk", "vocabulary"), words, _lexicon(shards), ANSWER))
    discard(words)
    hot_sets: list[set] = []

    def with_answers(work, columns: str, schema: str, sums: tuple[int, int] | None = None) -> DataFrame:
        """work on each chunk, its row (columns besides those of tokens) and answers; codes of n-grams only go into scores."""
        sets, n = list(hot_sets), n_texts

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = right.to_pylist()
            return pa.Table.from_batches([work(Chunk(c, rows, shards, sets, n, min_context, sums), c) for c in left.to_pylist()])

        values = [F.col(c) if sums else F.when(F.col("level") == 1, F.col(c)).alias(c) for c in ("codes", "backoffs")]
        return of_chunks(chunks.select("chunk", "train", "sizes", "tokens", *columns.split()), answers.select("chunk", "shard", "level", "numbers", *values), run, schema)

    for level in range(2, order + 1):
        hot_sets.append(set(counts))
        asked = with_answers(lambda c, _: c.asked(), "", ASKED)
        made = written(asked.repartition(shards, "shard").groupBy("shard").applyInArrow(_grams_answered(level, shards, hot, spark.sparkContext.broadcast(counts), level == order, min_context), ANSWER))
        counts, answers = hot_of(made), answers.unionByName(made)
    scored = with_answers(lambda c, row: c.scores(row["doc_ids"]), "doc_ids", SCORE, (total, types))
    return scored.withColumn("doc_id", F.col("doc_id").cast(documents.schema[doc_id].dataType))
