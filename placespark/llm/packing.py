"""Best-fit packing of token pieces after Martello and Toth's dominance reduction.

Texts become ids; longer ones are cut at the capacity. What the packing needs of the pieces is only how many there are of
each length: at most `capacity` counts, whatever the corpus, so the plan is made from that histogram. Sets that dominate
all others for their largest piece are fixed first, each as a pattern with a multiplicity (a piece that nothing fits
beside; a pair that fills a sequence; a pair where no third piece fits; a pair or triple that dominates all pairs); the
rest goes best-fit decreasing, groups of equal bins at once. The pieces of a length are then numbered, in buckets so
that a hot length is no single task, and the numbers are looked up in the plan.

Null and empty texts are one piece with the end id alone. Repeated rows are packed each. No documents: no rows.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.llm.tables import arrow_map, written
from placespark.llm.text import ragged

CAPACITY = 2048
END_ID = 0
ROWS_A_BUCKET = 500_000
_PLAIN = re.compile(r"""([a-zß-öø-ÿ]+)([-.,:;!?"#$%&()*+/=>@^_`{}~\[\]\\]*)""")
_ROWS = 512


class WordIds:
    """Ids of texts by a tokenizer that drops white space, kept by the pieces of text between ASCII white space.

    Such a tokenizer never joins across white space, so a text's ids are those of its pieces. A-Z are lower-cased first,
    as the tokenizer does, except in texts that may name a special token. Words of Latin letters, without the punctuation
    after them, are encoded many at a time and told apart by the tokens that end a word. When more than `most` pieces are
    kept, those of the last batch stay.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.kept = Tokenizer.from_file(path), most, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone."""
        out = []
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            ids = self._encode([" ".join(some)])[0]
            cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1)).tolist()
            fits = len(cuts) == len(some) and cuts[-1] == len(ids)
            out += [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)] if fits else self._encode(some)
        return out

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Keeps the missing pieces' ids; returns those of long ones, which aren't kept."""
        split, other, long, kept = [], [], {}, self.kept
        words: dict[str, bytes | None] = {}
        for piece in missing:
            word = piece.decode()
            found = _PLAIN.fullmatch(word if word.isascii() or max(word) > "ÿ" else word.lower()) if len(piece) <= 64 else None
            if found:
                word, mark = found.groups()
                split.append((piece, word, mark))
                words[word] = kept.get(word.encode())
                if mark and mark not in words:
                    words[mark] = kept.get(mark.encode()) or self._encode([mark])[0]
            else:
                other.append(piece)
        new = [w for w, ids in words.items() if ids is None]
        words.update(zip(new, self._words(new), strict=True))
        for piece, word, mark in split:
            kept[piece] = words[word] + words[mark] if mark else words[word]
        for at in range(0, len(other), 1024):
            some = other[at : at + 1024]
            for piece, ids in zip(some, self._encode([x.decode() for x in some]), strict=True):
                (kept if len(piece) <= 64 else long)[piece] = ids
        return long

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        pieces, seen, kept = [], set(), self.kept
        for text in texts:
            raw = (text or "").encode()
            pieces.append((raw if b"<|" in raw else raw.lower()).split())
            seen.update(pieces[-1])
        long = self._learn([x for x in seen if x not in kept])
        if long:
            out = [b"".join([kept[w] if w in kept else long[w] for w in x]) for x in pieces]
        else:
            out = [b"".join(map(kept.__getitem__, x)) for x in pieces]
        if len(kept) > self.most:
            self.kept = {x: kept[x] for x in seen if x in kept}
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(documents: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents' columns (or those in keep) with piece, start, length and ids_crc32: a row for each piece."""
    end = int(end_id).to_bytes(4, "little")

    def cut(texts: pa.Array) -> list[pa.Array]:
        encoder, lengths, sums, counts = word_ids(tokenizer), [], [], []
        for at in range(0, len(texts), _ROWS):
            for ids in encoder.encode(texts.slice(at, _ROWS).to_pylist()):
                ids += end
                cuts = range(0, len(ids), 4 * capacity)
                counts.append(len(cuts))
                lengths += [(min(len(ids), i + 4 * capacity) - i) // 4 for i in cuts]
                sums += [crc32(ids[i : i + 4 * capacity]) for i in cuts]
        size = np.array(counts, np.int64)
        return [ragged(np.array(lengths, np.int64), size, pa.int64()), ragged(np.array(sums, np.int64), size, pa.int64())]

    columns = documents.columns if keep is None else keep
    state = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).alias("own_text"))
    cuts = arrow_map(state, {"texts": F.col("own_text")}, "lengths array<bigint>, sums array<bigint>", cut, keep=["row"])
    rows = cuts.select("row", F.posexplode(F.arrays_zip("lengths", "sums")).alias("piece", "cut"))
    return rows.select(*[F.col("row")[c].alias(c) for c in columns], "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start"), F.col("cut.lengths").alias("length"), F.col("cut.sums").alias("ids_crc32"))


class Plan:
    """Patterns [((length, copies), ...), multiplicity] for a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.patterns = capacity, []
        self.left = {w: n for w, n in counts.items() if n > 0}
        while self._reduce():
            pass
        self.fixed = len(self.patterns)
        self._best_fit()

    def _take(self, lengths: list[int]) -> None:
        """As many sets of these lengths as the counts allow."""
        need = {w: lengths.count(w) for w in lengths}
        times = min(self.left[w] // n for w, n in need.items())
        self.patterns.append((tuple(sorted(need.items(), reverse=True)), times))
        for w, n in need.items():
            self.left[w] -= times * n
            if not self.left[w]:
                del self.left[w]

    def _largest(self, most: int, used: list[int]) -> int:
        """Largest length up to most that is left besides those used; 0 if none."""
        return max((w for w, n in self.left.items() if w <= most and n > used.count(w)), default=0)

    def _smallest(self, used: int, n: int) -> list[int]:
        out: list[int] = []
        for w in sorted(self.left):
            out += [w] * min(self.left[w] - (w == used), n - len(out))
            if len(out) >= n:
                break
        return out

    def _dominant(self, w: int) -> list[int] | None:
        """A set with w that dominates every other set with w, if one is known."""
        room = self.capacity - w
        small = self._smallest(w, 3)
        if not small or small[0] > room:
            return [w]
        one = self._largest(room, [w])
        if one == room or len(small) < 2 or small[0] + small[1] > room:
            return [w, one]
        if len(small) == 3 and sum(small) <= room:
            return None  # three partners fit: sets are too many to judge
        two = self._largest(room - one, [w, one])
        half = self._largest(room // 2, [w])
        if two and two >= half:
            return [w, one, two]  # every pair fits into (one, two), every single into one
        best = max((a + b for a in self.left if a <= room and (b := self._largest(min(a, room - a), [w, a]))), default=0)
        return [w, one] if one >= best else None

    def _reduce(self) -> bool:
        """One pass over the lengths, largest first; whether anything was fixed."""
        before = len(self.patterns)
        for w in sorted(self.left, reverse=True):
            while w in self.left and (found := self._dominant(w)):
                self._take(found)
        return len(self.patterns) > before

    def _best_fit(self) -> None:
        """Best-fit decreasing: a group of equal bins takes as many copies as fit, fullest groups first."""
        open_bins: dict[int, list[tuple[tuple, int]]] = {}
        for w in sorted(self.left, reverse=True):
            n = self.left[w]
            for room in sorted(r for r in open_bins if r >= w):
                copies, groups = room // w, open_bins.pop(room)
                while groups and n:
                    items, times = groups.pop()
                    whole = min(times, n // copies)
                    n -= whole * copies
                    if whole:
                        open_bins.setdefault(room - copies * w, []).append(((*items, (w, copies)), whole))
                        times -= whole
                    if times and n:
                        open_bins.setdefault(room - n * w, []).append(((*items, (w, n)), 1))
                        n, times = 0, times - 1
                    if times:
                        groups.append((items, times))
                if groups:
                    open_bins.setdefault(room, []).extend(groups)
                if not n:
                    break
            copies = self.capacity // w
            if n // copies:
                open_bins.setdefault(self.capacity - copies * w, []).append((((w, copies),), n // copies))
            if n % copies:
                open_bins.setdefault(self.capacity - n % copies * w, []).append((((w, n % copies),), 1))
        self.patterns += [x for groups in open_bins.values() for x in groups]

    def slots(self) -> dict[str, np.ndarray]:
        """Runs of the pieces of one length: key (length and first number), copies a sequence, first sequence, offset."""
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for items, times in self.patterns:
            offset = 0
            for w, copies in items:
                rows.append(((w << 44) + used.get(w, 0), copies, sequence, offset))
                used[w] = used.get(w, 0) + copies * times
                offset += copies * w
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.sequences = sequence
        return {"key": table[:, 0], "copies": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def numbered(pieces: DataFrame, total: int, rows_a_bucket: int) -> DataFrame:
    """pieces (with a fixed uid) with number: from 0 within each length."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-total // rows_a_bucket)))))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1
    return dealt.withColumn("place", place).join(before, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("place")).drop("before", "place", "bucket")


def pack(documents: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", keep: list[str] | None = None, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """token_pieces with sequence_id and offset: each piece's sequence and its place there. Own columns of the results' names stay, before these."""
    columns = documents.columns if keep is None else keep
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), F.col(text).alias("text"))
    pieces = written(token_pieces(rows, tokenizer, capacity=capacity, end_id=end_id, keep=["own"]).select(F.struct("*").alias("piece"), "length", F.monotonically_increasing_id().alias("uid")))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = pieces.sparkSession.sparkContext.broadcast(Plan(counts, capacity).slots())

    def place(length: pa.Array, number: pa.Array) -> list[pa.Array]:
        slots, n = plan.value, number.to_numpy(zero_copy_only=False)
        w = length.to_numpy(zero_copy_only=False)
        at = np.searchsorted(slots["key"], (w << 44) + n, "right") - 1
        n = (w << 44) + n - slots["key"][at]
        return [pa.array(slots["sequence"][at] + n // slots["copies"][at]), pa.array(slots["offset"][at] + n % slots["copies"][at] * w)]

    ranked = numbered(pieces, sum(counts.values()), rows_a_bucket)
    placed = arrow_map(ranked, {"length": F.col("length"), "number": F.col("number")}, "sequence_id bigint, offset bigint", place, keep=["piece"])
    made = [F.col("piece")[c].alias(c) for c in ("piece", "start", "length", "ids_crc32")]
    return placed.select(*[F.col("piece")["own"][c].alias(c) for c in columns], *made, "sequence_id", "offset")
