"""Elias-Fano sequences and the levels of an n-gram trie, as flat bytes that can be mapped from a file.

A non-decreasing sequence is kept as its low bits, packed, and its high parts in unary. Reading an element selects a one
of the unary part; searching selects the zeros around the high part and halves the few elements between. Where many
are asked for at once, the sequence is read from one end to the other, and they are sought among its elements.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U = np.uint64
#: A sequence of fewer elements than this many for each one asked for is read through.
DENSE = 8


class Bits:
    """Ranks and selection over 64-bit words."""

    def __init__(self, words: np.ndarray, before: np.ndarray, size: int):
        self.words, self.before, self.size = words, before, size

    def _select(self, k: np.ndarray, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(before, k, "right") - 1
        word, left, place = words[at], (k - before[at]).astype(np.int64), np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & U((1 << step) - 1)).astype(np.int64)
            go = left >= low
            left -= low * go
            place += step * go
            word = np.where(go, word >> U(step), word)
        return at * 64 + place

    def one(self, k: np.ndarray) -> np.ndarray:
        return self._select(k, self.words, self.before)

    def zero(self, k: np.ndarray) -> np.ndarray:
        return self._select(k, ~self.words, np.arange(len(self.before)) * 64 - self.before)


class EliasFano:
    def __init__(self, buffer, at: int = 0):
        self.n, self.low_bits, low, high = np.frombuffer(buffer, np.int64, 4, at).tolist()
        at += 32
        self.low = np.frombuffer(buffer, np.uint64, low, at)
        words = np.frombuffer(buffer, np.uint64, high, at + 8 * low)
        before = np.frombuffer(buffer, np.int64, high, at + 8 * (low + high))
        self.high = Bits(words, before, high * 64)
        self.end = at + 8 * (low + 2 * high)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        """Bytes of a non-decreasing sequence of uint64."""
        n = len(values)
        most = int(values[-1]) + 1 if n else 1
        bits = max(0, (most // max(1, n)).bit_length() - 1)
        if bits:
            places = np.ascontiguousarray(values, U).view(np.uint8).reshape(n, 8)
            low = np.packbits(np.unpackbits(places[:, : -(-bits // 8)], axis=1, count=bits, bitorder="little").ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        low = np.frombuffer(low.tobytes() + bytes(16 + -len(low) % 8), np.uint64)
        top = (values >> U(bits)).astype(np.int64)
        unary = np.zeros((int(top[-1]) if n else 0) + n + 65, np.uint8)
        unary[top + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        high = np.frombuffer(high.tobytes() + bytes(-len(high) % 8), np.uint64)
        before = np.cumsum(np.bitwise_count(high).astype(np.int64)) - np.bitwise_count(high)
        return np.array([n, bits, len(low), len(high)], np.int64).tobytes() + low.tobytes() + high.tobytes() + before.astype(np.int64).tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        place = i * self.low_bits
        word, shift = place >> 6, (place & 63).astype(U)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << U(1)) << (U(63) - shift))) & U((1 << self.low_bits) - 1)

    def every(self) -> np.ndarray:
        """All elements, read in passing."""
        top = np.flatnonzero(np.unpackbits(self.high.words.view(np.uint8), bitorder="little").view(bool)) - np.arange(self.n)
        places = np.zeros((self.n, 8), np.uint8)
        if self.low_bits:
            low = np.unpackbits(self.low.view(np.uint8), count=self.n * self.low_bits, bitorder="little")
            places[:, : -(-self.low_bits // 8)] = np.packbits(low.reshape(self.n, self.low_bits), axis=1, bitorder="little")
        return top.astype(U) << U(self.low_bits) | places.view(U).ravel()

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (((self.high.one(i) - i).astype(U)) << U(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x in the sequence, -1 where it is not in it."""
        x = np.asarray(x, U)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        if self.n < DENSE * len(x):
            values = self.every()
            place = np.minimum(np.searchsorted(values, x), self.n - 1)
            return np.where(values[place] == x, place, -1)
        top = (x >> U(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero(x <= self[np.array([self.n - 1])][0])
        top, low = top[inside], x[inside] & U((1 << self.low_bits) - 1)
        a = np.where(top > 0, self.high.zero(np.maximum(top - 1, 0)) - (top - 1), 0)
        b = self.high.zero(top) - top  # elements with this high part: from a, before b
        stop = b.copy()
        while (a < b).any():
            middle = (a + b) >> 1
            less = (a < b) & (self._low(np.minimum(middle, self.n - 1)) < low)
            b = np.where(less | (a >= b), b, middle)
            a = np.where(less, middle + 1, a)
        hit = (a < stop) & (self._low(np.minimum(a, self.n - 1)) == low)
        out[inside[hit]] = a[hit]
        return out


class Level:
    """One level of a trie: contexts, where each one's successors begin, successors and their values."""

    def __init__(self, buffer):
        self.span = int(np.frombuffer(buffer, np.int64, 1)[0])
        self.contexts = EliasFano(buffer, 8)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.successors = EliasFano(buffer, self.pointers.end)
        n = self.successors.n
        self.codes = np.frombuffer(buffer, np.uint16, n, self.successors.end)
        self.backoffs = np.frombuffer(buffer, np.uint16, n, self.successors.end + 2 * n)

    @staticmethod
    def pack(context: np.ndarray, word: np.ndarray, codes: np.ndarray, backoffs: np.ndarray) -> bytes:
        """Bytes of distinct (context, word), in that order, with their quantised values."""
        new = np.concatenate([[True], context[1:] != context[:-1]])[: len(context)]
        first, rank = np.flatnonzero(new), np.cumsum(new) - 1
        contexts = context[first]
        span = int(word.max()) + 1 if len(word) else 1
        successors = rank.astype(U) * U(span) + word.astype(U)  # relative to the context, so they never decrease
        parts = [EliasFano.pack(contexts.astype(U)), EliasFano.pack(np.append(first, len(context)).astype(U)), EliasFano.pack(successors)]
        return np.array([span], np.int64).tobytes() + b"".join(parts) + codes.astype(np.uint16).tobytes() + backoffs.astype(np.uint16).tobytes()

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each (context, word), -1 where there is none; neighbours of one context look it up once."""
        new = np.concatenate([[True], context[1:] != context[:-1]])[: len(context)]
        rank = self.contexts.find(context[new].astype(U))[np.cumsum(new) - 1]
        out = np.full(len(rank), -1, np.int64)
        known = np.flatnonzero((rank >= 0) & (word < self.span))
        out[known] = self.successors.find(rank[known].astype(U) * U(self.span) + word[known].astype(U))
        return out


def mapped(data: bytes) -> mmap.mmap:
    """data in a file without a name, mapped; it goes with the mapping."""
    with tempfile.TemporaryFile() as file:
        file.write(data)
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
