"""Byte-level text helpers for Arrow batches.

A batch's texts are handled in blocks of about BLOCK_BYTES of UTF-8 (one longer text makes a block of its own), as whole
numpy arrays: no per-word Python objects. Only A-Z are lower-cased, so byte offsets never move. Null reads as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 20

_CODES = np.arange(256)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
#: Words of letters, digits and anything outside ASCII.
ALNUM = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
#: Words between ASCII white space.
NON_SPACE = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each block."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, places, content = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of lower-cased data; words end with their text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    last[:-1] = ~inside[1:]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    start, end = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for spans inside a piece."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(PIECE_BYTES, base & _MASK, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; spans in order of their starts.

    Spans inside a piece of PIECE_BYTES come from one running sum over the piece; the few others are added up part by part,
    so that memory beyond the data and the spans is that of a piece, however long a text is.
    """
    powers, inverse = _powers()
    out = np.empty(len(start), np.uint64)
    cuts = np.searchsorted(start, np.arange(0, len(data) + PIECE_BYTES, PIECE_BYTES))
    for number, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if lo == hi:
            continue
        base = number * PIECE_BYTES
        piece = data[base : base + PIECE_BYTES]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_TABLE[piece] * powers[: len(piece)], out=total[1:])
        a, b = start[lo:hi] - base, end[lo:hi] - base
        inside = b <= len(piece)
        out[lo:hi] = (total[np.minimum(b, len(piece))] - total[a]) * inverse[a]
        for i in (np.flatnonzero(~inside) + lo).tolist():
            out[i] = _long_sum(data, int(start[i]), int(end[i]), powers)
    return mix(out)


def _long_sum(data: np.ndarray, start: int, end: int, powers: np.ndarray) -> int:
    value, factor, step = 0, 1, pow(_BASE, PIECE_BYTES, 1 << 64)
    for at in range(start, end, PIECE_BYTES):
        part = data[at : min(end, at + PIECE_BYTES)]
        value = (value + factor * int((_TABLE[part] * powers[: len(part)]).sum(dtype=np.uint64))) & _MASK
        factor = factor * step & _MASK
    return value


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbouring hashes; the caller leaves out those that cross texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + h[j : j + len(out)]
    return mix(out)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array with counts[i] of the values in row i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))
