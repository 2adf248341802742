"""Token counts by count-only Viterbi over a unigram vocabulary.

Aho and Corasick's automaton gives all vocabulary matches of a text by their ends; the dynamic program carries, for each
end, the best score and its number of pieces, nothing else. The tokenizer's rules: a match replaces the best so far only
if it scores higher, longest first; a character that is no piece itself costs the least score less 10; unknown pieces
in a row are one. Spaces are the mark U+2581, one more stands first. As no piece holds the mark after another character,
texts fall apart before their marks, and parts are counted once and kept.

Null texts have no tokens, an empty one has its mark. Repeated rows are counted each.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placespark.llm.tables import arrow_map

MARK = "▁"
PENALTY = 10.0
_PART = re.compile(" +[^ ]*")


def vocabulary_of(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file in the order of ids: the unknown piece and those that stand for text, so that
    the names of control and byte pieces in a text are ordinary text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in own]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0, most: int = 500_000):
        self.automaton, self.most, self.kept = ahocorasick.Automaton(), most, {}
        for i, (piece, score) in enumerate(vocabulary):
            if re.search(f"[^{MARK}]{MARK}", piece):
                raise ValueError("a piece holds the mark inside")
            self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - PENALTY

    def part(self, text: str) -> int:
        """Pieces of a text with its marks."""
        n = len(text)
        best, pieces, loose = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float, bool]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for end in range(1, n + 1):
            matches, single = ends[end - 1], False
            matches.sort(key=lambda m: -m[0])
            for size, score, is_unknown in matches:
                start = end - size
                single = single or size == 1
                total = score + best[start]
                if best[end] is None or total > best[end]:
                    best[end], pieces[end], loose[end] = total, pieces[start] + (not (is_unknown and loose[start])), is_unknown
            if not single:
                total = self.unknown + best[end - 1]
                if best[end] is None or total > best[end]:
                    best[end], pieces[end], loose[end] = total, pieces[end - 1] + (not loose[end - 1]), True
        return pieces[n]

    def count(self, text: str) -> int:
        parts = _PART.findall(" " + text.replace(MARK, " "))
        total = 0
        for part in parts:
            n = self.kept.get(part)
            if n is None:
                n = self.part(part.replace(" ", MARK))
                if len(part) <= 64:
                    self.kept[part] = n
            total += n
        if len(self.kept) > self.most:
            self.kept = dict.fromkeys(parts, 0) | {p: self.kept[p] for p in parts if p in self.kept}
            self.kept = {p: n for p, n in self.kept.items() if n}
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(vocabulary_of(path))


def with_token_count(documents: DataFrame, vocabulary: str, text: str = "text", name: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """documents (or its columns keep) with name: the number of tokens of text."""

    def count(texts: pa.Array) -> list[pa.Array]:
        own = counter(vocabulary)
        return [pa.array([0 if t.as_py() is None else own.count(t.as_py()) for t in texts], pa.int64())]

    return arrow_map(documents, {"texts": F.col(text)}, f"{name} bigint", count, keep)
