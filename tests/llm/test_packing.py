import random
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from placespark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Don't they'LL it's <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b ÉCOLE Straße İstanbul ΣΑΣ école café! ǅ x 日本語 テスト　か 🙂🙂 \x1c\x1d a\x85b 12a3 _x_ --a-- ''s ½ ²", "", "  ", "a" * 5000 + " b", "ñ̃ Å Å"]


def test_ids_equal_the_tokenizer(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:120] + ODD
    whole = Tokenizer.from_file(PATH)
    for most in (1_000_000, 50):
        got = packing.WordIds(PATH, most).encode(texts)
        assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]


def check_plan(rows, capacity):
    """Pieces of a sequence lie gaplessly from 0 and within the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, PATH, keep=["doc_id"], rows_a_bucket=50).collect()
    n = check_plan(rows, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 2
    whole = Tokenizer.from_file(PATH)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.piece] = r
    for d in docs.collect():
        ids = np.array([*whole.encode(d.text, add_special_tokens=False).ids, 0], np.uint32)
        pieces = by[d.doc_id]
        assert len(pieces) == -(-len(ids) // 2048)
        for i, r in pieces.items():
            cut = ids[i * 2048 : i * 2048 + 2048]
            assert (r.start, r.length, r.ids_crc32) == (i * 2048, len(cut), crc32(cut.tobytes()))


def fewest(lengths, capacity):
    """Least number of bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= lengths[i]}):
            rest = list(bins)
            rest.remove(room)
            go(i + 1, [*rest, room - lengths[i]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_plan_uses_every_piece_and_few_bins():
    rng = random.Random(4)
    worse = 0
    for _ in range(60):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))]
        plan = packing.Plan({w: lengths.count(w) for w in set(lengths)}, 20)
        used = []
        for items, times in plan.patterns:
            assert sum(w * n for w, n in items) <= 20
            used += [w for w, n in items for _ in range(n * times)]
        assert sorted(used) == sorted(lengths)
        worse += sum(t for _, t in plan.patterns) - fewest(lengths, 20)
    assert worse <= 2


def test_dominance_fixes_pairs():
    plan = packing.Plan({12: 3, 8: 2, 7: 1, 20: 5}, 20)
    assert ((20, 1),) in [p for p, _ in plan.patterns] and (((12, 1), (8, 1)), 2) in plan.patterns and plan.fixed >= 3


def test_edges(spark, edges, nothing):
    rows = packing.pack(edges, PATH).collect()
    check_plan(rows, 2048)
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert sum(r.doc_id == 6 for r in rows) == 2
    assert packing.pack(nothing, PATH).count() == 0
    assert packing.pack(edges, PATH).columns[-6:] == ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_own_columns_of_the_results_names_stay(spark):
    rows = spark.createDataFrame([(1, "some words here", 7, 8, "p"), (2, None, None, None, None)], "doc_id bigint, text string, length int, start int, piece string")
    got = packing.pack(rows, public_tokenizers.path("word_bpe_49k.json"))
    assert got.columns == ["doc_id", "text", "length", "start", "piece", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 2
