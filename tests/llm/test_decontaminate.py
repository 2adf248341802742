import hashlib
import random
import re

from placespark.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        windows += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(i)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out[d] = (len(w), len(hit), len({i for i in found if i is not None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "Zz"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(3, "shared id words beyond ten so that they are a real window"), (None, "q q q q q q q q q q"), (50, None)]
    docs = []
    for d in range(40):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            t[len(t) // 2 : len(t) // 2] = w[a : a + rng.choice([4, 9, 10, 15])]
        docs.append((d, ", ".join(t).upper() if d % 3 else " ".join(t)))
    return docs, items


def report(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return {r[0]: tuple(r)[1:] for r in decontaminate.contamination_report(d, b).collect()}


def test_equals_brute_force(spark):
    for seed in range(3):
        docs, items = corpus(seed)
        assert report(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = corpus(7)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = decontaminate.find_contamination(d, b).collect()
    parts = decontaminate.find_contamination(d, b, block_chars=150).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))


def test_edges(spark, edges, nothing):
    b = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve"), (2, "one two")], "item_id bigint, text string")
    rows = decontaminate.contamination_report(edges, b).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert (by[1].n_words, by[1].contaminated, by[2].n_words, by[3].n_words) == (0, False, 0, 0)
    assert (by[5].n_hit, by[6].n_hit, by[8].n_words) == (2, 2, 1)
    assert decontaminate.contamination_report(nothing, b).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination_report(edges, b.limit(0)).collect())
    kept = decontaminate.drop_contaminated(edges, b)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 3
