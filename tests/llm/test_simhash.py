import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from placespark.llm import simhash
from placespark.llm.components import connected_components


def brute_print(text, k=4):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, threshold=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, x), x)
    return [least[find(i)] for i in range(len(prints))]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    prints = [brute_print(r.text) for r in docs]
    want = dict(zip([r.doc_id for r in docs], zip(prints, brute_components(prints, [r.doc_id for r in docs]), strict=True), strict=True))
    assert got == want


def close_prints(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.append(x)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                x ^= 1 << b
    return list(dict.fromkeys(out))[:n]


def test_links_lose_nothing(spark):
    for seed, most in ((1, 20_000), (2, 3)):
        prints = close_prints(300, seed)
        frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint bigint")
        comp = {r.node: r.component for r in connected_components(simhash.links_of(frame, most=most)).collect()}
        own = [int(np.uint64(p).view(np.int64)) for p in prints]
        want = brute_components(prints, own)
        assert [comp.get(p, p) for p in own] == want


def test_one_hot_neighbourhood_in_blocks(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = list({base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)})
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint bigint")
    comp = connected_components(simhash.links_of(frame, most=20))
    assert comp.select("component").distinct().count() == 1 and comp.count() == len(prints)


def test_every_close_pair_meets_at_a_home():
    rng = random.Random(5)
    anchors = simhash.Anchors(4, 3)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        pair = np.array([x, y], np.uint64)
        key, who = anchors.replicas(pair)
        home = anchors.home(pair[who], key)
        assert {k for k, w, h in zip(key, who, home, strict=True) if w == 0 and h} & {k for k, w in zip(key, who, strict=True) if w == 1}


def test_long_chain_is_one_component(spark):
    links = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(links).select("component").distinct().collect() == [(0,)]
    assert connected_components(links.limit(0)).count() == 0


def test_fingerprints_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    texts = ["a b c d e f g h i j k l m n o p", "", "x", "Ä b  c\nD e f g", None]
    assert simhash.fingerprints(pa.array(texts, pa.string()), 4).tolist() == [brute_print(t) for t in texts]


def test_edges(spark, edges, nothing):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    zero = [r.component_id for r in rows if r.fingerprint == 0]
    assert zero and set(zero) == {1}
    assert simhash.near_duplicates(nothing).count() == 0
