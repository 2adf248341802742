import math
import random

import numpy as np

from placespark.llm import knn


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in ok:
        if i % 50 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = set()
    for q, x in asks.items():
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in ok if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cell int, x string")
    got = knn.top_k(frame, frame["vec_id"] % 50 == 0, **more).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    same = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, same if i % 3 == 0 else [rng.gauss(0, 0.3) for _ in range(8)], 1, None) for i in range(600)]
    rows += [(1000, None, 1, None), (1050, [None] * 8, 1, None), (1100, [float("nan")] * 8, 1, None), (None, same, 1, None), (1150, [float("inf")] * 8, 1, None)]
    want = brute([r[:2] for r in rows])
    for more in ({}, {"pivots": 4, "rows_a_task": 60, "queries_a_task": 3}, {"pivots": 1}):
        assert run(spark, rows, **more) == want


def test_edges(spark):
    assert run(spark, [(0, [0.5], 1, None)]) == set()
    assert run(spark, []) == set()
    assert run(spark, [(1, [0.5], 1, None)]) == set()
    assert run(spark, [(0, [], 1, None), (1, [], 1, None)]) == {(0, 1, 1, 0)}
    few = [(0, [1.0, 0.0], 1, None), (1, [0.5], 1, None), (2, [-1.0, 3.0], 1, None), (0, [1.0, 0.0], 1, None)]
    assert run(spark, few) == {(0, 1, 1, 32768), (0, 2, 2, -65536)}
    huge = [(0, [3e6, 1e6], 1, None), (1, [2e6, 5.0], 1, None)]
    assert run(spark, huge) == brute([r[:2] for r in huge])


def test_own_rows_repeated_at_a_pivot(spark):
    rng = random.Random(2)
    rows = [(0, [1.0, 0.0], 1, None)] * 50 + [(i, [-1.0 + rng.uniform(0, 0.2), rng.uniform(-1, 1)], 1, None) for i in range(1, 31)]
    want = brute([r[:2] for r in rows])
    assert len(want) == 5
    for more in ({}, {"rows_a_task": 10}):
        assert run(spark, rows, **more) == want
    spread = [(0, [1.0, i / 50], 1, None) for i in range(50)] + rows[50:]
    assert run(spark, spread) == brute([r[:2] for r in spread])


def test_groups_of_cells(spark, sf):
    """Where bounds prune nothing, all cells are one group; apart clusters stay apart, and nothing is lost."""
    bins = np.zeros(8)
    bins[0] = 100
    counts = {0: bins, 1: bins, 2: bins}
    everything = np.zeros((3, 3)), np.full((3, 3), 9.0)
    assert knn.groups_of(*everything, [0, 1, 2], counts, 1.0) == [[0, 1, 2]]
    own = np.where(np.eye(3) > 0, 0.0, np.inf), np.where(np.eye(3) > 0, 9.0, -np.inf)
    assert sorted(knn.groups_of(*own, [0, 1, 2], counts, 1.0)) == [[0], [1], [2]]


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8)) * 20
    centres /= np.linalg.norm(centres, axis=1)[:, None] / 50
    vectors = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(1200)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    cells, sent = [], []
    keep_groups = knn.groups_of

    def watched(low, high, queries, counts, width):
        groups = keep_groups(low, high, queries, counts, width)
        sent.append(sum(sum(n.sum() for j, n in counts.items() if high[g].max(axis=0)[j] >= low[g].min(axis=0)[j]) for g in groups))
        cells.append(len(groups))
        return groups

    knn.groups_of = watched
    try:
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_k(frame, frame["vec_id"] % 50 == 0, pivots=6).collect()}
    finally:
        knn.groups_of = keep_groups
    x = np.floor(np.array([v for _, v in vectors]) * 256).astype(np.int64)
    for q in range(0, 1200, 50):
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1200), -scores)).tolist() if i != q][:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, int(scores[i])) for i in order]
    assert cells[0] > 1 and sent[0] <= 3 * 1200
