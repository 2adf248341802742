"""Exact top-k by inner product as a Voronoi join (Lu, Shen, Chen and Ooi, 2012).

The greatest inner products are the least distances once every data vector gets one more component, which gives all of
them the same length, and queries get 0 there. Pivots from a bounded sample split the space; data and queries go to
their nearest pivot's cell. Summaries of the cells (count, greatest distance and the k + 1 nearest ids to the pivot)
bound, for each cell of queries, the distance of its k-th neighbours, and so by the triangle inequality which data can
matter to it. Cells of queries whose data mostly coincide form a group (from the summaries: joining them must save a
quarter of their rows), and data are replicated to groups, not cells: where no bound prunes anything, all cells are one group and
each row is sent once for each block of queries. A group is dealt in parts of at most rows_a_task rows and blocks of at most
queries_a_task queries, so that no cell, however many equal vectors it holds, is a single task. Each part gives its k best for
each query; the k best of all parts stay.

Components become floor(scale * x), and scores are sums of their products, exact as 64-bit integers (larger sums aren't supported). Vectors that are
null or hold null, NaN or infinity, and rows without id, take no part; shorter vectors count as filled up with zeros, an
empty one scores 0 with all. A query doesn't meet rows of its own id; of several query rows of one id the least vector
asks. Ties go to the smaller id. Fewer than k candidates: all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.llm.tables import written

SAMPLE = 2048
PIVOTS = 32
ROWS_A_TASK = 100_000
QUERIES_A_TASK = 4_000
BINS = 256
EXACT = float(1 << 53)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= EXACT:
        return a @ b.T
    return (a.astype(float) @ b.astype(float).T).astype(np.int64)


class Cells:
    """Pivots in the widened space and the bounds from the cells' summaries."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int):
        self.longest = longest
        points = self.widen(sample)
        chosen = [0]
        near = np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(pivots, len(points)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(points - points[chosen[-1]], axis=1))
        self.pivots = points[chosen]
        self.between = np.linalg.norm(self.pivots[:, None] - self.pivots[None], axis=2)

    def widen(self, data: np.ndarray) -> np.ndarray:
        x = data.astype(float)
        return np.hstack([x, np.sqrt(np.maximum(0, self.longest - (x * x).sum(axis=1)))[:, None]])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squares = (points * points).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * points @ self.pivots.T
        cell = squares.argmin(axis=1)
        return cell, np.linalg.norm(points - self.pivots[cell], axis=1)

    def bounds(self, queries: dict[int, float], data: dict[int, list[tuple[float, int]]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query cell and data cell: the range of distances to the pivot of data that can be among the k nearest."""
        n = len(self.pivots)
        low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for i, reach in queries.items():
            upper: dict[int, float] = {}
            for j, least in data.items():
                for d, vec_id in least:
                    upper[vec_id] = min(upper.get(vec_id, np.inf), reach + self.between[i, j] + d)
            limit = sorted(upper.values())[k] if len(upper) > k else np.inf  # one of the k + 1 ids can be the query's own
            slack = 1e-6 * (1 + reach + self.between[i].max())
            low[i] = self.between[i] - reach - limit - slack
            high[i] = self.between[i] + reach + limit + slack
        return low, high


def groups_of(low: np.ndarray, high: np.ndarray, queries: list[int], counts: dict[int, np.ndarray], width: float) -> list[list[int]]:
    """Groups of query cells: the two that save most are joined as long as that saves a quarter of their rows.

    low and high: the range of distances that each query cell needs of each data cell; counts: rows of each data cell by
    distance, in bins of width. Everything is a few numbers for each cell.
    """

    def rows(lo: np.ndarray, hi: np.ndarray) -> float:
        total = 0.0
        for j, n in counts.items():
            if hi[j] >= lo[j] and hi[j] >= 0:
                first, last = max(0, int(max(lo[j], 0) // width)), min(len(n) - 1, int(min(hi[j], width * len(n)) // width))
                total += float(n[first : last + 1].sum())
        return total

    groups = [([i], low[i], high[i], rows(low[i], high[i])) for i in queries]
    while True:
        best = None
        for a in range(len(groups)):
            for b in range(a):
                lo, hi = np.minimum(groups[a][1], groups[b][1]), np.maximum(groups[a][2], groups[b][2])
                apart = groups[a][3] + groups[b][3]
                together = rows(lo, hi)
                if together <= 0.75 * apart and (best is None or apart - together > best[0]):
                    best = (apart - together, a, b, lo, hi, together)
        if best is None:
            return [g[0] for g in groups]
        _, a, b, lo, hi, n = best
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [(sorted(groups[a][0] + groups[b][0]), lo, hi, n)]


def _usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    return vector.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))


def top_k(data: DataFrame, is_query: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
          pivots: int = PIVOTS, sample: int = SAMPLE, rows_a_task: int = ROWS_A_TASK, queries_a_task: int = QUERIES_A_TASK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of greatest inner product, from rank 1."""
    spark = data.sparkSession
    whole = data.where(_usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * scale)).alias("x"), is_query.alias("asks"))
    whole = written(whole)
    length = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    most = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    width, longest, most = whole.agg(F.max(F.size("x")), F.max(length), F.max(most)).first()
    whole = whole.withColumn("x", F.col("x").cast("array<smallint>")) if (most or 0) < 1 << 15 else whole  # what is shuffled is as small as it can be
    kind = dict(whole.dtypes)["x"]
    answer = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not width:  # no vectors at all, or only empty ones, whose scores are all 0
        width, longest = 1, 0.0
    rows = whole.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).select("x").toArrow()
    if not rows.num_rows:
        return spark.createDataFrame([], answer)
    cells = Cells(_matrix(rows.column("x"), width), float(longest), pivots)
    held = spark.sparkContext.broadcast(cells)

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            as_query = batch.column("as_query").to_numpy(zero_copy_only=False)
            points = np.where(as_query[:, None], np.hstack([x, np.zeros((len(x), 1))]), held.value.widen(x))
            cell, distance = held.value.nearest(points)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cell.astype(np.int32)), pa.array(distance)], names=["vec_id", "x", "cell", "distance"])

    shape = f"vec_id bigint, x {kind}, cell int, distance double"
    stored = whole.select("vec_id", "x", F.lit(False).alias("as_query")).mapInArrow(assign, shape)
    asked = whole.where("asks").groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("as_query", F.lit(True)).mapInArrow(assign, shape)
    stored, asked = written(stored.withColumn("number", F.monotonically_increasing_id())), written(asked)
    # summaries: a few numbers for each of at most `pivots` cells
    place = F.row_number().over(Window.partitionBy("cell", "part").orderBy("distance"))
    by_id = stored.groupBy("cell", "vec_id").agg(F.min("distance").alias("distance"))
    nearest = by_id.select("cell", "vec_id", "distance", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).withColumn("place", place).where(F.col("place") <= k + 1)
    least = {r[0]: sorted(r[1])[: k + 1] for r in nearest.groupBy("cell").agg(F.collect_list(F.struct("distance", "vec_id"))).collect()}
    queries = {r[0]: (r[1], r[2]) for r in asked.groupBy("cell").agg(F.max("distance"), F.count("*")).collect()}
    if not queries:
        return spark.createDataFrame([], answer)
    low, high = cells.bounds({i: r for i, (r, _) in queries.items()}, least, k)
    step = 2.0 * max(float(longest) ** 0.5, 1.0) / BINS
    found = stored.groupBy("cell", F.least(F.floor(F.col("distance") / step), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
    counts = {j: np.zeros(BINS) for j in {r[0] for r in found}}
    for j, place, n in found:
        counts[j][place] = n
    groups = groups_of(low, high, sorted(queries), counts, step)
    low, high = np.array([low[g].min(axis=0) for g in groups]), np.array([high[g].max(axis=0) for g in groups])
    group_of = np.full(len(cells.pivots), -1)
    for g, members in enumerate(groups):
        group_of[members] = g
    needed = [sum(counts[j].sum() for j in counts if high[g, j] >= low[g, j]) for g in range(len(groups))]
    parts = {g: max(1, int(-(-n // rows_a_task))) for g, n in enumerate(needed)}
    blocks = {g: max(1, -(-sum(queries[i][1] for i in members) // queries_a_task)) for g, members in enumerate(groups)}
    plan = spark.sparkContext.broadcast((low, high, parts, blocks, group_of))

    def replicate(batches):
        """Each data row to every group that it can matter to: a row for each block of that group's queries."""
        for batch in batches:
            low, high, parts, blocks, _ = plan.value
            cell, distance = batch.column("cell").to_numpy(), batch.column("distance").to_numpy()
            number = batch.column("number").to_numpy().view(np.uint64)  # not the id: rows of one id stay apart
            spread = number * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for i in parts:
                rows = np.flatnonzero((distance >= low[i, cell]) & (distance <= high[i, cell]))
                some = batch.select(["vec_id", "x"]).take(pa.array(rows))
                part = (spread[rows] % np.uint64(parts[i])).astype(np.int32)
                for b in range(blocks[i]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), pa.array(np.full(len(rows), b, np.int32)), pa.array(part), *some.columns], names=["cell", "block", "part", "vec_id", "x"])

    def deal(batches):
        """Each query to every part of its group's data."""
        for batch in batches:
            _, _, parts, blocks, group_of = plan.value
            cell = group_of[batch.column("cell").to_numpy()]
            for i in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == i)
                some = batch.select(["vec_id", "x"]).take(pa.array(rows))
                block = (batch.column("vec_id").to_numpy()[rows].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(blocks[i])
                for p in range(parts[i]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(rows), p, np.int32)), *some.columns], names=["cell", "block", "part", "vec_id", "x"])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        out = [[], [], []]
        if len(q) and len(ids):
            order = np.argsort(ids, kind="stable")
            ids, x, asks = ids[order], _matrix(right.column("x"), width)[order], _matrix(left.column("x"), width)
            step = max(1, 4_000_000 // max(1, len(ids)))
            for at in range(0, len(q), step):
                scores = products(asks[at : at + step], x)
                for row, own in zip(scores, q[at : at + step], strict=True):
                    open_ = np.flatnonzero(ids != own)
                    s = row[open_]
                    if len(s) > k:
                        least_score = np.partition(s, len(s) - k)[len(s) - k]
                        more = np.flatnonzero(s > least_score)
                        chosen = np.concatenate([more, np.flatnonzero(s == least_score)[: k - len(more)]])  # ids ascend
                    else:
                        chosen = np.arange(len(s))
                    out[0] += [own] * len(chosen)
                    out[1] += ids[open_[chosen]].tolist()
                    out[2] += s[chosen].tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(["query_id", "vec_id", "score"], out, strict=True)})

    keyed = f"cell int, block int, part int, vec_id bigint, x {kind}"
    left = asked.select("vec_id", "x", "cell").mapInArrow(deal, keyed).groupBy("cell", "block", "part")
    right = stored.mapInArrow(replicate, keyed).groupBy("cell", "block", "part")
    found = left.cogroup(right).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
