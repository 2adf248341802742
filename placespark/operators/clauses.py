"""Searches as trees of clauses, and their best documents without scoring all that match.

An impact index holds each token's documents in blocks, greatest BM25 first. A search reads the first blocks of its tokens, scores the
documents found there exactly, and knows the k-th best score so far. A document that was in no block yet can't score more than the sum
of what each token's next block begins with, and the phrases' bonuses; where that is below the k-th score (or equal, and the document
comes later) the search is done. The other searches read four times as many blocks, and so on. A search with required clauses, filters
among them, reads the blocks of the one that has the fewest only, as every result is in there. So a token that nearly every document has is
read only as far as it can matter, and the results are those of scoring every document.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.intermediate import written
from placespark.operators.search import bm25, phrases, sloppy_phrases

BLOCK = 256


@dataclass(frozen=True)
class Words:
    """A clause of words (query, token, pos, n) in weighted fields: boost times the best field's sum of BM25.

    required: a document must match it; excluded: must not (it scores nothing); every: all words must match in the field; ordered: they
    must stand in the query's order in the field.
    """

    asked: DataFrame
    fields: dict[str, float]
    boost: float = 1.0
    required: bool = False
    excluded: bool = False
    every: bool = False
    ordered: bool = False


@dataclass(frozen=True)
class Phrase:
    """A bonus for documents that hold the words in order in one of the fields, up to slop moves."""

    asked: DataFrame
    fields: tuple[str, ...]
    boost: float
    slop: int = 0


@dataclass(frozen=True)
class Tree:
    """Clauses whose scores add up; at least `minimum` of the optional ones must match. Documents must have all required clauses and no
    excluded one, and condition (over columns of queries and docs, a query and a doc in a row) must hold. factor, over the same columns,
    multiplies the score; the index must have been made with its ceilings. Bonuses of phrases have no ceilings, so there are none then."""

    words: list[Words]
    phrases: list[Phrase] = field(default_factory=list)
    minimum: int = 0
    condition: Column | None = None
    factor: Column | None = None

    def __post_init__(self) -> None:
        if self.factor is not None and self.phrases:
            raise ValueError("a tree with a factor takes ordered words instead of phrases")


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows with place: from 0 within each group, by order. A group may be spread over many tasks.

    Rows are sorted into ranges by group and order and written; each range's rows of a group begin after those of the ranges before.
    """
    placed = written(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    ranges = placed.groupBy(*group, "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select(*group, "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(starts, [*group, "range"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def impact_index(index: DataFrame, statistics: DataFrame, block: int = BLOCK, ceilings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of postings: (field, token, block, doc, impact, positions), and each block's begin (field, token, block, top, first).

    ceilings (doc, ceiling): the most that a tree's factor can be for the document, whatever the query; blocks are then ordered by
    impact times ceiling. Documents without one have 1.
    """
    score = bm25(F.col("tf"), F.col("df"), F.col("docs"), F.col("field_length"), F.col("average"))
    rows = index.join(statistics, ["field", "token"]).select("field", "token", "doc", "positions", "field_length", score.alias("impact"))
    rows = rows.withColumn("most", F.col("impact")) if ceilings is None else rows.join(ceilings, "doc", "left").withColumn("most", F.col("impact") * F.coalesce("ceiling", F.lit(1.0))).drop("ceiling")
    rows = written(numbered(rows, ["field", "token"], [F.desc("most"), F.asc("doc")]).withColumn("block", F.floor(F.col("place") / block).cast("int")).drop("place"))
    begin = F.min_by("doc", F.struct(-F.col("most"), F.col("doc")))
    heads = rows.groupBy("field", "token", "block").agg(F.max("most").alias("top"), begin.alias("first"))
    return rows, written(heads)


def exact_postings(docs: DataFrame, fields: list[str], doc_id: str = "osm_id") -> DataFrame:
    """Postings of whole values in lower case, for clauses that filter."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("token")) for f in fields])).alias("x")
    rows = docs.select(F.col(doc_id).alias("doc"), each).select("x.field", "x.token", "doc").where("token IS NOT NULL")
    return rows.select("field", "token", "doc", F.lit(1).cast("bigint").alias("tf"), F.array(F.lit(0)).alias("positions"), F.lit(1).alias("field_length"))


def exact_word(queries: DataFrame, value: str) -> DataFrame:
    """A query's value as the one word of a clause over exact_postings; null asks for nothing."""
    return queries.where(F.col(value).isNotNull()).select("query", F.lower(F.col(value).cast("string")).alias("token"), F.lit(0).alias("pos"), F.lit(1).alias("n"))


def _terms(tree: Tree) -> DataFrame:
    """(query, clause, token, times, n, field, weight) of all words."""
    rows = []
    for i, c in enumerate(tree.words):
        weights = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("weight")) for f, w in c.fields.items()]))
        counted = c.asked.groupBy("query", "token").agg(F.count("*").cast("int").alias("times"), F.first("n").alias("n"))
        rows.append(counted.select("query", F.lit(i).alias("clause"), "token", "times", "n", weights.alias("f")).select("query", "clause", "token", "times", "n", "f.*"))
    return reduce(DataFrame.unionByName, rows)


def scores(tree: Tree, terms: DataFrame, candidates: DataFrame, rows: DataFrame, queries: DataFrame | None, docs: DataFrame | None) -> DataFrame:
    """(query, doc, score) of the candidates (query, doc) that the tree takes, scored exactly."""
    joined = candidates.join(terms, "query").join(rows.select("doc", "token", "field", "impact"), ["doc", "token", "field"])
    of_field = joined.groupBy("query", "doc", "clause", "field").agg(F.sum(F.col("impact") * F.col("times") * F.col("weight")).alias("score"), F.sum("times").alias("matched"), F.first("n").alias("n"))
    every = [i for i, c in enumerate(tree.words) if c.every]
    of_field = of_field.where(~F.col("clause").isin(every) | (F.col("matched") >= F.col("n"))) if every else of_field
    ordered = [i for i, c in enumerate(tree.words) if c.ordered]
    if ordered:
        holds = []
        for i in ordered:
            clause = tree.words[i]
            own = candidates.join(clause.asked.select("query", "token").distinct(), "query").join(rows.where(F.col("field").isin(list(clause.fields))).select("doc", "token", "field", "positions"), ["doc", "token"])
            holds.append(phrases(clause.asked, own).withColumn("clause", F.lit(i)))
        in_order = F.col("clause").isin(ordered)
        of_field = of_field.where(~in_order).unionByName(of_field.where(in_order).join(reduce(DataFrame.unionByName, holds), ["query", "doc", "field", "clause"]))
    best = of_field.groupBy("query", "doc", "clause").agg(F.max("score").alias("score"))
    boost = F.element_at(F.array(*[F.lit(0.0 if c.excluded else float(c.boost)) for c in tree.words]), F.col("clause") + 1)
    parts = [best.select("query", "doc", "clause", (F.col("score") * boost).alias("score"))]
    for i, p in enumerate(tree.phrases):
        asked = candidates.join(p.asked.select("query", "token").distinct(), "query")
        own = asked.join(rows.where(F.col("field").isin(list(p.fields))).select("doc", "token", "field", "positions"), ["doc", "token"])
        found = sloppy_phrases(p.asked, own, p.slop) if p.slop else phrases(p.asked, own)
        parts.append(found.select("query", "doc").distinct().select("query", "doc", F.lit(len(tree.words) + i).alias("clause"), F.lit(float(p.boost)).alias("score")))
    out = reduce(DataFrame.unionByName, parts).groupBy("query", "doc").agg(F.sum("score").alias("score"), F.collect_set("clause").alias("clauses"))
    needed, barred = [i for i, c in enumerate(tree.words) if c.required], [i for i, c in enumerate(tree.words) if c.excluded]
    for i in needed:
        out = out.where(F.array_contains("clauses", i))
    for i in barred:
        out = out.where(~F.array_contains("clauses", i))
    if tree.minimum:
        out = out.where(F.size(F.array_except("clauses", F.array(*map(F.lit, needed)) if needed else F.array().cast("array<int>"))) >= tree.minimum)
    if tree.condition is not None or tree.factor is not None:
        out = out.join(queries, "query").join(docs, "doc")
        out = out if tree.condition is None else out.where(tree.condition)
        out = out if tree.factor is None else out.withColumn("score", F.col("score") * tree.factor)
    return out.select("query", "doc", F.round(F.col("score") + 1e-12, 6).alias("score"))


def _driving(terms: DataFrame, heads: DataFrame, tree: Tree) -> DataFrame:
    """terms with drives: whether a query's documents are read from the term. All do, or those of its required clause of fewest blocks."""
    needed = [i for i, c in enumerate(tree.words) if c.required]
    if not needed:
        return terms.withColumn("drives", F.lit(True))
    blocks = heads.groupBy("field", "token").agg((F.max("block") + 1).alias("blocks"))
    sums = terms.where(F.col("clause").isin(needed)).join(blocks, ["field", "token"], "left").groupBy("query", "clause").agg(F.sum(F.coalesce("blocks", F.lit(0))).alias("blocks"))
    chosen = sums.groupBy("query").agg(F.min_by("clause", F.struct("blocks", "clause")).alias("chosen"))
    return terms.join(chosen, "query", "left").withColumn("drives", F.coalesce(F.col("chosen") == F.col("clause"), F.lit(True))).drop("chosen")


def _bounds(terms: DataFrame, heads: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """(query, bound, first): what a document of no block before `depth` can score, and the least such document of that score; no row
    where nothing is left to read."""
    boost = F.element_at(F.array(*[F.lit(0.0 if c.excluded else float(c.boost)) for c in tree.words]), F.col("clause") + 1)
    at = F.when(F.col("drives"), depth).otherwise(0)
    next_ = terms.withColumn("block", at).join(heads.where(F.col("block").isin(0, depth)), ["field", "token", "block"]).withColumn("part", F.col("top") * F.col("times") * F.col("weight") * boost)
    parts = next_.groupBy("query", "clause", "token").agg(F.max("part").alias("part"), F.min(F.when(F.col("drives"), F.col("first"))).alias("first"), F.max("drives").alias("drives"))
    bonus = sum(p.boost for p in tree.phrases)
    return parts.groupBy("query").agg(F.round(F.sum("part") * (1 + 1e-12) + bonus + 1e-12, 6).alias("bound"), F.min("first").alias("first"), F.max("drives").alias("drives")).where("drives").drop("drives")


def best(tree: Tree, impacts: tuple[DataFrame, DataFrame], k: int, queries: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank): each query's k best documents; ties to the smaller doc. Queries without words have none."""
    rows, heads = impacts
    terms = written(_driving(_terms(tree), heads, tree))
    read, depth, active, seen, done = 0, 1, terms.select("query").distinct(), None, []
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    while True:
        wanted = terms.where("drives").join(active, "query").select("query", "field", "token", F.explode(F.sequence(F.lit(read), F.lit(depth - 1))).alias("block"))
        new = wanted.join(rows.select("field", "token", "block", "doc"), ["field", "token", "block"]).select("query", "doc").distinct()
        new = new if seen is None else new.join(seen.select("query", "doc"), ["query", "doc"], "left_anti")
        found = scores(tree, terms, new, rows, queries, docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = found if seen is None else found.unionByName(seen.join(active, "query")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = written(found)
        last = found.where(F.col("rank") == k).select("query", F.col("score").alias("least"), F.col("doc").alias("least_doc"))
        rest = _bounds(terms.join(active, "query"), heads, tree, depth).join(last, "query", "left")
        open_ = F.col("least").isNull() | (F.col("bound") > F.col("least")) | ((F.col("bound") == F.col("least")) & (F.col("first") < F.col("least_doc")))
        active = written(rest.where(open_).select("query"))
        done.append(found.join(active, "query", "left_anti"))
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done).select("query", "doc", "score", "rank")
        seen, read, depth = found, depth, depth * 4
