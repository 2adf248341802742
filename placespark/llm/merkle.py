"""Merkle manifest of a table: a tree for each language, a tree over the languages' roots, and proofs that climb from every row.

H is SHA-256 in lower-case hex of its inputs one after the other, digests as hex. A leaf is H of the row's fields, each `-` if null, else
its UTF-8 byte count, a colon and its value. A language's leaves stand by doc_id (equal ids by their hashes); every ARITY of them become a
node, the last run may be shorter, until one is left: the language's root. These, by language (null first), become the root likewise.

Numbering: rows are sorted into ranges and counted in each; a range's rows begin after those of the ranges before, so no language is one
task. Levels: a run is ARITY rows by construction, so each level is one aggregation of an eighth of the rows; it is written as node rows,
which hold their siblings on both sides and the id of their parent. Node rows are joined to those of their parents, so that one row leads
LEAP levels up.

Climb: a recursive query starts at all leaves, with their own hash or a tampered one, and joins the node they stand at: the siblings are
appended, each leaf's hash is folded with them, and it stands at a node LEAP levels above. The leaves of a run travel in one row, as what
stands above them is the same; each folds its own hash. Nodes near the root are met by very many rows: the last NEAR or fewer, whole
levels, are broadcast in a second recursive query; below, a level has more nodes than that.

doc_id, lang, source, n_chars and text may be null: each is a field like any other; rows without doc_id are never tampered with. Empty texts
are `0:`. Repeated rows are leaves each. No rows: no tree, and no rows. Extra columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.llm.tables import written

ARITY = 8
LEAP = 3
#: So many nodes near the root are broadcast at most.
NEAR = 1 << 14
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(*parts: Column) -> Column:
    """H of texts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): each row's hash, and that of the row with its text's A-Z in lower case where 3 divides its id's CRC-32; else the same."""
    whole, lower = (_hash(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)) for text in (F.col("text"), F.translate("text", _UPPER, _LOWER)))
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return documents.select("doc_id", "lang", whole.alias("leaf"), F.when(chosen, lower).otherwise(whole).alias("tampered"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos (from 0, by order within each group; nulls first and a group of their own) and n, the group's rows.

    Rows are sorted into ranges by group and order, and written. There are as many (range, group) pairs as ranges and groups together.
    """
    sorted_ = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("place", F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumn("range", F.shiftright("place", 33))
    ranges = written(sorted_.groupBy(group, "range").agg(F.min("place").alias("first"), F.count("*").alias("rows")))
    own = Window.partitionBy(group)
    before = F.sum("rows").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select(F.col(group).alias("starts_of"), F.col("range").alias("starts_in"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    few = ranges.count() <= NEAR
    joined = sorted_.join(F.broadcast(starts) if few else starts, (F.col("range") == F.col("starts_in")) & F.col(group).eqNullSafe(F.col("starts_of")))
    return joined.select(*rows.columns, (F.col("place") + F.col("shift")).alias("pos"), "n")


def _sides(members: Column, i: Column) -> tuple[Column, Column]:
    """The hashes before and after place i of a run, one after the other."""
    join = lambda part: F.aggregate(part, F.lit(b""), lambda s, m: F.concat(s, m["hash"]))
    return join(F.slice(members, F.lit(1), i)), join(F.slice(members, i + 2, F.greatest(F.size(members) - i - 1, F.lit(0))))


def _node(level: int, pos: Column, group: Column, tree: str) -> Column:
    return F.concat(F.lit(f"{tree}{level}."), pos.cast("string"), group)


def _levels(rows: DataFrame, group: Column, tree: str, above: Column, carried: list[str]) -> tuple[DataFrame | None, list[DataFrame], DataFrame]:
    """Runs of level 0, node rows of the levels from 1 on, and what remains of each group, of rows (group's columns, pos, n, hash, carried).

    Runs are (members, parent); each level has rows (id, hash, left, right, parent); above is the id by which the last node of a group is known.
    """
    own = [c for c in rows.columns if c not in ("pos", "n", "hash", *carried)]
    last = rows.where("n = 1").select(*own, "hash")
    most = rows.agg(F.max("n")).first()[0] or 0
    current, first, nodes, level = rows.where("n > 1"), None, [], 0
    while most > 1:
        members = F.array_sort(F.collect_list(F.struct((F.col("pos") % ARITY).cast("int").alias("place"), "hash", *(carried if level == 0 else []))))
        runs = current.groupBy(*own, F.floor(F.col("pos") / ARITY).alias("pos"), "n").agg(members.alias("members"))
        hashes = F.aggregate(F.col("members"), F.lit(b""), lambda s, m: F.concat(s, m["hash"]))
        runs = written(runs.withColumn("hash", _hash(_hex(hashes))).withColumn("count", F.ceil(F.col("n") / ARITY)))
        parent = F.when(F.col("count") == 1, above).otherwise(_node(level + 1, F.col("pos"), group, tree))
        if level == 0:
            first = runs.select(*own, "members", parent.alias("parent"))
        else:
            named = _node(level, F.col("pos") * ARITY + F.col("member.place"), group, tree)
            nodes.append(_apart(runs.withColumn("parent", parent)).withColumn("id", named))
        next_ = runs.select(*own, "pos", F.col("count").alias("n"), "hash")
        last = last.unionByName(next_.where("n = 1").select(*own, "hash"))
        current, most, level = next_.where("n > 1"), -(-most // ARITY), level + 1
    return first, nodes, last


def _apart(runs: DataFrame) -> DataFrame:
    """A row for each member of the runs, with its hash and those on both sides."""
    each = runs.drop("hash").select("*", F.explode("members").alias("member"))
    left, right = _sides(F.col("members"), F.col("member.place"))
    return each.select("*", F.col("member.hash").alias("hash"), left.alias("left"), right.alias("right")).drop("members")


def tree(rows: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Of leaves' rows: where each run stands after its own fold (cur, members (doc_id, leaf, folded)), node rows (id, level, hash, left, right,
    parent, is_root; parents of null are the whole tree's root), and the root."""
    group = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("-"))
    own = F.concat(F.lit("s"), group)
    placed = numbered(rows, "lang", ["doc_id", "leaf"])
    runs, nodes, roots = _levels(placed.withColumnRenamed("leaf", "hash"), group, "n", own, ["doc_id", "tampered"])
    member = lambda m, folded: F.struct(m["doc_id"].alias("doc_id"), m["leaf"].alias("leaf"), folded.alias("folded"))
    alone = F.struct("doc_id", "leaf", F.col("tampered").alias("folded"))
    start = placed.where("n = 1").select(own.alias("cur"), F.array(member(alone, F.col("tampered"))).alias("members"))
    if runs is not None:

        def folded(m: Column, i: Column) -> Column:
            left, right = _sides(F.col("members"), i)
            return F.struct(m["doc_id"].alias("doc_id"), m["hash"].alias("leaf"), _hash(_hex(F.concat(left, m["tampered"], right))).alias("folded"))

        start = start.unionByName(runs.select(F.col("parent").alias("cur"), F.transform("members", folded).alias("members")))
    ranked = numbered(written(roots.select("lang", "hash", F.lit(1).alias("of"))), "of", ["lang"])
    top_runs, top, last = _levels(ranked, F.lit(""), "t", F.lit(None).cast("string"), ["lang"])
    found = last.select(_hex(F.col("hash"))).first()
    shape = ["id", "hash", "left", "right", "parent", "is_root"]
    nothing = F.lit(b"")
    lone = ranked.where("n = 1").select(own.alias("id"), "hash", nothing.alias("left"), nothing.alias("right"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("is_root"))
    tops = lone if top_runs is None else _apart(top_runs).withColumn("lang", F.col("member.lang")).withColumn("id", own).withColumn("is_root", F.lit(True))
    tables = [t.withColumn("is_root", F.lit(False)) for t in nodes] + [tops] + [t.withColumn("is_root", F.lit(False)) for t in top]
    leveled = [t.select(*shape, F.lit(i).alias("level")) for i, t in enumerate(tables)]
    return start, reduce(DataFrame.unionByName, leveled), found[0] if found else ""


def leaps(nodes: DataFrame) -> DataFrame:
    """(id, level, steps, next, sub): up to LEAP steps (left, right) above each node, where they lead, and a language's root's hash met on the way.

    A node has at most ARITY children, so no key of these joins has more rows. Nothing is folded where a tree of one language ends.
    """
    step = F.when(F.col("parent").isNotNull() | (F.length(F.concat("left", "right")) > 0) | ~F.col("is_root"), F.array(F.struct("left", "right"))).otherwise(F.array().cast("array<struct<left:binary,right:binary>>"))
    own = written(nodes.select("id", "level", step.alias("steps"), F.col("parent").alias("next"), F.when(F.col("is_root"), F.col("hash")).alias("sub")))
    out = own
    for _ in range(LEAP - 1):
        up = own.select(F.col("id").alias("next"), F.col("steps").alias("more"), F.col("next").alias("beyond"), F.col("sub").alias("met"))
        out = out.join(up, "next", "left").select("id", "level", F.when(F.col("more").isNull(), F.col("steps")).otherwise(F.concat("steps", "more")).alias("steps"), F.col("beyond").alias("next"), F.coalesce("sub", "met").alias("sub"))
    return written(out)


CLIMB = """
WITH RECURSIVE climb(cur, members, siblings, sub) AS (
  SELECT cur, members, siblings, sub FROM {start}
  UNION ALL
  SELECT n.next,
    transform(c.members, m -> named_struct('doc_id', m.doc_id, 'leaf', m.leaf, 'folded', aggregate(n.steps, m.folded, (f, s) -> unhex(sha2(lower(hex(concat(s.left, f, s.right))), 256))))),
    concat(c.siblings, aggregate(n.steps, X'', (x, s) -> concat(x, s.left, s.right))), coalesce(c.sub, n.sub)
  FROM climb c JOIN {nodes} n ON c.cur = n.id
)
SELECT c.* FROM climb c LEFT ANTI JOIN {ends} e ON c.cur = e.cur
"""


def climbed(spark: SparkSession, start: DataFrame, nodes: DataFrame) -> DataFrame:
    """start's rows at the root: (members, siblings above their run, sub)."""
    table = leaps(nodes)
    counts = sorted((r["level"], r["count"]) for r in table.groupBy("level").count().collect())
    near, room = len(counts), NEAR
    while near and counts[near - 1][1] <= room:
        near -= 1
        room -= counts[near][1]
    at = start.select("cur", "members", F.lit(b"").alias("siblings"), F.lit(None).cast("binary").alias("sub"))
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        for low, high in ((0, near), (near, len(counts))):
            if low == high:
                continue
            part = table.where((F.col("level") >= low) & (F.col("level") < high)).drop("level")
            ends = part.select(F.col("id").alias("cur"))
            if low == near:
                part, ends = F.broadcast(part), F.broadcast(ends)
            at = written(spark.sql(CLIMB, start=at, nodes=part, ends=ends))
    finally:
        spark.conf.set(ROW_LIMIT, before)
    return at


def manifest_report(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256 (all untampered), folded_root (of the tampered leaf and the original siblings), verified."""
    start, nodes, root = tree(leaves(documents))
    at = climbed(documents.sparkSession, start, nodes).select("*", F.posexplode("members").alias("i", "m"))
    left, right = _sides(F.transform("members", lambda m: F.struct(m["leaf"].alias("hash"))), F.col("i"))
    proof = F.sha2(_hex(F.concat(left, right, "siblings")), 256)
    folded = _hex(F.col("m.folded"))
    return at.select(F.col("m.doc_id").alias("doc_id"), _hex(F.col("m.leaf")).alias("leaf"), _hex(F.col("sub")).alias("subroot"), F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))
