"""Places of pattern matches in texts, with built-in functions only.

A text is cut at the matches of a pattern; the parts' and matches' lengths, summed, give each match's place in code
points. The running sum works in blocks, so that a text with very many matches costs little more for each. Patterns
are written so that Java's engine stays linear and iterative: possessive groups, and starts only where a run begins
(or where the last match ended, \\G), which finds the same leftmost matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def running_total(numbers: Column) -> Column:
    """Sums of array<bigint> up to and with each place."""
    n = F.size(numbers)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1)), lambda k: F.slice(numbers, k * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("before"))
    before = F.aggregate(blocks, start, lambda a, b: F.struct((a["sum"] + total(b)).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")))["before"]
    return F.flatten(F.zip_with(blocks, before, lambda b, s: F.transform(b, lambda _, i: s + total(F.slice(b, 1, i + 1)))))


def with_matches(df: DataFrame, text: Column, kinds: list[tuple[str, Column | None]], name: str = "spans") -> DataFrame:
    """df with name: array of SPAN arrays, one for each (pattern, whether a text can match) of kinds; value is the match."""
    values, parts, ends, found = ([f"{x}{i}" for i in range(len(kinds))] for x in ("values_", "parts_", "ends_", "found_"))
    own = df.columns
    nothing = F.array().cast("array<string>")
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce(text, F.lit("")).alias("own_text"))
    hits = [F.regexp_extract_all("own_text", F.lit(p), F.lit(0)) for p, _ in kinds]
    df = df.select("*", *[(hit if can is None else F.when(can, hit).otherwise(nothing)).alias(v) for hit, (_, can), v in zip(hits, kinds, values, strict=True)])
    df = df.select("*", *[F.when(F.size(v) > 0, F.slice(F.split("own_text", p, -1), F.lit(1), F.size(v))).otherwise(nothing).alias(x) for v, x, (p, _) in zip(values, parts, kinds, strict=True)])
    widths = [F.zip_with(x, v, lambda a, b: (F.length(a) + F.length(b)).cast("bigint")) for v, x in zip(values, parts, strict=True)]
    df = df.select("*", *[F.when(F.size(v) > 0, running_total(w)).otherwise(F.array().cast("array<bigint>")).alias(e) for v, w, e in zip(values, widths, ends, strict=True)])
    spans = [_spans(k, v, e).alias(f) for k, (v, e, f) in enumerate(zip(values, ends, found, strict=True))]
    df = df.select("row", *spans)
    return df.select(*[F.col("row")[c].alias(c) for c in own], F.array(*found).alias(name))


def _spans(kind: int, value: str, end: str) -> Column:
    zipped = F.arrays_zip(F.col(value).alias("v"), F.col(end).alias("e"))
    return F.transform(zipped, lambda z: F.struct(F.lit(kind).alias("kind"), (z["e"] - F.length(z["v"])).alias("start"), z["e"].alias("end"), z["v"].alias("value"))).cast(SPAN)


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def digest(spans: Column, names: list[str], by_start: bool) -> Column:
    """kind:start:end of spans, comma-joined, by start and then kind, or by kind and then start."""
    keyed = F.transform(spans, lambda s: F.struct(*[s[x].alias(x) for x in (("start", "kind") if by_start else ("kind", "start"))], s["end"].alias("end")))
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with the union of spans (start, end) replaced by mark."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    merged = F.aggregate(ordered, start, _joined)
    cuts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(merged, lambda s: s["end"]))
    stops = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    return F.array_join(F.zip_with(cuts, stops, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), mark)


def _joined(done: Column, s: Column) -> Column:
    last = F.try_element_at(done, F.lit(-1))
    wider = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
    return F.when(F.coalesce(last["end"] >= s["start"], F.lit(False)), wider).otherwise(F.concat(done, F.array(s)))
