"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score. Nearby is up to WINDOW characters
before a match or after it, other matches included. Built-in functions only.

Kinds: email; ip (parts up to 255); card (13 to 19 digits, Luhn); phone (+, 9 to 15 digits), which are always kept once
confirmed; iban (country, check digits and account, mod-97 equal 1) and ssn (three, two and four digits), which are kept
from a score of KEEP on: for an ssn only a word nearby reaches it. Matches of a kind never overlap; those that fail
their check are dropped without another try.

Null and empty texts have no spans. Each row is judged alone, so repeated rows give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.llm.spans import count_of, digest, with_matches

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4
WINDOW = 48
KEEP = 0.5
#: The patterns of the kinds.
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
]
#: Score without and with a word nearby, and the words.
SCORES = [(0.9, 1.0), (0.6, 0.9), (0.8, 1.0), (0.6, 0.9), (0.8, 1.0), (0.3, 0.8)]
NEARBY = [
    r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    r"(?i)\b(?:ip|address|host|server|login)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|payment)\b",
    r"(?i)\b(?:phone|tel|telephone|call|mobile|fax)\b",
    r"(?i)\b(?:iban|account|bank|transfer)\b",
    r"(?i)\b(?:ssn|social|security)\b",
]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Remainder of an account number: first four characters last, letters as 10 to 35, digit by digit."""
    plain = F.regexp_replace(value, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    numbers = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(numbers, F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97)


def confirmed(kind: int, value: Column) -> Column:
    size = F.length(digits(value))
    return {
        0: F.lit(True),
        1: value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        2: size.between(13, 19) & F.call_function("luhn_check", digits(value)),
        3: size.between(9, 15),
        4: mod97(value) == 1,
        5: ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$"),
    }[kind]


def near(text: Column, span: Column, pattern: str) -> Column:
    """Whether pattern is found in what stands before or after a span of text."""
    start = F.greatest(span["start"] - WINDOW, F.lit(0).cast("bigint"))
    before = F.substring(text, (start + 1).cast("int"), (span["start"] - start).cast("int"))
    return before.rlike(pattern) | F.substring(text, (span["end"] + 1).cast("int"), F.lit(WINDOW)).rlike(pattern)


def find_pii(documents: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """documents with name: array of (kind, start, end, value, score), kind by its place in KINDS, in code points, end exclusive.

    A column of documents with that name stays as well, name stands last.
    """
    has = [F.contains("own_text", F.lit("@")), F.contains("own_text", F.lit(".")), None, F.contains("own_text", F.lit("+")), None, F.contains("own_text", F.lit("-"))]
    columns = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_given"))
    df = with_matches(rows, F.col("_given")[text], list(zip(PATTERNS, has, strict=True)), "matches")

    def kept(kind: int) -> Column:
        low, high = SCORES[kind]
        sure = F.filter(F.get(F.col("matches"), F.lit(kind)), lambda s: confirmed(kind, s["value"]))
        scored = F.transform(sure, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.when(near(F.col("_given")[text], s, NEARBY[kind]), F.lit(high)).otherwise(F.lit(low)).alias("score")))
        return scored if kind < BASE else F.filter(scored, lambda s: s["score"] >= KEEP)

    return df.select(*[F.col("_given")[c].alias(c) for c in columns], F.concat(*[kept(k) for k in range(len(KINDS))]).alias(name))


def pii_report(documents: DataFrame) -> DataFrame:
    """Counts, digests and scores (in the order of spans) of find_pii for each document."""
    df = find_pii(documents.select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"] < BASE)
    counts = [count_of(F.col("pii"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)]
    placed = F.array_sort(F.transform("pii", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["score"].alias("score"))))
    scores = F.array_join(F.transform(placed, lambda s: s["score"].cast("string")), ",")
    return df.select("doc_id", *counts, F.sha2(digest(base, KINDS, False), 256).alias("base_sha256"), digest(F.col("pii"), KINDS, False).alias("spans"), scores.alias("scores"))
