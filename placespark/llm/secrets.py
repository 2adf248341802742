"""Secrets: three patterns, and a battery of randomness tests for everything that looks like an encoded key. Built-in functions only.

Patterns: assign (a telling name, = or :, and a value of 12 or more characters), access (AKIA, 18 or more), hex (16 or
more). Besides them, runs of 20 or more encoding characters are candidates. The smallest alphabet that holds a candidate's
characters is its encoding, and its characters become numbers there. Three tests: chi-squared of the counts against a
uniform alphabet, Wald and Wolfowitz's runs above and below the middle, and the serial correlation of neighbours. Each
gives a p-value of "this is no random key". Written text repeats letters, so its chi-squared is about df + n * EXCESS
with n characters, and random keys lie far below that. The other two are tests of equivalence: of "this departs from
randomness by MARGIN standard errors or more", which a |z| far below MARGIN rejects. A key has to reject all three, so the
greatest of the p-values is that of the battery (intersection-union). Longer candidates tell more, so they are split by
length, and in each class Benjamini and Hochberg's rule at level RATE, on counts of these p-values in fixed bins over the
whole table, sets the limit: at most so many of its finds are expected to be false.

Null and empty texts have no spans. Rows are judged one by one but for the limits, which depend on the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.llm.spans import count_of, digest, masked, total, with_matches
from placespark.llm.tables import written

KINDS = ["assign", "access", "hex", "random"]
BASE = 3
#: The patterns of the kinds.
PATTERNS = [
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    r"AKIA[A-Z0-9]{14,}+",
    r"[0-9a-f]{16,}+",
    r"[A-Za-z0-9+/_-]{20,}+={0,2}",
]
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Encodings, smallest first, and by how much a character of written text raises chi-squared.
ALPHABETS = [
    ("hexadecimal", "0123456789abcdef", 0.8),
    ("hexadecimal", "0123456789ABCDEF", 0.8),
    ("letters", "abcdefghijklmnopqrstuvwxyz", 0.7),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.7),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", 1.3),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.3),
    ("mixed letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 2.3),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.0),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 3.2),
]
#: Standard errors by which runs and serial correlation of what is no key depart from randomness.
MARGIN = 6.5
RATE = 0.01
LENGTHS = [20, 24, 32, 40, 48, 64]
BINS = 400
PER_DECADE = 20


def _test_columns(value: Column) -> Column:
    """(plain, encoding, n) of one candidate."""
    plain = F.regexp_replace(value, "=", "")
    encoding = F.coalesce(*[F.when(F.translate(plain, a, "") == "", F.struct(F.lit(a).alias("alphabet"), F.lit(float(len(a))).alias("size"), F.lit(e).alias("excess"))) for _, a, e in ALPHABETS])
    return F.struct(plain.alias("plain"), encoding.alias("encoding"), F.length(plain).cast("double").alias("n"))


def _statistics(s: Column) -> Column:
    n, size = s["n"], s["encoding"]["size"]
    chars = F.split(s["plain"], "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s["plain"], c, F.lit(""))), F.lit(2.0)))
    numbers = F.transform(chars, lambda c: F.instr(s["encoding"]["alphabet"], c).cast("double") - 0.5 - size / 2)
    return F.struct(n.alias("n"), (size - 1).alias("df"), s["encoding"]["excess"].alias("excess"), (size / n * squares - n).alias("chi"), numbers.alias("x"))


def _z_values(s: Column) -> Column:
    """z of chi-squared under written text, of the runs and of the serial correlation under randomness."""
    n, df, x = s["n"], s["df"], s["x"]
    more = n * s["excess"]
    z_text = (s["chi"] - df - more) / F.sqrt(2 * (df + 2 * more))
    above = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.when(v > 0, 1.0).otherwise(0.0))
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct((a * b).alias("product"), F.when((a > 0) != (b > 0), 1.0).otherwise(0.0).alias("change")))
    runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["change"])
    mean = 2 * above * (n - above) / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    energy = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    serial = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["product"]) / energy * F.sqrt(n)
    return F.struct(z_text.alias("z_text"), ((runs - mean) / spread).alias("z_runs"), serial.alias("z_serial"), n.alias("n"))


def _judged(z: Column) -> Column:
    """The battery's p-value: upper bound of its log10 by the normal tail, in whole bins, with the length class."""
    worst = F.greatest(z["z_text"], F.abs(z["z_runs"]) - MARGIN, F.abs(z["z_serial"]) - MARGIN)
    low = F.least(worst, F.lit(0.0))
    # log10 of a normal tail by Borjesson and Sundberg's bound, right at 0
    log_p = (-low * low / 2 - F.log(-low * 0.661 + 0.339 * F.sqrt(low * low + 5.51)) - 0.9189385332046727) / 2.302585092994046
    p_bin = F.when(worst >= 0, F.lit(0)).otherwise(F.least(F.floor(-log_p * PER_DECADE), F.lit(BINS - 1))).cast("int")
    length = sum((F.when(z["n"] >= x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    return F.struct(length.alias("length"), p_bin.alias("p_bin"))


def _limits(counts: DataFrame) -> list[tuple[int, int]]:
    """Benjamini and Hochberg: (length class, least bin that is found); at most one row for each length class."""
    upto = Window.partitionBy("length").orderBy(F.desc("p_bin"))
    rows = counts.groupBy("length", "p_bin").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("found", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("length")))
    ok = rows.where(F.pow(F.lit(10.0), -F.col("p_bin") / PER_DECADE) <= RATE * F.col("found") / F.col("all"))
    return [(r[0], r[1]) for r in ok.groupBy("length").agg(F.min("p_bin")).collect()]


def find_secrets(documents: DataFrame, text: str = "text", name: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """documents (or its columns keep) with name: array of (kind, start, end), kind by its place in KINDS, in code points, end exclusive.

    An own column of that name stays, before it. The texts are searched once: the spans are written beside the documents' columns, the limits counted from that table.
    """
    can = [None, F.contains("own_text", F.lit("AKIA")), None, None]
    own = documents.columns if keep is None else keep
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(text).alias("text"))
    df = with_matches(rows, F.col("text"), list(zip(PATTERNS, can, strict=True)), "spans")

    def place(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    assign = F.filter(F.get("spans", F.lit(0)), lambda s: F.length(F.regexp_replace(s["value"], _VALUE, "")) >= 12)
    base = F.concat(place(assign), place(F.get("spans", F.lit(1))), place(F.get("spans", F.lit(2))))
    asked = F.filter(F.transform(F.get("spans", F.lit(3)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _test_columns(s["value"]).alias("t"))), lambda s: s["t"]["encoding"].isNotNull() & (s["t"]["n"] >= LENGTHS[0]))
    df = df.select("row", base.alias("base"), asked.alias("asked"))
    df = df.withColumn("asked", F.transform("asked", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _statistics(s["t"]).alias("t"))))
    df = df.withColumn("asked", F.transform("asked", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _z_values(s["t"]).alias("t"))))
    df = written(df.withColumn("asked", F.transform("asked", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _judged(s["t"]).alias("t")))))
    bins = df.select(F.explode("asked").alias("s")).groupBy(F.col("s.t.length").alias("length"), F.col("s.t.p_bin").alias("p_bin")).agg(F.count("*").alias("n"))
    limits = _limits(bins)

    def is_found(t: Column) -> Column:
        ok = F.lit(False)
        for length, least in limits:
            ok = ok | ((t["length"] == length) & (t["p_bin"] >= least))
        return ok

    more = F.transform(F.filter("asked", lambda s: is_found(s["t"])), lambda s: F.struct(F.lit(BASE).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.select(*[F.col("row")[c].alias(c) for c in own], F.concat("base", more).alias(name))


def secrets_report(documents: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets for each document."""
    found = find_secrets(documents.select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] < BASE)
    counts = [count_of(F.col("secrets"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(digest(base, KINDS, True), 256).alias("base_sha256"), digest(F.col("secrets"), KINDS, True).alias("spans"))


def mask_secrets(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with every secret in text replaced by mark, and n_chars counted again where it is a column."""
    found = find_secrets(documents.select(F.struct("*").alias("doc")), "doc.text")
    text = F.when(F.size("secrets") > 0, masked(F.col("doc.text"), F.col("secrets"), mark)).otherwise(F.col("doc.text"))
    out = found.select("doc", text.alias("new_text"))
    fresh = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(documents.schema["n_chars"].dataType) if "n_chars" in documents.columns else None}
    return out.select(*[(fresh[c] if c in fresh else F.col("doc")[c]).alias(c) for c in documents.columns])
