import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from placespark.llm import secrets


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16])


rng = random.Random(9)
KEY = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(48))
CASES = [
    'PassWord = "abc.def-ghi_jkl" token=secret:abcdefghijklmnop passwd=short', "AKIAAKIA12345678901 AKIA1234567890123 AKIA" + "X" * 14, "deadbeefdeadbeef 0123456789abcdef0 abc face",
    f"key {KEY} here", "the thing andthethingandthenagainthething is words", "🙂 secret:🙂 secret='aaaaaaaaaaaaaa'", "api_key:" + " " * 3000 + "x", "apikey==" + "a=" * 2000, "f" * 5000, "", None,
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string")


def test_base_equals_python(spark, sf):
    texts = CASES + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for r in secrets.secrets_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        want = base_spans(texts[r.doc_id])
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_random_keys_are_found_and_words_are_not(spark):
    words = ["thentionoringesandherthewhationing", "internationalisationofthethings", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabcabcabcabc12"]
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in (string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/") for n in (32, 40, 64)]
    rows = [(i, f"see {t} there") for i, t in enumerate(keys + words)]
    found = {r.doc_id: [s for s in r.secrets if s.kind == 3] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(bool(found[i]) for i in range(len(keys))) >= len(keys) - 1
    assert not any(found[i] for i in range(len(keys), len(rows)))


def test_mask(spark, edges):
    out = secrets.mask_secrets(frame(spark).withColumn("n_chars", F.length("text")))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].text == "key [SECRET] here" and rows[2].text == "[SECRET] [SECRET] abc face" and rows[4].text == CASES[4]
    assert rows[9].text == "" and rows[10].text is None and rows[3].n_chars == 17
    masked = secrets.mask_secrets(edges)
    assert masked.columns == edges.columns and masked.count() == edges.count()


def test_edges(spark, edges, nothing):
    assert secrets.secrets_report(edges).count() == edges.count() and secrets.secrets_report(nothing).count() == 0
    assert secrets.find_secrets(edges).columns == [*edges.columns, "secrets"]


def test_no_python_in_the_plan(spark, edges):
    plan = secrets.secrets_report(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_false_discoveries_stay_below_their_rate(spark):
    """Keys of three encodings among four thousand long tokens of written text: few of what is found is no key; nearly all keys of base62 are found, and of base32 the long ones."""
    own = random.Random(8)
    syllables = ["the", "and", "ing", "tion", "her", "wor", "ld", "of", "in", "es", "at", "on", "Re", "St"]
    written = ["".join(own.choice(syllables) for _ in range(own.randrange(8, 20))) for _ in range(4000)]
    keys = ["".join(own.choice(a) for _ in range(own.randrange(28, 60))) for a in (string.ascii_letters + string.digits, string.ascii_uppercase + "234567") for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(written + keys)), "doc_id bigint, text string")
    found = {r.doc_id for r in secrets.find_secrets(rows).collect() if any(s.kind == 3 for s in r.secrets)}
    false = sum(i < len(written) for i in found)
    assert false <= 0.02 * len(found)
    base62, base32 = (sum(len(written) + lo <= i < len(written) + lo + 300 for i in found) for lo in (0, 300))
    assert base62 >= 0.95 * 300 and base32 >= 0.4 * 300


def test_orderly_characters_are_no_keys(spark):
    """Each character of the alphabet once, in order: counts are uniform, runs and neighbours are not."""
    rows = [(0, string.ascii_letters + string.digits), (1, "ab" * 30), (2, (string.digits + "abcdef") * 4)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert not [r for r in found if r.doc_id < 2 and any(s.kind == 3 for s in r.secrets)]


def test_a_column_of_the_results_name_stays(spark):
    got = secrets.find_secrets(frame(spark).withColumn("secrets", F.lit("own")).withColumn("spans", F.lit(1)))
    assert got.columns == ["doc_id", "text", "secrets", "spans", "secrets"] and got.count() == len(CASES)
