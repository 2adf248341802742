import hashlib
import re

from placespark.llm import pii


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


CASES = [
    "write to a.b+c@ex-am.ple.org, a@b.c_d@e.f or x@y (no)", "IPs 1.2.3.4.5.6.7.8 and 256.1.1.1, 000255.0.0.1 10.0.0.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112; 5500005555555559 12", "call +1 (212) 555-0100, +44.20.7946.0018 or +1 2", "DE89 3704 0044 0532 0130 00 and DE88370400440532013000",
    "ssn 123-45-6789; 123-45-6789 alone far away from any such word " + "." * 60 + " 078-05-1120", "🙂 é a@b.co 🙂 1.1.1.1", "@.+0 -", "a" * 3000 + "@", "1" * 3000 + "." + "2" * 3000, "+" + "1 " * 2000 + "x", "+1" * 3000,
]


def test_base_equals_python(spark, sf):
    texts = CASES + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        want = base_spans(texts[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(want))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert r.spans.startswith(listed)


def test_added_kinds_and_scores(spark):
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string")).collect()
    found = {r.doc_id: [(pii.KINDS[s.kind], r.text[s.start : s.end], s.score) for s in r.pii] for r in rows}
    assert ("iban", "DE89 3704 0044 0532 0130 00", 0.8) in found[4] and not any("DE88" in v for _, v, _ in found[4])
    assert [v for k, v, _ in found[5] if k == "ssn"][:1] == ["123-45-6789"] and "078-05-1120" not in [v for _, v, _ in found[5]]
    assert ("card", "4111 1111 1111 1111", 1.0) in found[2]


def test_many_matches_in_one_text(spark):
    text = "a@b.c " * 3000
    (r,) = pii.pii_report(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert r.n_email == 3000 and r.spans.endswith(f"email:{6 * 2999}:{6 * 2999 + 5}")


def test_edges(spark, edges, nothing):
    found = pii.find_pii(edges)
    assert found.columns == [*edges.columns, "pii"] and all(not r.pii for r in found.collect())
    assert pii.pii_report(edges).count() == edges.count() and pii.pii_report(nothing).count() == 0


def test_no_python_in_the_plan(spark, edges):
    plan = pii.pii_report(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_on_both_sides_and_beyond_other_matches(spark):
    texts = ["ssn 123-45-6789; 234-56-7890, 345-67-8901", "123-45-6789 is my social security number", "🙂🙂 345-67-8901 (SSN)", "123-45-6789 " + "." * 60 + " ssn"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    found = {r.doc_id: [r.text[s.start : s.end] for s in r.pii if pii.KINDS[s.kind] == "ssn"] for r in rows}
    assert found == {0: ["123-45-6789", "234-56-7890", "345-67-8901"], 1: ["123-45-6789"], 2: ["345-67-8901"], 3: []}


def test_own_column_of_the_name_stays(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", "mine")], "doc_id bigint, text string, pii string")
    out = pii.find_pii(df)
    assert out.columns == ["doc_id", "text", "pii", "pii"] and out.first()[2] == "mine" and len(out.first()[3]) == 1
    r = pii.pii_report(spark.createDataFrame([(1, "ssn 123-45-6789 and 4111 1111 1111 1111", "x")], "doc_id bigint, text string, pii string")).first()
    assert (r.spans, r.scores) == ("card:20:39,ssn:4:15", "0.8,0.8")
