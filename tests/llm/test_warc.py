import gzip
import hashlib
import tempfile
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from placespark.llm import queries, warc

PAGE = "page_id bigint, url string, html string, digest string, n int, kind string, `range` int"


def page(i, url, html):
    return (i, url, html, "d", 1, None, 0)


def folder():
    return f"{tempfile.mkdtemp(prefix='spark-')}/archives"


def brute(rows):
    """Digest columns by the rule; of equal first rows one is the response."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    first, out, taken = {}, [], set()
    for r in rows:
        raw = (r[2] or "").encode()
        if len(raw) >= 100 and (raw not in first or order(r) < order(first[raw])):
            first[raw] = r
    for r in rows:
        raw = (r[2] or "").encode()
        own = first.get(raw)
        response = own is None or (order(own) == order(r) and raw not in taken)
        if own is not None and response:
            taken.add(raw)
        out.append((r[0], len(raw), hashlib.sha256(raw).hexdigest(), "response" if response else "revisit", None if response else own[0]))
    return Counter(out)


def report(spark, rows, **options):
    at = folder()
    warc.write_archives(spark.createDataFrame(rows, PAGE), at, **options)
    got = warc.read_archives(spark, at).drop("uri", "record_id")
    return at, got.collect()


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    found = c.execute(queries.OP12_SQL)
    names = [d[0] for d in found.description]
    assert sorted(tuple(r) for r in queries.op12_warc(spark, sf).select(names).collect()) == sorted(found.fetchall())


ROWS = (
    [page(i, f"u{i}", "copied text " * 20) for i in range(40, 10, -1)] + [page(5, "b", "x" * 100), page(5, "a", "x" * 100), page(5, "a", "x" * 100), page(4, "z", "x" * 99), page(3, "z", "x" * 99)]
    + [page(7, "same", "equal rows " * 30)] * 25 + [page(8, "s", "short")] * 30 + [page(None, None, "null id " * 30), page(None, "n", "null id " * 30), page(9, None, None), page(10, "", ""), page(None, None, None)]
    + [page(100 + i, f"http://a.b/ü {i}\r\nX: 1", f"Seite {i} é🙂 " * (i + 1)) for i in range(60)] + [page(200, "long", "long " * 200_000)]
)


def test_records_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 10)
    at, got = report(spark, ROWS, roll=2_000, range_bytes=3_000)
    assert Counter(tuple(r)[:5] for r in got) == brute(ROWS)
    want = Counter((r[0], (r[2] or "").encode()) for r in ROWS)
    assert all(want[(r.page_id, bytes(r.payload))] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert not Path(at, "_temporary").exists()
    files = sorted(Path(at).glob("*.warc.gz"))
    assert len(files) > 8 and {f.name for f in files} == {r.file for r in spark.read.parquet(f"{at}/manifest").collect()}


def test_records_are_in_order_and_whole_archives_are_gzip(spark):
    at, _ = report(spark, ROWS, roll=4_000, range_bytes=3_000)
    ids = []
    for f in sorted(Path(at).glob("*.warc.gz")):
        text = gzip.decompress(f.read_bytes()).decode()
        assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo")
        ids += [x.split("\r\n")[0] for x in text.split("X-Page-Id: ")[1:]]
    own = [int(i) for i in ids if i.isdigit()]
    assert own == sorted(own) and len(ids) == len(ROWS)


def test_equal_pages_give_equal_files(spark):
    made = []
    for n in (1, 7):
        at = folder()
        warc.write_archives(spark.createDataFrame(ROWS, PAGE).repartition(n), at, roll=4_000, range_bytes=3_000)
        made.append({f.name: f.read_bytes() for f in Path(at).glob("*.warc.gz")})
    assert made[0] == made[1]


def test_commit_can_be_repeated_and_lost_tasks_leave_nothing_behind(spark):
    at = folder()
    lost = warc.Roll(at, 0, 100)
    lost.put(warc.page_record(1, "u", hashlib.sha256(b"x").hexdigest(), 0, 1, b"x", None))
    lost.close()
    rows = spark.createDataFrame(lost.done, warc.FILES)
    for _ in range(2):
        assert rows.mapInArrow(warc._committer(at), "file string, records bigint, bytes bigint, sha256 string").count() == 1
    warc.write_archives(spark.createDataFrame(ROWS, PAGE), at)
    assert warc.read_archives(spark, at).count() == len(ROWS)
    with pytest.raises(FileExistsError):
        warc.write_archives(spark.createDataFrame(ROWS, PAGE), at)


def test_damage_is_found(spark):
    at, _ = report(spark, ROWS[:3])
    name = next(Path(at).glob("*.warc.gz"))
    text = gzip.decompress(name.read_bytes())
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(text[text.index(b"WARC/1.1", 10) :].split(b"\r\n\r\nWARC/1.1")[0].replace(b"copied", b"copies") + b"\r\n\r\n")
    name.write_bytes(name.read_bytes()[:-20])
    with pytest.raises(Exception, match="cut off|damaged|incorrect|incomplete"):
        warc.read_archives(spark, at).collect()


def test_string_ids_and_no_pages(spark):
    rows = spark.createDataFrame(ROWS, PAGE).select(F.concat(F.lit("p\n"), "page_id").alias("page_id"), "url", "html")
    assert sorted(r.page_id for r in warc.archive_report(rows).where("page_id IS NOT NULL").collect()) == sorted(f"p\n{r[0]}" for r in ROWS if r[0] is not None)
    assert warc.archive_report(spark.createDataFrame([], PAGE)).count() == 0


def test_a_frequent_payload_travels_once(spark):
    rows = spark.createDataFrame(ROWS, PAGE).select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    _, payloads = warc.records(rows)
    assert payloads.where("url = 'same'").count() == 1 and payloads.where("page_id BETWEEN 11 AND 40").count() == 1
