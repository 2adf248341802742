"""WARC archives of pages: sorted, cut into files by their compressed size, committed by a manifest, and read back.

Every row of pages becomes a record. Of rows with equal payloads of `least` bytes or more the one of the smallest page id (then url) is a
response; the others are revisits that name it and carry no payload. Shorter payloads are responses each.

What a record says is known before payloads move: rows are counted by (page id, url, digest), and each digest's first row is joined to them.
Digests of a thousandth of all rows or more, of which there are a thousand at most, are broadcast; the others are joined by digest. Payloads
that no record needs stay where they are, for those frequent digests. Records and payloads then meet by sorting both into the same ranges.

Ranges are cut by the sizes of records whose hashes are drawn, so that equal pages give equal files, however Spark deals them out. A range is
a task: it writes gzip members, one for each record, and begins a new file when `roll` compressed bytes are reached. Ranges hold
`range_bytes` each, or more where that would give over RANGES of them. Headers, lengths and digests are made anew from what is written.

A task writes under a temporary name of its own. Only the rows of tasks that Spark counts as done name files; these files are renamed,
which can be repeated, and the manifest is written last. Readers take the files of the manifest and nothing else.

Null payloads are empty; null urls are named after the page id; null page ids come after all others, and records of them say null. Rows equal
in id, url and payload are so many records, of which one can be the response. No pages: no files, and no rows. Extra columns are not archived.
The folder is reached by pyarrow's file systems (local or shared folders, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placespark.llm.tables import shared_folder, written

LEAST = 100
ROLL = 256 << 20
RANGE_BYTES, RANGES, DRAWN = 8 << 20, 1 << 14, 16
#: Records of equal rows are made so many at a time, and a record without payload counts as so many bytes.
RUN, HEAD = 10_000, 512
#: A digest of one row in so many is frequent.
FREQUENT = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ["page_id", "url", "digest", "from"]
FILES = "file string, temporary string, records bigint, bytes bigint, sha256 string"
_CHUNK = 1 << 20


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a folder, and the folder's path in it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = f"file://{folder[5:]}"
    return fs.FileSystem.from_uri(folder)


def _first(page_id: Column, url: Column) -> Column:
    """Orders rows; nulls last."""
    return F.struct(page_id.isNull().alias("no_id"), page_id.alias("page_id"), url.isNull().alias("no_url"), url.alias("url"))


def records(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Of pages (page_id, url, payload): records (KEY, n, bytes, payload, kind, refers_id, refers_url), and what payloads they need (KEY, payload).

    A record's row stands for n equal rows from the one numbered `from` on. kind is response, or revisit; of the first rows of a shared
    digest the one numbered 0 is a response. Payloads shorter than least are in the records.
    """
    read = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    read = read.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"))
    small = F.when(F.col("bytes") < least, F.col("payload"))
    rows = written(read.groupBy("page_id", "url", "digest", "bytes", small.alias("payload")).agg(F.count("*").alias("n")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    shared = written(rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(_first(F.col("page_id"), F.col("url"))).alias("first"), F.sum("n").alias("copies")).where("copies > 1"))
    frequent = F.broadcast(shared.where(F.col("copies") * FREQUENT >= total).select("digest", "first"))
    other = shared.where(F.col("copies") * FREQUENT < total).select("digest", "first")
    large = rows.where(F.col("bytes") >= least)
    alone = rows.where(F.col("bytes") < least).withColumn("first", F.lit(None).cast(shared.schema["first"].dataType))
    joined = large.join(frequent, "digest").unionByName(large.join(frequent, "digest", "left_anti").join(other, "digest", "left")).unionByName(alone)
    is_first = F.col("first").isNull() | ((F.col("first.page_id").eqNullSafe(F.col("page_id"))) & (F.col("first.url").eqNullSafe(F.col("url"))))
    joined = joined.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint"))))
    out = joined.select(
        *KEY, F.least(F.lit(RUN).cast("bigint"), F.col("n") - F.col("from")).alias("n"), "bytes", "payload", F.when(is_first, "response").otherwise("revisit").alias("kind"),
        F.col("first.page_id").alias("refers_id"), F.col("first.url").alias("refers_url"), F.col("first").isNotNull().alias("shared"),
    )
    needed = read.where(F.col("bytes") >= least)
    hot = needed.join(frequent, "digest").where((F.col("first.page_id").eqNullSafe(F.col("page_id"))) & (F.col("first.url").eqNullSafe(F.col("url"))))
    hot = hot.groupBy("page_id", "url", "digest").agg(F.first("payload").alias("payload"))
    cold = needed.join(frequent, "digest", "left_anti").select("page_id", "url", "digest", "payload")
    return out, cold.unionByName(hot).withColumn("from", F.lit(0).cast("bigint"))


def _key(page_id: object, url: str | None, digest: str, start: int) -> tuple:
    """As Spark sorts: nulls first."""
    none = lambda x, empty: (x is not None, empty if x is None else x)
    return (*none(page_id, 0), *none(url, ""), digest, start)


def range_bounds(out: DataFrame, range_bytes: int) -> list[tuple]:
    """Keys that cut the records into ranges of about equal bytes: by the sizes of drawn records, at most 16 or so for each range."""
    size = F.when((F.col("kind") == "response") & ((F.col("from") == 0) | ~F.col("shared")), F.col("bytes")).otherwise(0) + F.lit(HEAD) * F.col("n")
    total, n = out.agg(F.sum(size), F.count("*")).first()
    ranges = min(RANGES, -(-(total or 0) // range_bytes))
    if ranges < 2:
        return []
    drawn = F.pmod(F.xxhash64(*KEY), F.lit(max(1, n // (DRAWN * ranges)))) == 0
    found = sorted((_key(*r[:4]), r[4]) for r in out.where(drawn).select(*KEY, size).collect())
    step, sum_, cuts = sum(s for _, s in found) / ranges, 0, []
    for key, own in found:
        if sum_ >= step * (len(cuts) + 1):
            cuts.append(key)
        sum_ += own
    return cuts


def _uri(url: str | None, page_id: object) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{quote(json.dumps(page_id))}"


def _record_id(page_id: object, url: str | None, digest: str, number: int) -> str:
    name = hashlib.sha256(json.dumps([page_id, url, digest, number]).encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name)}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: object, url: str | None, digest: str, number: int, size: int, payload: bytes | None, refers: tuple[object, str | None] | None) -> bytes:
    """A response with its payload, or a revisit of refers (page id and url) without."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if payload is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of page {page_id} isn't that of its record")
    headers = [("WARC-Record-ID", _record_id(page_id, url, digest, number)), ("WARC-Target-URI", _uri(url, page_id)), ("X-Page-Id", json.dumps(page_id)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(*refers, digest, 0)), ("WARC-Refers-To-Target-URI", _uri(refers[1], refers[0])), ("X-Refers-To-Page-Id", json.dumps(refers[0]))]
    return _record("response" if payload is not None else "revisit", headers, block + (payload or b""))


class Roll:
    """Files of one range under temporary names; a new one begins when the last has `roll` bytes."""

    def __init__(self, folder: str, number: int, roll: int) -> None:
        self.files, self.root = file_system(folder)
        self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}"
        self.number, self.roll, self.done, self.out = number, roll, [], None

    def put(self, record: bytes) -> None:
        if self.out is None:
            if not self.done:
                self.files.create_dir(self.temporary)
            self.name = f"pages-{self.number:05d}-{len(self.done):05d}.warc.gz"
            self.out, self.records, self.bytes, self.hash = self.files.open_output_stream(f"{self.temporary}/{self.name}", compression=None), 0, 0, hashlib.sha256()
            self._member(_record("warcinfo", [("WARC-Record-ID", _record_id(None, None, self.name, 0)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._member(record)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _member(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        for part in (packer.compress(record), packer.flush()):
            self.out.write(part)
            self.hash.update(part)
            self.bytes += len(part)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, f"{self.temporary}/{self.name}", self.records, self.bytes, self.hash.hexdigest()))
            self.out = None


def _writer(folder: str, roll: int):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number, waiting = None, None, None

        def put(row: dict, payload: bytes | None) -> None:
            response = row["kind"] == "response"
            refers = (row["refers_id"], row["refers_url"])
            for i in range(row["from"], row["from"] + row["n"]):
                first = response and (i == 0 or not row["shared"])
                if first and payload is None:
                    raise ValueError(f"no payload for page {row['page_id']}")
                out.put(page_record(row["page_id"], row["url"], row["digest"], i, row["bytes"], payload if first else None, refers))

        for batch in batches:
            for row in batch.to_pylist():
                key = [row[k] for k in KEY]
                if row["is_payload"]:
                    if waiting and [waiting[k] for k in KEY] == key:
                        put(waiting, row["payload"])
                        waiting = None
                    continue
                if waiting:
                    raise ValueError(f"no payload for page {waiting['page_id']}")
                if number != row["range"]:
                    if out:
                        out.close()
                        yield from _files(out)
                    number = row["range"]
                    out = Roll(folder, number, roll)
                if row["payload"] is None and row["kind"] == "response" and (row["from"] == 0 or not row["shared"]):
                    waiting = row
                else:
                    put(row, row["payload"])
        if waiting:
            raise ValueError(f"no payload for page {waiting['page_id']}")
        if out:
            out.close()
            yield from _files(out)

    return write


def _files(out: Roll) -> Iterator[pa.RecordBatch]:
    if out.done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done, strict=True)], names=[f.split()[0] for f in FILES.split(", ")])


def _committer(folder: str):  # noqa: ANN202
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if files.get_file_info(row["temporary"]).type == fs.FileType.File:
                    files.move(row["temporary"], f"{root}/{row['file']}")
                if files.get_file_info(f"{root}/{row['file']}").size != row["bytes"]:
                    raise ValueError(f"{row['file']} isn't whole")
            yield batch.drop_columns("temporary")

    return commit


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, roll: int = ROLL, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Archive pages in folder, which may not hold a manifest yet; gives the manifest (file, records, bytes, sha256)."""
    spark = pages.sparkSession
    files, root = file_system(folder)
    if files.get_file_info(f"{root}/manifest").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds archives")
    out, payloads = records(pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("binary").alias("payload")), least)
    out = written(out)
    bounds = spark.sparkContext.broadcast(range_bounds(out, range_bytes))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, urls: pa.Array, digests: pa.Array, starts: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds.value, _key(*k)) for k in zip(*[x.to_pylist() for x in (ids, urls, digests, starts)], strict=True)], pa.int32())

    both = out.withColumn("is_payload", F.lit(False)).unionByName(payloads.withColumn("is_payload", F.lit(True)), allowMissingColumns=True)
    dealt = both.withColumn("range", range_of(*KEY)).repartitionById(len(bounds.value) + 1, F.col("range")).sortWithinPartitions(*KEY, "is_payload")
    made = written(dealt.mapInArrow(_writer(folder, roll), FILES))
    manifest = T.StructType([f for f in T._parse_datatype_string(FILES) if f.name != "temporary"])
    made.mapInArrow(_committer(folder), manifest).write.parquet(f"{folder}/manifest")
    if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
        files.delete_dir(f"{root}/_temporary")
    return spark.read.schema(manifest).parquet(f"{folder}/manifest")


def members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one by one."""
    rest, unpack, parts = b"", None, []
    while rest or (rest := stream.read(_CHUNK)):
        unpack = unpack or zlib.decompressobj(31)
        parts.append(unpack.decompress(rest))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = None, []
    if parts:
        raise ValueError("the last record is cut off")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and block; what it says of the block must hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
    return headers, block


def _read(headers: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    response = headers["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    refers = json.loads(headers["X-Refers-To-Page-Id"]) if not response else None
    return {"page_id": json.loads(headers["X-Page-Id"]), "uri": headers["WARC-Target-URI"], "record_id": headers["WARC-Record-ID"], "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": refers, "payload": payload if response else None}


def read_archives(spark: SparkSession, folder: str, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """A row for each page record of the manifest's files: page_id, uri, record_id, payload_bytes, payload_digest, record_type, refers_to
    (the response's page id), payload (null for revisits). Lengths and digests are checked; a damaged record is an error."""
    schema = T._parse_datatype_string(f"page_id {id_type}, uri string, record_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}" + ", payload binary" * payloads)
    manifest = spark.read.parquet(f"{folder}/manifest")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        rows, size = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in members(stream):
                        headers, block = parsed(member)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_read(headers, block))
                        size += HEAD + len(block) * payloads
                        if size >= _CHUNK:
                            yield pa.RecordBatch.from_pylist([{n: r[n] for n in arrow.names} for r in rows], schema=arrow)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in arrow.names} for r in rows], schema=arrow)

    n = manifest.count()
    return manifest.select("file").repartition(max(1, min(n, RANGES)), "file").mapInArrow(read, schema)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write pages to the shared folder as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark, folder, pages.schema["page_id"].dataType.simpleString(), payloads=False)[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]]
