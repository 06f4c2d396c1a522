"""WARC archives as a Spark data source: written with deduplicated payloads, read with pushed-down predicates.

``df.write.format("warc").save(path)`` writes records; every task rolls files of ``roll_bytes`` and
only files of committed tasks are listed in the manifest, so a retried or lost task leaves nothing
behind that a reader sees. ``spark.read.format("warc").load(path)`` plans partitions from the file
sizes of the manifest, takes equality predicates on the record type and on headers, reads headers
first, and passes over the payload of a record (without reading or decompressing it) when a
predicate fails or when the option ``payload`` is ``false``. The payload is a gzip-encoded HTTP
body, so that archives are small and still seekable.

Scale: writing and reading are narrow; choosing what is a revisit shuffles page ids and digests
only, and the minimum per digest is combined before the shuffle, so a hot payload costs little.

Cases: null html is the empty payload; null urls give records without a target; a page without id
counts after all others and is a revisit if its payload has a response with an id; pages that
repeat the smallest id of their payload are all responses; empty tables give empty archives; other
columns are ignored; line ends in urls are escaped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from helixmill.session import materialize, shared_folder

READ = (
    "path string, offset long, record_type string, page_id long, target_uri string, payload_digest string, "
    "payload_length long, refers_to long, payload binary, digest_ok boolean"
)
WRITE = "page_id long, url string, html string, refers_to long"
MANIFEST = "_manifest.json"
AHEAD = 1 << 20
ROLL_BYTES, SPLIT_BYTES = 128 << 20, 64 << 20
PAGE = re.compile(r"<urn:page:(-?\d+)>")


def storage(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its gzip-encoded body, or a revisit with HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\n\r\n"
    block = http if refers_to is not None else http + gzip.compress(payload, 1, mtime=0)
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.roll = options["path"], int(options.get("roll_bytes", ROLL_BYTES))

    def write(self, rows: Iterator) -> Written:
        system, folder = storage(self.path)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for row in rows:
            if out is None:
                files.append([f"{uuid.uuid4().hex}.warc", 0])
                out, size = system.open_output_stream(f"{folder}/{files[-1][0]}"), 0
            data = record_bytes(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"])
            out.write(data)
            size += len(data)
            files[-1][1] = size
            if size >= self.roll:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, folder = storage(self.path)
        system.create_dir(folder, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        system, folder = storage(self.path)
        for message in messages:
            for name, _ in message.files if message is not None else ():
                system.delete_file(f"{folder}/{name}")


class ReadAhead:
    """A file read forward with read-ahead; positions that are skipped over are never read."""

    def __init__(self, file):
        self.file, self.base, self.data = file, 0, b""

    def at(self, start: int, size: int) -> bytes:
        if start < self.base or start + size > self.base + len(self.data):
            self.file.seek(start)
            self.base, self.data = start, self.file.read(max(size, AHEAD))
        return self.data[start - self.base : start - self.base + size]


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def body_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    encoding = headers_of(head).get("content-encoding", "")
    return zlib.decompress(body, 31) if encoding == "gzip" and body else body


def records(file, wanted, payload: bool) -> Iterator[tuple]:
    """Records whose headers pass ``wanted``; the payload of others is passed over."""
    view, start = ReadAhead(file), 0
    while True:
        size = 1024
        head = view.at(start, size)
        while b"\r\n\r\n" not in head and len(head) == size:
            size *= 2
            head = view.at(start, size)
        end = head.find(b"\r\n\r\n")
        if end < 0:
            if head.strip():
                raise ValueError(f"record at {start} has no end of headers")
            return
        found = headers_of(head[:end])
        length, begin = int(found.get("content-length", 0)), start + end + 4

        def page(name):
            hit = PAGE.fullmatch(found.get(name, ""))
            return int(hit[1]) if hit else None

        digest = found.get("warc-payload-digest", "").removeprefix("sha1:") or None
        known = found.get("x-payload-length")
        row = {
            "offset": start, "record_type": found.get("warc-type"), "page_id": page("warc-record-id"),
            "target_uri": found.get("warc-target-uri"), "payload_digest": digest,
            "payload_length": int(known) if known is not None else None, "refers_to": page("warc-refers-to"),
            "payload": None, "digest_ok": None,
        }
        if wanted(row):
            if payload and row["record_type"] == "response":
                row["payload"] = body_of(view.at(begin, length))
                row["digest_ok"] = digest is None or sha1_base32(row["payload"]) == digest
            yield row
        start = begin + length + 4


@dataclass
class Files(InputPartition):
    files: list


class WarcReader(DataSourceReader):
    HEADERS = ("record_type", "page_id", "target_uri", "payload_digest", "refers_to")

    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.split, self.equal = int(options.get("split_bytes", SPLIT_BYTES)), {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                held = self.equal.get(f.attribute[0])
                self.equal[f.attribute[0]] = values if held is None else held & values
            else:
                yield f

    def partitions(self):
        system, folder = storage(self.path)
        with system.open_input_file(f"{folder}/{MANIFEST}") as file:
            listed = json.loads(file.read())
        parts, size = [[]], 0
        for name, length in listed:
            if size and size + length > self.split:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += length
        return [Files(p) for p in parts]

    def read(self, partition):
        system, folder = storage(self.path)
        schema = pa.schema([
            ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
            ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()),
            ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()),
        ])

        def wanted(row):
            return all(row[name] in values for name, values in self.equal.items())

        for name in partition.files:
            held, size = [], 0
            with system.open_input_file(f"{folder}/{name}") as raw:
                file = gzip.GzipFile(fileobj=io.BufferedReader(raw)) if name.endswith(".gz") else raw
                for row in records(file, wanted, self.payload):
                    held.append(row | {"path": name})
                    size += 200 + len(row["payload"] or b"")
                    if size >= 4 << 20 or len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the page whose equal payload came first, null for responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    ids = materialize(rows.where(F.octet_length("html") >= least_bytes).select("page_id", F.sha1("html").alias("_digest")))
    firsts = ids.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = ids.join(firsts, "_digest").where("page_id > refers_to or page_id is null and refers_to is not null")
    later = materialize(later.select(F.col("page_id").alias("_page"), F.col("_digest").alias("_same"), "refers_to").distinct())
    match = F.col("page_id").eqNullSafe(F.col("_page")) & (F.sha1("html") == F.col("_same"))
    return rows.join(later, match, "left").select("page_id", "url", "html", "refers_to")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    with_revisits(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op7_warc(spark, sf):
    """Contract query: all pages written as records and read back, payloads of responses checked."""
    folder = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf}/pages.parquet"), path)
    found = read_warc(spark, path)
    digest = F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload differs from its digest")))
    return found.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        "refers_to",
    )
