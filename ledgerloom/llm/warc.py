"""WARC archives as a Spark data source: spark.read.format("warc") and df.write.format("warc").

Reading. A partition is a run of whole files; large folders are planned by file size. Predicates on the record type and on other
header columns are pushed down. Of each record the headers are parsed first: of a compressed record only its first few KB are
inflated. Where the predicates fail, or no column needs the payload, the reader goes on to the next record without inflating
the rest; the 'sl' (skip length) field in the gzip header, which the writer sets, says where that is. Records of
other writers without it are inflated but not kept.

Writing. Each task writes files of its own name, one gzip member per record; a file ends at fileBytes. Only the driver's commit names
them in a manifest, so what a lost or repeated task left behind is never read. A folder without a manifest (other
writers' archives) is read by its *.warc and *.warc.gz files.

Paths go through pyarrow's file systems (file, hdfs, s3, gs), which the driver and executors must all reach.

Options: verify (read; payloads of records are checked against their digest, default false), partitionBytes (read), fileBytes and level
(write), date (write; for rows without one).

Columns for writing: record_type, record_id, target_uri, date, content_type, refers_to, payload_sha1, payload_length, payload; all
but record_type may be missing or null. A response or revisit has an HTTP header in its block, other types have just the payload.
A null payload is empty; a null record_id gets a random one. Control characters in header values are escaped by percent.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ledgerloom.llm.joins import BROADCAST_ROWS, SALTS
from ledgerloom.session import new_folder, saved

#: Names of the format.
VERSION = b"WARC/1.1"
TYPE, ID, DATE, URI, LENGTH, CONTENT = "WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length", "Content-Type"
DIGEST, REFERS, PROFILE = "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Profile"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
END = b"\r\n\r\n"
#: Header columns (these can be pushed down) and the header that each comes from.
HEADERS = {"record_type": TYPE, "record_id": ID, "target_uri": URI, "date": DATE, "content_type": CONTENT, "refers_to": REFERS, "payload_digest": DIGEST}
SCHEMA = (
    "file string, at long, record_type string, record_id string, target_uri string, date string, content_type string, refers_to string, "
    "payload_digest string, content_length long, headers map<string,string>, payload_length long, payload binary"
)
#: Records whose block starts with an HTTP header.
HTTP_TYPES = ("response", "revisit")
HEAD, READ = 4 << 10, 1 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096


# --- reading records ------------------------------------------------------------------------


class Window:
    """A file read in pieces, forward, with gaps."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> memoryview:
        """Up to n bytes from there on; fewer at the end of the file."""
        if at < self.start or at + n > self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(n, READ))
        return memoryview(self.data)[at - self.start : at - self.start + n]


class Member:
    """One record's bytes from a place on: inflated piece by piece, or plain."""

    def __init__(self, window: Window, at: int, packed: bool) -> None:
        self.window, self.at, self.packed, self.begin = window, at, packed, at
        self.inflate = zlib.decompressobj(31) if packed else None
        self.skip = skip_length(window.get(at, 24)) if packed else None

    def read(self, n: int) -> bytes:
        """The next n bytes of the record, or fewer where it ends."""
        if not self.packed:
            piece = bytes(self.window.get(self.at, n))
            self.at += len(piece)
            return piece
        out = []
        while n > 0 and not self.inflate.eof:
            source = self.inflate.unconsumed_tail or self._more()
            if not source:
                raise ValueError(f"a record at {self.begin} ends too early")
            piece = self.inflate.decompress(source, n)
            n -= len(piece)
            out.append(piece)
        return b"".join(out)

    def _more(self) -> bytes:
        rest = self.begin + self.skip - self.at if self.skip else READ // 16
        piece = bytes(self.window.get(self.at, min(HEAD if self.at == self.begin else READ, rest)))
        self.at += len(piece)
        return piece

    def end(self, left: int) -> int:
        """Where the next record starts; left: bytes of the record that were not read yet."""
        if not self.packed:
            return self.at + left
        if self.skip:
            return self.begin + self.skip
        while not self.inflate.eof:
            self.read(READ)
        return self.at - len(self.inflate.unused_data)


def skip_length(head: bytes | memoryview) -> int | None:
    """Compressed length of a gzip member that has the 'sl' field first in its extra fields."""
    head = bytes(head)
    if len(head) >= 24 and head[:2] == b"\x1f\x8b" and head[3] & 4 and head[12:16] == b"sl\x08\x00":
        return struct.unpack("<I", head[16:20])[0]
    return None


@dataclass
class Record:
    headers: dict[str, str]
    at: int
    payload_length: int | None = None
    payload: bytes | None = None


def parse_headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    pairs = (line.split(":", 1) for line in lines[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def until_blank_line(member: Member, limit: int) -> tuple[bytes, bytes]:
    """(head, what was read beyond it): up to the first empty line, or all of limit bytes."""
    have = b""
    while END not in have and len(have) < limit:
        more = member.read(min(HEAD, limit - len(have)))
        if not more:
            break
        have += more
    head, _, rest = have.partition(END)
    return (head, rest) if END in have else (have, b"")


def records(file: pa.NativeFile, packed: bool, wanted: Callable[[dict], bool], lengths: bool, payloads: Callable[[dict], bool]) -> Iterator[Record]:
    """The wanted records; their payload lengths and payloads only where asked for."""
    window, at = Window(file), 0
    while at < window.size:
        member = Member(window, at, packed)
        head, ahead = until_blank_line(member, 1 << 20)
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        headers = parse_headers(head)
        size = int(headers[LENGTH.lower()])
        left = size - len(ahead)  # may be below 0 by what follows the block
        if wanted(headers):
            found = Record(headers, at)
            kind = headers.get(TYPE.lower())
            keep = payloads(headers)
            if lengths or keep:
                ahead = ahead[:size]
                http = {}
                if kind in HTTP_TYPES:
                    while END not in ahead and len(ahead) < size:
                        more = member.read(min(HEAD, size - len(ahead)))
                        if not more:
                            raise ValueError(f"the record at {at} ends too early")
                        ahead += more
                        left -= len(more)
                    top, _, ahead_body = ahead.partition(END)
                    http, ahead = parse_headers(top), ahead_body
                    body = size - len(top) - len(END)
                else:
                    body = size
                found.payload_length = int(http.get(LENGTH.lower(), body)) if kind == "revisit" else body
                if keep:
                    rest = member.read(body - len(ahead)) if body > len(ahead) else b""
                    left -= len(rest)
                    found.payload = ahead + rest
                    if len(found.payload) != body:
                        raise ValueError(f"the record at {at} ends too early")
            yield found
        at = member.end(left + len(END))


def store_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def column_value(headers: dict[str, str], column: str):
    if column == "content_length":
        return int(headers[LENGTH.lower()])
    value = headers.get(HEADERS[column].lower())
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


#: What a pushed predicate says of a value that isn't null.
TESTS: dict[type, Callable] = {
    EqualTo: lambda v, f: v == f.value, EqualNullSafe: lambda v, f: v == f.value, In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value), StringContains: lambda v, f: f.value in v,
    IsNotNull: lambda v, f: True, IsNull: lambda v, f: False,
}


def supported(f: Filter) -> bool:
    inner = f.child if isinstance(f, Not) else f
    return type(inner) in TESTS and len(inner.attribute) == 1 and inner.attribute[0] in (*HEADERS, "content_length")


def holds(f: Filter, headers: dict[str, str]) -> bool:
    """Does a supported predicate hold? As in SQL, a null value satisfies neither a comparison nor its negation."""
    inner = f.child if isinstance(f, Not) else f
    value = column_value(headers, inner.attribute[0])
    if isinstance(inner, (IsNull, IsNotNull)):
        found = (value is None) == isinstance(inner, IsNull)
    elif isinstance(inner, EqualNullSafe) and (value is None or inner.value is None):
        found = value is None and inner.value is None
    elif value is None:
        return False
    else:
        found = TESTS[type(inner)](value, inner)
    return found != isinstance(f, Not)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path = options["path"]
        self.columns = schema.fieldNames()
        self.arrow = pa.schema([(f.name, _ARROW[f.name]) for f in schema])
        self.verify = options.get("verify", "false") == "true"
        self.partition_bytes = int(options.get("partitionBytes", 128 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if supported(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files in runs of about partition_bytes, the largest files first."""
        out: list[Files] = []
        room = 0
        for path, size in sorted(archive_files(self.path), key=lambda x: (-x[1], x[0])):
            if room < size:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].paths.append(path)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        lengths, body = "payload_length" in self.columns, "payload" in self.columns
        wanted = lambda h: all(holds(f, h) for f in self.filters)
        checked = lambda h: self.verify and DIGEST.lower() in h and h.get(TYPE.lower()) != "revisit"
        for path in partition.paths:
            rows, held = [], 0
            store, inner = store_at(path)
            with store.open_input_file(inner) as file:
                for r in records(file, path.endswith(".gz"), wanted, lengths, lambda h: body or checked(h)):
                    if checked(r.headers) and r.headers[DIGEST.lower()].startswith("sha1:") and digest_of(r.payload) != r.headers[DIGEST.lower()][5:]:
                        raise ValueError(f"{path}: the payload of the record at {r.at} doesn't have its digest")
                    rows.append(self._row(path, r))
                    held += len(r.payload or b"") if body else 0
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, self.arrow)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, self.arrow)

    def _row(self, path: str, r: Record) -> dict:
        values = {"file": path, "at": r.at, "headers": r.headers, "payload_length": r.payload_length, "payload": r.payload}
        return {c: values[c] if c in values else column_value(r.headers, c) for c in self.columns}


_ARROW = {c: pa.string() for c in ("file", *HEADERS)} | {c: pa.int64() for c in ("at", "content_length", "payload_length")} | {"headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}


def archive_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the committed archives of a folder; of all archives where no manifest is."""
    store, inner = store_at(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    there = store.get_file_info(fs.FileSelector(inner, recursive=True))
    manifests = [x for x in there if x.base_name.startswith("_manifest-")]
    archives = [x for x in there if x.base_name.endswith((".warc", ".warc.gz"))]
    if manifests:
        named = set()
        for x in manifests:
            with store.open_input_stream(x.path) as f:
                named |= set(json.loads(f.read()))
        archives = [x for x in archives if x.base_name in named]
    return [(prefix + x.path, x.size) for x in archives]


# --- writing records ------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_text(value: str) -> str:
    return "".join(f"%{ord(ch):02X}" if ord(ch) < 0x20 or ord(ch) == 0x7F else ch for ch in value)


def record_bytes(row: dict, date: str) -> bytes:
    kind = row["record_type"]
    payload = row.get("payload") or b""
    payload = payload.encode() if isinstance(payload, str) else payload
    sha1 = row.get("payload_sha1")
    digest = digest_of(payload) if sha1 is None else base64.b32encode(sha1).decode()
    block, content = payload, row.get("content_type") or "application/octet-stream"
    if kind in HTTP_TYPES:
        length = row.get("payload_length")
        length = len(payload) if length is None else length
        top = f"HTTP/1.1 200 OK\r\nContent-Type: {header_text(row.get('content_type') or 'text/html; charset=utf-8')}\r\n{LENGTH}: {length}"
        block, content = top.encode() + END + (payload if kind == "response" else b""), HTTP_TYPE
    lines = [
        (TYPE, kind), (ID, f"<{row.get('record_id') or f'urn:uuid:{uuid.uuid4()}'}>"), (DATE, row.get("date") or date),
        (URI, row.get("target_uri")), (CONTENT, content), (DIGEST, f"sha1:{digest}"),
        (REFERS, f"<{row['refers_to']}>" if row.get("refers_to") else None), (PROFILE, SAME_PAYLOAD if kind == "revisit" else None), (LENGTH, str(len(block))),
    ]
    head = "\r\n".join(f"{k}: {header_text(v)}" for k, v in lines if v is not None)
    return VERSION + b"\r\n" + head.encode() + END + block + END


def gzip_member(record: bytes, level: int) -> bytes:
    """One gzip member with its own length and the record's in the 'sl' field, where they fit it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    if len(body) + 24 >= 1 << 32 or len(record) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, len(body) + 24, len(record)) + body


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        if overwrite:
            raise ValueError("archives can only be appended to")
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("fileBytes", 256 << 20))
        self.level = int(options.get("level", 3))
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written()
        store, inner = store_at(self.path)
        store.create_dir(inner, recursive=True)
        file, size = None, 0
        try:
            for batch in iterator:
                for k in range(batch.num_rows):  # row by row, so that one payload at a time is held twice
                    row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                    if file is None or size >= self.file_bytes:
                        if file is not None:
                            file.close()
                        done.names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        file, size = store.open_output_stream(f"{inner}/{done.names[-1]}", compression=None), 0
                    member = gzip_member(record_bytes(row, self.date), self.level)
                    file.write(member)
                    size += len(member)
        finally:
            if file is not None:
                file.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = store_at(self.path)
        store.create_dir(inner, recursive=True)
        with store.open_output_stream(f"{inner}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files of failed tasks stay unnamed; those of finished ones go."""
        store, inner = store_at(self.path)
        for name in [n for m in messages if m for n in m.names]:
            store.delete_file(f"{inner}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def use_warc(spark: SparkSession) -> None:
    """Make format("warc") known to the session, with its predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# --- pages as archives ----------------------------------------------------------------------

PAGE = "urn:page:"


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A record per row of pages(page_id, url, html).

    Of the records with equal payloads of at least least_bytes, that with the largest page_id is the response and the others revisit
    it, without a payload of their own; all smaller ones are responses. A null html is empty. A null page_id is below all
    others; rows that share the largest page_id are all responses. Revisits are told by digest, length and a second hash.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    keys = ["payload_sha1", "payload_length", "mark"]
    rows = pages.select("page_id", F.col("url").alias("target_uri"), body.alias("payload"))
    rows = rows.select("*", F.unhex(F.sha1("payload")).alias("payload_sha1"), F.octet_length("payload").cast("long").alias("payload_length"), F.xxhash64("payload").alias("mark"))
    shared = rows.where(F.col("payload_length") >= least_bytes).groupBy(*keys).agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
    shared = saved(shared.where("n > 1").select(*keys, "leader", F.lit(True).alias("shared")))
    if shared.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(shared), keys, "left")
    else:  # a payload that many pages share is dealt over SALTS tasks
        copies = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "target_uri"), F.lit(SALTS))).join(copies, [*keys, "salt"], "left")
    response = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("leader"))
    named = lambda c: F.concat(F.lit(PAGE), F.col(c).cast("string"))
    return rows.select(
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        named("page_id").alias("record_id"), "target_uri",
        F.when(~response, named("leader")).alias("refers_to"),
        "payload_sha1", "payload_length",
        F.when(response, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    use_warc(pages.sparkSession)
    page_records(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of all page records; payloads are checked."""
    use_warc(spark)
    kept = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long"
    rows = spark.read.format("warc").schema(kept).option("verify", "true").load(path).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE) + 1}) as bigint)")
    return rows.select(
        F.when(F.startswith("record_id", F.lit(PAGE)), number("record_id")).alias("page_id"), F.col("target_uri").alias("url"),
        F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )


def new_archive_path(spark: SparkSession) -> str:
    return new_folder(spark, "warc")
