"""WARC archives as a PySpark Python data source, and pages written to and read back from them.

Writing: every task rolls its records into .warc.gz files, a gzip member a record; the length of
each member stands in its gzip header (the public `sl` subfield), so that a reader can step over a
member without inflating it. The commit lists the files of the tasks that succeeded; what a lost task
left behind is never read.

Reading: files are planned into partitions by size, whole files together. Of each record the head is
inflated and parsed first (record header, then HTTP header); predicates on the record's type and headers,
pushed down by Spark, decide on it; the payload of a record that they reject, or of any record if no
payload column is read, is neither inflated nor decoded but stepped over. Plain .warc files are
stepped through by Content-Length.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
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

from .common import cut, shared_dir, small

#: Columns of records. payload_length is that of the full payload, also where a revisit leaves it out.
SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, content_type string, payload_length long, payload binary"
#: A task starts another file beyond so many compressed bytes; files are read together up to so many.
ROLL_BYTES, SPLIT_BYTES = 256 << 20, 32 << 20
#: Records with equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 1000
_DATE = "1970-01-01T00:00:00Z"
# Header fields by column, and the revisit profile of the WARC 1.1 standard.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_CHUNK = 1 << 16


# --- records


def _safe(value: str) -> str:
    """No line may end inside a header field: control characters are percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def encode_record(row: dict, level: int = 4) -> bytes:
    """One gzip member. Without payload (a revisit) the HTTP header is all of the block."""
    payload = row.get("payload")
    length = row["payload_length"] if payload is None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\nContent-Length: {length or 0}\r\n\r\n".encode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row.get("date") or _DATE)]
    if row.get("target_uri") is not None:
        head.append(("WARC-Target-URI", row["target_uri"]))
    if row.get("payload_digest") is not None:
        head.append(("WARC-Payload-Digest", "sha1:" + row["payload_digest"]))
    if row.get("refers_to") is not None:
        head += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload or b"")))]
    raw = b"".join([b"WARC/1.1\r\n", *[f"{n}: {_safe(v)}\r\n".encode() for n, v in head], b"\r\n", http, payload or b"", b"\r\n\r\n"])
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 4 + 8 + len(body) + 8
    known = size < 1 << 32 and len(raw) < 1 << 32  # the subfield holds 32 bits
    extra = b"sl" + struct.pack("<HII", 8, size, len(raw)) if known else b""
    return b"".join([b"\x1f\x8b\x08", b"\x04" if known else b"\x00", b"\x00\x00\x00\x00\x00\xff", struct.pack("<H", len(extra)) if known else b"", extra, body, struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)])


class _Input:
    """A file read in chunks, with a place that can move forwards."""

    def __init__(self, source):
        self.source, self.data, self.at, self.left = source, b"", 0, source.size()

    def more(self) -> bool:
        chunk = self.source.read(min(_CHUNK, self.left)) if self.left else b""
        self.left -= len(chunk)
        self.data, self.at = self.data[self.at :] + chunk, 0
        return bool(chunk)

    def peek(self, n: int) -> bytes:
        while len(self.data) - self.at < n and self.more():
            pass
        return self.data[self.at : self.at + n]

    def chunk(self) -> bytes:
        """All that is at hand, at least a byte unless the file ends; it counts as read."""
        self.peek(1)
        out, self.data, self.at = self.data[self.at :], b"", 0
        return out

    def skip(self, n: int) -> None:
        here = min(n, len(self.data) - self.at)
        self.at += here
        ahead = min(n - here, self.left)
        if ahead > 0:
            self.source.seek(self.source.tell() + ahead)
            self.left -= ahead

    def back(self, rest: bytes) -> None:
        self.data, self.at = rest + self.data[self.at :], 0


class _Member:
    """The bytes of one record: a gzip member, or a record of a plain file."""

    def __init__(self, file: _Input):
        self.file, self.size, self.done, self.out = file, None, False, b""
        self.gzip = file.peek(2) == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.gzip else None
        if self.gzip:
            head = file.peek(12)
            if len(head) == 12 and head[3] & 4:
                fields, at = file.peek(12 + head[10] + 256 * head[11])[12:], 0
                while at + 4 <= len(fields):
                    (n,) = struct.unpack_from("<H", fields, at + 2)
                    if fields[at : at + 2] == b"sl" and n == 8 and at + 12 <= len(fields):
                        (self.size,) = struct.unpack_from("<I", fields, at + 4)
                    at += 4 + n
        self.begun = file.source.tell() - (len(file.data) - file.at)

    def _pull(self) -> bool:
        if self.done:
            return False
        if not self.gzip:
            got = self.file.chunk()
            self.out += got
            return bool(got)
        given = self.inflate.unconsumed_tail or self.file.chunk()
        if not given:
            self.done = True
            return False
        self.out += self.inflate.decompress(given, _CHUNK)
        if self.inflate.eof:
            self.done = True
            self.file.back(self.inflate.unused_data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark (taken away with it); None if it doesn't come."""
        looked = 0
        while (at := self.out.find(mark, max(0, looked - len(mark)))) < 0:
            looked = len(self.out)
            if not self._pull():
                return None
        got, self.out = self.out[:at], self.out[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        while have < n:
            self.out = b""
            if not self._pull():
                break
            parts.append(self.out)
            have += len(self.out)
        whole = b"".join(parts)
        self.out = whole[n:]
        return whole[:n]

    def leave(self, left: int) -> None:
        """To the next record; `left` bytes of this one's block have not been taken."""
        if not self.gzip:
            self.file.back(self.out)
            self.file.skip(left)
            while self.file.peek(1) in (b"\r", b"\n"):
                self.file.skip(1)
        elif self.size is not None and not self.done:
            here = self.file.source.tell() - (len(self.file.data) - self.file.at)
            tail = len(self.inflate.unconsumed_tail)
            self.file.back(self.inflate.unconsumed_tail)
            self.file.skip(self.begun + self.size - here + tail)
        else:
            self.out = b""
            while self._pull():
                self.out = b""


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out.setdefault(name, value.strip())
    return out


def records(source, wanted: Callable[[dict], bool], payloads: bool) -> Iterator[dict]:
    """The records of an open file that are wanted by their headers."""
    file = _Input(source)
    while file.peek(1):
        member = _Member(file)
        head = member.until(b"\r\n\r\n")
        if head is None or not head.lstrip().startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {member.begun}")
        fields = _fields(head.lstrip())
        left = int(fields.get("content-length", 0))
        row = {c: fields.get(f.lower()) for c, f in FIELDS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] is not None else None
        if row["payload_digest"] is not None:
            row["payload_digest"] = row["payload_digest"].split(":", 1)[-1]
        row["payload_length"] = left
        if (row["content_type"] or "").startswith("application/http") and left:
            http = member.until(b"\r\n\r\n")
            left -= len(http) + 4
            inner = _fields(http)
            row["content_type"] = inner.get("content-type")
            row["payload_length"] = int(inner.get("content-length", left))
        row["payload"] = None
        if wanted(row):
            if payloads and row["record_type"] != "revisit":
                row["payload"] = member.take(left)
                left = 0
            yield row
        member.leave(left)


# --- data source


def _holds(f: Filter, row: dict) -> bool:
    """A pushed filter on a record, as SQL has it (a comparison with null doesn't hold)."""
    if isinstance(f, Not):
        return row[_column(f.child)] is not None and not _holds(f.child, row)
    value = row[f.attribute[0]]
    if isinstance(f, (IsNull, IsNotNull)):
        return (value is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    return _TESTS[type(f)](value, f.value)


_TESTS = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
}
_SIMPLE = (*_TESTS, EqualNullSafe, IsNull, IsNotNull)


def _column(f: Filter) -> str | None:
    """The header column that a filter is about, if it can be decided by headers."""
    if isinstance(f, Not):
        return _column(f.child) if isinstance(f.child, (EqualTo, In)) and not (isinstance(f.child, In) and None in f.child.value) else None
    if isinstance(f, _SIMPLE) and len(f.attribute) == 1 and f.attribute[0] in _NAMES and f.attribute[0] != "payload":
        return f.attribute[0]
    return None


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.schema, self.filters = schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _column(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files of committed tasks (of a folder that this source wrote), else all .warc and .warc.gz files."""
        system, root = _open(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root))
        lists = [i.path for i in found if i.base_name.startswith("_files-")]
        names = {n for p in lists for n in json.loads(system.open_input_stream(p).read())} if lists else None
        found = sorted((i for i in found if (i.base_name in names if names is not None else i.base_name.endswith((".warc", ".warc.gz")))), key=lambda i: i.path)
        out, size = [], 0
        for i in found:
            if not out or size + i.size > self.split:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(i.path)
            size += i.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _open(self.path)
        schema = to_arrow_schema(self.schema)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as source:
                for row in records(source, lambda r: all(_holds(f, r) for f in self.filters), "payload" in self.columns):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist([{c: r[c] for c in self.columns} for r in rows], schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in self.columns} for r in rows], schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.roll = options["path"], int(options.get("roll_bytes", ROLL_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is not None and out.tell() > self.roll:
                    out.close()
                    out = None
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out = system.open_output_stream(f"{root}/{names[-1]}", compression=None, buffer_size=1 << 20)
                out.write(encode_record(row))
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for name in (n for m in messages if m for n in m.files):
            system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """spark.read.format("warc").load(path), df.write.format("warc").mode("append").save(path). The path may be of
    any file system that Arrow opens (file, hdfs, s3, gs). Rows to write have the columns of SCHEMA or some of
    them, record_type and record_id among these; a row without payload is written with its payload_length alone."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to; give a new path")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of an archive. Without `payload` among the columns no payload is inflated. Spark 4.1 keeps
    the predicates of a DataFrame's last query where the next one on it pushes none; a predicate that all
    records meet, for each has a type, sees to it that every query pushes its own."""
    register(spark)
    kept = [c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in ("record_type", *columns)]
    found = spark.read.format("warc").schema(", ".join(kept)).load(path).filter("record_type is not null")
    return found.select(columns) if columns else found


# --- pages


def _page_uri(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def page_of(uri: str) -> Column:
    """The page id of a record id's column."""
    return F.substring_index(uri, ":", -1).try_cast("long")


def page_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """A record for each row of pages (page_id, url, html; other columns are ignored), payload the html in UTF-8, null as empty.
    Of rows with equal payloads of at least `least` bytes the one with the largest page_id is the response, and the others
    revisit it; rows that share that page_id are each a response. A payload that a third of all rows share is one row of
    the table of repeated payloads; that table is broadcast if counted small, else the payloads that many rows
    share are (10,000 at most, for each has a ten-thousandth of the rows), and the others are joined by shuffle."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    given = given.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    key = F.when(F.col("payload_length") >= least, F.sha2("payload", 256))
    keyed = given.withColumn("_key", key)
    groups = keyed.filter("_key is not null").groupBy("_key").agg(F.max("page_id").alias("_top"), F.count("*").alias("_n"))
    repeated = cut(groups.filter("_n > 1").withColumnRenamed("_key", "_same"), "repeated")
    near = small(repeated)
    if near is repeated:
        hot = F.broadcast(repeated.filter(F.col("_n") >= max(1000, pages.count() // 10_000)))
        told = keyed.join(hot, F.col("_key") == F.col("_same"), "left")
        rest = told.filter("_key is not null and _same is null").select(keyed.columns)
        told = told.filter("_key is null or _same is not null").unionByName(rest.join(repeated, F.col("_key") == F.col("_same"), "left"))
    else:
        told = keyed.join(near, F.col("_key") == F.col("_same"), "left")
    again = F.col("_same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return told.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        _page_uri(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.when(again, _page_uri(F.col("_top"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame) -> str:
    """Archives of the pages in the shared folder; the path."""
    spark = pages.sparkSession
    register(spark)
    path = os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    page_records(pages).write.format("warc").mode("append").save(path)
    return path


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record. Responses are told from their payloads;
    revisits from their headers, in a read that inflates no payload."""
    whole = read(spark, path, ["record_type", "record_id", "payload"]).filter("record_type = 'response'")
    heads = read(spark, path, ["record_type", "record_id", "refers_to", "payload_digest", "payload_length"]).filter("record_type = 'revisit'")
    first = whole.select(page_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(heads.select(page_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page_of("refers_to").alias("refers_to")))
