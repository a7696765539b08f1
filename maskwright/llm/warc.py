"""WARC archives as a Python data source, and deduplicated web archiving of a table of pages.

Reading (``spark.read.format("warc").load(path)``): the archives of the folder are planned into
partitions of about ``partition_bytes``, a file never being split. Predicates on the record type and
on the other header columns are pushed into the reader. It parses the headers of a record first; a
record that a predicate rejects is passed over without decoding its payload: by its length in a plain
archive, and in a compressed one by the member length that the gzip header carries in its ``sl``
field. Archives without that field are read too, by inflating each member to its end. With the option
``payload=false`` no payload is decoded at all.

Writing (``df.write.format("warc").mode("overwrite").save(path)``): each task writes archives of
about ``file_bytes``, one gzip member per record, under names of its own, and the driver publishes the
list of those that belong to the successful attempts. Archives of lost or repeated tasks are in no
list, and a reader takes only what is listed; a folder without a list is read whole.

Paths are whatever Arrow's file systems open (local, hdfs, s3, gs), in a folder that all executors
reach.

Defined cases: a null page text is the empty payload; a null url gives no target; control characters
and spaces in header values are percent-encoded; a null page_id never is the response of a group that
has another id, and groups of null ids alone are all responses; of repeated rows with the largest
page_id all are responses; an empty table gives an empty archive; extra columns are not used.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains,
    StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from maskwright.llm.common import materialize, scratch_dir, table

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_length long, payload binary"
)
#: Bytes of archives in a partition, of an archive before the next is begun, and read at once.
PARTITION_BYTES, FILE_BYTES, STEP = 64 << 20, 64 << 20, 1 << 14
LISTS = "_archives-"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records


def _value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def encode_record(row: dict) -> bytes:
    """One record; a response carries its payload, a revisit only the length of it."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = row[column] or (NO_DATE if column == "date" else None)
        if value is not None:
            value = f"<{_value(value)}>" if column in ("record_id", "refers_to") else _value(value)
            lines.append(f"{name}: {'sha1:' * (column == 'payload_digest')}{value}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member whose header tells its own length and that of the record."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    whole = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_header(head: bytes) -> dict:
    """The header columns of a record, and the length of its block."""
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    row = {column: fields.get(name.lower()) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        if row[column]:
            row[column] = row[column].removeprefix("<").removesuffix(">")
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    return row | {"length": int(fields.get("content-length", 0)), "http": fields.get("content-type", "").startswith("application/http")}


class Inflated:
    """The bytes of one gzip member, inflated only as far as they are asked for."""

    def __init__(self, file, start: int):
        self.file, self.start = file, start
        file.seek(start)
        head = file.read(10)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {start}")
        flags, self.size, at = head[3], None, 10
        if flags & 4:
            size = struct.unpack("<H", file.read(2))[0]
            extra = file.read(size)
            at += 2 + size
            while len(extra) >= 4:
                name, n = struct.unpack("<2sH", extra[:4])
                if name == b"sl" and n == 8:
                    self.size = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for flag in (8, 16):  # name, comment
            if flags & flag:
                while file.read(1) not in (b"\0", b""):
                    at += 1
                at += 1
        if flags & 2:
            file.read(2)
            at += 2
        self.at, self.ends = start + at, None
        self.inflater = zlib.decompressobj(-15)
        self.bytes = bytearray()

    def more(self) -> bool:
        """Inflates some more; whether there was any."""
        if self.inflater.eof:
            return False
        self.file.seek(self.at)
        got = self.file.read(STEP)
        if not got:
            raise ValueError(f"member at {self.start} is cut off")
        self.bytes += self.inflater.decompress(got)
        self.at += len(got)
        if self.inflater.eof:
            self.ends = self.at - len(self.inflater.unused_data) + 8
        return True

    def end(self) -> int:
        """Where the next member begins."""
        if self.size:
            return self.start + self.size
        while self.more():
            self.bytes.clear()
        return self.ends


def records(file, size: int, packed: bool, wanted, decode: bool) -> Iterator[dict]:
    """The records of an archive that ``wanted`` takes by their headers, with payloads if ``decode``."""
    at = 0
    while at < size:
        if packed:
            source = Inflated(file, at)
            while (cut := source.bytes.find(b"\r\n\r\n")) < 0 and source.more():
                pass
        else:
            file.seek(at)
            lead = bytearray()
            while (cut := lead.find(b"\r\n\r\n")) < 0 and (got := file.read(STEP)):
                lead += got
        if cut < 0:
            raise ValueError(f"no record header at {at}")
        row = parse_header(bytes((source.bytes if packed else lead)[:cut]))
        if wanted(row):
            stop = cut + 4 + row["length"]
            if packed:
                while len(source.bytes) < (stop if decode else cut + 4 + min(row["length"], STEP)) and source.more():
                    pass
                block = bytes(source.bytes[cut + 4 : stop])
            else:
                file.seek(at + cut + 4)
                block = file.read(row["length"] if decode else min(row["length"], STEP))
            yield row | split_block(row, block, decode)
        at = source.end() if packed else at + cut + 4 + row["length"] + 4


def split_block(row: dict, block: bytes, decode: bool) -> dict:
    """payload and payload_length; the length of a revisit's payload is in its HTTP header."""
    if not row["http"]:
        return {"payload": block if decode else None, "payload_length": row["length"]}
    cut = block.find(b"\r\n\r\n")
    cut = cut + 4 if cut >= 0 else len(block)
    if row["record_type"] == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", block[:cut])
        return {"payload": None, "payload_length": int(told[1]) if told else None}
    return {"payload": block[cut:] if decode else None, "payload_length": row["length"] - cut}


# ---- predicates


class Predicate:
    """The pushed filters, as a test of the header columns; null makes a comparison fail."""

    def __init__(self):
        self.filters: list[Filter] = []

    def takes(self, f: Filter) -> bool:
        inner = f.child if isinstance(f, Not) else f
        column = getattr(inner, "attribute", None)
        return (
            column is not None and len(column) == 1 and column[0] in HEADERS
            and isinstance(inner, (EqualTo, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains))
        )

    def __call__(self, row: dict) -> bool:
        return all(self._test(f, row) is True for f in self.filters)

    def _test(self, f: Filter, row: dict):
        if isinstance(f, Not):
            known = self._test(f.child, row)
            return None if known is None else not known
        value = row[f.attribute[0]]
        if isinstance(f, IsNull):
            return value is None
        if isinstance(f, IsNotNull):
            return value is not None
        if value is None:
            return None
        if isinstance(f, EqualTo):
            return None if f.value is None else value == f.value
        if isinstance(f, In):
            return value in f.value or (None if None in f.value else False)
        if isinstance(f, StringStartsWith):
            return value.startswith(f.value)
        return value.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in value


# ---- the data source


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict, schema):
        self.path, self.decode = path, options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.schema, self.wanted = schema, Predicate()

    def pushFilters(self, filters):
        for f in filters:
            if self.wanted.takes(f):
                self.wanted.filters.append(f)
            else:
                yield f

    def partitions(self):
        system, root = _opened(self.path)
        found = {f.path: f.size for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file}
        lists = [p for p in found if p.rpartition("/")[2].startswith(LISTS)]
        if lists:
            names = {n for p in lists for n in json.loads(system.open_input_stream(p).read())}
            found = {p: s for p, s in found.items() if p.rpartition("/")[2] in names}
        out: list[Files] = []
        room = 0
        for path, size in sorted(found.items()):
            if not path.endswith((".warc", ".warc.gz")):
                continue
            if not out or size > room:
                out.append(Files([]))
                room = self.most
            out[-1].paths.append((path, size))
            room -= size
        return out or [Files([])]

    def read(self, partition):
        system, _ = _opened(self.path)
        schema = pa.schema([(f.name, {"bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in self.schema])
        rows, size = [], 0
        for path, length in partition.paths:
            with system.open_input_file(path) as file:
                for row in records(file, length, path.endswith(".gz"), self.wanted, self.decode):
                    rows.append({n: row[n] for n in schema.names})
                    size += len(row["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.most = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                size += out.write(member(encode_record(row))) or 0
                if size >= self.most or out.tell() >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        before = []
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith(LISTS):
                    before += [f.path, *(f"{root}/{n}" for n in json.loads(system.open_input_stream(f.path).read()))]
        names = [n for m in messages if m is not None for n in m.names]
        name = f"{root}/{LISTS}{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps(names).encode())
        system.move(f"{name}.tmp", name)
        for path in before:
            if system.get_file_info(path).is_file:
                system.delete_file(path)

    def abort(self, messages):
        system, root = _opened(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                if system.get_file_info(f"{root}/{n}").is_file:
                    system.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    """format("warc"); options payload, partition_bytes, file_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to the session, with its predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, four letters from each five hexadecimal digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive_rows(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records of ``pages`` (page_id, url, html) for the writer. Of equal payloads of at least ``least`` bytes, the one
    with the largest page_id is the response and the others revisit it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.select("*", base32_sha1(F.col("payload")).alias("payload_digest"), F.length("payload").cast("long").alias("payload_length"))
    copies = rows.filter(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # a table of its own, so that a payload with very many copies is a join that Spark can split
    copies = materialize(copies.filter("n > 1 and first is not null").select("payload_digest", "first"), "copies")
    joined = rows.join(copies, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("date"), F.when(revisit, urn(F.col("first"))).alias("refers_to"), "payload_digest", "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(urn: str) -> Column:
    """The id in a record id of ``archive_rows``."""
    return F.nullif(F.substring(F.col(urn), 10, 20), F.lit("")).cast("long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    register(spark)
    path = scratch_dir(spark, "warc")
    archive_rows(pages).write.format("warc").mode("overwrite").save(path)
    found = spark.read.format("warc").load(path)
    # of a response, both come from the payload that was read
    whole = F.col("record_type") == "response"
    return found.select(
        page_of("record_id").alias("page_id"), F.when(whole, F.length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"),
    )


OP5_SQL = """
WITH parts AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
),
groups AS (SELECT hex, max(page_id) AS first, count(*) AS n FROM parts GROUP BY hex),
spelled AS (
  SELECT p.*, g.first, g.n > 1 AND g.first IS NOT NULL AND page_id IS DISTINCT FROM g.first AS again,
    list_transform(generate_series(0, 7), lambda k: CAST('0x' || substr(p.hex, 1 + 5 * k, 5) AS BIGINT)) AS parts,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters
  FROM parts p JOIN groups g ON p.hex = g.hex
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(parts, lambda x: letters[1 + (x >> 15)] || letters[1 + ((x >> 10) & 31)] || letters[1 + ((x >> 5) & 31)] || letters[1 + (x & 31)]), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM spelled
"""
