"""WARC archives as a PySpark data source: write records, plan partitions over files, push predicates on headers down.

Reading. The planner lists the files of a folder (those of the write's manifests, if there are any) and deals them to
partitions by bytes. A task parses the headers of a record first; a record that fails the pushed predicates is skipped without
inflating, copying or decoding its payload: in plain files by its length, in compressed ones by the length that the
gzip member carries in its ``sl`` extra field. Members without that field are inflated to find their end, but not kept.
Predicates on any header column are pushed (equality, ranges, membership, null tests, prefixes, their negations); others stay with Spark.
With ``payload=False`` no payload is decoded at all.

Writing. Each task writes its records, one gzip member each, to files of its own that are closed at ``file_bytes``. The
commit lists the files of the successful attempts in a manifest, so files of lost or repeated attempts are never read.

Files are reached through pyarrow, by the URI of the folder (local or any store that pyarrow knows), which all executors must share.

``with_revisits`` marks repeated payloads: the row with the largest id is the response and the others revisit it. Only
digests are grouped (combined before the shuffle), however many copies a payload has.

Defined results: a null or empty text is an empty payload; small payloads are never revisits; rows that share the
largest id of a payload are all responses; a null id revisits the largest id of its payload, and is a response if there is none; control
characters in header values are percent-encoded; an empty table gives no records; other columns are not read; a broken record
is an error that names file and offset.
"""
from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
                                    In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith,
                                    StringStartsWith, WriterCommitMessage)

from ..operators.joins import lookup_join

SCHEMA = ("record_id string, record_type string, date string, target_uri string, refers_to string, payload_digest string, content_length bigint, "
          "headers map<string,string>, payload binary, file string, offset bigint")
#: Columns that come from one header each (names as in the WARC format, compared without case).
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_length": "content-length"}
#: Extension header: length of the full payload, also where a revisit does not hold it.
FULL_LENGTH = "X-Payload-Length"
WINDOW, BATCH_BYTES, BATCH_ROWS = 1 << 18, 1 << 23, 2000
END = b"\r\n\r\n"


def filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def safe(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value) if re.search(r"[\x00-\x1f\x7f]", value) else value


def member(data: bytes) -> bytes:
    """One gzip member whose extra field ``sl`` holds its own length and that of the data."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    if max(size, len(data)) > 0xFFFFFFFF:                    # too long for the field
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """The bytes of one record. A response holds the payload behind an HTTP header, a revisit no payload."""
    payload = row["payload"] or b""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = row["record_type"] == "revisit"
    names = {"WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"],
             "WARC-Payload-Digest": f"sha1:{digest}", FULL_LENGTH: str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    if revisit:
        names |= {"WARC-Refers-To": f"<{row['refers_to']}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    else:
        block += payload
    names["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {safe(v)}\r\n" for k, v in names.items() if v is not None) + "\r\n"
    return head.encode() + block + END


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Files(names)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}") as out:
            out.write("".join(f"{n}\n" for m in messages if m for n in m.names).encode())

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/{name}")


class Window:
    """Reads ahead in a file; a jump past what was read costs a seek, not the bytes between."""

    def __init__(self, source):
        self.source, self.start, self.data = source, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        """Up to n bytes from pos."""
        if not self.start <= pos or pos + n > self.start + len(self.data):
            self.source.seek(pos)
            self.start, self.data = pos, self.source.read(max(n, WINDOW))
        return self.data[pos - self.start:pos - self.start + n]


class Record:
    """One record at a position: ``head`` first, then ``body()`` or ``end()``."""

    def __init__(self, window: Window, pos: int):
        self.window, self.pos, self.length, self.inflate = window, pos, None, None
        magic = window.at(pos, 26)
        self.got, self.fed = b"", pos
        if magic[:2] == b"\x1f\x8b":
            self.inflate = zlib.decompressobj(31)
            if len(magic) > 23 and magic[3] & 4 and magic[12:16] == b"sl\x08\0":
                self.length = struct.unpack("<I", magic[16:20])[0]
        while END not in self.got:
            if not self.more(4096):
                raise ValueError("headers do not end")
        head, self.got = self.got.split(END, 1)
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.head = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            self.head[name.strip().lower()] = value.strip()
        self.size = int(self.head["content-length"])
        self.plain_end = pos + len(head) + 4 + self.size + 4

    def more(self, n: int) -> bytes:
        """Further bytes of the record, none at its end."""
        if self.inflate is None:
            data = self.window.at(self.fed, n)
            self.fed += len(data)
        else:
            data = b""
            while not data and not self.inflate.eof:
                tail = self.inflate.unconsumed_tail
                raw = tail or self.window.at(self.fed, 1 << 15)
                if not raw:
                    raise ValueError("member is cut off")
                if not tail:
                    self.fed += len(raw)
                data = self.inflate.decompress(raw, n)
        self.got += data
        return data

    def body(self) -> bytes:
        parts, held = [self.got], len(self.got)
        while held < self.size:
            self.got = b""
            if not self.more(min(1 << 20, self.size - held)):
                raise ValueError("record is cut off")
            parts.append(self.got)
            held += len(self.got)
        self.got = b""
        return b"".join(parts)[:self.size]

    def end(self) -> int:
        """Where the next record starts."""
        if self.inflate is None:
            return self.plain_end
        if self.length:
            return self.pos + self.length
        while not self.inflate.eof:                          # a foreign member: inflate to its end, keep nothing
            self.got = b""
            self.more(1 << 20)
        return self.fed - len(self.inflate.unused_data)


def header_values(head: dict[str, str]) -> dict:
    out = {c: head.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c].strip("<>") if out[c] else None
    digest = out["payload_digest"]
    if digest and digest.lower().startswith("sha1:") and len(digest) == 37:
        out["payload_digest"] = base64.b32decode(digest[5:].upper()).hex()
    out["content_length"] = int(out["content_length"])
    return out


TESTS = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v,
         LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v),
         StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x}


def pushable(f: Filter) -> bool:
    if isinstance(f, Not):
        return pushable(f.child)
    known = type(f) in TESTS or isinstance(f, (EqualNullSafe, IsNull, IsNotNull))
    missing = isinstance(f, In) and None in f.value or type(f) in TESTS and f.value is None
    return known and not missing and len(f.attribute) == 1 and f.attribute[0] in HEADERS


def holds(f: Filter, row: dict) -> bool | None:
    """SQL truth of a pushed predicate; None is unknown."""
    if isinstance(f, Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    x = row[f.attribute[0]]
    if isinstance(f, (IsNull, IsNotNull)):
        return (x is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return x == f.value
    return None if x is None else TESTS[type(f)](x, f.value)


@dataclass
class FileGroup(InputPartition):
    names: list[str] = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes, self.filters = path, payload, partition_bytes, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[FileGroup]:
        from pyarrow import fs as pafs
        fs, root = filesystem(self.path)
        found = {i.base_name: i.size for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File}
        manifests = [n for n in found if n.startswith("_manifest-")]
        if manifests:
            listed = [n for m in manifests for n in fs.open_input_stream(f"{root}/{m}").read().decode().split("\n") if n]
        else:
            listed = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        groups, size = [FileGroup([])], 0
        for name in sorted(listed):
            if size and size + found[name] > self.partition_bytes:
                groups.append(FileGroup([]))
                size = 0
            groups[-1].names.append(f"{root}/{name}")
            size += found[name]
        return groups

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as source:
                window, pos, size = Window(source), 0, source.size()
                while pos < size:
                    try:
                        rec = Record(window, pos)
                        row = header_values(rec.head)
                        if all(holds(f, row) for f in self.filters):
                            payload = self.payload_of(rec) if self.payload else None
                            rows.append(row | {"headers": list(rec.head.items()), "payload": payload, "file": name.rsplit("/", 1)[-1], "offset": pos})
                            held += len(payload or b"") + 500
                        pos = rec.end()
                    except (ValueError, KeyError, zlib.error) as e:
                        raise ValueError(f"broken WARC record in {name} at {pos}: {e}") from e
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    @staticmethod
    def payload_of(rec: Record) -> bytes | None:
        kind = rec.head.get("warc-type")
        if kind == "revisit":
            return None
        block = rec.body()
        if rec.head.get("content-type", "").lower().startswith("application/http"):
            return block.partition(END)[2]
        return block


#: The Arrow form of SCHEMA.
ARROW = pa.schema([*[(c, pa.string()) for c in list(HEADERS)[:-1]], ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
                   ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc").mode("append")``; options: payload, partition_bytes, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("partition_bytes", 32_000_000)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 1_000_000_000)))


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 32_000_000) -> DataFrame:
    """Records of all archives in a folder, columns as in ``SCHEMA``; filters on header columns reach the tasks' header parser."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partition_bytes", partition_bytes).load(path)


def write_warc(records: DataFrame, path: str, file_bytes: int = 1_000_000_000) -> None:
    """Append records (record_id, record_type, date, target_uri, payload, refers_to) to the archives in a folder."""
    records.sparkSession.dataSource.register(WarcSource)
    own = records.select(*[F.col(c).cast("string") for c in ("record_id", "record_type", "date", "target_uri", "refers_to")], F.col("payload").cast("binary"))
    own.write.format("warc").mode("append").option("file_bytes", file_bytes).save(path)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 1000,
                  date: str = "2024-01-01T00:00:00Z", prefix: str = "urn:x-page:") -> DataFrame:
    """(record_id, record_type, date, target_uri, payload, refers_to) of each row; payloads of ``least_bytes`` or more are kept once."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"),
                        F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    long = F.octet_length("payload") >= least_bytes
    rows = rows.withColumn("key", F.when(long, F.sha2("payload", 256)))
    repeated = rows.filter("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    named = lambda c: F.concat(F.lit(prefix), F.coalesce(F.col(c).cast("string"), F.lit("")))
    joined = lookup_join(rows, repeated, ["key"])
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("id"))
    return joined.select(named("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.lit(date).alias("date"),
                         "target_uri", "payload", F.when(revisit, named("kept")).alias("refers_to"))


def page_records(spark: SparkSession, path: str, id_type: str = "bigint", prefix: str = "urn:x-page:") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that ``with_revisits`` made, from the archives
    alone: responses by their payload, revisits by their headers (their payloads are not there, and responses are skipped over)."""
    def ids(c):
        return F.nullif(F.substring(F.col(c), len(prefix) + 1, 1 << 30), F.lit("")).cast(id_type)
    responses = read_warc(spark, path).filter("record_type = 'response'").select(
        ids("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", F.lit(None).cast(id_type).alias("refers_to"))
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select(
        ids("record_id").alias("page_id"), F.col("headers")[FULL_LENGTH.lower()].cast("bigint").alias("payload_bytes"), "payload_digest", "record_type",
        ids("refers_to").alias("refers_to"))
    return responses.union(revisits)
