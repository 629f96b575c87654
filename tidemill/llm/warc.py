"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files, takes predicates on record type and headers into the scan, parses a
record's headers first and inflates a payload only if the record passes and the payload is asked for. Records
are gzip members that carry their length in the ``sl`` extra field, so an unwanted one is jumped over; members
without it, and plain ``.warc`` files, are read too.

Writing gives each task attempt a file name of its own; ``commit`` lists the files of successful attempts in
``_files.json``, and a reader that finds such a list reads no others.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemill.llm.common import scratch, stored
from tidemill.llm.files import file_system, new_file, open_file

#: Columns and the header each comes from; http_length is the Content-Length of the stored HTTP headers.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", http_length long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BATCH_BYTES = 4_000_000
_CHUNK = 1 << 18


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcSource(DataSource):
    """Options: path; for reading verify (true: recompute payload digests); for writing gzip (true), level (1), max_file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema.names, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]):
        unknown = set(columns) - set(HEADERS) - {"http_length", "payload"}
        if unknown:
            raise ValueError(f"warc has no columns {sorted(unknown)}")
        self.columns, self.options, self.tests = columns, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes =, IN, prefix and null tests on header columns; Spark applies the rest."""
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNull, IsNotNull)):
                self.tests.append((column, type(f).__name__, tuple(f.value) if isinstance(f, In) else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Whole files, small ones together up to the target bytes."""
        folder = self.options["path"]
        fs, base = file_system(folder)
        target = int(self.options.get("partition_bytes", 64 << 20))
        listed = _listed(fs, base)
        if listed is None:
            found = fs.get_file_info(pafs.FileSelector(base, recursive=True)) if fs.get_file_info(base).type == pafs.FileType.Directory else [fs.get_file_info(base)]
            sized = [(i.path, i.size) for i in found if i.is_file and i.path.endswith((".warc", ".warc.gz"))]
            prefix = folder[: len(folder) - len(base)] if folder.endswith(base) else "file://"
            sized = [(prefix + p, n) for p, n in sized]
        else:
            sized = [(f"{folder}/{name}", n) for name, n in listed]
        groups, size = [[]], 0
        for path, n in sorted(sized):
            if groups[-1] and size + n > target:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(tuple(g)) for g in groups if g] or [Files(())]

    def _passes(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            got = headers.get(HEADERS[column])
            ok = {"EqualTo": lambda: got == value, "In": lambda: got in value, "StringStartsWith": lambda: got is not None and got.startswith(value), "IsNull": lambda: got is None, "IsNotNull": lambda: got is not None}[kind]()
            if not ok:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        verify = self.options.get("verify", "false").lower() == "true"
        want = "payload" in self.columns or verify
        rows, size = [], 0
        for path in partition.paths:
            with open_file(path) as f:
                for headers, http, payload in _records(f, self._passes, want, "http_length" in self.columns):
                    if verify and headers.get("warc-type") == "response" and "warc-payload-digest" in headers and digest(payload) != headers["warc-payload-digest"]:
                        raise ValueError(f"{path}: payload of {headers.get('warc-record-id')} does not match its digest")
                    row = {c: headers.get(h) for c, h in HEADERS.items()} | {"http_length": http, "payload": payload}
                    rows.append(row)
                    size += len(payload or b"") + 500
                    if size > _BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kind = {"payload": pa.binary(), "http_length": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind.get(c, pa.string())) for c in self.columns], names=self.columns)


def _listed(fs: pafs.FileSystem, base: str) -> list[tuple[str, int]] | None:
    """Names and sizes of all committed files; None for a folder of some other writer."""
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        return None
    lists = [i.path for i in fs.get_file_info(pafs.FileSelector(base)) if i.base_name.startswith("_files")]
    if not lists:
        return None
    out = []
    for path in lists:
        with fs.open_input_stream(path) as f:
            out += [tuple(x) for x in json.loads(f.read())]
    return out


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _parse(block: bytes) -> dict[str, str]:
    """Header lines after the first; names in lower case, a continued line joined to the one before."""
    out: dict[str, str] = {}
    last = None
    for line in block.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, value = line.split(b":", 1)
            last = name.strip().lower().decode("latin-1")
            out[last] = value.strip().decode("utf-8", "replace")
    return out


def _split_http(content_type: str | None, body: bytes) -> tuple[int | None, bytes]:
    """The Content-Length that stored HTTP headers name, and the payload after them."""
    if not (content_type or "").startswith("application/http"):
        return None, body
    head, _, payload = body.partition(b"\r\n\r\n")
    length = _parse(head).get("content-length")
    return int(length) if length and length.isdigit() else None, payload


def _records(f, passes, want: bool, http: bool) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, http_length, payload) of the records that pass; bodies of others are not inflated or copied."""
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        head = f.read(min(_CHUNK, 64))
        stream = _Member(f, at, head) if head[:2] == b"\x1f\x8b" else _Plain(f, at)
        block = stream.until(b"\r\n\r\n")
        if block is None:
            if stream.rest().strip():
                raise ValueError("a record has no end of headers")
            return
        headers = _parse(block)
        length = int(headers["content-length"])
        if passes(headers):
            body = stream.take(length) if want or http else None
            named, payload = (None, None) if body is None else _split_http(headers.get("content-type"), body)
            yield headers, named, payload if want else None
        at = stream.end(length)


class _Plain:
    """A record of an uncompressed archive."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at

    def until(self, mark: bytes) -> bytes | None:
        self.f.seek(self.at)
        got = b""
        while mark not in got:
            more = self.f.read(8192)
            if not more:
                self.got = got
                return None
            got += more
        head = got.split(mark, 1)[0]
        self.body = self.at + len(head) + len(mark)
        return head.lstrip(b"\r\n")

    def rest(self) -> bytes:
        return self.got

    def take(self, n: int) -> bytes:
        self.f.seek(self.body)
        return self.f.read(n)

    def end(self, n: int) -> int:
        return self.body + n + 4


class _Member:
    """A record in a gzip member of its own; ``sl`` gives the member's length."""

    def __init__(self, f, at: int, head: bytes):
        self.f, self.start, self.length = f, at, None
        if len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl":
            self.length = struct.unpack("<I", head[16:20])[0]
        self.inflate, self.fed, self.out = zlib.decompressobj(31), at, b""

    def _more(self, limit: int) -> bool:
        """Inflates about ``limit`` bytes further; False at the member's end."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail
        if not data:
            self.f.seek(self.fed)
            n = _CHUNK if self.length is None else min(_CHUNK, self.start + self.length - self.fed)
            data = self.f.read(max(n, 1))
            self.fed += len(data)
            if not data:
                raise ValueError("an archive ends within a record")
        self.out += self.inflate.decompress(data, limit)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.out:
            if not self._more(4096):
                return None
        head, self.out = self.out.split(mark, 1)
        return head

    def rest(self) -> bytes:
        return self.out

    def take(self, n: int) -> bytes:
        parts, size = [self.out], len(self.out)
        while size < n:
            self.out = b""
            if not self._more(_CHUNK):
                raise ValueError("a record is shorter than its Content-Length")
            parts.append(self.out)
            size += len(self.out)
        body = b"".join(parts)
        self.out = body[n:]
        return body[:n]

    def end(self, n: int) -> int:
        if self.length is not None:
            return self.start + self.length
        while self._more(_CHUNK):
            self.out = b""
        return self.fed - len(self.inflate.unused_data)


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, record_type, target_uri, date, payload_sha1 (hex), refers_to, http_length and payload (null: headers alone)."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.gzip = options.get("gzip", "true").lower() == "true"
        self.level = int(options.get("level", 1))
        self.most = int(options.get("max_file_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        paths, out, size = [], None, 0
        for batch in iterator:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                data = _record({c: v[i].as_py() for c, v in columns.items()})
                data = _member(data, self.level) if self.gzip else data
                if out is None or size + len(data) > self.most:
                    if out is not None:
                        out.close()
                    path, out = new_file(self.folder, "part")
                    paths.append(path)
                    size = 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(tuple(paths))

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.folder)
        fs.create_dir(base, recursive=True)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(base))] if self.overwrite else []
        listed = []
        for path in sorted(p for m in messages if m for p in m.paths):
            name = f"{path.rpartition('/')[2]}.warc" + ".gz" * self.gzip
            at = file_system(path)[1]
            old = [x for x in old if x != at]
            fs.move(at, f"{base}/{name}")
            listed.append((name, fs.get_file_info(f"{base}/{name}").size))
        mark = hashlib.md5(json.dumps(listed).encode()).hexdigest()
        with fs.open_output_stream(f"{base}/_files-{mark}.json") as f:
            f.write(json.dumps(listed).encode())
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        for path in (p for m in messages if m for p in m.paths):
            fs, base = file_system(path)
            fs.delete_file(base)


def _record(row: dict) -> bytes:
    payload = row["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["http_length"]
    body = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + row["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode())
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its whole length and the length of the data (low 32 bits)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = deflate.compress(data) + deflate.flush()
    total = 24 + len(packed) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def use_warc(spark: SparkSession) -> None:
    """Registers the source and lets Spark push predicates into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html): the first of equal payloads in full, others as revisits.

    Of payloads of at least ``min_bytes`` bytes that are equal, the rows of the smallest page_id are responses and
    the others revisit it; null html is an empty payload. A null page_id is never the smallest, unless all are
    null; then all are responses. Repeated rows each give a record. Payloads are not shuffled while the table of
    repeated digests is small enough to broadcast; adaptive execution decides by its measured size.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("http_length"))
    repeated = keyed.groupBy(F.col("sha1").alias("_sha1"), F.col("http_length").alias("_length")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("_length") >= min_bytes)).drop("n")
    joined = keyed.join(stored(repeated, "warc-repeated"), (F.col("sha1") == F.col("_sha1")) & (F.col("http_length") == F.col("_length")), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.col("sha1").alias("payload_sha1"),
        F.when(again, urn("first_id")).alias("refers_to"),
        "http_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    use_warc(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit, payloads verified."""
    use_warc(spark)
    records = spark.read.format("warc").schema("record_id string, record_type string, payload_digest string, refers_to string, http_length long").option("verify", "true").load(folder)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return records.where(F.col("record_type").isin("response", "revisit")).select(number("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    write_pages(pages, folder, min_bytes)
    return read_pages(pages.sparkSession, folder)
