"""WARC archives as a Spark data source, read and written.

``spark.read.format("warc").load(folder)`` plans partitions of whole files, about
``split_bytes`` each. Comparisons on the columns that come from a record's headers
are pushed down: a record's headers are parsed first, and a record that they rule
out is skipped without inflating or decoding its payload. Compressed records
that this module wrote state their own length, so that skipping is a seek.

Written files have one gzip member for each record and go below the given folder
under names of their own. When a job commits, the files of its successful tasks are
listed in one ``manifest-*.txt``; a reader takes the files of all manifests, so
what failed or repeated tasks leave behind is never read. A folder without a
manifest is read as its ``.warc`` and ``.warc.gz`` files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from pagetab.llm.common import scratch, stored

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
    "content_type string, content_length long, http_status int, http_type string, payload_length long, payload binary"
)
_ARROW = pa.schema([
    *((n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "content_type")),
    ("content_length", pa.int64()), ("http_status", pa.int32()), ("http_type", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary()),
])
#: Columns that a record's own headers give, which decide before its block is read.
_FROM_HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_CHUNK = 1 << 16
#: Bytes of payloads that make a batch.
_BATCH = 8 << 20


# ---------------------------------------------------------------- records


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: object) -> bytes:
    """A header; control characters in the value are percent-encoded, so that it stays one line."""
    text = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in str(value))
    return f"{name}: {text}\r\n".encode()


def record_bytes(row: dict) -> bytes:
    """One record from record_type, record_id, target_uri, date, refers_to, http_type, payload, payload_digest, payload_length."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["payload_length"] if revisit else len(payload)
    http = b"HTTP/1.1 200 OK\r\n" + _line("Content-Type", row["http_type"] or "text/html; charset=utf-8") + _line("Content-Length", length) + b"\r\n"
    block = http if revisit else http + payload
    head = [b"WARC/1.1\r\n", _line("WARC-Type", row["record_type"]), _line("WARC-Record-ID", row["record_id"]), _line("WARC-Date", row["date"])]
    if row["target_uri"] is not None:
        head.append(_line("WARC-Target-URI", row["target_uri"]))
    head.append(_line("WARC-Payload-Digest", "sha1:" + (row["payload_digest"] if revisit else digest_of(payload))))
    if revisit:
        head += [_line("WARC-Profile", _REVISIT), _line("WARC-Refers-To", row["refers_to"])]
    head += [_line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", len(block)), b"\r\n"]
    return b"".join(head) + block + _END


def gzip_member(record: bytes, level: int = 4) -> bytes:
    """``record`` as a gzip member whose extra field ``sl`` states the member's and the record's length."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    return (
        b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body
        + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    )


class _Plain:
    """Records of an uncompressed file: bytes from where the file stands."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def open(self) -> bool:
        return self.file.tell() < self.size

    def read(self, n: int) -> bytes:
        return self.file.read(n)

    def skip(self, n: int) -> None:
        self.file.seek(min(self.file.tell() + n, self.size))

    def close(self, read_to: int) -> None:
        """Nothing more belongs to this record than was read."""


class _Gzip:
    """Records of a compressed file, a member each; only what is asked for is inflated."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at = file, file.size(), 0

    def open(self) -> bool:
        if self.at >= self.size:
            return False
        self.file.seek(self.at)
        head = self.file.read(24)
        self.length = int.from_bytes(head[16:20], "little") if head[3:4] == b"\x04" and head[12:14] == b"sl" else None
        self.file.seek(self.at)
        self.inflate, self.rest, self.eaten = zlib.decompressobj(31), b"", 0
        return True

    def read(self, n: int) -> bytes:
        out, left = [], n
        while left and not self.inflate.eof:
            data = self.rest or self.file.read(_CHUNK)
            if not self.rest:
                self.eaten += len(data)
            got = self.inflate.decompress(data, left)
            if not data and not got:
                break
            self.rest = self.inflate.unconsumed_tail
            out.append(got)
            left -= len(got)
        return b"".join(out)

    def skip(self, n: int) -> None:
        if self.length is None:
            while n > 0 and (got := self.read(min(n, _CHUNK))):
                n -= len(got)

    def close(self, read_to: int) -> None:
        if self.length is None:
            while not self.inflate.eof and self.read(_CHUNK):
                pass
            if not self.inflate.eof:
                raise ValueError("a compressed record ends early")
            self.length = self.eaten - len(self.inflate.unused_data)
        self.at += self.length


def _headers(block: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    last = ""
    for line in block.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            found[last] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def records(file: pa.NativeFile, packed: bool, wanted: callable, payloads: bool = True) -> Iterator[dict]:
    """The records of an open file that ``wanted(headers)`` admits, by the names of ``SCHEMA``."""
    source = _Gzip(file) if packed else _Plain(file)
    while source.open():
        buffer, searched = b"", 0
        while (end := buffer.find(_END, searched)) < 0:
            searched = max(0, len(buffer) - 3)
            more = source.read(max(1024, len(buffer) // 2))  # headers may be long: a URL has no limit
            if not more:
                if buffer.strip():
                    raise ValueError("a record's headers end early")
                break
            buffer += more
            if not packed and buffer[:1] in (b"\r", b"\n"):
                buffer, searched = buffer.lstrip(b"\r\n"), 0
        if end < 0:
            source.close(0)
            continue
        if not buffer.startswith(b"WARC/"):
            raise ValueError("not a record")
        head = _headers(buffer[:end])
        length = int(head.get("content-length", 0))
        left = length - (len(buffer) - end - 4)  # below zero: already in the next record
        if not wanted(head):
            if left >= 0:
                source.skip(left)
            elif not packed:
                file.seek(file.tell() + left)
            source.close(length)
            continue
        block = buffer[end + 4: end + 4 + length]
        http = b""
        is_http = head.get("content-type", "").startswith("application/http")
        if is_http or payloads:
            while left > 0 and (payloads or _END not in block):
                more = source.read(left if payloads else min(left, 1024))
                if not more:
                    raise ValueError("a record's block ends early")
                block, left = block + more, left - len(more)
        if left < 0 and not packed:
            file.seek(file.tell() + left)
        elif left > 0:
            source.skip(left)
        source.close(length)
        yield _row(head, block, length, is_http, payloads)


def _row(head: dict[str, str], block: bytes, length: int, is_http: bool, payloads: bool) -> dict:
    row = {c: head.get(h) for c, h in _FROM_HEADERS.items()} | {"content_length": length, "http_status": None, "http_type": None}
    payload, stated = block, None
    if is_http:
        http, _, payload = block.partition(_END)
        fields = _headers(http)
        status = http.split(b" ", 2)[1:2]
        row["http_status"] = int(status[0]) if status and status[0].isdigit() else None
        row["http_type"] = fields.get("content-type")
        stated = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
    revisit = row["record_type"] == "revisit"
    row["payload_length"] = stated if revisit or not payloads else len(payload)
    row["payload"] = payload if payloads and not revisit else None
    return row


# ---------------------------------------------------------------- data source


def _files(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the archives of ``path``: a file, a folder with manifests or a plain folder."""
    fs, at = pafs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = {f.path: f.size for f in fs.get_file_info(pafs.FileSelector(at, recursive=False)) if f.type == pafs.FileType.File}
    manifests = [p for p in found if p.rsplit("/", 1)[-1].startswith("manifest-")]
    if manifests:
        listed = []
        for p in sorted(manifests):
            with fs.open_input_stream(p) as f:
                listed += [f"{at.rstrip('/')}/{name}" for name in f.read().decode().split("\n") if name]
        return [(prefix + p, found[p]) for p in sorted(listed)]
    return [(prefix + p, n) for p, n in sorted(found.items()) if p.endswith((".warc", ".warc.gz"))]


def _open(uri: str) -> pa.NativeFile:
    fs, at = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(at)


def _test(f: Filter) -> callable | None:
    """A test on one header value for a pushed filter; None if it can't be pushed."""
    if isinstance(f, Not):
        inner = _test(f.child)
        if inner is None:
            return None
        # a null is neither equal nor unequal
        null_counts = isinstance(f.child, IsNull | IsNotNull | EqualNullSafe)
        return lambda v: not inner(v) if null_counts or v is not None else False
    simple = {
        EqualTo: lambda v: v is not None and v == f.value, EqualNullSafe: lambda v: v == f.value, In: lambda v: v is not None and v in f.value,
        IsNull: lambda v: v is None, IsNotNull: lambda v: v is not None,
        StringStartsWith: lambda v: v is not None and v.startswith(f.value),
        StringEndsWith: lambda v: v is not None and v.endswith(f.value), StringContains: lambda v: v is not None and f.value in v,
    }
    return simple.get(type(f))


def _column(f: Filter) -> str:
    while isinstance(f, Not):
        f = f.child
    return ".".join(f.attribute)


@dataclass
class Files(InputPartition):
    """Whole files that one task reads."""

    files: tuple[str, ...]

    def __init__(self, files: tuple[str, ...]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", 16 << 20))
        self.payloads = str(options.get("payloads", "true")).lower() != "false"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) is not Filter and _test(f) is not None and _column(f) in _FROM_HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, files, held = [], [], 0
        for uri, size in _files(self.path):
            if files and held + size > self.split_bytes:
                out.append(Files(tuple(files)))
                files, held = [], 0
            files.append(uri)
            held += size
        return [*out, Files(tuple(files))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests = [(_FROM_HEADERS[_column(f)], _test(f)) for f in self.filters]
        wanted = lambda head: all(test(head.get(name)) for name, test in tests)
        rows, held = [], 0
        for uri in partition.files:
            with _open(uri) as file:
                for row in records(file, uri.endswith(".gz"), wanted, self.payloads):
                    rows.append(row)
                    held += 512 + len(row["payload"] or b"")
                    if held >= _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


@dataclass
class Wrote(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_type, record_id, target_uri, date, refers_to, http_type, payload, payload_digest, payload_length."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll_bytes = int(options.get("roll_bytes", 256 << 20))
        self.packed = str(options.get("compression", "gzip")).lower() != "none"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        fs, at = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(at, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    data = record_bytes(batch.slice(i, 1).to_pylist()[0])
                    data = gzip_member(data) if self.packed else data
                    if out is None or size >= self.roll_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                        out, size = fs.open_output_stream(f"{at.rstrip('/')}/{names[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Wrote(tuple(names))

    def commit(self, messages: list[Wrote | None]) -> None:
        fs, at = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(at, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        with fs.open_output_stream(f"{at.rstrip('/')}/manifest-{uuid.uuid4().hex}.txt") as f:
            f.write("".join(f"{n}\n" for n in names).encode())

    def abort(self, messages: list[Wrote | None]) -> None:
        """Unlisted files are never read."""


class WarcSource(DataSource):
    """Format ``warc``; options: path, split_bytes, payloads (false: none are decoded), roll_bytes, compression (gzip, none)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are added to, never overwritten")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let its filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The records below ``path``; may be used in any number of queries.

    A relation of a Python source keeps the predicates of the last query that pushed
    any, for later queries that push none. So this one always has a predicate, true of
    every record, and each query states its own anew. With the bare format, load again
    for each query.
    """
    register(spark)
    return spark.read.format("warc").options(**options).load(path).where("content_length IS NOT NULL")


# ---------------------------------------------------------------- pages to archives


def page_records(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, date: Column | None = None,
) -> DataFrame:
    """The records to write for ``pages``: response, or revisit of the smallest id with an equal payload.

    Payloads are UTF-8 (null: empty). Payloads under ``min_bytes`` bytes are always
    responses. Rows that share the smallest id of a payload are all responses, so a
    repeated row doesn't refer to itself; null ids come last and revisit the
    smallest id, or are responses where every id is null. A null URL gives a record
    without one. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), (date if date is not None else F.lit("1970-01-01T00:00:00Z")).alias("date"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    light = pages.select(F.col(id_col).alias("id"), payload.alias("payload")).select("id", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    first = light.where(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1").select("sha1", "bytes", "first"), f"{folder}/first")
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:row:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.join(first, ["sha1", "bytes"], "left").withColumn("again", revisit).select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), urn(F.col("id")).alias("record_id"),
        F.col("url").alias("target_uri"), "date", F.when(F.col("again"), urn(F.col("first"))).alias("refers_to"),
        F.lit("text/html; charset=utf-8").alias("http_type"), F.when(~F.col("again"), F.col("payload")).alias("payload"),
        F.when(F.col("again"), F.col("sha1")).alias("sha1"), F.col("bytes").alias("payload_length"))


def _base32(hex40: Column) -> Column:
    """Upper-case base 32 of 40 hex digits, five digits to four characters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(hex40, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_pages(pages: DataFrame, path: str, compression: str = "gzip", **names: object) -> None:
    """Write ``pages`` as archives below ``path``; see ``page_records``."""
    spark = pages.sparkSession
    register(spark)
    rows = page_records(pages, scratch(spark, "warc-first"), **names)
    rows = rows.withColumn("payload_digest", _base32(F.col("sha1"))).drop("sha1")
    rows.write.format("warc").option("compression", compression).mode("append").save(path)


def archived_pages(pages: DataFrame, **names: object) -> DataFrame:
    """Write ``pages``, read the archives back: (id, payload_bytes, payload_digest, record_type, refers_to).

    Sizes and digests of responses are computed from the payloads read, those of
    revisits come from their headers. Ids are whole numbers or null. An empty table
    gives an empty table.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_pages(pages, path, **names)
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:row:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    whole = F.col("record_type") == "response"
    return read_warc(spark, path).select(
        number("record_id").alias("id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, _base32(F.sha1("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"))
