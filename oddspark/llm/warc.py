"""WARC archives as a Spark data source, and pages written with revisit records for equal payloads."""

import contextlib
import hashlib
import io
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from oddspark.llm.shared import Work

#: Payloads below this size are always stored.
LEAST_REVISIT = 1000
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column -> header that it holds.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "date": "warc-date"}
READ = T.StructType([T.StructField(c, T.StringType()) for c in HEADERS] + [
    T.StructField("payload_length", T.LongType()), T.StructField("read_digest", T.StringType()),
    T.StructField("payload", T.BinaryType())])
WRITE = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType())])


def place(path: str):
    """The file system and the path on it. Plain paths are local."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def one_line(value: str) -> str:
    """A header value; line ends, which would end the header, are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(block: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field gives its length, so that readers can step over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(block) + packer.flush()
    length = 24 + len(body) + 8
    return (b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, length, len(block) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF))


def record(kind, identity, uri, refers_to, digest, payload, date) -> bytes:
    """One record; a revisit holds the HTTP head alone, whose length is that of the full payload."""
    payload = payload or b""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Date", date), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", digest and f"sha1:{digest}"), ("WARC-Refers-To", refers_to),
              ("WARC-Profile", PROFILE if kind == "revisit" else None),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + text.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of bounded size; only those of tasks that ended well are listed.

    A job writes below a folder of its own. What its lost or doubled attempts leave there is in no
    manifest, and is not taken for an archive that someone else put beside it.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.most = int(options.get("maxFileBytes", 128 << 20))
        self.date = options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = place(self.path)
        system.create_dir(posixpath.join(root, self.job), recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in zip(*[batch.column(c).to_pylist() for c in WRITE.names], strict=True):
                data = member(record(*row, self.date))
                if out is None or size + len(data) > self.most:
                    if out is not None:
                        out.close()
                    files.append([f"{self.job}/{uuid.uuid4().hex}.warc.gz", 0])
                    out, size = system.open_output_stream(
                        posixpath.join(root, files[-1][0]), compression=None), 0
                out.write(data)
                size += len(data)
                files[-1][1] = size
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        new = {name: size for m in messages if m is not None for name, size in m.files}
        old = dict(files_of(system, root))
        listed = [*({} if self.overwrite else old).items(), *new.items()]
        with system.open_output_stream(posixpath.join(root, MANIFEST)) as out:
            out.write(json.dumps(listed).encode())
        if self.overwrite:
            self.delete(old)

    def abort(self, messages) -> None:
        self.delete(name for m in messages if m is not None for name, _ in m.files)

    def delete(self, names) -> None:
        system, root = place(self.path)
        for name in names:
            with contextlib.suppress(FileNotFoundError):
                system.delete_file(posixpath.join(root, name))


def files_of(system, root: str) -> list[tuple[str, int]]:
    """Name and size: of the manifest, else of all archives in the folder; a file stands for itself."""
    here = system.get_file_info(root)
    if here.type == fs.FileType.File:
        return [("", here.size)]
    try:
        with system.open_input_file(posixpath.join(root, MANIFEST)) as listed:
            return [tuple(x) for x in json.loads(listed.read())]
    except FileNotFoundError:
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [(f.base_name, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz"))]


@dataclass
class Archive(InputPartition):
    name: str
    size: int


class Stream:
    """Reads an archive record by record; what isn't asked for is stepped over, not decoded."""

    def __init__(self, raw, size: int):
        self.raw, self.size = raw, size
        self.packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)

    def records(self, wanted, body: bool):
        """(headers, block or None) of the records whose headers are wanted.

        A gzip member that states its length holds one record, others are read to their end.
        """
        at = 0
        while at < self.size:
            self.raw.seek(at)
            source, length = self.opened(at)
            while (headers := parsed(source)) is not None:
                need, n = wanted(headers), int(headers.get("content-length", 0))
                block = source.read(n) if need and body else None
                if block is not None and len(block) < n:
                    raise ValueError(f"a record of {n} bytes ends after {len(block)}")
                if need:
                    yield headers, block
                if length:
                    break
                if block is None:
                    self.step(source, n)
            at = at + length if length else source.end() if self.packed else self.size

    def step(self, source, n: int) -> None:
        """Pass over ``n`` bytes, which must be there."""
        if self.packed:
            while n and (data := source.read(min(n, 1 << 20))):
                n -= len(data)
        elif (end := source.tell() + n) <= self.size:
            source.seek(end)
            n = 0
        if n:
            raise ValueError(f"a record lacks its last {n} bytes")

    def opened(self, at: int):
        if not self.packed:
            return self.raw, None
        head = self.raw.read(24)
        skip = head[3:4] == b"\x04" and head[12:14] == b"sl"
        length = struct.unpack("<I", head[16:20])[0] if skip else None
        self.raw.seek(at)
        return Inflated(self.raw, at), length


class Inflated:
    """The content of one gzip member, inflated as far as it is read."""

    def __init__(self, raw, at: int):
        self.raw, self.at, self.taken = raw, at, 0
        self.machine, self.ready = zlib.decompressobj(31), bytearray()

    def more(self, step: int) -> bool:
        data = self.machine.unconsumed_tail or self.raw.read(step)
        if not data or self.machine.eof:
            return False
        if not self.machine.unconsumed_tail:
            self.taken += len(data)
        self.ready += self.machine.decompress(data, max(step, 4096))
        return True

    def readline(self) -> bytes:
        while b"\n" not in self.ready and self.more(1024):
            pass
        end = self.ready.find(b"\n") + 1 or len(self.ready)
        line, self.ready = bytes(self.ready[:end]), self.ready[end:]
        return line

    def read(self, n: int) -> bytes:
        while len(self.ready) < n and self.more(1 << 16):
            pass
        data, self.ready = bytes(self.ready[:n]), self.ready[n:]
        return data

    def end(self) -> int:
        while not self.machine.eof and self.more(1 << 16):
            self.ready.clear()
        if not self.machine.eof:
            raise ValueError(f"the gzip member at byte {self.at} doesn't end")
        return self.at + self.taken - len(self.machine.unused_data)


def parsed(source) -> dict | None:
    """The header fields of the next record, names in lower case; None at the end."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    fields = {}
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def body_of(headers: dict, block: bytes) -> tuple[int | None, bytes | None]:
    """Length and bytes of the payload: what follows the HTTP head, or the block without one."""
    if not headers.get("content-type", "").startswith("application/http"):
        return len(block), block
    head, _, body = block.partition(b"\r\n\r\n")
    if headers.get("warc-type") != "revisit":
        return len(body), body
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            return int(value), None
    return None, None


class WarcReader(DataSourceReader):
    """One partition per file; filters on header columns are applied before a payload is touched."""

    def __init__(self, schema: T.StructType, options):
        self.path, self.names, self.tests = options["path"], schema.names, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                value = f.value if not isinstance(f, IsNotNull) else None
                self.tests.append((HEADERS[column], type(f).__name__, value))
            else:
                yield f

    def wanted(self, headers: dict) -> bool:
        for name, kind, value in self.tests:
            have = headers.get(name)
            if name == "warc-payload-digest" and have:
                have = have.removeprefix("sha1:")
            if have is None or (kind == "EqualTo" and have != value) or (
                    kind == "In" and have not in value) or (
                    kind == "StringStartsWith" and not have.startswith(value)):
                return False
        return True

    def partitions(self):
        return [Archive(*f) for f in files_of(*place(self.path))]

    def read(self, partition: Archive | None):
        if partition is None:  # Spark's stand-in for a folder without archives
            return
        system, root = place(self.path)
        path = posixpath.join(root, partition.name) if partition.name else root
        body = bool({"payload", "payload_length", "read_digest"} & set(self.names))
        with system.open_input_file(path) as raw:
            raw = io.BufferedReader(raw, 1 << 18)
            for headers, block in Stream(raw, partition.size).records(self.wanted, body):
                row = {c: headers.get(h) for c, h in HEADERS.items()}
                row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                if body:
                    row["payload_length"], payload = body_of(headers, block)
                    row["payload"] = payload
                    row["read_digest"] = None if payload is None else hashlib.sha1(payload).hexdigest()
                yield tuple(row.get(c) for c in self.names)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``.

    Give the reader a schema with fewer columns to keep it from decoding payloads at all.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return READ

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The records of pages (page_id, url, html), in the columns of ``WRITE``.

    Of equal payloads of ``least`` bytes or more, the page with the largest id is the response.
    Null html is an empty payload, a null url is left out of the header. Rows that repeat a page id
    with its payload are responses each; a null id refers to the largest, and is a response if all
    are null. Html of any length is one record, held whole by its task; it moves once, to meet its group.
    An empty table gives an empty archive. Other columns are not read.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    ready = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = (ready.where(F.octet_length("payload") >= least).groupBy("digest")
              .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return ready.join(groups.hint("merge"), "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        identity("page_id").alias("record_id"), F.col("url").alias("target_uri"),
        F.when(again, identity("first")).alias("refers_to"), F.col("digest").alias("payload_digest"),
        "payload")


def write_pages(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> None:
    register(pages.sparkSession)
    page_records(pages, least).write.format("warc").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page id, payload length and digest, record type and the page that a revisit refers to.

    The digest of a stored payload is computed from the bytes that were read, that of a revisit
    is the one in its header.
    """
    register(spark)
    columns = ["record_type", "record_id", "refers_to", "payload_digest", "payload_length", "read_digest"]
    read = spark.read.format("warc").schema(T.StructType([READ[c] for c in columns])).load(folder)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    return read.where(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.coalesce("read_digest", "payload_digest").alias("payload_digest"), "record_type",
        page("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back."""
    work = Work(pages.sparkSession, "warc")
    write_pages(pages, f"{work.path}/archives")
    return read_pages(pages.sparkSession, f"{work.path}/archives")
