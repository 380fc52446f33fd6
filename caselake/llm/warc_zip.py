"""WARC records in ZIP-packaged archives, written and read by range.

An archive is a ZIP file with a stored (uncompressed) WARC member and a stored
index member, in the manner of web archive collections. The reader never
extracts: it reads the end of the file, parses the end-of-central-directory
record and, where sizes need it, the ZIP64 locator, record and extra fields,
finds where the stored members' bytes begin, reads the index by range and then
each record by range.

Each writing task writes its archives under a name of its own into a folder
that all machines share and hands back their addresses once they are closed;
an attempt that fails leaves a file that nothing refers to.

Cases: a null payload is empty; an empty payload is a record like any other; a
null page_id or address is written as an absent header and read back as null; rows
that repeat the smallest page_id of a payload are all responses; line breaks in an address
are percent-encoded and stay so; an archive without an index, or with several WARC members, is walked
record by record; a missing or compressed member, a record without its headers, or a broken archive raises ValueError; an empty table gives no
archive and an empty result; further columns aren't written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, ship, spread, table

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.jsonl"
REVISIT = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 256 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- writing ---------------------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {kind}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


class Writer:
    """One archive, written front to back to a stream."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, record: bytes) -> None:
        self.index.append((self.size, len(record)))
        self.member.write(record)
        self.size += len(record)

    def close(self) -> None:
        self.member.close()
        lines = "".join(json.dumps({"offset": o, "length": n}) + "\n" for o, n in self.index)
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER, (1980, 1, 1, 0, 0, 0)), lines)
        self.zip.close()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path of an address; one without a scheme is a local path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the cluster's own file system where it names none."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-31T00:00:00Z", roll: int = ROLL_BYTES) -> DataFrame:
    """Write (page_id long, url string, payload binary, refers_to long) and return (uri, bytes, records) of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        store.create_dir(top, recursive=True)
        writer = stream = name = None
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            writer.close()
            stream.close()
            done.append((name, writer.size, len(writer.index)))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    stream = pa.PythonFile(store.open_output_stream(f"{top}/{name}"), mode="w")
                    writer = Writer(stream)
                page_id, url, payload, refers_to = row
                writer.add(record_bytes(page_id, url, payload or b"", refers_to, date))
                if writer.size >= roll:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done]), pa.array([d[1] for d in done]), pa.array([d[2] for d in done])], names=["uri", "bytes", "records"])

    return spread(records.select("page_id", "url", "payload", "refers_to")).mapInArrow(run, "uri string, bytes long, records long")


# -- reading ---------------------------------------------------------------------------------


class Range:
    """Reads parts of a file in any store that pyarrow knows, or of bytes."""

    def __init__(self, source: str | bytes):
        if isinstance(source, bytes):
            self.file = pa.BufferReader(source)
        else:
            store, path = opened(source)
            self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("the archive ends early")
        return self.file.read_at(n, at)


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored: int
    header: int


def directory(f: Range) -> list[Member]:
    """Members by the central directory, ZIP64 or not."""
    tail_size = min(f.size, 65_557)
    tail = f.read(f.size - tail_size, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > tail_size or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > tail_size):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    end = f.size - tail_size + at
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        sign, _, where, _ = struct.unpack("<4sIQI", f.read(end - 20, 20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        big = f.read(where, 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", big, 32)
    data, at, out = f.read(start, size), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        stored, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide, k = extra[4 : 4 + n], 0
                if plain == 0xFFFFFFFF:
                    plain, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                if stored == 0xFFFFFFFF:
                    stored, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", wide, k)[0]
            extra = extra[4 + n :]
        out.append(Member(name, method, plain, stored, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(f: Range, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed")
    head = f.read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def record_ranges(f: Range) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record: by the index member where there is one, else by walking each stored WARC member from header to header."""
    members = {m.name: m for m in directory(f)}
    archives = [m for name, m in members.items() if name.endswith(".warc")]
    if not archives:
        raise ValueError("no WARC member")
    if INDEX_MEMBER in members and len(archives) == 1:
        start, index = data_start(f, archives[0]), members[INDEX_MEMBER]
        for line in f.read(data_start(f, index), index.size).splitlines():
            entry = json.loads(line)
            yield start + entry["offset"], entry["length"]
        return
    for member in archives:
        at = data_start(f, member)
        stop = at + member.size
        while at < stop:
            n = walked(f, at, stop)
            yield at, n
            at += n


def walked(f: Range, at: int, stop: int) -> int:
    """Length of the record that begins at a place, with the blank line after it."""
    head, step = b"", 1024
    while b"\r\n\r\n" not in head:
        if at + len(head) >= stop:
            raise ValueError("a record without an end of its header")
        head += f.read(at + len(head), min(step, stop - at - len(head)))
    head = head.partition(b"\r\n\r\n")[0]
    size = next((x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if size is None or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    return len(head) + 4 + int(size) + 4


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    digest: str
    size: int
    payload: bytes | None


def parse_record(data: bytes) -> Record:
    """A record's parts; a response's size and digest come from its payload, a revisit's from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    if missing := {"Content-Length", "WARC-Type", "WARC-Payload-Digest"} - field.keys():
        raise ValueError(f"a record without {', '.join(sorted(missing))}")
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    page = lambda x: int(x.rsplit(":", 1)[1].rstrip(">")) if x else None
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or sha1_base32(payload) != digest:
            raise ValueError("a payload doesn't match its digest")
    return Record(page(field.get("WARC-Record-ID")), field.get("WARC-Target-URI"), kind, page(field.get("WARC-Refers-To")), digest, size, payload if kind == "response" else None)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives named in ``uri``: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                found = list(record_ranges(Range(uri)))
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["uri", "at", "n"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[str, Range] | None = None
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                got = []
                for uri, at, n in zip(*(c.to_pylist() for c in batch.slice(s, 256).columns), strict=True):
                    if open_ is None or open_[0] != uri:
                        open_ = (uri, Range(uri))
                    got.append(parse_record(open_[1].read(at, n)))
                columns = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64()), pa.array(columns[6] if payloads else [None] * len(got), pa.binary())],
                    names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"],
                )

    ship(archives.sparkSession)
    spots = spread(archives.select("uri")).mapInArrow(ranges, "uri string, at long, n long")
    wide = max(archives.sparkSession.sparkContext.defaultParallelism, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spots = spots.repartitionByRange(wide, "uri", "at").sortWithinPartitions("uri", "at")
    return spots.mapInArrow(records, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def with_revisits(pages: DataFrame, least: int = 0, most_broadcast: int = 200_000) -> DataFrame:
    """pages (page_id, url, payload binary) with refers_to: the smallest page_id of an equal payload of at least ``least`` bytes, null for that page itself.

    Revisits are broadcast up to ``most_broadcast`` of them, so that payloads stay where they are, and joined by key beyond.
    """
    keys = pages.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")).filter(F.col("size") >= least)
    first = keys.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = keys.join(first, ["sha", "size"]).filter("page_id <> first").select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    later = cut(later)
    few = later.limit(most_broadcast + 1).count() <= most_broadcast
    own = pages.withColumn("sha", F.sha1("payload"))
    return own.join(F.broadcast(later) if few else later, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").selectExpr("CAST(page_id AS long) AS page_id", "CAST(url AS string) AS url", "CAST(coalesce(html, '') AS binary) AS payload")
    written = cut(write_archives(with_revisits(pages), qualified(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")))
    return read_archives(written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
