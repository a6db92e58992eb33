"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle ends with the seek table of the public
seekable Zstandard format (a skippable frame with the sizes of all frames), so any frame can be found and read alone. An
index maps each record to its bundle, frame and offset inside the frame. Of records with equal payloads of at least
LEAST bytes the one with the smallest page_id is a response and the others are revisits that refer to it.

Bundles go to the cluster's shared folder under names of their own for each attempt; the index, written by Spark, names
only those of attempts that ended well, so a lost executor leaves at most files that nothing reads. Folders are opened
by pyarrow; the schemes that only Hadoop knows by another name are translated (s3a, s3n: s3).

A revisit carries no payload. What is said of it when it is read comes from the response that it refers to, whose payload
was hashed; a revisit without such a response is an error.

Defined cases: a null html is an empty payload; a null page_id is written as `null` and comes after all others; a null
url leaves out the target line; rows that repeat the smallest page_id with its payload are all responses; payloads under
LEAST bytes are always responses; an empty table makes no bundle.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_arrow, scratch_path, slices, stored, table

LEAST = 100
FRAME, BUNDLE = 128 << 10, 64 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, offset long, length long"


#: Hadoop's names of object stores, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), urlsplit(path).path
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def planned(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest, record_type and refers_to."""
    body = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    keys = named.where(F.col("bytes") >= LEAST).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    later = F.col("first").isNotNull() & (F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)))
    # small payloads refer to nothing: a key of their own deals them out, however many are equal
    key = F.when(F.col("bytes") >= LEAST, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = named.withColumn("key", key).join(keys, F.col("key") == F.col("d"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    name = "null" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


class BundleWriter:
    """Appends records; a frame ends once it holds FRAME bytes. Memory: one frame."""

    def __init__(self, folder: str, frame: int = FRAME):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.frame, self.held, self.size, self.frames = frame, [], 0, []
        self.written = 0
        self.coder = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int]:
        at = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame:
            self._end()
        return at

    def _end(self) -> None:
        packed = self.coder.compress(b"".join(self.held))
        self.out.write(packed)
        self.written += len(packed)
        self.frames.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._end()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    def __init__(self, path: str):
        system, name = file_system(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        start = size - 9 - n * width
        head, length = struct.unpack("<II", self._at(start - 8, 8))
        if head != SKIPPABLE or length != n * width + 9:
            raise ValueError(f"{path}: broken seek table")
        raw = self._at(start, n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", raw, k * width)
            self.frames.append((at, packed, plain))
            at += packed
        self.coder = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        at, packed, _ = self.frames[k]
        return self.coder.decompress(self._at(at, packed))

    def close(self) -> None:
        self.file.close()


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(fields["Content-Length"])
    block = data[start : start + size]
    return fields, block[block.index(b"\r\n\r\n") + 4 :], start + size + 4


def write(pages: DataFrame, folder: str, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Write the archives; lazily returns the index, which must be evaluated once (stored)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, []

        def index() -> pa.RecordBatch:
            ids, frames, offsets, lengths = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([writer.name] * len(rows)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "bundle", "frame", "offset", "length"])

        for batch in slices(batches, "html", 4 << 20):
            for page_id, url, html, digest, kind, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")), strict=True):
                writer = writer or BundleWriter(folder, frame)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, kind, refers_to)
                rows.append((page_id, *writer.add(data), len(data)))
                if writer.written >= bundle:
                    writer.close()
                    yield index()
                    writer, rows = None, []
        if writer:
            writer.close()
            yield index()

    return map_arrow(planned(pages), task, INDEX)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def _row(fields: dict[str, str], payload: bytes) -> tuple:
    said, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response":
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != said or size != int(fields["X-Payload-Length"]):
            raise ValueError(f"{fields['WARC-Record-ID']}: payload does not match its digest")
    return _id(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), said, kind, _id(fields["WARC-Refers-To"]) if kind == "revisit" else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def records(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the index's bundles as it stands there, frame by frame; response payloads are checked against their digests."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                reader = BundleReader(f"{folder}/{name}")
                for k in range(len(reader.frames)):
                    data, at, rows = reader.frame(k), 0, []
                    while at < len(data):
                        fields, payload, at = parse(data, at)
                        rows.append(_row(fields, payload))
                    yield _batch(rows)
                reader.close()

    names = index.select("bundle").distinct()
    return map_arrow(names.repartition(max(1, names.count()), "bundle"), task, _READ)


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every record with the size and digest of its full payload: a revisit's are those found for the response it refers to."""
    found = stored(records(index, folder), "warc-records")
    responses = found.where(F.col("record_type") == "response")
    whole = responses.select(F.col("page_id").alias("of"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).distinct()
    revisits = found.where(F.col("record_type") == "revisit").join(whole, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("n")), "left")
    broken = F.raise_error(F.concat(F.lit("no response of this payload for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    checked = lambda c, e: F.when(F.col("of").isNotNull(), F.col(c)).otherwise(broken.cast(e))
    return responses.unionByName(revisits.select("page_id", checked("n", "long").alias("payload_bytes"), checked("d", "string").alias("payload_digest"), "record_type", "refers_to"))


def _fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """page_id, payload, digest and refers_to of the index rows wanted: only their frames are read, one after another."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader, held, data = None, None, None, b""
        for batch in batches:
            for name, k, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset")), strict=True):
                if name != last:
                    if reader:
                        reader.close()
                    last, reader, held = name, BundleReader(f"{folder}/{name}"), None
                if k != held:
                    held, data = k, reader.frame(k)
                fields, payload, _ = parse(data, offset)
                page_id, _, digest, kind, refers_to = _row(fields, payload)
                yield pa.RecordBatch.from_arrays([pa.array([page_id], pa.int64()), pa.array([payload if kind == "response" else None], pa.binary()), pa.array([digest]), pa.array([refers_to], pa.int64())], ["page_id", "payload", "digest", "refers_to"])
        if reader:
            reader.close()

    placed = wanted.select("bundle", "frame", "offset").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return map_arrow(placed, task, "page_id long, payload binary, digest string, refers_to long")


def lookup(wanted: DataFrame, folder: str, index: DataFrame | None = None) -> DataFrame:
    """page_id and payload of the index rows wanted. Given the whole index, a revisit's payload is that of the response it refers to; without it, null."""
    found = _fetch(wanted, folder)
    if index is None:
        return found.select("page_id", "payload")
    found = stored(found, "warc-found")
    named = found.where(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("of")).distinct()
    referred = index.join(named, F.col("page_id") == F.col("of"), "left_semi")
    whole = _fetch(referred, folder).where(F.col("payload").isNotNull()).select(F.col("page_id").alias("of"), F.col("digest").alias("d"), F.col("payload").alias("p")).dropDuplicates(["of", "d"])
    out = found.join(whole, (F.col("refers_to") == F.col("of")) & (F.col("digest") == F.col("d")), "left")
    return out.select("page_id", F.coalesce("payload", "p").alias("payload"))


def query(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = stored(write(table(spark, sf_dir, "pages"), folder), "warc-index")
    return read(index, folder)


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from f
"""
