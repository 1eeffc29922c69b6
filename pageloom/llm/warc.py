"""WARC records in seekable Zstandard bundles, written and read by Spark's own file sources.

A bundle is a file of independent frames, each holding whole records; then a skippable frame maps
record ids to (frame, offset in the frame, length); then the seek table of the seekable Zstandard
format gives every frame's size, so that one record costs one frame. Any zstd tool can read a bundle. Files are
written through Spark's commit protocol: a lost or repeated task leaves no half bundle.
"""

from __future__ import annotations

import hashlib
import json
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import attach, free_name

# Bytes of records in a frame, and of compressed frames in a bundle, before the next begins. A record is
# never cut, so a larger one has a frame to itself.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 23
# Payloads below this are always written out.
LEAST_SHARED = 100

# Fixed values of the Zstandard and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

RECORD = "record_id string, uri string, record_type string, digest string, payload binary, payload_bytes long, refers_to string"


# --- One record

# In place of an id that is null, in headers and in the index; ids themselves are percent-encoded.
NO_NAME, NO_INDEX_NAME = "<urn:none>", "%"


def _target(uri: str) -> list[str]:
    """The target's header lines: percent-encoded where it must be, and then also as it was."""
    encoded = urllib.parse.quote(uri, safe="".join(chr(c) for c in range(33, 127)))
    return [f"WARC-Target-URI: {encoded}", *([f"X-Original-Target: {json.dumps(uri)}"] if encoded != uri else [])]


def _urn(name: str | None) -> str:
    return NO_NAME if name is None else f"<urn:record:{urllib.parse.quote(name)}>"


def record_bytes(
    record_id: str | None, uri: str | None, kind: str | None, digest: str | None, payload: bytes | None, payload_bytes: int | None, refers_to: str | None, date: str,
) -> bytes:
    """One WARC/1.1 record. A revisit carries HTTP headers only, and the length of the payload it stands for.

    Without a kind it is a response; a digest and length not given are those of the payload, none counting as empty.
    """
    payload, kind = payload or b"", kind or "response"
    digest = hashlib.sha256(payload).hexdigest() if digest is None else digest
    payload_bytes = len(payload) if payload_bytes is None else payload_bytes
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {date}"]
    head += _target(uri) if uri is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(value: str | None) -> str | None:
    return None if value is None or value == NO_NAME else urllib.parse.unquote(value.removeprefix("<urn:record:").removesuffix(">"))


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at `at`, and where the next begins. A payload that does not have its digest is an error."""
    head, body = data.index(b"\r\n\r\n", at), data.index(b"\r\n\r\n", at) + 4
    fields = dict(line.split(": ", 1) for line in data[at:head].decode().split("\r\n")[1:])
    length = int(fields["Content-Length"])
    block = data[body : body + length]
    http = block.index(b"\r\n\r\n")
    payload_bytes = int(block[:http].decode().rpartition("Content-Length: ")[2])
    payload, digest, kind = block[http + 4 :], fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    uri, original = fields.get("WARC-Target-URI"), fields.get("X-Original-Target")
    return {
        "record_id": _name(fields["WARC-Record-ID"]), "uri": json.loads(original) if original else uri,
        "record_type": kind, "digest": digest, "payload": payload if kind == "response" else None,
        "payload_bytes": payload_bytes, "refers_to": _name(fields.get("WARC-Refers-To"))}, body + length + 4


# --- One bundle

class Bundle:
    """Gathers records into frames."""

    def __init__(self, level: int) -> None:
        self.packer, self.frames, self.sizes, self.index = zstandard.ZstdCompressor(level=level), [], [], []
        self.open, self.length, self.packed = [], 0, 0

    def add(self, record_id: str | None, record: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.length, len(record)))
        self.open.append(record)
        self.length += len(record)
        if self.length >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.length))
            self.open, self.length, self.packed = [], 0, self.packed + len(frame)

    def finish(self) -> bytes:
        """The whole file."""
        self._close_frame()
        lines = "".join(f"{frame} {offset} {length} {NO_INDEX_NAME if name is None else urllib.parse.quote(name)}\n" for name, frame, offset, length in self.index)
        index = self.packer.compress(lines.encode())
        index = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        table = b"".join(struct.pack("<II", *size) for size in [*self.sizes, (len(index), 0)])
        table += struct.pack("<IBI", len(self.sizes) + 1, 0, SEEKABLE)
        return b"".join([*self.frames, index, struct.pack("<II", SKIPPABLE_SEEK, len(table)), table])


class Reader:
    """Random access to one bundle's bytes."""

    def __init__(self, data: bytes) -> None:
        count, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        self.data, self.unpacker = data, zstandard.ZstdDecompressor()
        sizes = list(struct.iter_unpack("<II", data[-9 - 8 * count : -9]))
        self.starts, at = [], 0
        for packed, plain in sizes:
            self.starts.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.starts[number]
        return self.unpacker.decompress(self.data[at : at + packed], max_output_size=plain)

    def index(self) -> list[tuple[str | None, int, int, int]]:
        """(record id, frame, offset in the frame, length) of every record."""
        at, packed, _ = self.starts[-1]
        lines = self.unpacker.decompress(self.data[at + 8 : at + packed]).decode().split("\n")[:-1]
        parts = (line.split(" ", 3) for line in lines)
        return [(None if name == NO_INDEX_NAME else urllib.parse.unquote(name), int(frame), int(offset), int(length)) for frame, offset, length, name in parts]

    def records(self) -> Iterator[dict]:
        for number in range(len(self.starts) - 1):
            data, at = self.frame(number), 0
            while at < len(data):
                record, at = parse_record(data, at)
                yield record


# --- Spark

def with_revisits(records: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """`records` (id, digest, payload_bytes, any others) with record_type and refers_to.

    Of equal payloads of `least` bytes or more the record with the smallest id is the response and
    the others revisit it; rows that repeat that id are responses too, null ids come last. Smaller ones are all responses.
    """
    large = (F.col("payload_bytes") >= least) & F.col("digest").isNotNull()
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    same, first = free_name(records, "same"), free_name(records, "first")
    rows = attach(records.withColumn(same, key), [same], {first: (F.min("id"), F.min)}, ["id"])
    again = F.coalesce(large & ~F.col("id").eqNullSafe(F.col(first)), F.lit(False))
    return rows.withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col(first))}).drop(same, first)


def write_bundles(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """Write `records` (RECORD's columns; the payload of revisits is not written) as bundles under `path`, in the rows' order.

    Any column may be null: such ids come back as null, kinds as responses, digests and lengths as those of the payload. Rows
    may repeat; other columns are left out; an empty table gives a folder without bundles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(level)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([bundle.finish()[:-1]], pa.binary())], ["value"])
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                name, uri, kind, digest, payload, size, refers_to = (x.as_py() for x in row)
                bundle.add(name, record_bytes(name, uri, kind, digest, payload, size, refers_to, date))
                if bundle.packed >= BUNDLE_BYTES:
                    yield done()
                    bundle = Bundle(level)
        if bundle.index:
            yield done()

    columns = [part.split()[0] for part in RECORD.split(", ")]
    files = records.select(*columns).mapInArrow(run, "value binary")
    # A file per row: the text writer puts the bytes as they are, and its line end is the last byte of a bundle.
    writer = files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", chr(SEEKABLE >> 24)).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, path, frame, offset, length) of every record under `path`; no rows where there are no bundles.

    Spark's file source hands a bundle over whole: what the index saves is unpacking, and bundles are bounded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                rows = [(r, name.as_py(), *place) for r, *place in Reader(content.as_py()).index()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["record_id", "path", "frame", "offset", "length"])

    return _files(spark, path).mapInArrow(run, "record_id string, path string, frame long, offset long, length long")


def _batch(records: list[dict]) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
    names = [part.split()[0] for part in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], kinds.get(n, pa.string())) for n in names], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under `path` with RECORD's columns; the payload of a revisit is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                held, size = [], 0
                for record in Reader(content.as_py()).records():
                    held.append(record)
                    size += len(record["payload"] or b"")
                    if size >= BUNDLE_BYTES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return _files(spark, path).mapInArrow(run, RECORD)


def fetch(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The records whose record_id is in `ids`, unpacking only the frames that hold one.

    Ids asked for twice or unknown change nothing; a null id finds none; ids that repeat give all their records.
    """
    places = read_index(spark, path).join(ids.select("record_id").distinct(), "record_id", "left_semi")
    wanted = places.groupBy("path").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(*batch.columns, strict=True):
                reader, held, frame = Reader(content.as_py()), (-1, b""), -1
                for frame, offset in sorted((p["frame"], p["offset"]) for p in places.as_py()):
                    if held[0] != frame:
                        held = (frame, reader.frame(frame))
                    yield _batch([parse_record(held[1], offset)[0]])

    return _files(spark, path).join(wanted, "path").select("content", "places").mapInArrow(run, RECORD)
