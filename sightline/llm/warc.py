"""WARC archives in the Zstandard form: a dictionary in the leading skippable frame, then one frame per record.

write_archives() turns payload rows into archive files and returns one row per archive; read_archives() reads them
back, checks every frame, header, length and digest, and returns one row per record. Files are opened through
pyarrow's file systems, so the folder may be local (one machine), a shared mount or an object store.

Defined cases: a null payload is an empty one; a null uri is written as an empty target; an empty table gives an empty
result and no file; rows may repeat or tie in anything, `record_id` included: a record is written and read back for each row,
and the rows of one id and payload get the same decision; further columns of the input are ignored. Rows with a null
record_id, any number of them, are written in full under a name of their own and read back with a null record_id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import ragged
from sightline.runtime import delete_at_exit, materialize, shared_dir

#: Magic number of the skippable frame that holds the dictionary, as the Zstandard WARC convention fixes it.
DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads below this many bytes are always written in full.
REVISIT_BYTES = 1000
#: Archives are closed beyond this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Bytes of payload and of dictionary that a task's first records give the dictionary trainer.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 32 << 10
#: What the name of a record without an id begins with.
UNNUMBERED = "null-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "archive string, records long, bytes long"
RECORD = "record_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class ArchiveError(ValueError):
    """An archive breaks the format or a record's headers don't fit its block."""


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path)
    return pafs.FileSystem.from_uri(uri)


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_bytes(record_id: int | None, uri: str, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC record, headers and block; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{UNNUMBERED + uuid.uuid4().hex if record_id is None else record_id}>",
        f"WARC-Target-URI: {' '.join(uri.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: {sha1_label(digest)}",
        f"WARC-Block-Digest: {sha1_label(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on sample records; where they are too few or too alike for that, their beginning is one as it is."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b"".join(samples)[:DICTIONARY_BYTES]
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class ArchiveWriter:
    """Appends records to one archive; the name is final only after close()."""

    def __init__(self, folder: str, dictionary: bytes) -> None:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = file_system(self.name)[0].open_output_stream(file_system(self.name)[1])
        packed = zstandard.ZstdCompressor(level=3).compress(dictionary) if dictionary else b""
        self.bytes = self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.records = 0

    def add(self, record: bytes) -> None:
        self.bytes += self.out.write(self.packer.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.name, self.records, self.bytes


def read_archive(stream) -> Iterator[bytes]:
    """Each record's bytes: the dictionary of the leading skippable frame, then a frame a record.

    The stream is read in blocks, so an archive's size doesn't bound memory; a record's size does.
    """
    head = stream.read(8)
    if len(head) < 8:
        raise ArchiveError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ArchiveError("the leading frame isn't a dictionary frame")
    packed = stream.read(size)
    if len(packed) != size:
        raise ArchiveError("the dictionary is cut short")
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=1 << 26) if packed else b""
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest = b""
    while True:
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            block = rest or stream.read(1 << 20)
            rest = b""
            if not block:
                if parts:
                    raise ArchiveError("the last frame is cut short")
                return
            try:
                parts.append(frame.decompress(block))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"bad frame: {e}") from e
        rest = frame.unused_data
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """The fields of a record after its version, lengths, trailer and digests have been checked."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ArchiveError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ArchiveError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "content-length", "warc-payload-digest", "warc-block-digest"} - fields.keys():
        raise ArchiveError(f"missing headers {sorted(missing)}")
    block, tail = rest[: (size := int(fields["content-length"]))], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ArchiveError(f"{len(rest) - 4} bytes of block under a length of {size}")
    if sha1_label(hashlib.sha1(block).digest()) != fields["warc-block-digest"]:
        raise ArchiveError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(":")[2]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    named = lambda name: fields[name].removeprefix("<urn:record:").removesuffix(">")
    number = lambda name: None if named(name).startswith(UNNUMBERED) else int(named(name))
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or sha1_label(hashlib.sha1(payload).digest()) != fields["warc-payload-digest"]):
        raise ArchiveError("payload doesn't fit its length or digest")
    if kind == "revisit" and (payload or fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields):
        raise ArchiveError("bad revisit record")
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"unknown type {kind!r}")
    return {
        "record_id": number("warc-record-id"), "uri": fields.get("warc-target-uri", ""), "record_type": kind,
        "refers_to": number("warc-refers-to") if kind == "revisit" else None, "payload_bytes": length,
        "payload_digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), "payload": None if kind == "revisit" else payload,
    }


def with_revisits(df: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(record_id, uri, payload, refers_to): which record holds each payload.

    Only (digest, length, id) are shuffled for the decision, pre-aggregated to one row per payload and task, and only
    digests found twice come back; bodies meet the decision on their id and digest, so no group of copies meets in a task.
    """
    digest, size = F.sha1(F.coalesce("payload", F.encode(F.lit(""), "utf-8"))).alias("digest"), F.coalesce(F.octet_length("payload"), F.lit(0)).alias("size")
    keyed = df.select("record_id", digest, size).filter(F.col("size") >= least)
    chosen = keyed.groupBy("digest", "size").agg(F.max("record_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "size", "refers_to")
    decided = keyed.join(chosen, ["digest", "size"]).filter("record_id <> refers_to").select("record_id", "digest", "refers_to").distinct()
    return df.select("record_id", "uri", "payload", digest).join(decided, ["record_id", "digest"], "left").drop("digest")


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """Write (record_id, uri, payload, refers_to) rows; returns one row per finished archive.

    A task that is run again writes other files; only the names in the returned rows count, so lost executors
    neither lose nor double a record. The result has to be materialized before it is read twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer, first, held = [], None, [], 0

        def flush() -> None:
            nonlocal writer, first, held
            if first and writer is None:
                writer = ArchiveWriter(folder, train_dictionary(first))
            for r in first:
                writer.add(r)
            first, held = [], 0

        for b in batches:
            for i, u, p, ref in zip(*(b[c].to_pylist() for c in ("record_id", "uri", "payload", "refers_to")), strict=True):
                body = p or b""
                record = record_bytes(i, u or "", body, hashlib.sha1(body).digest(), ref)
                if writer is None:
                    first.append(record)
                    held += len(record)
                    if held >= SAMPLE_BYTES:
                        flush()
                else:
                    writer.add(record)
                if writer is not None and writer.bytes >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        flush()
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), d, strict=True)) for d in done], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return ragged.map_batches(df.select("record_id", "uri", "payload", "refers_to"), write, WRITTEN)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives named by `archives`; payloads=False leaves the bodies behind after their checks."""
    schema = pa.schema([("record_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, expected in zip(b["archive"].to_pylist(), b["records"].to_pylist(), strict=True):
                fs, path = file_system(name)
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(path) as stream:
                    for record in read_archive(stream):
                        row = parse_record(record)
                        seen += 1
                        held += len(record) if payloads else 200
                        rows.append(row if payloads else row | {"payload": None})
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if seen != expected:
                    raise ArchiveError(f"{name}: {seen} of {expected} records")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ragged.map_batches(archives.select("archive", "records"), read, RECORD)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write a record per page, read the archives back, one digest row per page."""
    rows = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    written = materialize(write_archives(with_revisits(rows), folder), "warc-index")
    files = max(1, written.count())
    spread = written.repartition(min(files, 100_000), "archive")
    return read_archives(spread, payloads=False).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("uri").alias("url"))
