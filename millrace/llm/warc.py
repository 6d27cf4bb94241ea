"""WARC archives in Zstandard with a dictionary in the leading skippable frame.

Writing: each archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; each record is one Zstandard frame with content size and checksum. Of pages with
equal payloads the one with the largest page_id is a response, the others are revisits of it.
The dictionary is trained on the first records of the archive, at most ``TRAIN_BYTES`` of
them; an archive too small to train one has none. A task writes under a name of its attempt
and renames when the archive is complete, so a lost executor leaves no half archive.

Reading: one frame per record; frame sizes, checksums, the WARC and HTTP lengths and the
payload digests are checked, and any fault raises.

Rows: one per page. Null html is an empty payload. Pages with equal ids and payloads are
responses alike when their id is the largest; a null page_id is revisited by none. An empty
table gives no archive and an empty result. Other columns of ``pages`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, shared_folder, text_slices

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 32 << 10
TRAIN_BYTES = 1 << 20
ARCHIVE_BYTES = 32 << 20  # compressed, after which the next archive starts
FEED = 16 << 10
OUT = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def plan_records(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``(page_id, url, html, sha1, refers_to)``; ``refers_to`` is null for responses.

    Only ids and digests are grouped; the texts move once, by page_id, so a payload that a
    third of all pages share does not gather in one task."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    narrow = rows.where(F.octet_length("html") >= min_payload).select("page_id", "sha1")
    largest = narrow.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "last")
    revisits = (narrow.join(largest, "sha1").where(~F.col("page_id").eqNullSafe(F.col("last"))).distinct()
                      .select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), F.col("last").alias("refers_to")))
    return (rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left")
                .select("page_id", "url", "html", "sha1", "refers_to"))


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, sha1: bytes, refers_to, date: str) -> bytes:
    """One WARC record. The HTTP head of a revisit keeps the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+\s*", " ", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Archive:
    """One archive being written: buffered until the dictionary is trained, then streamed."""

    def __init__(self, filesystem, folder: str, name: str, attempt: int):
        self.filesystem, self.final, self.held, self.size, self.records = filesystem, f"{folder}/{name}", [], 0, 0
        self.part, self.stream, self.written = f"{folder}/.{name}.{attempt}", None, 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.stream is not None:
            return self._write(self.compress.compress(data))
        self.held.append(data)
        self.size += len(data)
        if self.size >= TRAIN_BYTES:
            self._start()

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.written += len(data)

    def _start(self) -> None:
        trained = None
        if len(self.held) >= 64:
            try:
                trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.held, level=3)
            except zstandard.ZstdError:  # samples too few or too alike
                trained = None
        self.stream = self.filesystem.open_output_stream(self.part)
        if trained is not None:
            raw = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        for data in self.held:
            self._write(self.compress.compress(data))
        self.held = []

    def close(self) -> None:
        if self.stream is None:
            self._start()
        self.stream.close()
        self.filesystem.move(self.part, self.final)


def write_archives(records: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes ``plan_records`` rows below ``folder``; returns ``(archive, n_records, n_bytes)``."""
    filesystem, path = _filesystem(folder)
    filesystem.create_dir(path)

    def run(batches):
        from pyspark import TaskContext

        task, (filesystem, path) = TaskContext.get(), _filesystem(folder)
        archive, done = None, []
        for batch in batches:
            for part in text_slices(batch, "html"):
                for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if archive is None:
                        archive = _Archive(filesystem, path, f"part-{task.partitionId():05d}-{len(done):04d}.warc.zst", task.taskAttemptId())
                    archive.add(record(page_id, url, html.encode(), bytes.fromhex(sha1), refers_to, date))
                    if archive.written >= ARCHIVE_BYTES:
                        archive.close()
                        done.append(archive)
                        archive = None
        if archive is not None:
            archive.close()
            done.append(archive)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([a.final for a in done]), pa.array([a.records for a in done], pa.int64()),
                                              pa.array([a.written for a in done], pa.int64())], names=["archive", "n_records", "n_bytes"])

    return materialise(records.mapInArrow(run, "archive string, n_records bigint, n_bytes bigint"), "warc-manifest")


def read_frames(data: bytes):
    """The records of an archive, one per frame, decoded with its own dictionary."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8:8 + n])
        if len(raw) != n:
            raise ValueError("archive ends within its dictionary")
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + n
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if view[at:at + 4] != FRAME_MAGIC:
            raise ValueError(f"no Zstandard frame at byte {at}")
        frame, out = decoder.decompressobj(), []
        while not frame.eof:
            fed = view[at:at + FEED]
            if not fed:
                raise ValueError("archive ends within a frame")
            out.append(frame.decompress(fed))
            at += len(fed)
        at -= len(frame.unused_data)
        yield b"".join(out)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse_record(data: bytes) -> tuple:
    """``OUT`` of one record, its headers, lengths and digest checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != b"WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    h = _headers(lines[1:])
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{h['warc-record-id']}: the block has {len(rest) - 4} bytes, its header says {n}")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1.1 "):
        raise ValueError(f"{h['warc-record-id']}: no HTTP head")
    full = int(_headers(http.split(b"\r\n")[1:])["content-length"])
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
    page, refers = (re.fullmatch(r"<urn:page:(-?\d*)>", h.get(k, "<urn:page:>"))[1] for k in ("warc-record-id", "warc-refers-to"))
    if kind == "response":
        if len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{h['warc-record-id']}: the payload does not match its length or digest")
    elif kind != "revisit" or payload or h.get("warc-profile") != PROFILE:
        raise ValueError(f"{h['warc-record-id']}: not a response, nor a revisit of an equal payload")
    return (int(page) if page else None, h.get("warc-target-uri"), payload if kind == "response" else None, full, digest, kind, int(refers) if refers else None)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``OUT``; the payload is null for revisits."""
    files = (spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile")
                  .option("pathGlobFilter", "*.warc.zst").load(folder).select("content"))

    def run(batches):
        names = [f.split()[0] for f in OUT.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in read_frames(content.as_py()):
                    rows.append(parse_record(data))
                    held += len(data)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(run, OUT)


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(plan_records(pages, min_payload), folder)
    return read_archives(spark, folder)
