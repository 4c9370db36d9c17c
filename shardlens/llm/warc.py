"""Web archives compressed record by record with a dictionary: a writer, and a reader that validates."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlens.llm.common import bounded_sample, map_batches, staged
from shardlens.session import run_folder

# Fixed by the archive format: the magic number of the skippable frame that holds the dictionary.
DICT_FRAME = 0x184D2A5D
DICT_BYTES, DICT_SAMPLE = 64 * 1024, 400
CHUNK = 1 << 20
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class BadArchive(ValueError):
    """An archive that breaks the format; the message names the file and the record."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str):
    """The file system of a path and the path there; ``file:/x`` and plain paths are local."""
    if re.match(r"file:/(?!/)", path):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _line(text: str | None) -> str:
    """A header value: nothing that could end the line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Refers-To: <urn:page:{'' if first is None else first}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of up to 64 KiB; with too little to learn from, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or VERSION


def write_archives(batches: Iterator[pa.RecordBatch], folder: str, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Writes one archive per task.  Its name carries the attempt: only files that a finished task returned are read."""
    from pyspark import TaskContext

    at = TaskContext.get()
    path = f"{folder}/pages-{at.partitionId():06d}-{at.taskAttemptId()}.warc.zst"
    store, inner = _open(path)
    made, out = 0, None
    level = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
    for batch in batches:
        columns = [batch[c] for c in ("page_id", "url", "html", "_first", "_revisit")]
        for page_id, url, html, first, revisit in ((v.as_py() for v in row) for row in zip(*columns)):
            if out is None:
                out = store.open_output_stream(inner, compression=None)
                out.write(struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary)
            payload = (html or "").encode()
            out.write(level.compress(record(page_id, url, payload, payload_digest(payload), first, revisit)))
            made += 1
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([made], pa.int64())})


def _frames(path: str) -> Iterator[bytes]:
    """The decompressed frames of an archive after its dictionary, read in chunks."""
    store, inner = _open(path)
    with store.open_input_stream(inner, compression=None) as source:
        head = source.read(8)
        magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        if magic != DICT_FRAME:
            raise BadArchive(f"{path}: no dictionary frame at the start")
        dictionary = source.read(size)
        if len(dictionary) != size:
            raise BadArchive(f"{path}: the dictionary frame is cut off")
        engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        rest, number = b"", 0
        while rest or (rest := source.read(CHUNK)):
            frame, parts = engine.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := source.read(CHUNK)):
                    raise BadArchive(f"{path}: frame {number} is cut off")
                try:
                    parts.append(frame.decompress(rest))
                except zstandard.ZstdError as e:
                    raise BadArchive(f"{path}: frame {number}: {e}") from e
                rest = frame.unused_data if frame.eof else b""
            yield b"".join(parts)
            number += 1


def _headers(block: bytes, where: str) -> tuple[str, dict[str, str], bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive(f"{where}: no end of headers")
    first, *lines = head.decode().split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"{where}: header without a colon")
        fields[name.strip().lower()] = value.strip()
    return first, fields, body


def _number(fields: dict[str, str], where: str) -> int:
    value = fields.get("content-length", "")
    if not value.isdigit():
        raise BadArchive(f"{where}: Content-Length is {value!r}")
    return int(value)


def _page(urn: str, where: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
    if not found:
        raise BadArchive(f"{where}: record id {urn!r}")
    return int(found[1]) if found[1] else None


def parse_record(frame: bytes, where: str) -> dict:
    """The record of one frame, with version, fields, lengths and digest checked."""
    version, fields, body = _headers(frame, where)
    if version.encode() != VERSION:
        raise BadArchive(f"{where}: version {version!r}")
    if missing := {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"} - fields.keys():
        raise BadArchive(f"{where}: without {sorted(missing)}")
    size = _number(fields, where)
    if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        raise BadArchive(f"{where}: the block has {len(body) - 4} bytes, not {size}, or no end mark")
    kind = fields["warc-type"]
    status, http, payload = _headers(body[:size], where)
    length, digest = _number(http, where), fields["warc-payload-digest"].removeprefix("sha1:")
    if not status.startswith("HTTP/1.1 ") or kind not in ("response", "revisit"):
        raise BadArchive(f"{where}: {kind} with status {status!r}")
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise BadArchive(f"{where}: payload length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise BadArchive(f"{where}: revisit with a payload, or without its response")
    return {
        "page_id": _page(fields["warc-record-id"], where),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"], where) if kind == "revisit" else None,
        "url": fields.get("warc-target-uri", ""),
        "payload": payload,
    }


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
TYPES = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("url", pa.string())]
)


def read_archives(batches: Iterator[pa.RecordBatch], with_payload: bool = False) -> Iterator[pa.RecordBatch]:
    """Streams the archives named in ``path``; each must hold ``records`` records."""
    types = TYPES.append(pa.field("payload", pa.binary())) if with_payload else TYPES
    for batch in batches:
        for path, records in zip(batch["path"].to_pylist(), batch["records"].to_pylist()):
            rows, number, held = [], 0, 0
            for number, frame in enumerate(_frames(path), 1):
                row = parse_record(frame, f"{path}: record {number}")
                rows.append({name: row[name] for name in types.names})
                held += len(frame) if with_payload else 200
                if held > 8 * CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)
                    rows, held = [], 0
            if number != records:
                raise BadArchive(f"{path}: {number} records, not {records}")
            yield pa.RecordBatch.from_pylist(rows, schema=types)


def write_warc(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder; returns their ``path`` and ``records``.

    Of records with equal payloads the one with the smallest ``page_id`` (nulls last; repeated rows: the first in the
    input) is a response, the others revisit it, however small.  A null html is an empty payload.  Other columns are
    ignored; an empty table makes no archive.

    The rows are written once with a number and their digest.  Equal payloads are found on digests alone, and only
    those with more than one record are joined back, from a table whose size Spark knows.  The dictionary comes from a
    bounded sample (about ``DICT_SAMPLE`` pages).
    """
    spark = pages.sparkSession
    rows = staged(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            "url",
            F.coalesce("html", F.lit("")).alias("html"),
        ).select("*", F.sha1("html").alias("_sha"), F.monotonically_increasing_id().alias("_row")),
        "warc-pages",
    )
    sample = bounded_sample(rows.select("page_id", "url", F.substring("html", 1, 20_000).alias("html")), DICT_SAMPLE)
    dictionary = train_dictionary([record(r.page_id, r.url, r.html.encode(), "", None, False) for r in sample])
    rank = F.struct(F.col("page_id").isNull().alias("gone"), F.col("page_id").alias("page_id"), F.col("_row").alias("row"))
    repeated = (
        rows.groupBy("_sha")
        .agg(F.min(rank).alias("_least"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("_sha", F.col("_least.page_id").alias("_first"), F.col("_least.row").alias("_first_row"))
    )
    marked = rows.join(staged(repeated, "warc-repeated"), "_sha", "left").select(
        "page_id", "url", "html", "_first", F.coalesce(F.col("_row") != F.col("_first_row"), F.lit(False)).alias("_revisit")
    )
    folder = run_folder(spark, "warc")
    store, inner = _open(folder)
    store.create_dir(inner, recursive=True)
    made = map_batches(marked, lambda batches: write_archives(batches, folder, dictionary), "path string, records long")
    return staged(made, "warc-manifest")


def read_warc(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives that ``write_warc`` returned; a broken archive raises ``BadArchive``."""
    schema = SCHEMA + (", payload binary" if with_payload else "")
    spread = archives.repartition(archives.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(lambda batches: read_archives(batches, with_payload), schema)
