"""Zstandard WARC archives: one frame for each record behind a dictionary in the leading skippable frame.

Writing.  Equal payloads of at least `least` bytes share one response, that of the smallest page_id; the others revisit it.  Every
partition becomes one or more archives in the shared folder: a new one, with a dictionary of its own, begins as soon as the last holds `most`
bytes, so an archive holds at most that, its training sample (1 MiB) and one record, however large the partition.  Spark's text writer puts the frames down byte by byte and an empty
skippable frame between them (its eight bytes are the line separator), so the files are plain .zst and no executor touches a
local disk or a file API of its own.

Reading.  Archives come through the binaryFile source.  Frame borders are found from the block headers, each frame is
decompressed alone, must hold exactly one record, and the record is checked: version line, mandatory headers, Content-Length
against the block, the closing blank lines, block digest, HTTP length and payload digest.

Defined cases: a null html is an empty payload; payloads below `least` bytes are always responses; a null url becomes
urn:page:<id>; control characters in a url are percent-encoded; rows that repeat the response's page_id and payload are responses
too; a group without any page_id is all responses; an empty table gives no archives and no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, table

# Fixed values of the Zstandard and WARC formats.
_ZSTD_MAGIC = 0xFD2FB528
_SKIPPABLE = 0x184D2A50
_DICTIONARY = 0x184D2A5D
_BETWEEN = "P*M\x18\x00\x00\x00\x00"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string"


class WarcError(ValueError):
    """A record or frame that does not hold what its headers say."""


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}'.encode()).hexdigest()[:32])}>"


def build_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP headers of the payload and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}"]
    head += [f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> bytes | None:
    """A dictionary from the first records of an archive, or None where they are too few to train one."""
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes], sample_bytes: int = 1 << 20, dict_bytes: int = 16 << 10, level: int = 3, most: int = 64 << 20) -> Iterator[bytes]:
    """One archive: the dictionary frame, then a frame for each record until `most` bytes are written.  Only the first sample_bytes are held to train on; what is not written stays in records."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= sample_bytes:
            break
    trained = train_dictionary([x[: 64 << 10] for x in held], dict_bytes)
    if trained:
        yield struct.pack("<II", _DICTIONARY, len(trained)) + trained
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    written = 0
    for record in held:
        frame = pack.compress(record)
        written += len(frame)
        yield frame
    held.clear()
    while written < most and (record := next(records, None)) is not None:
        frame = pack.compress(record)
        written += len(frame)
        yield frame


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, from its headers alone."""
    if at + 8 > len(data):
        raise WarcError(f"the archive ends inside a frame header at byte {at}")
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == _SKIPPABLE:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == _ZSTD_MAGIC:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise WarcError(f"the archive ends inside the frame at byte {at}")
            block = data[end] | data[end + 1] << 8 | data[end + 2] << 16
            last, kind = bool(block & 1), block >> 1 & 3
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * (flags >> 2 & 1)
    else:
        raise WarcError(f"no frame starts at byte {at}")
    if end > len(data):
        raise WarcError(f"the archive ends inside the frame at byte {at}")
    return end


def records(content: bytes, max_record_bytes: int = 1 << 30) -> Iterator[tuple[int, bytes]]:
    """Offset and decompressed bytes of each record frame of an archive."""
    data, at, unpack = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        (magic,) = struct.unpack_from("<I", data, at)
        if magic == _DICTIONARY and at == 0:
            loaded = bytes(data[8:end])
            if loaded[:4] == struct.pack("<I", _ZSTD_MAGIC):
                loaded = zstandard.ZstdDecompressor().decompress(loaded, max_output_size=1 << 24)
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(loaded))
        elif magic == _ZSTD_MAGIC:
            known = zstandard.get_frame_parameters(bytes(data[at : min(end, at + 18)])).content_size
            if known < 1 << 60 and known > max_record_bytes:
                raise WarcError(f"the record at byte {at} has {known} bytes")
            try:
                stream = unpack.decompressobj()
                yield at, stream.decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise WarcError(f"the frame at byte {at} can't be decoded: {e}") from e
        at = end


def parse_record(record: bytes) -> dict:
    """Headers, checked against the block; payload is None for a revisit."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    first, *named = head.decode("utf-8", "replace").split("\r\n")
    if not sep or first not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("it does not begin with a WARC version and end its headers")
    headers = {}
    for line in named:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [x for x in _MANDATORY if x not in headers]:
        raise WarcError(f"headers missing: {', '.join(missing)}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) + 4 != len(rest):
        raise WarcError(f"Content-Length is {headers['content-length']}, the block and its end have {len(rest)} bytes")
    if rest[-4:] != b"\r\n\r\n":
        raise WarcError("two line ends must close the record")
    block = rest[:-4]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise WarcError("the block digest differs")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return headers | {"payload": block, "payload_bytes": len(block)}
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    stated = int(length[1]) if length else len(payload)
    if kind == "response":
        if stated != len(payload):
            raise WarcError(f"the HTTP length is {stated}, the payload has {len(payload)} bytes")
        if (said := headers.get("warc-payload-digest", "")).startswith("sha256:") and hashlib.sha256(payload).hexdigest() != said[7:]:
            raise WarcError("the payload digest differs")
    elif "warc-refers-to" not in headers:
        raise WarcError("a revisit must say what it refers to")
    return headers | {"payload": payload if kind == "response" else None, "payload_bytes": stated}


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set for revisits."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = shared.where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = rows.join(shared, rows["digest"] == shared["d"], "left")
    revisit = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 100, date: str = "2024-01-01T00:00:00Z", most: int = 64 << 20) -> None:
    """Writes the planned records, a partition after another into archives of about `most` bytes: <path>/archive=<number in its partition>/<part>."""

    def run(batches):
        def each():
            for batch in batches:
                for row in batch.to_pylist():
                    yield build_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date)

        def batch(number: int, first: int, held: list[bytes]) -> pa.RecordBatch:
            places = pa.array(range(first, first + len(held)), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([number] * len(held), pa.int32()), places, pa.array(held, pa.binary())], names=["archive", "place", "frame"])

        waiting, number, place = each(), 0, 1
        while place:
            held, place, size = [], 0, 0
            for frame in frames(waiting, most=most):
                held.append(frame)
                size += len(frame)
                if len(held) == 256 or size > 1 << 22:
                    yield batch(number, place, held)
                    held, place, size = [], place + len(held), 0
            yield batch(number, place, held)
            place += len(held)
            number += 1

    framed = plan_records(pages, least).mapInArrow(run, "archive int, place long, frame binary").sortWithinPartitions("archive", "place")
    framed.select("archive", F.col("frame").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", _BETWEEN).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under path; a bad frame or record raises an error that names archive and byte."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for at, record in records(content.as_py()):
                    try:
                        x = parse_record(record)
                    except WarcError as e:
                        raise WarcError(f"{name}, byte {at}: {e}") from e
                    number = lambda key: int(x[key]) if key in x else None  # noqa: E731,B023
                    held.append((number("x-page-id"), x.get("warc-target-uri"), x["payload_bytes"], x.get("warc-payload-digest", "").removeprefix("sha256:"), x["warc-type"], number("x-refers-to-page-id"), x["payload"] if payloads else None, name))
                    size += len(record)
                    if size > 1 << 23:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    return found.mapInArrow(run, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FIELDS.split(", ")])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p
), g AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
"""
