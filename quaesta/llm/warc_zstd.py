"""WARC in Zstandard (operator 4): writer and reader of dictionary-compressed archives.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary;
then every record is one frame. The reader loads the dictionary from that frame, finds
each frame's end by its block headers, decodes frame by frame, and checks headers, lengths,
checksums and digests. Archives end at a bounded size, so a task holds one at a time.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put_file, shared_dir, written

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
MIN_REVISIT_BYTES = 100
#: Raw bytes after which an archive ends; at most one record more.
ARCHIVE_BYTES = 16 << 20
#: Rows the dictionary is fitted on, and characters of each: a documented bound, it changes sizes only.
SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES = 256, 8192, 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary fitted on samples, empty where they are too few."""
    samples = [s for s in samples if len(s) >= 64]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True, write_content_size=True)


def header_value(text: str) -> str:
    """A header value: control characters, ``%`` and anything outside ASCII as ``%XX`` of UTF-8."""
    return "".join(chr(b) if 33 <= b < 127 and b != 37 else f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(buf: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by its block headers."""
    if len(buf) - at < 6 or struct.unpack_from("<I", buf, at)[0] != FRAME_MAGIC:
        raise WarcError(f"no frame at byte {at}")
    checksum = bool(buf[at + 4] & 4)
    pos = at + zstandard.frame_header_size(bytes(buf[at : at + 18]))
    last = False
    while not last:
        if pos + 3 > len(buf):
            raise WarcError(f"frame at byte {at} is cut short")
        head = buf[pos] | buf[pos + 1] << 8 | buf[pos + 2] << 16
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError(f"reserved block type at byte {pos}")
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * checksum
    if pos > len(buf):
        raise WarcError(f"frame at byte {at} is cut short")
    return pos


def read_dictionary(buf: memoryview) -> tuple[bytes, int]:
    """Dictionary of the leading skippable frame (itself compressed or not) and where records start."""
    if len(buf) < 8 or struct.unpack_from("<I", buf, 0)[0] != DICT_MAGIC:
        return b"", 0
    size = struct.unpack_from("<I", buf, 4)[0]
    if 8 + size > len(buf):
        raise WarcError("the dictionary frame is cut short")
    raw = bytes(buf[8 : 8 + size])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
    return raw, 8 + size


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, validated."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    head = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"malformed header line {line[:60]!r}")
        head[name.decode("ascii").lower()] = value.strip().decode("ascii")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in head:
            raise WarcError(f"header {need} is missing")
    if not head["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    size = int(head["content-length"])
    if len(raw) != end + 4 + size + 4 or raw[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length differs from the record's length")
    return head, raw[end + 4 : end + 4 + size]


def read_archive(content: bytes):
    """Records of one archive, ``(headers, http_head, payload)`` each; raises WarcError where it breaks the format."""
    buf = memoryview(content)
    dictionary, at = read_dictionary(buf)
    decode = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(buf):
        if len(buf) - at >= 8 and struct.unpack_from("<I", buf, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", buf, at + 4)[0]
            continue
        end = frame_end(buf, at)
        try:
            raw = decode.decompressobj().decompress(bytes(buf[at:end]))
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        head, block = parse_record(raw)
        cut = block.find(b"\r\n\r\n")
        if head["warc-type"] in ("response", "revisit") and cut < 0:
            raise WarcError("no HTTP head")
        payload = block[cut + 4 :]
        if head["warc-type"] == "response" and head.get("warc-payload-digest", "") != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise WarcError(f"payload digest of {head['warc-record-id']} differs")
        yield head, block[: cut + 4], payload
        at = end


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Which record each page becomes: ``page_id, url, payload, digest, kind, refers_to``.

    Only digests are grouped (partial minima, one row a digest); of them only repeated
    ones are joined back.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    shared = p.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("d", "least")
    again = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return p.join(shared, p["digest"] == shared["d"], "left").select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("least")).alias("refers_to")
    )


def _write(folder: str, dictionary: bytes):
    def run(batches):
        from pyspark import TaskContext

        part, seq, frames, raw_size = TaskContext.get().partitionId(), 0, [], 0
        packer, done = _compressor(dictionary), []

        def flush():
            nonlocal seq, frames, raw_size
            uri = f"{folder}/part-{part:06d}-{seq:05d}.warc.zst"
            body = zstandard.ZstdCompressor(level=3).compress(dictionary) if dictionary else b""
            lead = struct.pack("<II", DICT_MAGIC, len(body)) + body if dictionary else b""
            put_file(uri, lambda out: (out.write(lead), [out.write(f) for f in frames]))
            done.append((uri, len(frames)))
            seq, frames, raw_size = seq + 1, [], 0

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page, url, payload, digest, kind, refers = (x.as_py() for x in row)
                frames.append(packer.compress(raw := record_bytes(page, url, payload, digest, kind, refers)))
                raw_size += len(raw)
                if raw_size >= ARCHIVE_BYTES:
                    flush()
        if frames:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write pages as archives below ``folder`` (a store that pyarrow can write); returns the manifest ``archive, records``.

    A retried or repeated task writes the same files under the same names. Null html is an empty payload; a null
    url leaves its header out; a null page_id is written as ``none`` and never is a revisit's target. Of pages
    with equal payloads and the smallest id, repeated rows are all responses. An empty table writes nothing.
    """
    html = F.substring(F.col(columns.get("html_col", "html")).cast("string"), 1, SAMPLE_CHARS)
    sample = [bytes(r[0]) for r in pages.select(F.encode(html, "utf-8")).where(html.isNotNull()).limit(SAMPLE_ROWS).collect()]
    # in one order whatever the joins' fetches did: a retried task cuts its archives where the lost one did
    records = plan_records(pages, **columns).sortWithinPartitions("digest", "page_id", "url")
    return written(records.mapInArrow(_write(folder, train_dictionary(sample)), "archive string, records long"), "manifest")


def _read(batches):
    names = ["record_id", "record_type", "url", "payload", "payload_digest", "payload_bytes", "refers_to"]
    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for head, http, payload in read_archive(content.as_py()):
                full = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                if full is None or (head["warc-type"] == "response" and full != len(payload)):
                    raise WarcError(f"HTTP Content-Length of {head['warc-record-id']} differs")
                rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), payload, head.get("warc-payload-digest", "")[7:], full, head.get("warc-refers-to")))
                size += len(payload)
                if size > 4 << 20:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)


def read_archives(spark, path: str) -> DataFrame:
    """Records of all ``*.warc.zst`` below ``path``, read by Spark, one archive in a task's memory at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(
        _read, "record_id string, record_type string, url string, payload binary, payload_digest string, payload_bytes long, refers_to string"
    )


def archive_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Archives written and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per page."""
    spark = pages.sparkSession
    folder = shared_dir(spark) + "/warc"
    if write_archives(pages, folder, **columns).limit(1).count() == 0:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return read_archives(spark, folder).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to")
    )
