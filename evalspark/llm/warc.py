"""WARC archives in Zstandard with a dictionary: writer, reader, and duplicate payloads as revisit records.

An archive is a sequence of frames.  The first is a skippable frame that holds the dictionary; then each
record is one Zstandard frame of its own.  Spark's text writer stores the frames through its commit
protocol on any file system; its line separator is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import P, cut, hashed_sample

#: Fixed values of the archive format: magic of the dictionary's skippable frame, and of dictionary and frame.
DICT_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: An empty skippable frame; every byte is ASCII, so it can be a line separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, error string"


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): refers_to names the least page_id
    of the pages with the same payload of at least ``MIN_REVISIT`` bytes, and is null for that page
    itself (and for its repeated rows) and for small payloads.  A page without an id never is the one referred to; it
    refers to the least page_id like any other copy, or to none if no copy has an id.

    Equal payloads are grouped by length and SHA-256 after partial aggregation; only narrow rows meet
    the winners, so a payload that holds a third of the pages is split by AQE, not collected.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest")
    )
    big = p.where(F.col("payload_bytes") >= MIN_REVISIT)
    nameless = F.max(F.col("page_id").isNull()).alias("nameless")
    groups = big.groupBy("payload_bytes", "payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), nameless)
    winners = groups.where((F.col("last") > F.col("first")) | (F.col("first").isNotNull() & F.col("nameless")))
    j = p.join(winners.select("payload_bytes", "payload_digest", "first"), ["payload_bytes", "payload_digest"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return j.select("page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def train_dictionary(pages: DataFrame, samples: int = 256, max_bytes: int = 32_768, size: int = 32_768) -> bytes:
    """Dictionary from about ``samples`` pages of at most ``max_bytes``, chosen by a hash of page_id
    (about 8 MB at most reach the driver).  Too few pages: their bytes as they are."""
    few = pages.where(F.octet_length("html").between(1, max_bytes)).select("page_id", "html")
    rows = hashed_sample(few, ["page_id"], samples, few.select("page_id").count()).limit(2 * samples).collect()
    rows.sort(key=lambda r: (r.page_id is None, r.page_id, r.html))
    texts = [r.html.encode() for r in rows]
    if len(texts) >= 32:
        try:
            return zstandard.train_dictionary(size, texts).as_bytes()
        except zstandard.ZstdError:  # samples too alike to train on
            pass
    return b"".join(texts)[-size:] or b"<!DOCTYPE html><html><head></head><body></body></html>"


def skippable(payload: bytes) -> bytes:
    return DICT_MAGIC + len(payload).to_bytes(4, "little") + payload


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def header_value(value: str) -> str:
    """A value on one line: control characters, blanks at the ends and % are percent-encoded."""
    text = "".join(c if " " <= c != "%" and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)
    return "%20" + text[1:] if text.startswith(" ") else text


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head (with the payload's length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}"]
    head.append(f"WARC-Date: {date}")
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> None:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as archives under ``path``.

    One archive per partition of the pages joined with their winners: the session's partition sizes
    (``spark.sql.files.maxPartitionBytes``, AQE's advisory size) bound an archive, and payloads cross at
    most one shuffle (none if the winners are broadcast).  A very long page is one record in any case.
    An empty table writes archives without records.
    """
    rows = classify(pages.select("page_id", "url", "html"))
    dictionary = train_dictionary(pages)
    frame_of, encode = skippable, build_record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary)
        z = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
        first = [frame_of(zstandard.ZstdCompressor(level=level).compress(dictionary))]
        for b in batches:
            cols = [b.column(i) for i in range(6)]
            frames, held = first, 0
            first = []
            for i in range(b.num_rows):
                page, url, html, _, digest, refers = (c[i].as_py() for c in cols)
                f = z.compress(encode(page, url, html.encode("utf-8"), refers, digest, date))
                frames.append(f)
                held += len(f)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
                    frames, held = [], 0
            if frames:
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary())], names=["frame"])

    frames = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.mode("overwrite").option("lineSep", SEPARATOR).option("compression", "none").text(path)


def frames_of(data: bytes) -> Iterator[tuple[bytes | None, bytes, str | None]]:
    """(dictionary, decoded record, error) for each frame of an archive after the leading dictionary.

    One decoder object per record finds where its frame ends.  Bytes that are no frame end the archive
    with an error; a frame that can't be decoded is reported and ends it too, as its end is unknown.
    """
    dictionary, at, n = None, 0, len(data)
    view = memoryview(data)
    while at < n:
        magic = data[at : at + 4]
        if len(magic) == 4 and 0x50 <= magic[0] <= 0x5F and magic[1:] == DICT_MAGIC[1:]:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            body = data[at + 8 : at + 8 + size]
            if len(body) < size or n < at + 8:
                yield None, b"", "skippable frame is cut off"
                return
            if magic == DICT_MAGIC and dictionary is None:
                if body[:4] == FRAME_MAGIC:
                    body = zstandard.ZstdDecompressor().decompress(body)
                dictionary = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            yield None, b"", "bytes that are no frame"
            return
        d = (dictionary or zstandard.ZstdDecompressor()).decompressobj()
        parts, step = [], 1 << 16
        try:
            while not d.eof and at < n:
                piece = view[at : at + step]
                parts.append(d.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as e:
            yield None, b"", f"frame can't be decoded: {e}"
            return
        if not d.eof:
            yield None, b"", "frame is cut off"
            return
        at -= len(d.unused_data)
        yield None, b"".join(parts), None


def parse_record(raw: bytes) -> dict:
    """Headers, lengths and digest of one record, checked; ``error`` says what is wrong with it."""
    out = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error"))
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in lines[1:]) if s}

    def number(text: str | None, prefix: str) -> int | None:
        body = (text or "")[len(prefix) : -1]
        return int(body) if body.lstrip("-").isdigit() else None

    problems = []
    if not sep or not lines[0].startswith("WARC/1."):
        problems.append("no WARC head")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            problems.append(f"no {name}")
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        problems.append("Content-Length does not match the block")
    block = rest[:-4]
    http, gap, payload = block.partition(b"\r\n\r\n")
    declared = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    size = int(declared[0]) if declared and declared[0].isdigit() else None
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if not gap or size is None:
        problems.append("no HTTP head with a length")
    elif kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        problems.append("payload does not match its length or digest")
    elif kind == "revisit" and (payload or "warc-refers-to" not in fields):
        problems.append("revisit with a payload or without its target")
    elif kind not in ("response", "revisit"):
        problems.append(f"record type {kind}")
    out |= {
        "page_id": number(fields.get("warc-record-id"), "<urn:page:"), "payload_bytes": size, "payload_digest": digest or None,
        "record_type": kind, "refers_to": number(fields.get("warc-refers-to"), "<urn:page:"), "url": fields.get("warc-target-uri"),
        "error": "; ".join(problems) or None,
    }
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path`` (columns ``RECORD``); damaged frames give a row
    with ``error`` alone.  One archive is one row of Spark's binary reader, so its size bounds memory."""
    files = spark.read.format("binaryFile").load(path).select("content")
    split, parse = frames_of, parse_record
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for _, raw, error in split(content.as_py()):
                    rows.append(dict.fromkeys(names) | {"error": error} if error else parse(raw))
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, RECORD)


def check_revisits(records: DataFrame) -> DataFrame:
    """``records`` with an error on each revisit whose target is no response of the same length and digest."""
    targets = records.where((F.col("record_type") == "response") & F.col("error").isNull()).select(
        F.col("page_id").alias(f"{P}id"), F.col("payload_bytes").alias(f"{P}n"), F.col("payload_digest").alias(f"{P}d")
    ).distinct()
    on = (F.col("refers_to") == F.col(f"{P}id")) & (F.col("payload_bytes") == F.col(f"{P}n")) & (F.col("payload_digest") == F.col(f"{P}d"))
    j = records.join(targets, on, "left")
    lost = (F.col("record_type") == "revisit") & F.col(f"{P}id").isNull()
    return j.withColumn("error", F.coalesce("error", F.when(lost, "revisit of no known response"))).drop(f"{P}id", f"{P}n", f"{P}d")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives, read them back, check them; one row per page."""
    write_archives(pages, path)
    return check_revisits(cut(read_archives(pages.sparkSession, path)))

