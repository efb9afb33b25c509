"""WARC archives of pages: written as segments of bounded size, read back and put together.

Writing: equal payloads are stored once (one response, the others revisit it). A payload gets
chunked transfer framing; a block beyond the segment size is cut into a first record and
continuation records. An archive ends after a fixed number of records, which are no longer than
a segment, so archives are bounded whatever the pages are. Spark's text writer ends each record
with the blank line that the format asks for, so archives go to any file system Spark can write
to; payloads are shuffled once, and archives are written where they land.

Reading: each archive is parsed by its Content-Length fields. Unsegmented records are decoded
where they are read; only segments are shuffled, grouped by the id of their origin, ordered by
number and checked against the total length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, materialise, read, release_memory, slices

SEGMENT_BYTES, CHUNK_BYTES = 16 << 10, 4 << 10
ARCHIVE_RECORDS = 1000  # about 17 MB at most
BATCH_BYTES = 4 << 20  # of blocks, handed on at a time
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, type string, target string, page_id long, refers_id string, digest string, "
    "origin string, segment long, total long, block binary"
)
PAGE_SCHEMA = "record_id string, type string, target string, page_id long, refers_id string, digest string, complete boolean, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Transfer framing: hexadecimal length, line end, that many bytes, line end; closed by a zero length."""
    parts = [b"%x\r\n%b\r\n" % (len(part := payload[i:i + size]), part) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """Payload of a framed body (extensions and trailers are passed over); None if the framing breaks off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"x", 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 2 + size + 2


def http_payload(block: bytes) -> bytes | None:
    """Payload of an HTTP response; None if it has no end of header or breaks off."""
    head, split, body = block.partition(b"\r\n\r\n")
    if not split:
        return None
    framed = any(h.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for h in head.split(b"\r\n")[1:])
    return unchunked(body) if framed else body


def _record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in fields if value is not None]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def _records_of(row: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of a page: a revisit, a response, or a response and its continuations."""
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    target = None if row["url"] is None else quote(row["url"], safe="%:/?#[]@!$&'()*+,;=~-._")
    about = [("WARC-Target-URI", target), ("WARC-Page-ID", row["page_id"]), ("WARC-Payload-Digest", f"sha1:{digest}"),
             ("Content-Type", "application/http;msgtype=response")]
    response = _urn("response", row["digest"]) if row["shared"] else _urn("response", row["digest"], row["page_id"], row["copy"])
    if row["payload"] is None:
        about += [("WARC-Refers-To", response), ("WARC-Profile", PROFILE)]
        yield _record("revisit", _urn("revisit", row["digest"], row["page_id"], row["url"], row["copy"]), HTTP_HEAD, about)
        return
    block = HTTP_HEAD + chunked(row["payload"], chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record("response", response, block, about)
        return
    yield _record("response", response, block[:segment_bytes], [*about, ("WARC-Segment-Number", 1)])
    starts = range(segment_bytes, len(block), segment_bytes)
    for n, start in enumerate(starts, 2):
        fields = [("WARC-Segment-Origin-ID", response), ("WARC-Segment-Number", n),
                  ("WARC-Segment-Total-Length", len(block) if n == len(starts) + 1 else None)]
        yield _record("continuation", _urn(response, n), block[start:start + segment_bytes], fields)


def _to_records(segment_bytes: int, chunk_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                for record in _records_of(row, segment_bytes, chunk_bytes):
                    held.append(record)
                    size += len(record)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    return write


def planned(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """One row per record: page_id, url, digest, copy, shared, payload (null for a revisit).

    Of equal payloads of ``revisit_from`` bytes or more, the page with the smallest id (null last,
    then the smallest url) is the response. Payloads move once, reduced to one per digest and
    task before; everything about revisits is narrow.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= revisit_from)
    rank = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    first = large.groupBy("digest").agg(F.min_by(F.struct("page_id", "url", "payload"), rank).alias("row"))
    responses = first.select("row.page_id", "row.url", "digest", F.lit(0).cast("bigint").alias("copy"), F.lit(True).alias("shared"), "row.payload")
    # Rows that repeat all of page, url and payload are counted and numbered again; the first of the response's is the response.
    counted = large.groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    chosen = large.groupBy("digest").agg(F.min(rank).alias("rank"))
    is_first = (F.col("rank.page_id").eqNullSafe(F.col("page_id"))) & (F.col("rank.url").eqNullSafe(F.col("url")))
    others = counted.join(chosen, "digest").select(
        "page_id", "url", "digest", F.when(is_first, F.col("n") - 1).otherwise(F.col("n")).alias("n")
    ).where(F.col("n") > 0)
    thousands = others.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("n") - 1, F.lit(1000)))))
    revisits = thousands.select(
        "page_id", "url", "digest",
        F.explode(F.sequence(F.col("t") * 1000 + 1, F.least(F.col("t") * 1000 + 1000, F.col("n")))).alias("copy"),
        F.lit(True).alias("shared"), F.lit(None).cast("binary").alias("payload"),
    )
    out = responses.unionByName(revisits)
    if revisit_from > 0:
        small = rows.where(F.octet_length("payload") < revisit_from).withColumn("shared", F.lit(False))
        out = out.unionByName(small.withColumn("copy", F.monotonically_increasing_id()))
    return out


def write_archives(
    pages: DataFrame, path: str, revisit_from: int = 0, archive_records: int = ARCHIVE_RECORDS,
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Archives (gzip) in ``path``, one record per row of ``pages`` (page_id, url, html) and its continuations.

    Null html is an empty payload; null page_id and url are left out of the record; other columns
    are ignored. Equal payloads of at least ``revisit_from`` bytes are stored once; rows that
    repeat page_id, url and html are a response and revisits like any other. No page gives no
    record. A page may be as long as a row can be; its segments go to different archives.
    """
    records = planned(pages, revisit_from).mapInArrow(_to_records(segment_bytes, chunk_bytes), "record binary")
    (
        records.select(F.col("record").cast("string").alias("value")).write
        .options(lineSep=END, compression="gzip", maxRecordsPerFile=archive_records).text(path)
    )


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; an archive that breaks off inside a record is an error."""
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        if at > len(archive):
            raise ValueError(f"record at byte {start} breaks off")
        yield fields, archive[start:at]
        at += 4


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _parsed(segments: bool):
    schema = pa.schema([
        *[(c, pa.string()) for c in ("record_id", "type", "target")], ("page_id", pa.int64()),
        *[(c, pa.string()) for c in ("refers_id", "digest", "origin")], ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "content"):
            for content in batch.column("content"):
                for fields, block in parse(content.as_buffer().to_pybytes()):
                    if ("warc-segment-number" in fields) != segments:
                        continue
                    record = fields.get("warc-record-id")
                    held.append((
                        record, fields.get("warc-type"), fields.get("warc-target-uri"), _number(fields.get("warc-page-id")),
                        fields.get("warc-refers-to"), (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        fields.get("warc-segment-origin-id", record), _number(fields.get("warc-segment-number")),
                        _number(fields.get("warc-segment-total-length")), block,
                    ))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
        release_memory()

    return run


def read_records(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    """Records of the archives in ``path`` that are (or aren't) segments of a larger one, as ``RECORD_SCHEMA``."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed(segments), RECORD_SCHEMA)


def joined(parts: list[dict]) -> bytes | None:
    """Block of segments in order; None unless they run from 1 without a hole and have the total length together.

    A segment found twice counts once.
    """
    by_number = {p["segment"]: p for p in reversed(parts)}
    numbers = sorted(by_number)
    if numbers != list(range(1, len(numbers) + 1)):
        return None
    block = b"".join(by_number[n]["block"] for n in numbers)
    return block if by_number[numbers[-1]]["total"] == len(block) else None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PAGE_SCHEMA`` of records with their whole block, or with the list of their segments."""
    names = ("record_id", "type", "target", "page_id", "refers_id", "digest")
    schema = pa.schema([*[(c, pa.int64() if c == "page_id" else pa.string()) for c in names], ("complete", pa.bool_()), ("payload", pa.binary())])
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            out = []
            for row in batch.slice(start, 256).to_pylist():
                block = joined(row["parts"]) if "parts" in row else row["block"]
                payload = None if block is None or row["type"] != "response" else http_payload(block)
                complete = block is not None if row["type"] == "revisit" else payload is not None and sha1_base32(payload) == row["digest"]
                out.append((*[row[c] for c in names], complete, payload if complete else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    release_memory()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``PAGE_SCHEMA`` of the responses and revisits in the archives of ``path``.

    ``complete`` is false, and the payload null, where segments are missing, lengths or framing
    don't fit, or the payload's digest isn't the stated one. A segment group without its first
    record has null fields besides its id. Revisits have no payload. No records give no rows.
    """
    wanted = F.col("type").isin("response", "revisit")
    single = read_records(spark, path, segments=False).where(wanted)
    first = F.col("segment") == 1
    groups = (
        read_records(spark, path, segments=True).groupBy(F.col("origin").alias("record_id"))
        .agg(
            *[F.max(F.when(first, F.col(c))).alias(c) for c in ("type", "target", "page_id", "refers_id", "digest")],
            F.collect_list(F.struct("segment", "total", "block")).alias("parts"),
        )
    )
    fields = ["record_id", "type", "target", "page_id", "refers_id", "digest"]
    whole = single.select(*fields, "block").mapInArrow(_decoded, PAGE_SCHEMA)
    return whole.unionByName(groups.select(*fields, "parts").mapInArrow(_decoded, PAGE_SCHEMA))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page of the response) of every page record.

    A revisit gets the length of the response it refers to, null where that is missing,
    incomplete or of another digest.
    """
    found = read_pages(spark, path).select(
        "record_id", "type", "page_id", "refers_id", "complete", "digest", F.octet_length("payload").cast("bigint").alias("payload_bytes")
    )
    found = materialise(spark, found, "page-records")
    responses = found.where(F.col("type") == "response")
    target = responses.where("complete").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("digest").alias("whole_digest"), F.col("payload_bytes").alias("whole_bytes")
    )
    same = F.col("digest") == F.col("whole_digest")
    revisits = found.where(F.col("type") == "revisit").join(target, "refers_id", "left").select(
        "page_id", F.when(same, F.col("whole_bytes")).alias("payload_bytes"), F.when(same, F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
    return responses.select(
        "page_id", "payload_bytes", F.when(F.col("complete"), F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"),
    ).unionByName(revisits)


def op12_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written to archives and read back; see ``write_archives`` and ``page_records``."""
    path = fresh_path(spark, "archives")
    write_archives(read(spark, sf_dir, "pages"), path)
    return page_records(spark, path)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {i}, 5) AS BIGINT) >> {shift}) & 31) + 1, 1)"
    for i in range(1, 40, 5) for shift in (15, 10, 5, 0)
)
OP12_SQL = f"""
WITH hashed AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h,
        min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first_id FROM pages
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed
"""
