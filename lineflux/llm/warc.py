"""WARC archives: writing with digest-based revisits, and a salvage reader.

The reader checks each record (version line, headers, Content-Length, block digest, closing blank lines). After a failed
check it searches for the next gzip member or version line that begins a valid record, recovers what follows, and logs the
skipped bytes as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, fresh_path, ship, store, table

LOG = logging.getLogger(__name__)
VERSION = re.compile(rb"WARC/1\.[0-9]\r?\n")
MEMBER = b"\x1f\x8b\x08"
#: Bytes that are inflated at once.
PIECE = 1 << 16
#: Gzip members within members beyond this depth, and members that give more bytes than this, are quarantined.
DEEPEST, MOST_INFLATED = 4, 1 << 28
#: Records per archive, payload bytes above which a page goes to archives of its own kind, and bytes of those archives (one record at
#: least): an archive is read whole by one task, so these bound its memory.
RECORDS_PER_ARCHIVE, LARGE, ARCHIVE_BYTES = 2000, 1 << 17, 1 << 28
#: Shared digests (about 60 bytes each) up to this number are broadcast.
FEW_DIGESTS = 200_000

SCHEMA = "archive string, first_byte long, end_byte long, fault string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, page_id long, payload binary"


@dataclass
class Found:
    """A record, or a quarantined gap (fault set). Offsets are bytes of the archive as stored."""

    first: int
    end: int
    fault: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_record(data: bytes, at: int) -> Found | str:
    """The record that begins at `at`, or why there is none."""
    m = VERSION.match(data, at)
    if not m:
        return "no version line"
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        return "headers do not end"
    headers = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not line:
            continue
        if not colon or b" " in name.strip():
            return "malformed header"
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in headers:
        return "no length or type"
    first = stop + 4
    end = first + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "block does not end as its length says"
    block = data[first:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        return "block digest differs"
    return Found(at, end + 4, None, headers, block)


def inflate(data: memoryview, at: int, most: int = MOST_INFLATED) -> tuple[bytes, int | None]:
    """What the gzip member at `at` gives, and where it ends: None if it is damaged or gives more than `most` bytes, with what came before."""
    d, out, left, k = zlib.decompressobj(wbits=31), [], most, at
    while k < len(data):
        piece = data[k : k + PIECE]
        while len(piece):
            before = d.copy()
            try:
                got = d.decompress(piece, max(min(left, 16 * PIECE), 1))
            except zlib.error:
                # the damaged piece again in small steps, for what it still gives
                d = before
                for i in range(0, len(piece), 64):
                    try:
                        out.append(d.decompress(piece[i : i + 64], max(left, 1)))
                    except zlib.error:
                        break
                    left -= len(out[-1])
                    if left <= 0 or d.unconsumed_tail:
                        break
                return b"".join(out), None
            out.append(got)
            left -= len(got)
            piece = d.unconsumed_tail
            if d.eof:
                return b"".join(out), min(k + PIECE, len(data)) - len(d.unused_data)
            if left <= 0:
                return b"".join(out), None
        k += PIECE
    return b"".join(out), None


def salvage(data: bytes, depth: int = 0, most: int = MOST_INFLATED) -> Iterator[Found]:
    """Records and gaps of an archive, in order; together they cover all its bytes.

    A damaged gzip member is a gap; whole records that it gave before the damage come first, with an empty extent at its start. So is a
    member that gives more than `most` bytes, and one within more than DEEPEST others, which isn't opened at all."""
    at, bad, why, view = 0, None, "", memoryview(data)
    while at < len(data):
        if data.startswith(MEMBER, at) and depth > DEEPEST:
            got = "gzip members nested too deeply"
        elif data.startswith(MEMBER, at):
            out, end = inflate(view, at, most)
            inside = list(salvage(out, depth + 1, most)) if out else []
            good = [f for f in inside if not f.fault]
            if good and bad is not None:
                yield Found(bad, at, why)
                bad = None
            if good and end is not None:
                for f in inside:
                    yield Found(at, end, f.fault, f.headers, f.block)
                at = end
                continue
            for f in good:
                yield Found(at, at, None, f.headers, f.block)
            got = "damaged gzip member" if len(out) < most else "gzip member of too many bytes"
        else:
            got = parse_record(data, at)
        if isinstance(got, Found):
            if bad is not None:
                yield Found(bad, at, why)
                bad = None
            yield got
            at = got.end
            continue
        if bad is None:
            bad, why = at, got
        m = VERSION.search(data, at + 1)
        g = data.find(MEMBER, at + 1)
        places = [x for x in (m.start() if m else -1, g) if x >= 0]
        at = min(places, default=len(data))
    if bad is not None:
        yield Found(bad, len(data), why)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 by built-ins: each five hex digits are four base32 digits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null on responses).

    Of payloads of least_bytes or more with equal digest and length, the smallest page_id (null last, then the smallest row)
    is the response; pages with that same id are responses too. Only digests that several pages share are joined, one row each,
    so payloads are shuffled only where more than FEW_DIGESTS are shared.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    first = p.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = store(first.where("_n > 1").drop("_n"), "digests")
    p = p.join(few(first, FEW_DIGESTS), ["payload_digest", "payload_bytes"], "left")
    return p.withColumn("refers_to", F.when(F.col("page_id") != F.col("_first"), F.col("_first"))).drop("_first")


def one_line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", " ")


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write pages (page_id, url, html) as WARC/1.1 archives, one record each. Null html is an empty payload, a null url an
    empty target; a null page_id has no page header; an empty table gives no records. Further columns are ignored. Spark's text writer
    commits the files. Pages of more than LARGE bytes go to archives of fewer records, so an archive's bytes are bounded."""
    p = deduplicated(pages, least_bytes)
    most = pages.agg(F.coalesce(F.max(F.octet_length("html")), F.lit(0))).first()[0]
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    empty = base64.b32encode(hashlib.sha1(b"").digest()).decode()

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    page = F.coalesce(header("X-Page-Id", F.col("page_id").cast("string")), F.lit(""))
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", urn),
        header("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        header("WARC-Target-URI", one_line(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, empty).otherwise(F.col("payload_digest")))),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(""),
        page,
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    # the line separator is the end of a record
    large = F.col("payload_bytes") > LARGE
    parts = [(p.where(~large), records_per_archive), (p.where(large), max(1, ARCHIVE_BYTES // most))] if most > LARGE else [(p, records_per_archive)]
    for some, records in parts:
        some.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path)


def read_archives(spark, path: str, *, payloads: bool = True) -> DataFrame:
    """One row per record and per quarantined gap of the archives under path; a gap has a fault and no record columns.

    payload_bytes and payload_digest are computed from the block of a response; a revisit carries those of the full payload.
    """
    ship(spark)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out, held = [], 0
                for f in salvage(content.as_py()):
                    h = f.headers
                    if f.fault:
                        out.append((archive, f.first, f.end, f.fault, *[None] * 8))
                    else:
                        whole = h["warc-type"] != "revisit"
                        digest = sha1_base32(f.block) if whole else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        length = len(f.block) if whole else int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None
                        refers = re.fullmatch(r"<urn:page:(.*)>", h.get("warc-refers-to", ""))
                        page = h.get("x-page-id", "")
                        out.append((archive, f.first, f.end, None, h["warc-type"], h.get("warc-record-id"), h.get("warc-target-uri"), refers[1] if refers else None, digest, length, int(page) if page.lstrip("-").isdigit() else None, f.block if payloads else None))
                        held += len(f.block) * payloads
                    if held > 8 << 20 or len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds(pa))], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds(pa))], names)

    def kinds(pa):
        return [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, SCHEMA)


def quarantine(found: DataFrame, most: int = 100) -> DataFrame:
    """(archive, first_byte, end_byte, fault) of the gaps; the first `most` of them go to the log, with their number."""
    gaps = found.where("fault is not null").select("archive", "first_byte", "end_byte", "fault")
    n = gaps.count()
    for r in gaps.orderBy("archive", "first_byte").limit(most).collect() if n else ():
        LOG.warning("quarantined %s bytes %d to %d: %s", *r)
    if n:
        LOG.warning("%d gaps quarantined", n)
    return gaps


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    back = store(read_archives(spark, path, payloads=False).drop("payload"), "records")
    quarantine(back)
    return back.where("fault is null").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP1_SQL = r"""
WITH h AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), v AS (
  SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(hex, CAST(1 + 5 * k AS BIGINT), 5) AS BIGINT)) AS parts FROM h
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(parts, lambda p:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (p >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (p >> 10) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (p >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', p % 32 + 1, 1)), '') AS payload_digest
  FROM v
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
