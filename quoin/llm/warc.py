"""WARC archives: writing with segmentation and chunked framing, reading with reassembly.

A payload is sent as an HTTP response in chunks; a block longer than `segment` bytes is cut into a first record and
continuation records that name its id and their number, the last one also the total length. Reading collects a
record's segments by origin id, orders them by number, checks that none is missing and that the length is right, undoes the
chunks and checks the payload's digest. Of equal payloads of at least `least` bytes, the one with the smallest page_id is
written in full, the others as revisits of it.

Null html is an empty payload; a null url writes no target URI. A null page_id is larger than any other; if all rows of
a payload have none, they are all responses. A row that repeats page_id and payload is written again, under a record id of
its own, and read again: both come back as they are. Other columns do not matter. Archives lie in the shared folder as gzip
files of at most FILE_RECORDS records, each one gzip stream; a file is read record by record, its compressed bytes in memory. In
foreign archives, segments that are there twice under one id are one segment.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import dropped, map_rows, remove, settled, shared_path, spread_join

SEGMENT = 16_384
CHUNK = 4_096
FILE_RECORDS = 1_000
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest_hex: Column) -> Column:
    """Upper-case base32 of 20 bytes given in hex: five hex digits are four letters."""
    parts = []
    for g in range(8):
        n = F.conv(F.substring(digest_hex, 5 * g + 1, 5), 16, 10).cast("int")
        for s in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(data), size):
        piece = data[at : at + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The body under chunked transfer framing; extensions and trailers are allowed."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if at + size + 2 > len(data) or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(data[at : at + size])
        at += size + 2


def record_id(kind: str, page: int | None, digest: str, url: str | None, nth: int = 1) -> str:
    """nth: of rows with the same page, payload and url."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page}/{digest}/{nth}/{url}')}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records(page: int | None, url: str | None, payload: bytes, refers: dict | None, nth: int = 1, segment: int = SEGMENT) -> list[bytes]:
    """The records of one capture, without the line ends that close a record; refers: page and url of the response that it repeats."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else None
    kind = "revisit" if refers else "response"
    own = record_id(kind, page, digest, url, nth)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-Id", page), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("response", refers["page_id"], digest, refers["url"]))]
        return [record(fields, HTTP + b"\r\n")]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record(fields, block)]
    out = [record([*fields, ("WARC-Segment-Number", 1)], block[:segment])]
    for n, at in enumerate(range(segment, len(block), segment), 2):
        last = at + segment >= len(block)
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"continuation-{n}", page, digest, url, nth)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if last else None)]
        out.append(record(more, block[at : at + segment]))
    return out


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Writes pages (page_id, url, html) to path by Spark's own writer, whose record ends are the ends of WARC records.

    Which pages repeat a payload is found on ids and digests alone; payloads are then joined by page, so a very common one is not a hot key.
    """
    sent = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = settled(sent.select("page_id", "url", "digest", (F.length("payload") >= least).alias("long")), "keys")
    first = keys.where("long").groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first")).where("n > 1 and first.page_id is not null")
    named = spread_join(keys.where("long").groupBy("page_id", "digest").agg(F.count("*").alias("_n")), first.select("digest", F.struct("first.page_id", "first.url").alias("refers")), ["digest"], ["page_id"], "inner")
    again = named.where("page_id is null or page_id <> refers.page_id").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers")
    rows = sent.join(again, sent["page_id"].eqNullSafe(again["_page"]) & (sent["digest"] == again["_digest"]), "left").select("page_id", "url", "payload", "refers", "digest")
    if not keys.groupBy("page_id", "url", "digest").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # equal rows: one stands for all, each with a number
        rows = rows.groupBy("page_id", "url", "digest").agg(F.first("payload").alias("payload"), F.first("refers").alias("refers"), F.count("*").cast("int").alias("n"))
        rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
    else:
        rows = rows.withColumn("nth", F.lit(1))
    made = map_rows(rows.select("page_id", "url", "payload", "refers", "nth"), lambda r: ((x,) for x in records(*r, segment=segment)), "value binary", pa.schema([("value", pa.binary())]))
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    dropped(keys)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, gzip (of one member or many) or plain, by Content-Length; one record is unpacked at a time."""
    with gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data) as f:
        while line := f.readline():
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no record where one should begin")
            fields: dict[str, str] = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode("utf-8", "replace").partition(":")
                fields[k.strip().lower()] = v.strip()
            n = int(fields["content-length"])
            block = f.read(n)
            if len(block) != n:
                raise ValueError("a record is cut short")
            yield fields, block


SEGMENTS = "origin string, number int, total long, type string, page_id long, url string, digest string, refers string, block binary"


def segments(spark: SparkSession, path: str, cut: bool) -> DataFrame:
    """One row a record of every archive under path: those cut into segments, or the others."""
    fields = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())])
    number = lambda x: None if x is None else int(x)

    def rows(row: tuple):
        for f, block in parsed(row[0]):
            kind = f.get("warc-type")
            if kind in ("response", "revisit", "continuation", "resource") and ("warc-segment-number" in f) == cut:
                yield (f.get("warc-segment-origin-id") or f["warc-record-id"], int(f.get("warc-segment-number", 1)), number(f.get("warc-segment-total-length")), kind, number(f.get("x-page-id")), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, f.get("warc-refers-to"), block)

    return map_rows(spark.read.format("binaryFile").load(path).select("content"), rows, SEGMENTS, fields)


CAPTURE = "origin string, type string, page_id long, url string, digest string, refers string, payload binary, intact boolean"


def capture(origin: str, parts: list[dict]) -> tuple:
    """One capture of all its segments; a segment that is there twice must be the same both times."""
    unique = {p["number"]: p for p in reversed(parts)}
    head = unique.get(1)
    if head is None:
        return (origin, None, None, None, None, None, None, False)
    block = b"".join(unique[n]["block"] for n in sorted(unique))
    total = next((p["total"] for p in unique.values() if p["total"] is not None), None)
    intact = all(unique[p["number"]]["block"] == p["block"] for p in parts) and sorted(unique) == list(range(1, len(unique) + 1)) and (total == len(block) if len(unique) > 1 else total in (None, len(block)))
    payload = None
    if head["type"] != "revisit" and intact:
        top, _, body = block.partition(END)
        try:
            payload = unchunked(body) if b"transfer-encoding: chunked" in top.lower() else body
        except ValueError:
            intact = False
        if intact and head["digest"]:
            intact = base64.b32encode(hashlib.sha1(payload).digest()).decode() == head["digest"]
    return (origin, head["type"], head["page_id"], head["url"], head["digest"], head["refers"], payload, intact)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """origin, type, page_id, url, digest, refers, payload of each capture; intact: complete, of the stated length, of the stated digest.

    Only records cut into segments are shuffled, by the id of their first; equal segments under one id are one.
    """
    fields = pa.schema([("origin", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())])
    names = ["number", "total", "type", "page_id", "url", "digest", "refers", "block"]
    alone = map_rows(segments(spark, path, cut=False), lambda r: iter([capture(r[0], [dict(zip(names, r[1:], strict=True))])]), CAPTURE, fields)
    cut = segments(spark, path, cut=True).withColumn("sha", F.xxhash64("block", "total"))
    parts = cut.groupBy("origin", "number", "sha").agg(*(F.first(c).alias(c) for c in names[1:])).groupBy("origin").agg(F.collect_list(F.struct(*names)).alias("parts"))
    return alone.unionByName(map_rows(parts, lambda r: iter([capture(r[0], r[1])]), CAPTURE, fields))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives and reads them: page_id, payload_bytes, payload_digest, record_type, refers_to, intact. A revisit's payload is that of the response it names."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least)
    got = captures(spark, path).withColumn("n", F.length("payload").cast("long")).withColumn("sha", F.when(F.col("payload").isNotNull(), base32(F.sha1("payload"))))
    got = settled(got.drop("payload"), "captures")
    remove(spark, path)
    full = got.where("type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "intact")
    origin = got.where("type = 'response'").groupBy(F.col("origin").alias("refers")).agg(F.min(F.struct("n", "sha", "page_id", "intact")).alias("r")).select("refers", "r")
    revisits = got.where("type = 'revisit'")
    asked = origin.join(revisits.select("refers").distinct(), "refers", "left_semi")
    again = spread_join(revisits, asked, ["refers"], ["origin"]).select("page_id", F.col("r.n").alias("payload_bytes"), F.col("r.sha").alias("payload_digest"), F.col("type").alias("record_type"), F.col("r.page_id").alias("refers_to"), (F.col("intact") & F.col("r.intact") & (F.col("r.sha") == F.col("digest"))).alias("intact"))
    return full.unionByName(again)
