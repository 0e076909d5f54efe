"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is a transaction of up to three kinds of records: the response (or a revisit of an equal earlier payload), the request, and
metadata.  The latter two name the former in ``WARC-Concurrent-To``.  :func:`transactions` joins the records of an
archive through these identifiers into one nested row for each capture.

Archives are written by Spark's own writer: a task packs records into archives of a bounded size, each a row and so
a file, in whatever storage the path names.  They are uncompressed WARC/1.1, or gzip as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.store import drop, keep

ARCHIVE_BYTES = 8 << 20
END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names of our record identifiers are derived from this one.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = (
    "record_id string, type string, date string, uri string, concurrent_to string, refers_to string, payload_digest string, "
    "headers map<string,string>, http_status string, payload_bytes long, payload_sha1 string, payload binary, error string"
)
RECORD_NAMES = [c.strip().split(" ")[0] for c in RECORD.split(", ")]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def identifier(kind: str, key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{key}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without the two line ends that close it."""
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def _capture(key: str, page: int | None, url: str, payload: bytes, refers_key: str | None) -> Iterator[bytes]:
    """The response or revisit, the request and the metadata of a capture."""
    own, target = identifier("capture", key), url or "urn:none"
    digest = f"sha1:{base32_sha1(payload)}"
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    if refers_key is None:
        kind = [("WARC-Type", "response")]
        block = status + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", identifier("capture", refers_key))]
        block = status + b"\r\n"
    yield record([*kind, ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], block)
    host, _, path = target.partition("://")[2].partition("/")
    yield record(
        [("WARC-Type", "request"), ("WARC-Record-ID", identifier("request", key)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")],
        f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(),
    )
    yield record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", identifier("metadata", key)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")],
        (f"page_id: {page}\r\n" * (page is not None) + f"payload_bytes: {len(payload)}\r\n").encode(),
    )


def _archives(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    kept: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([END.join(kept)], pa.binary())], names=["value"])

    for batch in batches:
        for key, page, url, html, refers in zip(*batch.columns, strict=True):
            for r in _capture(key.as_py(), page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers.as_py()):
                kept.append(r)
                size += len(r) + len(END)
            if size >= most:
                yield out()
                kept, size = [], 0
    if kept:
        yield out()


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, compression: str = "none") -> None:
    """Write a capture for each row of ``pages (page_id, url, html)`` to archives in ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, one with the largest ``page_id`` is the
    response and the others are revisits that refer to it; smaller payloads are all responses.  Null html is an empty
    payload.  Every row is a capture: its identifiers are derived from ``page_id``, a hash of url and html, and a number
    that tells equal rows apart.  Rows without ``page_id`` have none in their metadata and count last as a response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    mark = F.substring(F.sha2(F.concat(F.coalesce(F.octet_length("url"), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce("url", F.lit("")), "digest"), 256), 1, 32)
    rows = rows.withColumn("id", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), mark))
    # Who is the response is found on identifiers and digests alone; payloads are shuffled once, to be told.
    whole = F.octet_length("html") >= min_revisit_bytes
    copies = keep(rows.select("id", "page_id", F.when(whole, F.col("digest")).alias("digest")).groupBy("id", "page_id", "digest").agg(F.count(F.lit(1)).alias("n")), "copies")
    first = copies.where("digest IS NOT NULL").groupBy("digest").agg(F.max(F.struct("page_id", "id")).alias("r"), F.sum("n").alias("all")).where("all > 1").select("digest", F.concat("r.id", F.lit(":1")).alias("refers"))
    special = keep(copies.join(first, "digest", "left").where("n > 1 OR refers IS NOT NULL").select("id", "n", "refers"), "special")
    columns = ["id", "page_id", "url", "html", "refers"]
    known = rows.join(special, "id", "left").where("n IS NULL OR n = 1").select(*columns, F.lit(1).cast("long").alias("number"))
    equal = special.where("n > 1")
    if not equal.isEmpty():  # equal rows become one, which is written as often as they occur
        one = rows.join(equal, "id").groupBy("id").agg(F.min(F.struct("page_id", "url", "html", "refers", "n")).alias("r"))
        known = known.union(one.select("id", *(f"r.{c}" for c in columns[1:]), F.explode(F.sequence(F.lit(1).cast("long"), "r.n"))))
    known = known.select(F.concat_ws(":", "id", F.col("number").cast("string")).alias("key"), "page_id", "url", "html", "refers")
    known = known.withColumn("refers", F.when(F.col("key") != F.col("refers"), F.col("refers")))
    packed = known.mapInArrow(partial(_archives, most=archive_bytes), "value binary")
    writer = packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1)
    writer.option("compression", compression).text(path)
    drop(copies, special)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; stray bytes between records raise ``ValueError``."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head = data.find(END, at)
        if head < 0:
            raise ValueError(f"the headers at byte {at} don't end")
        headers: dict[str, str] = {}
        name = ""
        for line in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in " \t" and name:
                headers[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            raise ValueError(f"the record at byte {at} has no length") from None
        start = head + len(END)
        if length < 0 or start + length > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, data[start : start + length]
        at = start + length
        while data.startswith(b"\r\n", at):
            at += 2


def _entry(headers: dict[str, str], block: bytes, payload_of: frozenset[str]) -> tuple:
    kind, content = headers.get("warc-type"), headers.get("content-type", "")
    status = None
    payload = block
    if content.startswith("application/http"):
        head, found, payload = block.partition(END)
        status = head.split(b"\r\n", 1)[0].decode("latin-1")
        payload = payload if found else b""
    full = kind != "revisit"
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-date"), headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
        (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None, list(headers.items()), status, len(payload) if full else None, base32_sha1(payload) if full else None, payload if full and kind in payload_of else None, None,
    )


def _records(batches: Iterator[pa.RecordBatch], payload_of: frozenset[str]) -> Iterator[pa.RecordBatch]:
    text = pa.string()
    kinds = [text] * 7 + [pa.map_(text, text), text, pa.int64(), text, pa.binary(), text]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=RECORD_NAMES)

    for batch in batches:
        for content in batch.column(0):
            data, rows = content.as_py(), []
            try:
                if data[:2] == b"\x1f\x8b":
                    parts = []
                    while data:  # an archive may have a gzip member for each record
                        d = zlib.decompressobj(31)
                        parts.append(d.decompress(data) + d.flush())
                        data = d.unused_data
                    data = b"".join(parts)
                for headers, block in parse(data):
                    rows.append(_entry(headers, block, payload_of))
                    if len(rows) == 1000:
                        yield out(rows)
                        rows = []
            except (ValueError, zlib.error) as e:
                rows.append((None,) * 12 + (str(e),))
            yield out(rows)


def read(spark: SparkSession, path: str, payload_of: tuple[str, ...] = ("response", "request", "metadata", "resource", "warcinfo", "conversion")) -> DataFrame:
    """The records of all archives in ``path``, with the columns of :data:`RECORD`.

    A payload's length and digest are computed from its bytes; a revisit has none.  The bytes themselves are a column
    for the types in ``payload_of``.  A damaged archive gives its
    records up to the damage, then a row with only ``error``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(partial(_records, payload_of=frozenset(payload_of)), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id, uri, date, response, request, metadata``.

    ``response`` is the response or revisit record.  Requests and metadata belong to the record that they name in
    ``WARC-Concurrent-To``; ``metadata`` is an array, as there can be several.  Captures without a request or metadata
    have null and an empty array; records concurrent to nothing known have no row.  Of repeated records with one identifier the
    least counts, compared column by column, and of several requests too.  A row is made by one aggregation over all records.
    """
    names = [c for c in records.columns if c != "error"]
    # Maps have no order; their entries do.
    plain = F.struct(*(F.map_entries(n).alias(n) if n == "headers" else F.col(n) for n in names))
    back = lambda r: F.when(F.col(r).isNotNull(), F.struct(*(F.map_from_entries(f"{r}.{n}").alias(n) if n == "headers" else F.col(f"{r}.{n}") for n in names)))
    head = F.col("type").isin("response", "revisit")
    other = F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()
    sane = records.where("error IS NULL AND record_id IS NOT NULL").where(head | other)
    met = sane.groupBy(F.when(head, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id")).agg(
        F.min(F.when(head, plain)).alias("head"),
        F.min(F.when(F.col("type") == "request", plain)).alias("asked"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "metadata", plain))).alias("metadata"),
    )
    return met.where("head IS NOT NULL").select("capture_id", "head.uri", "head.date", back("head").alias("response"), back("asked").alias("request"), "metadata")


def captures(pages: DataFrame, path: str, min_revisit_bytes: int = 0, compression: str = "none") -> DataFrame:
    """Write ``pages`` to archives in ``path``, read them back, and return for each page ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``: length and digest are those of the full payload as read from the
    response, for a revisit from the one that it refers to.  See :func:`write` for odd rows."""
    write(pages, path, min_revisit_bytes, compression=compression)
    found = transactions(read(pages.sparkSession, path, payload_of=("metadata",)))
    key = F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), r"page_id: (-?\d+)", 1).try_cast("long")
    flat = found.select(key.alias("page_id"), "capture_id", "response.type", "response.payload_bytes", "response.payload_sha1", F.col("response.refers_to").alias("refers_id"))
    flat = keep(flat, "captures")
    full = flat.where("type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_sha1").alias("full_sha1"))
    return flat.join(full, "refers_id", "left").select(
        "page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), F.coalesce("payload_sha1", "full_sha1").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )
