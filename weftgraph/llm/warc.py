"""WARC archives with revisit resolution.

Every page becomes a record whose payload is its html in UTF-8. Of the records with equal payloads
(by SHA-1 digest) of at least ``least_bytes`` bytes, the one with the largest id is the response;
the others are revisits that refer to it and store no payload. Smaller payloads are all responses.

Plan: digests are computed where the pages lie; only (digest, id, url) headers are shuffled by digest, with
map-side maxima, so a payload that a third of all pages share costs one row for each task. Headers
find their response by a join on the digest, which carries no payloads and in which digests of many pages
are broadcast (``components.join_hot``). Payloads are shuffled once, by (id, digest), to meet their header.

Archives are written through Spark's own writer into the cluster's shared folder, so a lost executor's
attempt leaves nothing behind. A file is one row of the writer: records of up to ``BYTES_PER_FILE`` bytes
together (or one larger record), after a warcinfo record, each record ending in CR LF CR LF, which is
the writer's line end here. So a reader holds that much at once, however long the pages. Files are one
gzip stream each, not one member for each record: the archives are for sequential reading.

Headers are fresh: dates are those of the writing, record ids are UUIDs that follow from the page's id, the
digest and the number of the repeated row (a retried task writes the same ones), and revisits name the
original's record, URI and date.

Defined cases: null html is the empty payload; null ids order below all others; of repeated rows (the
same id and payload) one is the response and the rest are revisits; a very long payload is a file of its own
and must fit a task's memory; an empty table writes no records; further columns don't matter, whatever
their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.components import join_hot
from weftgraph.llm.runtime import only, settle

BYTES_PER_FILE = 24_000_000
END = "\r\n\r\n"
_LEAST = -(2**63)


def headers(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(id, digest as 20 bytes, bytes, link) without payloads."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("__id"), F.unhex(F.sha1(body.cast("binary"))).alias("__digest"), F.octet_length(body).cast("long").alias("__bytes"), F.col(url).alias("__link"))


def resolve(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages with __digest, __bytes, __twin (1 for the first of repeated rows), __kind (response or revisit),
    __original (an id, or null) and __link (the original's URI)."""
    heads = settle(headers(pages, key, url, payload), "heads")
    each = heads.groupBy("__id", "__digest").agg(F.first("__bytes").alias("__bytes"))
    last = F.struct("__id", F.coalesce("__link", F.lit("")).alias("link"))
    largest = heads.groupBy("__digest").agg(F.max(last).alias("__last"), F.count("*").alias("n"))
    found = join_hot(each, largest, "__digest", heads.count()).select("__id", "__digest", "__bytes", F.col("__last.__id").alias("__largest"), F.col("__last.link").alias("__link"))
    body = F.coalesce(F.col(payload), F.lit(""))
    full = pages.withColumns({"__id": F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)), "__digest": F.unhex(F.sha1(body.cast("binary")))})
    twin = F.row_number().over(Window.partitionBy("__id", "__digest").orderBy(F.lit(1)))
    met = full.join(found, ["__id", "__digest"]).withColumn("__twin", twin)
    revisit = (F.col("__bytes") >= least_bytes) & ((F.col("__id") != F.col("__largest")) | (F.col("__twin") > 1))
    return met.withColumns({"__kind": F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), "__original": F.when(revisit & (F.col("__largest") != _LEAST), F.col("__largest"))})


def record_id(page, digest: bytes, twin: int) -> str:
    """A UUID for the n-th row of a page with a payload."""
    name = hashlib.sha1(f"{'' if page is None else page}|{twin}|".encode() + digest).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"


def records(resolved: DataFrame, date: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One string column: a file's records, without the closing CR LF CR LF of the last one."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = format_record(*row, date)
                if held and size + len(made) > BYTES_PER_FILE:
                    yield whole(held)
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield whole(held)

    def whole(held):
        fields = b"software: weftgraph\r\nformat: WARC File Format 1.1\r\n"
        name = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(held[0]).digest()[:16], version=5)}>"
        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {name}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}{END}".encode()
        return pa.RecordBatch.from_arrays([pa.array([END.encode().join([info + fields, *held])], pa.binary()).cast(pa.string())], ["record"])

    src = resolved.select(F.col(key).cast("long").alias("page"), F.col(url).alias("link"), F.when(F.col("__kind") == "response", F.col(payload)).alias("body"), "__digest", "__bytes", "__twin", "__kind", "__original", "__link")
    return src.mapInArrow(run, "record string")


def format_record(page, link, body, digest: bytes, size: int, twin: int, kind: str, original, first_link, date: str) -> bytes:
    """A record up to, not including, its closing CR LF CR LF; ``body`` is left out of revisits by the caller."""
    name = base64.b32encode(digest).decode()
    clean = lambda x: re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", x or "")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}".encode() + ((body or "").encode() if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest, twin)}", f"X-Page-ID: {'' if page is None else page}", f"WARC-Target-URI: {clean(link)}", f"WARC-Date: {date}"]
    head += [f"WARC-Payload-Digest: sha1:{name}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(original, digest, 1)}", f"WARC-Refers-To-Target-URI: {clean(first_link)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {'' if original is None else original}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + END).encode() + block


def write_archives(resolved: DataFrame, path: str, **names) -> None:
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    records(resolved, date, **names).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_archive(raw: bytes):
    """(headers as a dict with lower-case names, content block) of each record of an archive."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        start = stop + 4
        end = start + int(head["content-length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's length is wrong at byte {at}")
        yield head, raw[start:end]
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of written archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    ``payload`` is null for revisits. Every stored payload is checked against its digest.
    """

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for head, block in parse_archive(gzip.decompress(raw.as_py())):
                    if head["warc-type"] == "warcinfo":
                        continue
                    body = block.partition(b"\r\n\r\n")[2]
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                    page, target = head["x-page-id"], head.get("x-refers-to-page", "")
                    rows.append((int(page) if page else None, head["warc-target-uri"], int(head["x-payload-length"]), digest, kind, int(target) if target else None, body if kind == "response" else None))
                    held += len(body)
                    if held > 8_000_000:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _batch(rows, kinds):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write deduplicated archives of all pages under ``path`` and read them back."""
    pages = only(pages, key, url, payload)
    write_archives(resolve(pages, key, url, payload, least_bytes), path, key=key, url=url, payload=payload)
    return read_archives(pages.sparkSession, path)
