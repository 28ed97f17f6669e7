"""Order MinHash fingerprints: sketches that are sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence (the second "abc" isn't the first). Each of
``SLOTS`` slots has an order of its own over numbered k-mers (their hash, mixed with the slot's two keys),
selects the ``PICKED`` that come first in it, retains their order in the text and hashes the tuple of k-mers
to 16 bits. The orders are the same for all texts, and independent between slots. The likeness of two
fingerprints is the share of equal slots.

The edited text takes the last floor(n / 2) code points from the start of the next document in
ascending id. Documents are dealt by ranges of id whose borders are quantiles (as many as there are
shuffle partitions, or more for more than ``RANGE_BYTES`` of text to a range), a task for each range, are
sorted there, and the first document of each range also goes to the one before. Texts travel once,
compressed; no task holds more than a batch of its range.

Defined cases: a null text is empty and its fingerprint is all zeros; a text shorter than k is one
k-mer; one with fewer k-mers than are picked has them all in each slot; a very long text is sketched whole,
some slots at a time; a single document is its own next one; rows with equal ids are ordered by their
text; null ids come first; ids must be whole numbers; an empty table gives no rows; other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.runtime import only, text_of

K, SLOTS, PICKED = 5, 128, 2
RANGE_BYTES = 64_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 16  # ranks that are held at once
_PLACE = np.uint64(20)  # bits that positions take beside a k-mer's hash while both are sorted


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-mers by position; the whole text if it is shorter than k."""
    k = min(k, len(codes))
    h = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        h = h * _PRIME + codes[i : len(codes) - k + 1 + i] + np.uint64(1)
    return _mix(h)


#: Each slot's keys: the ranks of numbered k-mers are (hash ^ first) * second, which no two hashes share.
_KEYS = _mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * _PRIME).astype(np.uint32).reshape(2, SLOTS) | np.array([[0], [1]], np.uint32)


def numbered(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of k-mers (their upper 44 bits) with the numbers of their occurrences, by position."""
    if len(h) <= 1 << 20:
        both = np.sort(((h >> _PLACE) << _PLACE) | np.arange(len(h), dtype=np.uint64))
        at, same = (both & np.uint64((1 << 20) - 1)).astype(np.int64), both >> _PLACE
    else:
        same = h >> _PLACE
        at = np.argsort(same, kind="stable")  # equal k-mers in text order, as above
        same = same[at]
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    occurrence = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    out = np.empty(len(h), np.uint32)
    out[at] = (_mix(same + occurrence.astype(np.uint64) * _PRIME + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    return out


def sketch(codes: np.ndarray) -> np.ndarray:
    """The fingerprint of a text's code points: SLOTS numbers of 16 bits, all zero for the empty text."""
    if not len(codes):
        return np.zeros(SLOTS, np.uint16)
    h = kmers(codes)
    n, own = len(h), numbered(h)
    least = min(PICKED, n)
    picked = np.empty((SLOTS, least), np.int64)
    step = max(1, _CELLS // n)
    for s in range(0, SLOTS, step):
        ranks = (own ^ _KEYS[0, s : s + step, None]) * _KEYS[1, s : s + step, None]
        each = np.arange(len(ranks))
        for c in range(least):
            where = ranks.argmin(1)  # of equal ranks the first in the text
            picked[s : s + step, c] = where
            ranks[each, where] = 0xFFFFFFFF
    picked.sort(axis=1)
    out = np.full(SLOTS, np.uint64(least))
    for c in range(least):
        out = _mix(out * _PRIME + h[picked[:, c]])
    return (out >> np.uint64(48)).astype(np.uint16)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def as_text(prints: np.ndarray) -> str:
    return prints.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def ranges(docs: DataFrame, key: str, parts: int) -> list[int]:
    """Borders of about even ranges of ids, from approximate quantiles over all rows."""
    found = docs.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    return sorted(set(found or []))


def neighbours(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, id, packed, lead) sorted within parts: each part ends with the row that follows it."""
    spark = docs.sparkSession
    only_key = only(docs, key, "text")
    if dict(only_key.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be a whole number")
    whole = only_key.select(F.col(key).cast("long").alias("id"), text_of().alias("text"))
    size = whole.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    borders = ranges(whole, "id", max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    parts = len(borders) + 1
    shared = spark.sparkContext.broadcast(np.array(borders, np.int64))

    def place(ids: pa.Array) -> np.ndarray:
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(shared.value, ids.fill_null(0).to_numpy(), side="right"))

    def heads(batches):
        least: dict[int, int | None] = {}
        for batch in batches:
            ids = batch.column(0)
            if ids.null_count:
                least[0] = None
            known = ids.drop_null()
            where, values = place(known), known.to_numpy()
            for p in np.unique(where).tolist():
                low = int(values[where == p].min())
                least[p] = low if p not in least else None if least[p] is None else min(least[p], low)
        yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.int32()), pa.array(least.values(), pa.int64())], ["part", "id"])

    found: dict[int, int | None] = {}
    for r in whole.select("id").mapInArrow(heads, "part int, id long").distinct().collect():  # at most a row for each part and task
        found[r.part] = r.id if r.part not in found else None if None in (r.id, found[r.part]) else min(found[r.part], r.id)
    firsts = sorted(found)
    ids = [found[p] for p in firsts if found[p] is not None]
    some = F.col("id").isin(ids) if ids else F.lit(False)
    some = some | F.col("id").isNull() if None in found.values() else some
    leads = spark.createDataFrame([(found[p], firsts[n - 1]) for n, p in enumerate(firsts)], "first long, part int")
    first = whole.filter(some).groupBy("id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    extra = first.join(F.broadcast(leads), F.col("id").eqNullSafe(F.col("first"))).select("part", "id", "text", F.lit(1).alias("lead"))
    rows = whole.select(F.lit(None).cast("int").alias("part"), "id", "text", F.lit(0).alias("lead")).union(extra)

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [t.encode() for t in batch.column(2).to_pylist()]
            part = pa.array(place(batch.column(1)), pa.int32()) if batch.column(0).null_count else batch.column(0)
            yield pa.RecordBatch.from_arrays([part, batch.column(1), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([z.compress(r) for r in raw], pa.binary()), batch.column(3)], ["part", "id", "sha", "packed", "lead"])

    packed = rows.mapInArrow(pack, "part int, id long, sha string, packed binary, lead int")
    return packed.repartitionById(parts, "part").sortWithinPartitions("part", "lead", F.col("id").asc_nulls_first(), "sha")


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""

    def run(batches):
        z, names = zstandard.ZstdDecompressor(), ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None  # the row that waits for its next one: part, id, text, sketch
        for batch in batches:
            out = []
            for part, key, packed, lead in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "packed", "lead")), strict=True):
                text = z.decompress(packed).decode()
                own = sketch(codes_of(text))
                if held and held[0] == part:
                    _, before, left, mine = held
                    half = len(left) // 2
                    edited = left[: len(left) - half] + text[:half]
                    theirs = sketch(codes_of(edited))
                    out.append((before, len(left), hashlib.sha256(edited.encode()).hexdigest(), as_text(mine), as_text(theirs), likeness(mine, theirs), likeness(mine, own)))
                held = None if lead else (part, key, text, own)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = neighbours(docs, key).select("part", "id", "packed", "lead")
    out = rows.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", key)
