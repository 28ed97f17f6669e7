"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to ``ORDER`` bytes, pretrained on the training documents. Each
text is read as its UTF-8 bytes and one end symbol, after ``ORDER`` start symbols. A symbol is coded in
the longest context of the trie: a seen symbol with its count, otherwise an escape (method C: as many
counts as the context has distinct symbols), and then in the next shorter context without the symbols
that the longer one has already ruled out; at last all bytes are alike. Code lengths add up to the
document's log10 probability.

Size: every n-gram of the training documents is a node, at any corpus size. N-grams are dealt into
buckets by the last ``NEAR`` bytes of their context; with the nodes of the ``NEAR`` shortest orders, which
no corpus makes more than 256 + 256^2 + 256^3 and which are broadcast, a bucket holds all that its n-grams'
scores depend on. The scores of n-grams that make up at least 1 / ``HOT_GRAMS`` of all training symbols
(``HOT_GRAMS`` at most) are broadcast as a cache; all others meet their bucket by a shuffle. A node's
shorter contexts are nodes, so a context's excluded symbols are those of the next longer context alone;
that makes exclusion a stored number.

Words (for the base score) that make up at least 1 / ``HOT_WORDS`` of all tokens are broadcast (``HOT_WORDS``
at most, of up to 64 bytes each); all others meet their counts in buckets by a hash of the word.

What travels: nothing is a row for each n-gram or word. Tasks add up what they see and send sorted,
packed arrays, one for each bucket and flush; a bucket's task merges them (in steps, so that its memory
follows the distinct n-grams and not the number of flushes). Questions about cold n-grams and words travel
the same way, and answers come back as arrays by flush. A flush is at most ``_FLUSH_ASKS`` questions. The
number of buckets follows the bytes of training text, up to ``MOST_BUCKETS``.

Base: sum over a text's tokens (its words, A-Z in lower case, and one end) of
log10((c + 1) / (N + V + 1)).

Defined cases: a null text is empty and has its end alone; with no training documents every symbol is
equally likely and no word is known; rows with a null id are training documents; repeated rows are
scored each; an empty table gives no rows; other columns don't matter. A very long text is one slice
of a batch and takes some 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.runtime import only, settle, slices, text_of

ORDER = 6
NEAR = 3
HOT_GRAMS = 1 << 21
HOT_WORDS = 1 << 18
START, END, SYMBOLS = 0xFE, 0xFF, 255
#: Bytes of training text to a bucket, and the most buckets.
_BUCKET, MOST_BUCKETS = 16_000_000, 1 << 14
_RAW, _FLUSH_GRAMS, _FLUSH_WORDS, _FLUSH_ASKS = 4_000_000, 1_500_000, 400_000, 1_500_000
_FLUSH_DOCS = 50_000
_ROWS = 256  # texts that are looked up at once; their number fits in a key's free byte
GRAMS, WORDS, SHORT, DOCS = 0, 1, 2, 3  # kinds of rows: n-grams, words, n-grams of the shortest orders; documents pass by


def symbols(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (context, symbol) for every symbol of all texts, and each text's number of symbols."""
    raw = [t.encode() for t in texts]
    pad, end = bytes([START]) * order, bytes([END])
    flat = np.frombuffer(b"".join(x for r in raw for x in (pad, r, end)), np.uint8).astype(np.uint64)
    key = flat.copy()
    for k in range(1, order + 1):
        key[k:] |= flat[:-k] << np.uint64(8 * k)
    return key[flat != START], np.array([len(r) + 1 for r in raw])


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


# -- blocks ----------------------------------------------------------------------------------


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """An array's bytes, like ones together, compressed; ``rising`` numbers as their differences."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def unpack(raw: bytes, kind=np.uint64, rising: bool = False) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    values = np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def gram_place(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each (context, symbol) key, from the last ``NEAR`` bytes of the context."""
    near = (keys >> np.uint64(8)) & np.uint64((1 << (8 * NEAR)) - 1)
    return ((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)


def by_place(place: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """An order that brings equal places together and keeps all else, and (place, start, end) of each."""
    order = np.argsort(place, kind="stable")
    sorted_ = place[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(place) else np.empty(0, int)
    return order, zip(sorted_[first].tolist(), first.tolist(), [*first[1:].tolist(), len(place)], strict=True)


def tokens(texts: pa.Array) -> pa.ListArray:
    """Each text's words, A-Z in lower case; white space is 0x20 and 0x09 to 0x0D. Ends may give empty words."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def word_counts(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()


def gather(train: DataFrame, buckets: int, parts: int) -> DataFrame:
    """The model: one row (bucket, kind, keys, counts, n, total) for each bucket and kind of block.

    ``keys`` are packed n-grams, or words joined by spaces; ``n`` is their number and ``total`` their count.
    """
    names = ["bucket", "kind", "keys", "counts"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def gram_blocks(keys, counts):
        order, places = by_place(gram_place(keys, buckets))
        keys, counts = keys[order], counts[order]
        return [(p, GRAMS, pack(keys[a:b], True), pack(counts[a:b])) for p, a, b in places]

    def word_blocks(table):
        words, counts = table["word"].combine_chunks().cast(pa.binary()).to_pylist(), table["n"].to_numpy()
        order, places = by_place(np.array([crc32(w) % buckets for w in words], np.uint16))
        return [(p, WORDS, b" ".join([words[i] for i in order[a:b].tolist()]), pack(counts[order[a:b]])) for p, a, b in places]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def count(batches):
        raw, held, grams, words = [], 0, [], []

        def condensed():
            keys = np.sort(np.concatenate(raw))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            runs = [*grams, (keys[first], np.diff(np.append(first, len(keys))))]
            return [merge(runs)] if len(runs) > 1 else runs

        for batch in (b.slice(s, _ROWS) for b in batches for s in range(0, b.num_rows, _ROWS)):
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, 1_000_000):
                raw.append(symbols(texts[a:b])[0])
                held += len(raw[-1])
                found = pc.value_counts(tokens(batch.column(0).slice(a, b - a)).flatten())
                some = pa.table([found.field(0), found.field(1)], ["word", "n"])
                words.append(some.filter(pc.not_equal(some["word"], "")))
                if held > _RAW:
                    grams = condensed()
                    raw, held = [], 0
                    if len(grams[0][0]) > _FLUSH_GRAMS:
                        yield batch_of(gram_blocks(*grams.pop()))
                if sum(map(len, words)) > _FLUSH_WORDS:
                    words = [word_counts(words)]
                    if len(words[0]) > _FLUSH_WORDS // 2:
                        yield batch_of(word_blocks(words.pop()))
        if raw:
            grams = condensed()
        if grams:
            yield batch_of(gram_blocks(*grams[0]))
        if words and len(left := word_counts(words)):
            yield batch_of(word_blocks(left))

    def join(batches):
        """A bucket's blocks come together; they are merged whenever the fresh ones outweigh the merged one."""
        now, held, fresh = None, [], 0

        def result():
            keys, counts = merge(held) if len(held) > 1 else held[0]
            short = []
            for j in range(NEAR):
                k, n = merge([(keys & np.uint64((1 << (8 * (j + 1))) - 1), counts)])
                short.append((k | np.uint64(j << 56), n))
            short = tuple(map(np.concatenate, zip(*short, strict=True)))
            return [(now, kind, pack(k, True), pack(n), len(k), int(n.sum())) for kind, (k, n) in ((GRAMS, (keys, counts)), (SHORT, short))]

        def words():
            table = word_counts(held)
            return [(now, WORDS, b" ".join(table["word"].cast(pa.binary()).to_pylist()), pack(table["n"].to_numpy()), len(table), pc.sum(table["n"]).as_py())]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*kinds, pa.int64(), pa.int64()], strict=True)], [*names, "n", "total"])

        kind = None
        for batch in batches:
            for place, k, keys, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (place, k) != (now, kind):
                    if held:
                        yield batch_of(result() if kind == GRAMS else words())
                    now, kind, held, fresh = place, k, [], 0
                n = unpack(counts, np.int64)
                if kind == GRAMS:
                    held.append((unpack(keys, rising=True), n))
                    if (fresh := fresh + len(n)) > max(1_000_000, len(held[0][0])):
                        held, fresh = [merge(held)], 0
                else:
                    held.append(pa.table([pa.array(keys.split(b" "), pa.binary()).cast(pa.string()), n], ["word", "n"]))
                    if (fresh := fresh + len(n)) > max(500_000, len(held[0])):
                        held, fresh = [word_counts(held)], 0
        if held:
            yield batch_of(result() if kind == GRAMS else words())

    dealt = train.select(text_of().alias("text")).mapInArrow(count, "bucket int, kind int, keys binary, counts binary").repartitionById(parts, "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(join, "bucket int, kind int, keys binary, counts binary, n long, total long")


class Trie:
    """Kept nodes of each order as sorted arrays, after those of ``base``; see the module for what the numbers mean."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], documents: int, seen: int, base: Trie | None = None):
        self.levels = list(base.levels) if base else []
        below = self.levels[-1][:2] if self.levels else None
        for j, (keys, counts) in enumerate(nodes, len(self.levels)):  # shortest contexts first
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.empty(0, int)
            names = context[first]
            kept = np.add.reduceat(counts, first) if len(keys) else counts
            distinct = np.diff(np.append(first, len(keys)))
            if j == 0:
                total, out = np.full(len(names), seen), np.zeros(len(names), np.int64)
            else:
                if base:  # nothing is pruned, and the context as an n-gram of its own may be in another bucket
                    total = kept
                else:
                    at = np.searchsorted(below[0], names)
                    at = np.minimum(at, len(below[0]) - 1)
                    total = np.where(below[0][at] == names, below[1][at], documents)  # a context of start symbols alone: every text's first
                lower = keys & np.uint64((1 << (8 * j)) - 1)
                out = np.add.reduceat(below[1][np.searchsorted(below[0], lower)], first) if len(keys) else counts
            self.levels.append([keys, counts, names, total, kept, distinct, out])
            below = (keys, counts)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each (context, symbol) key."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        ruled, left_out = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # excluded counts and symbols
        for j in range(len(self.levels) - 1, -1, -1):
            entries, counts, names, total, kept, distinct, below = self.levels[j]
            if not len(todo) or not len(names):
                continue
            key = keys[todo] & np.uint64((1 << (8 * (j + 1))) - 1)
            context = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(names, context), len(names) - 1)
            known = names[at] == context
            some, at, key = todo[known], at[known], key[known]
            fresh = distinct[at] - left_out[some]
            inside = kept[at] - ruled[some]
            pruned = total[at] - kept[at]
            whole = (inside + pruned + fresh).astype(float)
            e = np.minimum(np.searchsorted(entries, key), len(entries) - 1)
            hit = entries[e] == key
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.log10(np.where(hit, counts[e], pruned + fresh) / whole)
            out[some] += np.where(whole > 0, gain, 0.0)
            ruled[some], left_out[some] = below[at], distinct[at]
            done = np.zeros(len(keys), bool)
            done[some[hit]] = True
            todo = todo[~done[todo]]
        out[todo] -= np.log10(SYMBOLS - left_out[todo])
        return out


class Scorer:
    """A trie with a direct-mapped table of (context, symbol) scores already known."""

    def __init__(self, trie: Trie, bits: int = 20):
        self.trie, self.shift = trie, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.zeros(1 << bits)

    def totals(self, texts: list[str]) -> np.ndarray:
        keys, sizes = symbols(texts)
        slot = (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != keys)
        if len(missed):
            fresh, which = np.unique(keys[missed], return_inverse=True)
            scores = self.trie.log10(fresh)
            out[missed] = scores[which]
            slot = (fresh * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            self.keys[slot], self.values[slot] = fresh, scores
        return np.add.reduceat(out, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(sizes) else np.empty(0)


class Cache:
    """Scores of common (context, symbol) keys, sorted."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each of up to 256 texts' total over cached keys, and (text, key, times) of all others."""
        keys, sizes = symbols(texts)
        both = np.sort((keys << np.uint64(8)) | np.repeat(np.arange(len(texts), dtype=np.uint64), sizes))
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, int)
        times, both = np.diff(np.append(first, len(both))), both[first]
        text, keys = (both & np.uint64(255)).astype(np.int64), both >> np.uint64(8)
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(at, len(self.keys) - 1)
            hit = self.keys[at] == keys
        total = np.bincount(text[hit], self.values[at[hit]] * times[hit], len(texts))
        return total, text[~hit], keys[~hit], times[~hit]


def near_trie(model: DataFrame, documents: int, seen: int) -> Trie:
    """The nodes of the ``NEAR`` shortest orders; their number is bounded by the bytes that follow one another."""

    def rows(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(keys, rising=True).view(np.int64)), pa.array(unpack(counts, np.int64))], ["gram", "n"])

    found = model.filter(F.col("kind") == SHORT).select("keys", "counts").mapInArrow(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    keys, counts = found["gram"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    cuts = np.searchsorted(keys, np.arange(NEAR + 1, dtype=np.uint64) << np.uint64(56))
    low = np.uint64((1 << 56) - 1)
    return Trie([(keys[a:b] & low, counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], documents, seen)


def bucket_trie(keys: np.ndarray, counts: np.ndarray, near: Trie, documents: int, seen: int) -> Trie:
    """The whole trie for the contexts of a bucket, from all its n-grams."""
    return Trie([merge([(keys & np.uint64((1 << (8 * (j + 1))) - 1), counts)]) for j in range(NEAR, ORDER + 1)], documents, seen, near)


def hot(model: DataFrame, near, documents: int, seen: int, least_gram: int, least_word: int) -> tuple[np.ndarray, np.ndarray, dict[bytes, float]]:
    """Keys and scores of common n-grams, and log10(count + 1) of common words; bounded by the two limits."""

    def run(batches):
        for batch in batches:
            for kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                n = unpack(counts, np.int64)
                if kind == GRAMS:
                    keys = unpack(keys, rising=True)
                    own = n >= least_gram
                    if own.any():
                        score = bucket_trie(keys, n, near.value, documents, seen).log10(keys[own])
                        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([pack(keys[own], True)], pa.binary()), pa.array([pack(score)], pa.binary())], ["kind", "keys", "scores"])
                else:
                    own = np.flatnonzero(n >= least_word)
                    if len(own):
                        words = keys.split(b" ")
                        own = [i for i in own.tolist() if len(words[i]) <= 64]
                        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([b" ".join([words[i] for i in own])], pa.binary()), pa.array([pack(np.log10(n[own] + 1.0)) if own else b""], pa.binary())], ["kind", "keys", "scores"])

    found = model.filter(F.col("kind") != SHORT).select("kind", "keys", "counts").mapInArrow(run, "kind int, keys binary, scores binary").collect()
    grams = [(unpack(r["keys"], rising=True), unpack(r["scores"], np.float64)) for r in found if r["kind"] == GRAMS]
    common = {w: v for r in found if r["kind"] == WORDS and r["keys"] for w, v in zip(bytes(r["keys"]).split(b" "), unpack(r["scores"], np.float64).tolist(), strict=True)}
    keys, scores = (np.concatenate([g[i] for g in grams]) for i in (0, 1)) if grams else (np.empty(0, np.uint64), np.empty(0))
    order = np.argsort(keys)
    return keys[order], scores[order], common


def answers(model: DataFrame, asked: DataFrame, near, documents: int, seen: int, parts: int) -> DataFrame:
    """Documents as they are, and (flush, who, s, k, b): what a bucket's cold n-grams or words give a flush's documents."""
    own = ["flush", "doc", "id", "held", "n_tokens", "known", "base", "score"]
    names = [*own, "who", "s", "k", "b"]
    blocks = ["bucket", "kind", "flush", "keys", "counts", "repeats", "docs"]

    def run(batches):
        now, held, known = None, None, None

        def batch_of(flush, who, *sums):
            cells = [pack(who, True), *(None if s is None else pack(s) for s in sums)]
            return pa.RecordBatch.from_arrays([pa.array([flush], pa.int64()), *(pa.nulls(1, k) for k in types[1:8]), *(pa.array([c], pa.binary()) for c in cells)], names)

        for batch in batches:
            types = [batch.schema.field(c).type for c in own]
            document = pc.equal(batch["kind"], DOCS)
            some = batch.filter(document).select(own)
            if len(some):
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.nulls(len(some), pa.binary()) for _ in range(4))], names)
            rest = batch.filter(pc.invert(document))
            for place, kind, flush, keys, counts, repeats, docs in zip(*(rest[c].to_pylist() for c in blocks), strict=True):
                if (place, kind) != now:
                    now, held, known = (place, kind), None, None
                if flush is None:
                    held = (keys, counts)
                    continue
                times, who, repeats = (unpack(x, np.uint32) for x in (counts, docs, repeats))
                which = np.repeat(np.arange(len(repeats)), repeats)
                size = int(who.max()) + 1
                if kind == GRAMS:
                    if known is None:
                        mine = (unpack(held[0], rising=True), unpack(held[1], np.int64)) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
                        known = bucket_trie(*mine, near.value, documents, seen)
                    score = known.log10(unpack(keys, rising=True))[which]
                    some = np.flatnonzero(np.bincount(who, minlength=size))
                    yield batch_of(flush, some.astype(np.uint32), np.bincount(who, score * times, size)[some], None, None)
                else:
                    if known is None:
                        known = dict(zip(held[0].split(b" "), unpack(held[1], np.int64).tolist(), strict=True)) if held else {}
                    n = np.array([known.get(w, 0) for w in keys.split(b" ")])[which]
                    some = np.flatnonzero(np.bincount(who, n > 0, size))  # an unknown word adds nothing to either sum
                    if len(some):
                        yield batch_of(flush, some.astype(np.uint32), None, np.bincount(who, times * (n > 0), size)[some].astype(np.int64), np.bincount(who, np.log10(n + 1.0) * times, size)[some])

    kinds = dict(asked.dtypes)
    trained = model.filter(F.col("kind") != SHORT).select("bucket", "kind", "keys", "counts")
    trained = trained.select(*(F.col(c) if c in trained.columns else F.lit(None).cast(k).alias(c) for c, k in asked.dtypes))
    rows = trained.union(asked).repartitionById(parts, "bucket").sortWithinPartitions("bucket", "kind", F.col("flush").asc_nulls_first())
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in own) + ", who binary, s binary, k binary, b binary")


def crc_mod(key: str, mod: int):
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def score(docs: DataFrame, held_out, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score); ``held_out`` is a boolean column."""
    spark = docs.sparkSession
    src = only(docs, key, "text").select(F.col(key).alias("id"), text_of().alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    train = src.filter("NOT held")
    documents, size = train.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts_n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, size // (4 * _BUCKET)))
    buckets = max(min(parts_n, MOST_BUCKETS), min(MOST_BUCKETS, size // _BUCKET))
    model = settle(gather(train, buckets, parts_n), "model")
    sums = {r["kind"]: r for r in model.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}  # a row for each kind
    count_of = lambda kind, c: sums[kind][c] if kind in sums else 0
    words, distinct, seen = count_of(WORDS, "total"), count_of(WORDS, "n") + (documents > 0), count_of(GRAMS, "total")
    total = words + documents
    near = spark.sparkContext.broadcast(near_trie(model, documents, seen))
    shared = spark.sparkContext.broadcast(hot(model, near, documents, seen, max(1, -(-seen // HOT_GRAMS)), max(1, -(-total // HOT_WORDS))))
    summed = added(answers(model, looked_up(src, shared, documents, buckets), near, documents, seen, parts_n), parts_n)
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return summed.select(F.col("id").alias(key), F.col("held").alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def looked_up(src: DataFrame, shared, documents: int, buckets: int) -> DataFrame:
    """Documents with what the cache knows, and blocks of questions to buckets."""
    names = ["flush", "doc", "id", "held", "n_tokens", "known", "base", "score", "bucket", "kind", "keys", "counts", "repeats", "docs"]
    kind_of_id = dict(src.dtypes)["id"]
    end = float(np.log10(documents + 1))

    def run(batches):
        known_keys, known_scores, common = shared.value
        cache = Cache(known_keys, known_scores)
        flush, n_docs, asks = TaskContext.get().partitionId() << 32, 0, 0
        grams, rare = [], []

        def question(place, kind, keys, counts, repeats, who):
            return (place, kind, keys, pack(counts.astype(np.uint32)), pack(repeats.astype(np.uint32)), pack(who.astype(np.uint32)))

        def questions():
            out = []
            if grams:
                who, keys, times = (np.concatenate([g[i] for g in grams]) for i in range(3))
                at = np.argsort(keys)
                who, keys, times = who[at], keys[at], times[at]
                at, places = by_place(gram_place(keys, buckets))
                who, keys, times = who[at], keys[at], times[at]
                for place, a, b in places:
                    own = keys[a:b]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    out.append(question(place, GRAMS, pack(own[first], True), times[a:b], np.diff(np.append(first, b - a)), who[a:b]))
            if rare:
                coded = pa.concat_arrays([r[1] for r in rare]).dictionary_encode()
                words = coded.dictionary.cast(pa.binary()).to_pylist()
                both, times = np.unique((coded.indices.to_numpy().astype(np.uint64) << np.uint64(32)) | np.concatenate([r[0] for r in rare]).astype(np.uint64), return_counts=True)
                which, who = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
                at, places = by_place(np.array([crc32(w) % buckets for w in words], np.uint16)[which])
                which, who, times = which[at], who[at], times[at]
                for place, a, b in places:
                    own = which[a:b]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    out.append(question(place, WORDS, b" ".join([words[i] for i in own[first].tolist()]), times[a:b], np.diff(np.append(first, b - a)), who[a:b]))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            for s in range(0, len(out), 500):
                some = out[s : s + 500]
                empty = (pa.nulls(len(some), k) for k in (pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([flush] * len(some), pa.int64()), *empty, *(pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True))], names)

        for batch in (b.slice(s, _ROWS) for b in batches for s in range(0, b.num_rows, _ROWS)):
            texts = batch.column(1).to_pylist()
            id_type = batch.column(0).type
            for a, b in slices(texts, 1_000_000):
                n = b - a
                scores, cold_doc, cold_key, cold_times = cache.totals(texts[a:b])
                split = tokens(batch.column(1).slice(a, n))
                doc = np.repeat(np.arange(n), split.value_lengths().to_numpy())
                coded = split.flatten().dictionary_encode()
                which = coded.indices.to_numpy()
                value = np.array([common.get(w, np.nan) if w else -1.0 for w in coded.dictionary.cast(pa.binary()).to_pylist()])[which]
                real, cold = value != -1, np.isnan(value)
                warm = real & ~cold
                count = np.bincount(doc[real], minlength=n) + 1
                base = np.bincount(doc[warm], value[warm], n) + end
                known = np.bincount(doc[warm], minlength=n) + (documents > 0)
                if len(cold_doc):
                    grams.append((cold_doc + n_docs, cold_key, cold_times))
                if cold.any():
                    rare.append((doc[cold] + n_docs, coded.dictionary.take(pa.array(which[cold]))))
                asks += len(cold_doc) + int(cold.sum())
                yield pa.RecordBatch.from_arrays([pa.array([flush] * n, pa.int64()), pa.array(range(n_docs, n_docs + n), pa.int64()), batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(count, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array((flush + np.arange(n_docs, n_docs + n)) % buckets, pa.int32()), pa.array([DOCS] * n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(4))], names)
                n_docs += n
                if asks > _FLUSH_ASKS or n_docs > _FLUSH_DOCS:
                    yield from questions()
                    grams, rare, asks, n_docs = [], [], 0, 0
                    flush += 1
        if n_docs:
            yield from questions()

    return src.select("id", "text", "held").mapInArrow(run, f"flush long, doc long, id {kind_of_id}, held boolean, n_tokens long, known long, base double, score double, bucket int, kind int, keys binary, counts binary, repeats binary, docs binary")


def added(gained: DataFrame, parts: int) -> DataFrame:
    """Documents with the answers to their flush's questions added."""
    names = ["id", "held", "n_tokens", "known", "base", "score"]

    def run(batches):
        now, rows, sums = None, [], None

        def start():
            size = max(int(r["doc"].to_numpy().max()) for r in rows) + 1
            return [np.zeros(size, np.int64), np.zeros(size), np.zeros(size)]

        def result():
            held = pa.Table.from_batches(rows).combine_chunks()
            at = held["doc"].to_numpy()
            more = [held[c].to_numpy() + s[at] for c, s in zip(("known", "base", "score"), sums or start(), strict=True)]
            return pa.table([*(held[c] for c in ("id", "held", "n_tokens")), *map(pa.array, more)], names).to_batches()

        for batch in batches:
            flushes = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], flushes[1:] != flushes[:-1]])) if len(flushes) else []
            for a, b in zip(starts, [*starts[1:], len(flushes)], strict=True):
                if flushes[a] != now:
                    if rows:
                        yield from result()
                    now, rows, sums = flushes[a], [], None
                part = batch.slice(a, b - a)
                n = len(part) - part.column(1).null_count  # documents come before answers
                if n:
                    rows.append(part.slice(0, n).select(["doc", *names]))
                if n < len(part):
                    sums = sums or start()
                    for who, score, known, base in zip(*(part.column(c).slice(n).to_pylist() for c in ("who", "s", "k", "b")), strict=True):
                        who = unpack(who, np.uint32, True)
                        for total, x, kind in zip(sums, (known, base, score), (np.int64, np.float64, np.float64), strict=True):
                            if x is not None:
                                total[who] += unpack(x, kind)
        if rows:
            yield from result()

    dealt = gained.repartition(parts, "flush").sortWithinPartitions("flush", F.col("doc").asc_nulls_last())
    return dealt.mapInArrow(run, f"id {dict(gained.dtypes)['id']}, held boolean, n_tokens long, known long, base double, score double")
