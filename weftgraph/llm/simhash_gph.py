"""SimHash fingerprints, linked exactly within a Hamming distance by generalised pigeonhole.

A fingerprint has a bit set if more than half of the shingles' hashes have it. Two texts are linked
if their fingerprints differ in at most ``most`` bits; classes are the components of all links.

Search (over distinct fingerprints, so exact copies cost nothing more):

1. The 64 bits are grouped into ``parts`` partitions of correlated bits, from bit statistics over all
   fingerprints. Histograms of each partition's values, over all fingerprints, give exact counts of
   candidates for every radius.
2. Every fingerprint gets thresholds of its own, one for each partition (-1: not probed), whose sum
   is ``most - parts + 1``. By the pigeonhole principle a pair within ``most`` differs in at most the
   threshold in some partition. Dynamic programming picks the thresholds with the fewest candidates.
3. Index rows carry a partition's value, probe rows every value within the threshold. Rows of equal
   keys meet, are compared by popcount, and only a spanning forest of the verified links leaves, so
   a bucket never emits all its pairs.
4. A bucket that the histograms show to be over ``bucket`` rows is taken apart: its remaining bits
   fall into ``most + 1`` blocks, of which a pair agrees in one at least; a bucket that is still too
   large is dealt as pairs of chunks. Nothing is capped.

Histograms are at most parts * 2^(64 / parts) numbers (1 MB), statistics 64 * 64; both are bounded.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any
other; fewer words than the shingle's width are one shingle; the smallest id names a class; null ids
count only where a class has no other; repeated rows share their class; a very long text is hashed whole,
with its shingles in memory; an empty table gives no rows; other columns don't matter, whatever their names.
A bucket that stays over ``bucket`` rows after two divisions is compared chunk by chunk, which costs the
square of its distinct fingerprints in comparisons, spread over tasks of at most ``bucket`` rows: that takes
more than 4,096 distinct fingerprints that agree in some 40 bits.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.components import components, join_hot
from weftgraph.llm.runtime import only, settle, trim

#: What a row of a bucket is: a fingerprint's own value, a value near it, or its own value that is also probed.
INDEX, PROBE, BOTH = 0, 1, 2
#: Pairs compared at once, and links after which a bucket's forest is made anew (or as many as it has, if more).
CELLS, FRESH = 1 << 18, 1 << 17
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles as an unsigned number."""
    words = text.encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n).view(np.uint8).reshape(n, 8)
    sets = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * sets > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """All columns of ``docs`` and ``__fp``, a signed 64-bit number."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py() or "", width) for x in batch.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*batch.schema.names, "__fp"])

    return docs.mapInArrow(run, _plus(docs, "__fp"))


def _plus(docs: DataFrame, name: str):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([*docs.schema.fields, StructField(name, LongType())])


# -- partitions and thresholds ---------------------------------------------------------------


def _longs(batch, name) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each pair of bits is set together, over all of them."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(_longs(batch, "fp").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int32()), pa.array([*total.ravel(), n], pa.float64())], ["cell", "n"])

    rows = prints.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows
    cells = np.zeros(4097)
    for r in rows:
        cells[r.cell] = r.n
    return int(cells[-1]), cells[:-1].reshape(64, 64)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[np.ndarray]:
    """Partitions of correlated bits, equal in size: each grows from the bit least like those taken."""
    share = together / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(64)), []
    for _ in range(parts):
        part = [max(sorted(free), key=lambda b: corr[b, sorted(free - {b})].sum() if len(free) > 1 else 0.0)]
        free.discard(part[0])
        while len(part) < 64 // parts:
            best = max(sorted(free), key=lambda b: corr[b, part].sum())
            part.append(best)
            free.discard(best)
        out.append(np.array(sorted(part)))
    return out


def values(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of a partition, packed low to high."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> int(b)) & 1) << k
    return out


def histograms(prints: DataFrame, groups: list[np.ndarray]) -> np.ndarray:
    """How many fingerprints have each value of each partition."""
    size = 1 << len(groups[0])

    def run(batches):
        total = np.zeros((len(groups), size), np.int64)
        for batch in batches:
            fps = _longs(batch, "fp")
            for i, bits in enumerate(groups):
                total[i] += np.bincount(values(fps, bits), minlength=size)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total.ravel()[cell], pa.int64())], ["cell", "n"])

    summed = prints.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # bounded by parts * size
    out = np.zeros(len(groups) * size, np.int64)
    out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(len(groups), size)


def balls(counts: np.ndarray, most: int) -> np.ndarray:
    """[partition, radius, value]: fingerprints within the radius of the value, for radii 0 to most."""
    parts, size = counts.shape
    shell = [counts]
    for r in range(1, most + 1):  # shells of radius r by the recurrence r*S_r = sum of flips of S_{r-1} - (bits - r + 2) * S_{r-2}
        width = size.bit_length() - 1
        flips = sum(shell[-1].reshape(parts, -1, 2, 1 << b)[:, :, ::-1, :].reshape(parts, size) for b in range(width))
        shell.append((flips - (width - r + 2) * (shell[-2] if r > 1 else 0)) // r)
    return np.cumsum(np.stack(shell, 1), axis=1)


def thresholds(cost: np.ndarray, total: int) -> np.ndarray:
    """The cheapest thresholds with the given sum for each row; cost[row, partition, threshold + 1]."""
    rows, parts, options = cost.shape
    lowest, span = -parts, options * parts
    best = np.full((rows, span), np.inf)
    best[:, -lowest] = 0
    picks = []
    for i in range(parts):
        after, pick = np.full((rows, span), np.inf), np.zeros((rows, span), np.int8)
        for k in range(options):
            step = k - 1
            moved = np.full((rows, span), np.inf)
            a, b = max(0, step), min(span, span + step)
            moved[:, a:b] = best[:, a - step : b - step] + cost[:, i, k, None]
            better = moved < after
            after[better], pick[better] = moved[better], step
        best = after
        picks.append(pick)
    at = np.full(rows, total - lowest)
    out = np.zeros((rows, parts), np.int8)
    for i in reversed(range(parts)):
        out[:, i] = picks[i][np.arange(rows), at]
        at = at - out[:, i]
    return out


def _flips(bits: np.ndarray, radius: int) -> np.ndarray:
    """XOR masks within the radius of nothing, over the partition's places in a fingerprint."""
    return np.array([sum((1 << int(b)) for b in c) for r in range(radius + 1) for c in combinations(bits, r)], dtype=np.uint64).view(np.int64)


def _mask(bits) -> int:
    return int(np.array(sum(1 << int(b) for b in bits), dtype=np.uint64).view(np.int64))


def _blocks(used: tuple, groups: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The bits outside the used partition and blocks, in most + 1 blocks."""
    first, *rest = used
    left = np.array([b for i, g in enumerate(groups) if i != first for b in g])
    for j in rest:
        taken = np.array_split(left, most + 1)[j]
        left = np.array([b for b in left if b not in set(taken.tolist())])
    return np.array_split(left, most + 1)


def links(prints: DataFrame, most: int = 3, parts: int = 4, bucket: int = 4096, trees: bool = False) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (column ``fp``, distinct) within ``most`` bits.

    An edge leads to the smallest fingerprint that is linked with ``u`` in a bucket; with ``trees`` every
    edge is itself a pair within ``most`` bits, the nearest ones first (a bucket's minimum spanning forest).
    """
    n, together = bit_statistics(prints)
    groups = group_bits(n, together, parts)
    counts = histograms(prints, groups)
    near = balls(counts, most)
    probes = np.array([len(_flips(groups[0], r)) for r in range(most + 1)])
    shared = prints.sparkSession.sparkContext.broadcast((groups, near))

    def emit(batches):
        groups, near = shared.value
        flips = [[_flips(g, r) for r in range(most + 1)] for g in groups]
        masks = [_mask(g) for g in groups]
        for batch in batches:
            for s in range(0, batch.num_rows, 20_000):
                fps = _longs(batch.slice(s, 20_000), "fp")
                cost = np.zeros((len(fps), parts, most + 2))
                for i, g in enumerate(groups):
                    cost[:, i, 1:] = near[i][:, values(fps, g)].T + probes
                chosen = thresholds(cost, most - parts + 1)
                for i, g in enumerate(groups):
                    for t in range(-1, most + 1):
                        own = fps[chosen[:, i] == t]
                        if not len(own):
                            continue
                        around = flips[i][max(t, 0)]
                        for c in range(0, len(own), 2_000):
                            some = own[c : c + 2_000]
                            keys = ((some[:, None] ^ around[None, :]) & masks[i]).ravel()
                            who = np.repeat(some, len(around))
                            role = np.full(len(who), PROBE, np.int32)
                            role[:: len(around)] = INDEX if t < 0 else BOTH  # no flip comes first: the fingerprint's own value
                            filled = near[i][0][values(keys, g)]
                            asked = filled > 0
                            if asked.any():
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(asked.sum()), i, np.int32)), pa.array(keys[asked]), pa.array(who[asked]), pa.array(role[asked]), pa.array(filled[asked] > bucket)], ["path", "val", "fp", "role", "hot"])

    rows = prints.select("fp").mapInArrow(emit, "path int, val long, fp long, role int, hot boolean")
    hot = int(near[:, 0].max(initial=0)) > bucket
    if hot:
        rows = settle(rows, "probes")
    cool = rows.filter("NOT hot").select("path", "val", F.lit(0).alias("cell"), "fp", "role")
    if hot:
        cool = cool.union(_take_apart(rows.filter("hot").select("path", "val", "fp", "role"), groups, most, bucket))
    return meet(cool, most, trees)


def _take_apart(rows: DataFrame, groups: list[np.ndarray], most: int, bucket: int) -> DataFrame:
    """Rows of buckets that are too large, under the keys of smaller ones."""
    shared = rows.sparkSession.sparkContext.broadcast(groups)

    def refine(batches):
        groups = shared.value
        masks: dict[int, list[int]] = {}
        for batch in batches:
            path, val, fp, role = (_longs(batch, c) for c in ("path", "val", "fp", "role"))
            for p in np.unique(path).tolist():
                if p not in masks:
                    masks[p] = [_mask(b) for b in _blocks(_used(p, most), groups, most)]
                own = path == p
                for j, mask in enumerate(masks[p]):
                    k = int(own.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, (p + 1) * 16 + j, np.int32)), pa.array(val[own] | (fp[own] & mask)), pa.array(fp[own]), pa.array(role[own], pa.int32())], ["path", "val", "fp", "role"])

    schema = "path int, val long, fp long, role int"
    done = None
    for _ in range(2):
        rows = rows.mapInArrow(refine, schema)
        sizes = rows.groupBy("path", "val").agg(F.count("*").alias("n")).filter("n > 1")
        rows = settle(rows.join(sizes, ["path", "val"]), "buckets")
        small = rows.filter(F.col("n") <= bucket).select("path", "val", F.lit(0).alias("cell"), "fp", "role")
        done = small if done is None else done.union(small)
        rows = rows.filter(F.col("n") > bucket)
        large, rows = rows, rows.select("path", "val", "fp", "role")
    chunks = F.ceil(F.col("n") * 2 / F.lit(bucket)).cast("int")
    dealt = large.withColumn("c", chunks).withColumn("a", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    cells = F.expr("transform(sequence(0, c - 1), b -> least(a, b) * c + greatest(a, b))")
    return done.union(dealt.select("path", "val", F.explode(cells).alias("cell"), "fp", "role"))


def _used(path: int, most: int) -> tuple:
    out = []
    while path >= 16:
        out.append(path % 16)
        path = path // 16 - 1
    return (path, *reversed(out))


def meet(rows: DataFrame, most: int, trees: bool = False) -> DataFrame:
    """A spanning forest of the links within each (path, val, cell)."""

    def run(batches):
        held = None
        for batch in batches:
            now = np.stack([_longs(batch, c) for c in ("path", "val", "cell", "fp", "role")])
            if held is not None:
                now = np.concatenate([held, now], axis=1)
            last = np.flatnonzero((now[:3, :-1] != now[:3, 1:]).any(0))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = now[:, cut:]
            if cut:
                yield join(now[:, :cut], most)
        if held is not None and held.shape[1]:
            yield join(held, most)
        held = now = batch = None
        trim()

    join = _trees if trees else _forest
    dealt = rows.repartition("path", "val", "cell").sortWithinPartitions("path", "val", "cell", "fp", "role")
    return dealt.mapInArrow(run, "u long, v long")


def _trees(rows: np.ndarray, most: int) -> pa.RecordBatch:
    """The nearest links between probes and index rows that span all of them, over the groups of ``rows``."""
    fp, role = rows[3].view(np.uint64), rows[4]
    starts = np.concatenate([[0], np.flatnonzero((rows[:3, :-1] != rows[:3, 1:]).any(0)) + 1])
    kept, fresh, held = np.empty((3, 0), np.int64), [], 0
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.shape[1]], strict=True):
        index, probes = fp[a:b][role[a:b] != PROBE], fp[a:b][role[a:b] != INDEX]
        if not len(index) or not len(probes):
            continue
        for c in range(0, len(probes), most_cells := max(1, CELLS // len(index))):
            apart = np.bitwise_count(probes[c : c + most_cells, None] ^ index[None, :])
            i, j = np.nonzero((apart <= most) & (apart > 0))
            if len(i):
                fresh.append(np.stack([probes[c : c + most_cells][i].view(np.int64), index[j].view(np.int64), apart[i, j].astype(np.int64)]))
                held += len(i)
            if held > max(FRESH, kept.shape[1]):
                kept, fresh, held = spanning(np.concatenate([kept, *fresh], axis=1)), [], 0
    kept = spanning(np.concatenate([kept, *fresh], axis=1)) if fresh else kept
    return pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1])], ["u", "v"])


def spanning(edges: np.ndarray) -> np.ndarray:
    """A minimum spanning forest of (u, v, distance), by Boruvka's rounds; ties go to the smaller pair."""
    edges = edges[:, np.lexsort((edges[1], edges[0], edges[2]))]
    nodes, ends = np.unique(edges[:2], return_inverse=True)
    a, b = ends.reshape(2, -1)
    part, chosen = np.arange(len(nodes)), []
    rank = np.arange(len(a))
    while True:
        live = part[a[rank]] != part[b[rank]]
        rank = rank[live]
        if not len(rank):
            break
        best = np.full(len(nodes), len(a))
        for side in (a, b):
            np.minimum.at(best, part[side[rank]], rank)
        picked = np.unique(best[best < len(a)])
        chosen.append(picked)
        while True:  # the parts that the picked edges join take their smallest number
            x, y = part[a[picked]], part[b[picked]]
            low = np.minimum(x, y)
            if (x == y).all():
                break
            to = np.arange(len(nodes))
            np.minimum.at(to, np.maximum(x, y), low)
            part = to[to[part]]
    return edges[:, np.concatenate(chosen)] if chosen else edges[:, :0]


def _forest(rows: np.ndarray, most: int) -> pa.RecordBatch:
    """Links between neighbours at growing offsets in sorted rows, reduced to a forest on the way."""
    fp = rows[3]
    group = np.concatenate([[0], np.cumsum((rows[:3, :-1] != rows[:3, 1:]).any(0))])
    sizes = np.bincount(group)
    edges = np.empty((2, 0), np.int64)
    live = np.arange(len(fp))
    ends = np.cumsum(sizes)[group]
    step, fresh, held = 1, [], 0
    while True:
        live = live[live + step < ends[live]]
        if not len(live):
            break
        other = live + step
        hit = np.bitwise_count((fp[live] ^ fp[other]).view(np.uint64)) <= most
        hit &= fp[live] != fp[other]
        if hit.any():
            fresh.append(np.stack([fp[live[hit]], fp[other[hit]]]))
            held += int(hit.sum())
            if held > 500_000:
                edges, fresh, held = _span(np.concatenate([edges, *fresh], axis=1)), [], 0
        step += 1
    edges = _span(np.concatenate([edges, *fresh], axis=1)) if fresh else edges
    return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["u", "v"])


def _span(edges: np.ndarray) -> np.ndarray:
    """(node, smallest node reachable) for the nodes of an edge list, without the roots themselves."""
    nodes, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    own = root != np.arange(len(nodes))
    return np.stack([nodes[own], nodes[root[own]]])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = 3, bucket: int = 4096) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``."""
    return classes(with_fingerprints(only(docs, key, text).select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "text", width).select("doc_id", "__fp"), most, bucket).withColumnRenamed("doc_id", key)


def classes(keyed: DataFrame, most: int = 3, bucket: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id, __fp) from (doc_id, __fp)."""
    keyed = settle(keyed, "fingerprints")
    distinct = settle(keyed.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, most, bucket=bucket))
    rooted = settle(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    named = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    by_print = settle(join_hot(rooted, named, "root", rooted.count()).select(F.col("fp").alias("__fp"), "component_id"), "named")
    return keyed.join(by_print, "__fp").select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id", "__fp")


# -- similar texts ---------------------------------------------------------------------------


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; fewer words are one shingle, no words none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    found = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common elements of two sorted sets; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def digest_of(text: str = "text"):
    """16 bytes that name a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def first_of_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, width: int = 5, most: int = 11, bucket: int = 1 << 15) -> DataFrame:
    """(key, __text, copies): the smallest key of each class of similar texts, the name of its text, and how often
    that row is there.

    Texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least ``least``,
    which is checked on every link that counts. Candidates are pairs of SimHash fingerprints (three-word
    shingles, which stay closer than five-word ones) within ``most`` bits; of a bucket's candidates its
    minimum spanning forest is checked, so a group of copies costs a link for each member and not for each
    pair. Texts of equal fingerprints are checked against one of them. Rows with equal texts are one text.
    Partitions are fewer and wider for more fingerprints, so that a bucket has ``bucket`` / 2 on average at most.
    """
    docs = only(docs, key, text).select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = settle(with_fingerprints(docs).select("doc_id", digest_of().alias("__text"), "__fp"), "fingerprints")
    rows = keyed.groupBy("__text", "doc_id").agg(F.first("__fp").alias("fp"), F.count("*").alias("n"))
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n"))
    texts = settle(rows.groupBy("__text").agg(least_row.alias("f"), F.first("fp").alias("fp")).select("__text", F.col("f.doc_id").alias("least"), F.col("f.n").alias("copies"), "fp"), "texts")
    prints = settle(texts.groupBy("fp").agg(F.min("__text").alias("own")), "distinct")
    n = prints.count()
    parts = next((p for p in (6, 5, 4) if n >> (64 // p) <= bucket // 2), 4)
    pairs = links(prints, most, parts, bucket, trees=True).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    named = pairs.join(prints.select(F.col("fp").alias("u"), F.col("own").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("own").alias("b")), "v").select("a", "b")
    alike = texts.join(prints, "fp").filter("__text != own").select(F.col("__text").alias("a"), F.col("own").alias("b"))
    tried = settle(named.union(alike), "candidates")
    wanted = tried.select("a").union(tried.select("b")).distinct().withColumnRenamed("a", "__text").join(texts, "__text").select("__text", F.col("least").alias("__least"))

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py(), width).tobytes() for x in batch.column(1)], pa.binary())], ["name", "words"])

    def verified(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in ("x", "y"))
            good = pa.array([jaccard(x, y) >= least for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good).rename_columns(["u", "v"])

    own = docs.withColumn("name", digest_of())
    found = own.join(wanted, (F.col("name") == F.col("__text")) & F.col("doc_id").eqNullSafe(F.col("__least")), "left_semi")
    known = settle(found.select("name", "text").mapInArrow(sets, "name binary, words binary").groupBy("name").agg(F.first("words").alias("words")), "shingles")
    met = tried.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b").select("a", "b", "x", "y")
    roots = components(met.mapInArrow(verified, "u binary, v binary"))
    rooted = texts.join(roots.withColumnRenamed("node", "__text"), "__text", "left")
    first = rooted.groupBy(F.coalesce("root", "__text").alias("root")).agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "__text", "copies")).alias("f"))
    return first.select(F.col("f.least").alias(key), F.col("f.__text").alias("__text"), F.col("f.copies").alias("copies"))
