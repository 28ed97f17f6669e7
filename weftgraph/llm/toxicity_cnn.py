"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings: of the word itself and of its beginnings of four, five
and six letters. Filters of widths one, two and three run over the words; each is rectified and
max-pooled over the whole text, and a linear layer gives the logit. As a filter is linear before its
pooling, its response is a sum of one projection per word and place, so scoring looks up projections
of distinct words and adds shifted rows.

The weights, the counts of texts that share an embedding and the thresholds come from all labelled rows of
the fold. ``Network.fit`` only finds where the weights start from: on a bounded draw (``SAMPLE`` positive and
``NEGATIVES`` negative rows with the lowest hashes of their id, of ``SAMPLE_BYTES`` in all), in the driver.
Then ``PASSES`` passes over all labelled rows follow. They are dealt by hashes of their ids into shards of some
``SHARD_BYTES`` of text, whatever a text's length; in a pass each shard steps through all its rows from the
common weights, and the new common weights are the means over the shards, of an embedding over the steps that
touched it. The sums for these means are of whole numbers, so they don't depend on which task added what.
Embeddings that fewer than ``LEAST_TEXTS`` of all labelled texts share stay zero, there and in all scored texts:
what one text alone has can't be learned from. Each step leaves out a random half of the words, so that no
filter can rest on one word of a text, and weighs positive texts up to their share.

Thresholds are the logits with the fewest errors by language over all labelled rows of the fold, each counted on
a grid of logits of 1 / ``GRID``; a language with under ten positives there takes the common threshold. These
rows also gave the weights: on the small tables that judged held-out rows better than a part kept back (README).
The language is read from the text's own function words, and no column but the text is an input of a score. The
score is the logistic function of the logit less its language's threshold, so 0.5 is the threshold, and a score
of just 0.5 is predicted positive.

Defined cases: null and empty texts score as texts without words; with no labelled rows at all every
score is 0; labels other than 0 and 1 aren't used; an id that is labelled both ways is positive; repeated rows are
learned from and scored each, and those of one id are in one shard; a very long text is read whole, in
memory for one text; an empty table gives no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import copy
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weftgraph.llm.ppm import crc_mod
from weftgraph.llm.runtime import forget, only, settle, slices, spans, trim

SAMPLE, NEGATIVES, SAMPLE_BYTES = 1_500, 6_000, 64_000_000
ROUNDS, STEPS = (12, 60), 1_500
SHARD_BYTES, PASSES, BATCH = 8_000_000, 4, 32
#: Steps of the grid of logits to one, the most bits that tell labelled ids, rows of sums that travel together, and
#: the most partitions that shards are dealt to.
GRID, ID_BITS, BLOCK, MOST_PARTITIONS = 256, 1 << 27, 2048, 20_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
PLACES = [(w, k) for w in WIDTHS for k in range(w)]
#: Texts of the fit that must share a bucket of embeddings.
LEAST_TEXTS = 3
#: Share of words left out of each step of the fit, and the most that a positive text weighs against a negative.
LEFT_OUT, MOST_WEIGHT = 0.5, 8.0
_WORD = re.compile(r"[^\W_]+")

# Function words that tell the languages apart.
TELLING = [
    "the and is of to in that it for was with are this be by from or have not".split(),
    "der die das und ist von mit nicht zu sich auf für den dem ein eine auch im".split(),
    "le la les des et est une du que qui dans pour pas sur au avec par sont".split(),
    "el los las y que en un del por con para se no su es como una lo".split(),
]
_TELLS = {w: n for n, ws in enumerate(TELLING) for w in ws if sum(w in o for o in TELLING) == 1}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashes(distinct: list[str]) -> np.ndarray:
    """Four bucket numbers for each word."""
    h = xxhash.xxh32_intdigest
    flat = (n for w in distinct for n in (h(w, 1), h(w[:4], 2), h(w[:5], 3), h(w[:6], 4)))
    return np.fromiter(flat, np.int64, 4 * len(distinct)).reshape(-1, 4) % BUCKETS


def tells(distinct: list[str]) -> np.ndarray:
    out = np.zeros((len(distinct), len(TELLING)), np.float32)
    for i, w in enumerate(distinct):
        if w in _TELLS:
            out[i, _TELLS[w]] = 1
    return out


def flatten(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the texts' word numbers (0 is padding after each text) and each text's start."""
    index: dict[str, int] = {}
    ids, starts, at = [], [], 0
    number = index.setdefault
    for t in texts:
        starts.append(at)
        own = [number(w, len(index)) for w in words(t)]
        ids.append(np.array(own, np.int64) + 1)
        ids.append(np.zeros(max(WIDTHS), np.int64))
        at += len(own) + max(WIDTHS)
    return list(index), np.concatenate(ids) if ids else np.empty(0, np.int64), np.array(starts, np.int64)


#: The weights besides embeddings.
DENSE = ("filters", "bias", "out", "shift")


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)  # the last one is zero
        self.filters = rng.normal(0, 0.3, (DIM, len(PLACES) * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.full(1, -1.0, np.float32)
        self.limits = np.zeros(len(TELLING) + 1)
        self.squares = {k: np.full_like(getattr(self, k), 1e-2) for k in ("embed", *DENSE)}
        self.shared = None  # texts that share each bucket; from the texts of the fit if not given
        self.trained = False

    def project(self, buckets: np.ndarray) -> np.ndarray:
        """A row of projections for padding and for each word."""
        return np.concatenate([np.zeros((1, self.filters.shape[1]), np.float32), self.embed[buckets].sum(1) @ self.filters])

    def respond(self, rows: np.ndarray, ids: np.ndarray, starts: np.ndarray):
        """Pooled responses before rectification, and where in ``ids`` each one was found."""
        pooled, n = np.empty((len(starts), len(WIDTHS) * FILTERS), np.float32), len(ids)
        ends = np.append(starts[1:], n)
        for i, width in enumerate(WIDTHS):
            total = np.zeros((n, FILTERS), np.float32)
            for k in range(width):
                at = PLACES.index((width, k)) * FILTERS
                total[: n - k] += rows[ids[k:], at : at + FILTERS]
            for k in range(1, width):
                total[ends - k] = 0  # a window that begins in a text's padding doesn't see the next text
            pooled[:, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(total, starts)
            if i == 0:
                totals = []
            totals.append(total)
        return pooled, totals

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def fit(self, texts: list[str], labels: np.ndarray, batch: int = BATCH, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        if self.shared is None:
            self.shared = shares(hashes(list(dict.fromkeys(words(t)))) for t in texts)
        self.embed[:BUCKETS][self.shared < LEAST_TEXTS] = 0
        ready, weight = [], weight_of(labels.sum(), len(labels))
        for s in range(0, len(texts), batch):
            distinct, ids, starts = flatten(texts[s : s + batch])
            ready.append((self.known(hashes(distinct)).astype(np.int32), ids.astype(np.int32), starts, labels[s : s + batch]))
        for _ in range(min(ROUNDS[1], max(ROUNDS[0], STEPS // len(ready)))):
            for i in rng.permutation(len(ready)):
                self.step(*ready[i], weight, rng)
        self.trained = True

    def known(self, buckets: np.ndarray) -> np.ndarray:
        """The buckets, and the one that stays zero in place of those that too few texts share."""
        return np.where(self.shared[buckets] < LEAST_TEXTS, BUCKETS, buckets)

    def step(self, buckets: np.ndarray, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: float, rng, rate: float = 0.1) -> np.ndarray:
        """One step of AdaGrad; ``buckets`` are those of words 1, 2, ... of ``ids``. The buckets that it touched."""
        ids = np.where(rng.random(len(ids)) < LEFT_OUT, 0, ids)
        vectors = np.concatenate([np.zeros((1, DIM), np.float32), self.embed[buckets].sum(1)])
        pooled, totals = self.respond(vectors @ self.filters, ids, starts)
        active = np.maximum(pooled + self.bias, 0)
        z = active @ self.out + self.shift
        g = ((1 / (1 + np.exp(-z)) - y) / len(y) * np.where(y > 0, weight, 1.0)).astype(np.float32)
        d_out = active.T @ g
        d_pool = g[:, None] * self.out * (active > 0)
        d_vectors, d_filters = np.zeros_like(vectors), np.zeros_like(self.filters)
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True))
        for w, width in enumerate(WIDTHS):
            where = np.stack([a + totals[w][a:b].argmax(0) for a, b in spans])
            d = d_pool[:, w * FILTERS : (w + 1) * FILTERS]
            for k in range(width):
                at = PLACES.index((width, k)) * FILTERS
                word = ids[np.minimum(where + k, len(ids) - 1)]
                some = self.filters[:, at : at + FILTERS]
                d_filters[:, at : at + FILTERS] = np.einsum("nf,nfd->df", d, vectors[word])
                np.add.at(d_vectors, word.ravel(), (d[:, :, None] * some.T).reshape(-1, DIM))
        touched = np.flatnonzero(np.abs(d_vectors[1:]).sum(1))
        spread = buckets[touched].ravel()
        some, back = np.unique(spread, return_inverse=True)
        d_embed = np.zeros((len(some), DIM), np.float32)
        np.add.at(d_embed, back, np.repeat(d_vectors[1:][touched], 4, axis=0))
        self.squares["embed"][some] += d_embed**2
        self.embed[some] -= rate * d_embed / np.sqrt(self.squares["embed"][some])
        self.embed[BUCKETS] = 0
        for k, d in zip(DENSE, (d_filters, d_pool.sum(0), d_out, g.sum(keepdims=True)), strict=True):
            self.squares[k] += d**2
            setattr(self, k, (getattr(self, k) - rate * d / np.sqrt(self.squares[k])).astype(np.float32))
        return some[some < BUCKETS]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and their squares as rows: one for each embedding, then all others."""
        rest = [np.concatenate([np.ravel(get(k)) for k in DENSE]) for get in (lambda k: getattr(self, k), self.squares.get)]
        rest = [np.pad(r, (0, -len(r) % DIM)).reshape(-1, DIM) for r in rest]
        return tuple(np.concatenate([e[:BUCKETS], r]).astype(np.float64) for e, r in zip((self.embed, self.squares["embed"]), rest, strict=True))

    def take(self, weights: np.ndarray, squares: np.ndarray) -> None:
        """The inverse of ``table``."""
        for source, put in ((weights, lambda k, v: setattr(self, k, v)), (squares, self.squares.__setitem__)):
            old = self.squares["embed"][BUCKETS:] if source is squares else self.embed[BUCKETS:]
            put("embed", np.concatenate([source[:BUCKETS].astype(np.float32), old]))
            rest, at = source[BUCKETS:].ravel().astype(np.float32), 0
            for k in DENSE:
                shape = getattr(self, k).shape
                put(k, rest[at : at + int(np.prod(shape))].reshape(shape))
                at += int(np.prod(shape))

    def calibrate(self, texts: list[str], labels: np.ndarray, rate: float) -> None:
        """For each language the logit with the fewest errors, where positives are ``rate`` of all texts."""
        z, language = self.raw(texts)
        weight = (1 - rate) / rate * labels.sum() / max(1, (labels == 0).sum())
        self.settle_limits(language, np.rint(z * GRID), np.where(labels > 0, 0, weight), np.where(labels > 0, 1, 0))

    def settle_limits(self, language: np.ndarray, at: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> None:
        """Thresholds from how many (or what weight of) texts of a language have a logit of ``at / GRID``."""
        self.limits[:] = _limit(at, clean, toxic, 0.0)
        for k in range(len(self.limits)):
            own = language == k
            if toxic[own].sum() >= 10:
                self.limits[k] = _limit(at[own], clean[own], toxic[own], self.limits[k])

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        scorer, zs, languages = WordRows(self), [], []
        for a, b in slices(texts, 1_000_000):
            z, lang = scorer.logits(texts[a:b])
            zs.append(z)
            languages.append(lang)
        return np.concatenate(zs), np.concatenate(languages)


def _limit(at: np.ndarray, clean: np.ndarray, toxic: np.ndarray, default: float) -> float:
    """The middle of the logits between which the weighted error is least."""
    if not toxic.sum() or not clean.sum():
        return default
    steps, back = np.unique(at, return_inverse=True)
    below = np.concatenate([[0], np.cumsum(np.bincount(back, toxic))])
    above = np.concatenate([np.cumsum(np.bincount(back, clean)[::-1])[::-1], [0]])
    best = np.flatnonzero(below + above <= (below + above).min() + 1e-9)
    cut = best[len(best) // 2]
    s = np.concatenate([[steps[0] - GRID], steps, [steps[-1] + GRID]]) / GRID
    return float((s[cut] + s[cut + 1]) / 2)


def shares(buckets_of_texts) -> np.ndarray:
    """How many texts have each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for buckets in buckets_of_texts:
        out[np.unique(buckets)] += 1
    return out


def weight_of(toxic: float, rows: float) -> float:
    """What a positive text weighs against a negative one."""
    return min(MOST_WEIGHT, max(1.0, (rows - toxic) / max(1, toxic)))


class WordRows:
    """Projections of words met so far, bounded."""

    def __init__(self, net: Network, most: int = 120_000):
        self.net, self.most = net, most
        self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(PLACES) * FILTERS), np.float32)
        self.tells = np.zeros((1024, len(TELLING)), np.float32)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.most:
            self._reset()
        old, index = len(self.index), self.index
        number = index.setdefault
        ids, starts, at = [], [], 0
        gap = np.zeros(max(WIDTHS), np.int64)
        for t in texts:
            starts.append(at)
            own = np.array([number(w, len(index) + 1) for w in words(t)], np.int64)
            ids += [own, gap]
            at += len(own) + len(gap)
        fresh = list(index)[old:]
        if fresh:
            need = len(index) + 1
            if need > len(self.rows):
                room = max(need, 2 * len(self.rows)) - len(self.rows)
                self.rows = np.concatenate([self.rows, np.zeros((room, self.rows.shape[1]), np.float32)])
                self.tells = np.concatenate([self.tells, np.zeros((room, self.tells.shape[1]), np.float32)])
            self.rows[old + 1 : need] = self.net.project(hashes(fresh))[1:]
            self.tells[old + 1 : need] = tells(fresh)
        flat, starts = np.concatenate(ids), np.array(starts)
        pooled, _ = self.net.respond(self.rows, flat, starts)
        told = np.add.reduceat(self.tells[flat], starts)
        return self.net.logits(pooled).astype(np.float64), np.where(told.sum(1) > 0, told.argmax(1), len(TELLING))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.net.trained:
            return np.zeros(len(texts))
        z, language = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(z - self.net.limits[language], -500, 500)))


#: A shard of labelled texts: buckets of its distinct words, the texts' word numbers (from 0), words, labels and
#: languages of each text, and how many texts have each bucket.
SHARD = "shard int, buckets binary, ids binary, sizes binary, labels binary, languages binary, shared binary"


class Shard:
    def __init__(self, row: dict):
        as_ = lambda k, kind: np.frombuffer(row[k], kind)
        self.number, self.buckets, self.ids = row["shard"], as_("buckets", np.uint16).reshape(-1, 4), as_("ids", np.uint32)
        self.sizes, self.labels, self.languages = as_("sizes", np.int64), as_("labels", np.uint8), as_("languages", np.uint8)
        self.ends = np.cumsum(self.sizes)

    @staticmethod
    def packed(number: int, texts: list[str], labels: list[int]) -> dict:
        index: dict[str, int] = {}
        own = [np.array([index.setdefault(w, len(index)) for w in words(t)], np.uint32) for t in texts]
        distinct, ids = list(index), np.concatenate(own)
        buckets, sizes = hashes(distinct), np.array([len(o) for o in own], np.int64)
        telling = tells(distinct)
        told = np.array([telling[o].sum(0, dtype=np.float64) for o in own])  # text by text: no table as long as ids
        languages = np.where(told.sum(1) > 0, told.argmax(1), len(TELLING)).astype(np.uint8)
        arrays = [buckets.astype(np.uint16), ids, sizes, np.array(labels, np.uint8), languages, shares(buckets[np.unique(o)] for o in own)]
        return {"shard": number} | {k.split()[0]: a.tobytes() for k, a in zip(SHARD.split(", ")[1:], arrays, strict=True)}

    def batches(self, texts: int, most: int = 0):
        """Range, buckets, word numbers (0 is padding after each text) and starts of texts that are next to each other."""
        a = 0
        while a < len(self.sizes):
            begin = self.ends[a] - self.sizes[a]
            b = min(len(self.sizes), a + texts) if texts else max(a + 1, int(np.searchsorted(self.ends, begin + most, "right")))
            some, back = np.unique(self.ids[begin : self.ends[b - 1]], return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(self.sizes[a : b - 1] + max(WIDTHS))])
            ids = np.zeros(len(back) + (b - a) * max(WIDTHS), np.int64)
            ids[np.arange(len(back)) + np.repeat(np.arange(b - a) * max(WIDTHS), self.sizes[a:b])] = back + 1
            yield slice(a, b), self.buckets[some].astype(np.int64), ids, starts
            a = b

    def learn(self, net: Network, weight: float, turn: int) -> np.ndarray:
        """One pass over all rows; how many steps touched each row of the network's table."""
        rng, steps = np.random.default_rng([7, turn, self.number]), np.zeros(len(net.table()[0]), np.int64)
        ready = list(self.batches(BATCH))
        for i in rng.permutation(len(ready)):
            own, buckets, ids, starts = ready[i]
            steps[net.step(net.known(buckets), ids, starts, self.labels[own].astype(np.float32), weight, rng)] += 1
            steps[BUCKETS:] += 1
        return steps

    def logits(self, net: Network) -> np.ndarray:
        out = [net.logits(net.respond(net.project(buckets), ids, starts)[0]) for _, buckets, ids, starts in self.batches(0, 200_000)]
        return np.concatenate(out).astype(np.float64)


def dealt(docs: DataFrame, known: DataFrame, key: str, rows: int) -> DataFrame:
    """All rows of ``docs`` (key, t) whose key has a label in ``known`` (key, y), as shards; a shard's texts meet in one task.

    So that only labelled texts travel, texts first pass a bitmap of the hashes of labelled keys, of 16 MB at
    most; what else passes it finds no label in its shard.
    """
    bits = min(ID_BITS, max(1 << 15, 1 << (16 * rows - 1).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    maps = known.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__map"))
    spot = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__map", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = docs.withColumn("__part", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "__part")
    found = found.filter(F.getbit(byte, (spot % 8).cast("int")) == 1).select(key, "t")
    size = found.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    many = size // SHARD_BYTES + 1
    shard = F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(many)).cast("int").alias("shard")

    def pack(texts: pa.Table, labels: pa.Table) -> pa.Table:
        label = dict(zip(labels[key].to_pylist(), labels["y"].to_pylist(), strict=True))
        own = []
        for batch in texts.to_batches(max_chunksize=512):  # texts without a label aren't held as strings, too
            own += [(h, t, label[k]) for h, k, t in zip(*(batch.column(c).to_pylist() for c in ("h", key, "t")), strict=True) if k in label]
        own.sort()
        schema = pa.schema([(n, pa.int32() if kind == "int" else pa.binary()) for n, kind in (c.split() for c in SHARD.split(", "))])
        if not own:
            return schema.empty_table()
        out = pa.Table.from_pylist([Shard.packed(texts["shard"][0].as_py(), [t for _, t, _ in own], [y for *_, y in own])], schema)
        own.clear()
        trim()
        return out

    sides = found.select(shard, key, "t", F.xxhash64(key).alias("h")), known.select(shard, key, "y")
    ours, theirs = (side.repartition(min(2 * many, MOST_PARTITIONS), "shard").groupBy("shard") for side in sides)
    return settle(ours.cogroup(theirs).applyInArrow(pack, SHARD), "toxic-shards")


def summed(shards: DataFrame, each, many: int, width: int) -> np.ndarray:
    """Sum of the tables of whole numbers, ``many`` by ``width``, that ``each`` gives for a row of shards; zeros don't travel."""

    def give(blocks):
        for n, total in blocks:
            if len(some := np.flatnonzero(total.any(1))):
                yield pa.RecordBatch.from_pydict({"block": pa.array([n], pa.int32()), "rows": [some.astype(np.int32).tobytes()], "sums": [total[some].tobytes()]})

    def own(batches):
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                more = each(batch.slice(i, 1).to_pylist()[0])
                total = more if total is None else total + more
        if total is not None:
            yield from give((n // BLOCK, total[n : n + BLOCK]) for n in range(0, len(total), BLOCK))
        del total
        trim()

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, rows, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = total.setdefault(n, np.zeros((BLOCK, width), np.int64))
                own[np.frombuffer(rows, np.int32)] += np.frombuffer(sums, np.int64).reshape(-1, width)
        yield from give(total.items())

    kind = "block int, rows binary, sums binary"
    out = np.zeros((many, width), np.int64)
    for r in shards.mapInArrow(own, kind).repartition(-(-many // BLOCK), "block").mapInArrow(add, kind).collect():
        out[r.block * BLOCK + np.frombuffer(r.rows, np.int32)] = np.frombuffer(r.sums, np.int64).reshape(-1, width)
    return out


def train(docs: DataFrame, labels: DataFrame, usable, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """Learn from all rows with a label; ``usable`` is a boolean column over ``labels`` (the training fold)."""
    net = Network()
    labels = only(labels, key, label).withColumn("y", F.col(label).cast("int"))
    known = labels.filter(usable & F.col("y").isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max("y").alias("y"))
    rows = known.count()
    if not rows:
        return net
    texts = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    shards = dealt(texts, known, key, rows)
    if not shards.select("shard").head():
        return net
    net.shared = summed(shards.select("shared"), lambda r: np.frombuffer(r["shared"], np.int64)[:, None], BUCKETS, 1)[:, 0]
    start(net, texts, known, key)
    _passes(net, shards)
    net.squares.clear()  # no more steps follow
    _thresholds(net, shards)
    forget(shards)
    return net


def start(net: Network, texts: DataFrame, known: DataFrame, key: str) -> None:
    """Fit on a bounded draw, for weights that the passes over all rows go on from."""
    order = F.xxhash64(key)
    chosen = known.filter("y = 1").orderBy(order, key).limit(SAMPLE).union(known.filter("y = 0").orderBy(order, key).limit(NEGATIVES))
    ids = F.broadcast(chosen)  # SAMPLE + NEGATIVES rows at most
    sizes = texts.join(ids, key).groupBy(key, "y").agg(F.max(F.octet_length("t")).alias("bytes"))
    fitting, used = [], 0
    for at, size in sizes.orderBy(order, key).select(order, "bytes").collect():
        if used + size <= SAMPLE_BYTES or not fitting:
            fitting.append(at)
            used += size
    if fitting:
        # as an Arrow table: a list of rows would start Python workers of another kind, which stay beside the others
        picked = texts.sparkSession.createDataFrame(pa.table({"__at": pa.array(fitting, pa.int64())}))
        ids = F.broadcast(chosen.join(F.broadcast(picked), order == F.col("__at"), "left_semi"))
        rows = texts.join(ids, key).groupBy(key, "y").agg(F.min("t").alias("t")).orderBy(order, key).collect()  # SAMPLE_BYTES in all
        net.fit([r.t for r in rows], np.array([r.y for r in rows], np.float32))


def _passes(net: Network, shards: DataFrame) -> None:
    """All rows of all shards, ``PASSES`` times; embeddings that too few texts share stay zero."""
    net.embed[:BUCKETS][net.shared < LEAST_TEXTS] = 0
    toxic, count = summed(shards.select("labels"), lambda r: np.array([[sum(r["labels"]), len(r["labels"])]], np.int64), 1, 2)[0].tolist()
    weight, units = weight_of(toxic, count), np.repeat([2.0**28, 2.0**16], DIM)
    rows = shards.drop("shared")
    for turn in range(PASSES):
        common = shards.sparkSession.sparkContext.broadcast(net)

        def each(row, common=common, turn=turn):
            own, (old, _) = copy.deepcopy(common.value), common.value.table()
            steps = Shard(row).learn(own, weight, turn)[:, None]
            new, squares = own.table()
            out, some = np.zeros((len(steps), 2 * DIM + 1), np.int64), np.flatnonzero(steps)
            out[some, :-1] = np.rint(np.concatenate([new[some] - old[some], squares[some]], 1) * steps[some] * units)
            out[some, -1:] = steps[some]
            return out

        weights, squares = net.table()
        sums = summed(rows, each, len(weights), 2 * DIM + 1)
        met = np.flatnonzero(sums[:, -1])
        means = sums[met, :-1] / units / sums[met, -1:]
        weights[met] += means[:, :DIM]
        squares[met] = means[:, DIM:]
        net.take(weights, squares)
        common.destroy()
    net.trained = True


def _thresholds(net: Network, shards: DataFrame) -> None:
    """From the logits of all rows of all shards."""
    common = shards.sparkSession.sparkContext.broadcast(net)

    def judge(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                at = np.clip(np.rint(shard.logits(common.value) * GRID), -200 * GRID, 200 * GRID).astype(np.int64)
                some, n = np.unique(np.stack([shard.languages, at, shard.labels], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in some.T.astype(np.int64)), pa.array(n.astype(np.int64))], ["language", "at", "y", "n"])

    counts = shards.drop("shared").mapInArrow(judge, "language long, at long, y long, n long").groupBy("language", "at", "y").agg(F.sum("n").alias("n")).collect()
    language, at, y, n = np.array([tuple(r) for r in counts], np.int64).T
    net.settle_limits(language, at, np.where(y == 0, n, 0), np.where(y == 1, n, 0))
    common.destroy()


def with_scores(docs: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)

    def run(batches):
        rows = WordRows(shared.value)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()
            for a, b in spans(lengths, 1_000_000):  # a slice's texts become strings at a time, not a batch's
                part = batch.slice(a, b - a)
                texts = [x or "" for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows.scores(texts), pa.float64())], [*batch.schema.names, name])
        rows = batch = part = texts = None
        trim()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); documents whose crc32(doc_id) mod 5 is 0 are held out."""
    docs = only(docs, "doc_id", "text")
    net = train(docs, labels, crc_mod("doc_id", 5) != 0)
    out = with_scores(docs, net)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
