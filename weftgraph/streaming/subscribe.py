"""Live queries: a stream of changes in, changes of a query's result out.

Changes are rows of ``CHANGE_SCHEMA``. Each micro-batch is applied to the graph as one set-based delta; the
query runs again on the new version, and its result is compared with the last one by a full outer join
on the element: rows come out as Added, Removed or Updated. Batches and results are written to the shared
folder; the graph is its tables with the batches' deltas over them, and its tables are written anew after
``COMPACT`` batches, so plans don't grow with the stream. A batch whose
changes touch none of the query's labels and properties is passed over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.model import PropertyGraph
from weftgraph.operators import mutation
from weftgraph.runtime import settle

CHANGE_SCHEMA = "seq long, op string, id long, label string, src long, dst long, key string, value string"
#: Batches whose deltas are kept beside the tables.
COMPACT = 8
OPS = ("vertex_added", "vertex_removed", "vertex_property", "edge_added", "edge_removed", "edge_property")


def apply_changes(graph: PropertyGraph, batch: DataFrame) -> PropertyGraph:
    """A batch as deltas, with the outcome of its changes in the order of ``seq``.

    An element is there afterwards if its last addition or removal is an addition; it then has the last value
    of each property set since its last removal. A vertex takes along the edges that were there when it went.
    """
    batch = settle(batch)
    lives = {}
    for kind, name in (("v", "vertex"), ("e", "edge")):
        added, removed = F.col("op") == f"{name}_added", F.col("op") == f"{name}_removed"
        lives[kind] = batch.filter(added | removed).groupBy("id").agg(F.max_by(F.struct(added.alias("here"), "label", "src", "dst", "seq"), "seq").alias("last"), F.max(F.when(removed, F.col("seq"))).alias("gone")).select("id", "last.*", "gone")
    gone = settle(lives["v"].filter("gone IS NOT NULL").select("id", "gone"))
    made = {"v": lives["v"].filter("here"), "e": lives["e"].filter("here")}
    for end in ("src", "dst"):  # edges made before one of their ends went
        late = gone.select(F.col("id").alias(end), F.col("gone").alias("after"))
        made["e"] = made["e"].join(late, end, "left").filter("after IS NULL OR after < seq").drop("after")
    for kind in "ve":
        lost = lives[kind].filter("gone IS NOT NULL").select("id")
        if not lost.isEmpty():
            graph, _ = mutation.remove(graph, kind, lost)
    for kind in "ve":
        rows = settle(made[kind])
        for (label,) in sorted(rows.select("label").distinct().collect()):
            graph = mutation.append(graph, kind, label, rows.filter(F.col("label") == label).select(*(("id",) if kind == "v" else ("id", "src", "dst"))))
    for kind, name in (("v", "vertex"), ("e", "edge")):
        changes = batch.filter(F.col("op") == f"{name}_property")
        for (key,) in sorted(changes.select("key").distinct().collect()):
            rows = changes.filter(F.col("key") == key).join(lives[kind].select("id", "gone"), "id", "left").filter("gone IS NULL OR gone < seq")
            rows = rows.groupBy("id").agg(F.max_by("value", "seq").alias("value"))
            dtype = graph.properties(kind).get(key)
            value = F.col("value") if dtype is None else F.col("value").try_cast(dtype)
            graph = mutation.update(graph, kind, key, rows.select("id", value.alias("value")), dtype or rows.schema["value"].dataType)
    return graph


def frozen(graph: PropertyGraph) -> PropertyGraph:
    return graph.changed({k: settle(v) for k, v in graph.vertices.items()}, {k: settle(v) for k, v in graph.edges.items()})


def result_of(traversal, graph: PropertyGraph) -> DataFrame:
    """(id, row, times): the current result, a row's content as text and how often it is there."""
    t = type(traversal)(graph, traversal.steps)
    df = t.df()
    key = F.col("id") if "id" in df.columns else F.xxhash64(*df.columns)
    return df.select(key.alias("id"), F.to_json(F.struct(*df.columns)).alias("row")).groupBy("id", "row").agg(F.count("*").alias("times"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, event, before, after, times) of what changed; a row that is there more or less often is Added or Removed."""

    def side(df, name, n):
        return df.select("id", F.col("row").alias(name), (F.col("times") if "times" in df.columns else F.lit(1).cast("long")).alias(n))

    met = side(before, "before", "m").join(side(after, "after", "n"), "id", "full_outer").withColumn("more", F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0)))
    changed = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before") != F.col("after"))
    event = F.when(changed, "Updated").when(F.col("more") > 0, "Added").when(F.col("more") < 0, "Removed")
    return met.select("id", event.alias("event"), "before", "after", F.when(changed, F.col("n")).otherwise(F.abs("more")).alias("times")).filter("event IS NOT NULL")


@dataclass
class Subscription:
    """A running live query; ``graph`` is the latest version."""

    traversal: object
    sink: object
    graph: PropertyGraph
    include_initial: bool = False
    last: DataFrame | None = None
    query: object = None
    skipped: int = 0
    batches: int = 0
    keys: set = field(default_factory=set)
    labels: set = field(default_factory=set)
    hops: bool = False

    def begin(self) -> None:
        self.last = settle(result_of(self.traversal, self.graph))
        for s in self.traversal.steps:
            if s.name == "hasLabel":
                self.labels |= set(s.args)
            if s.name == "has" and len(s.args) < 3:
                self.keys.add(s.args[0])
            self.hops |= s.name not in ("V", "hasLabel", "has", "hasNot")
        if self.include_initial:
            self.sink(self.last.select("id", F.lit("Added").alias("event"), F.lit(None).cast("string").alias("before"), F.col("row").alias("after"), "times"), -1)

    def concerns(self, batch: DataFrame) -> bool:
        """Whether a change can touch the result: of a query without hops, label additions and vertex changes only."""
        if self.hops:
            return True
        touching = F.col("op").isin("vertex_removed", "vertex_property") | ((F.col("op") == "vertex_added") & (F.col("label").isin(*self.labels) if self.labels else F.lit(True)))
        return not batch.filter(touching).isEmpty()

    def on_batch(self, batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        needed = self.concerns(batch)
        self.graph = apply_changes(self.graph, batch)
        self.batches += 1
        if self.batches % COMPACT == 0:
            self.graph = frozen(self.graph)
        if not needed:
            self.skipped += 1
            return
        now = settle(result_of(self.traversal, self.graph))
        self.sink(difference(self.last, now), epoch)
        self.last = now

    def cancel(self) -> None:
        if self.query is not None:
            self.query.stop()


def subscribe(traversal, changes: DataFrame, sink, include_initial: bool = False, checkpoint: str | None = None, available_now: bool = False) -> Subscription:
    """Start a live query. ``sink(events, epoch)`` gets each batch's events as a DataFrame."""
    out = Subscription(traversal, sink, traversal.graph, include_initial)
    out.begin()
    if not changes.isStreaming:
        out.on_batch(changes, 0)
        return out
    writer = changes.writeStream.foreachBatch(out.on_batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    out.query = writer.start()
    return out


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """An extension for event tables: counts and sums by type in event-time windows, with a watermark."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    got = src.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")
