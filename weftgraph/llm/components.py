"""Connected components of an edge table by alternating stars, all in DataFrames.

Each round reconnects every node's larger neighbours to the smallest node it sees (large star), then
its smaller neighbours likewise (small star); the number of rounds grows with the logarithm of the
longest chain. Minima are combined before the shuffle, and a round's edges go to the shared folder.
The root of a large class has an edge to each of its nodes: the minima of such nodes are broadcast (there
are few, see ``join_hot``), so their edges stay where they are.

Nodes are numbers or byte strings. Repeated edges and loops don't matter; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.runtime import forget, settle


#: Keys with over 1 / ``HOT`` of all rows are joined by broadcast: at most ``HOT`` rows.
HOT, FEW = 50_000, 1_000


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to a row for each key, whose ``n`` says how many of the ``total`` rows have it.

    Keys of more than total / HOT rows (and more than ``FEW``) are broadcast; all others meet by a shuffle in
    which no key can stand out.
    """
    over = F.col("n") > max(FEW, total // HOT)
    heavy, light = F.broadcast(per_key.filter(over).drop("n")), per_key.filter(~over).drop("n")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the smallest node reachable."""
    now = settle(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "low")
        large = join_hot(both.filter("v > u"), low, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        known, state = state, _state(after)
        forget(now)
        forget(low)
        now = after
        if state == known:
            break
    else:
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
