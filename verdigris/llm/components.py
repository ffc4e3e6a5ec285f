"""Connected components by repeated contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import KEPT, kept_since, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, root): one root for all nodes of a component; only nodes that have an edge.

    Each round every node is merged into its neighbour of least hash (or stays), the edges are mapped and
    deduplicated, and the round's map is kept; the graph shrinks by a constant factor in expectation, also along
    long chains, as the hash order is random. The maps are then composed from the last round back. The node maps
    are aggregates with map-side combine, so a star's centre isn't gathered in one task; the joins are plain
    equi-joins, which adaptive execution splits where a key is hot.
    """
    before = list(KEPT)
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(key("b")).alias("m"))
        old = kept_since(before)[-1:]
        step = stored(near.select("node", F.least("m", key("node"))["node"].alias("to")), "hook")
        maps.append(step)
        moved = live.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        live = stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", clear=old)
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = maps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        root = step.join(root.select(F.col("node").alias("to"), "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return stored(root, "roots", clear=kept_since(before))
