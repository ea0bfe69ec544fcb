"""Connected components of an edge table, by alternating large-star and small-star steps.

A step is a grouped minimum, combined inside each task before its exchange, and
a join with it that Spark can split where one node has very many edges. Stars
halve in depth, so that a few steps are enough even for long chains. Edges stay
in tables of the shared folder, each replacing the one before, and are never
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, brief, discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another; root is the component's smallest node. Ids are longs."""
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before:
        # Steps never add edges: a table of few is broadcast without being written and measured again.
        few = 2 * 64 * state[0] <= BROADCAST_BYTES
        written: list[DataFrame] = [now]

        def kept(table: DataFrame, name: str) -> DataFrame:
            if few:
                return table
            written.append(materialize(table, name))
            return written[-1]

        def joined(table: DataFrame, name: str) -> DataFrame:
            return F.broadcast(table) if few else brief(kept(table, name))

        # Large star: each node's larger neighbours move to its smallest neighbour (itself included).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = joined(both.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
        large = kept(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")), "edges-large")
        # Small star: each node and its smaller neighbours move to the smallest of them.
        smallest = joined(large.groupBy("u").agg(F.min("v").alias("m")), "edges-smallest")
        moved = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = materialize(moved.where("u != v").distinct(), "edges")
        discard(*written)
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, object]:
    """Number of the edges and a sum over them: a step that changes neither has changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
