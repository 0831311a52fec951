"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(7)))).first()
    )


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each node of ``edges`` (of any type with an order): the smallest node that it reaches.

    Each round points the larger neighbours of a node at its smallest one, then
    the smaller; a logarithmic number of rounds is enough, whatever the shape. Minima are
    pre-aggregated before the shuffle, neighbours are never gathered, and each
    round is written to the shared folder. Null ends, loops and repeated edges
    are allowed; loops alone and an empty table give no component beyond the
    node itself.
    """
    edges = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    start = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    nodes = current = materialize(start, "edges")
    state = _state(current)
    while True:
        proper = current.where("u <> v")
        both = proper.select("u", "v").unionByName(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if current is not nodes:
            discard(current)
        new = _state(after)
        current = after
        if new == state:
            break
        state = new
    roots = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(
        current.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left"
    ).select("node", F.coalesce("root", "node").alias("component"))
