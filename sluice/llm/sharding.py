"""Sharding: a k-d tree whose leaves are shards of nearly equal bytes.

A node with room for k shards is split along its widest metadata dimension, at the weighted quantile that gives k // 2
shards to the left. The quantiles of all nodes of a level come from two distributed histograms: over the dimension, then
over hashes within the bucket where the cut falls. Histograms stay tables; the driver knows the cut of each
node, no more than the list of shards, and rows find it in a literal.

Copies of a text stay together. Those that weigh a good part of a shard would throw a cut off balance, so they are
packed into shards first, and the tree fills each shard up to the rest of its share.
"""

from __future__ import annotations

import heapq
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .shared import discard, materialize

BUCKETS, FINE = 1024, 4096
#: Copies of a text that weigh more than this share of a shard are packed before the tree is built.
HEAVY = 1 / 16


def packed(weights: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """``(text, salt, weight, shard)``: the heaviest first, each to the shard that holds least so far."""
    held = [(0, i) for i in range(shards)]
    out = []
    for text, salt, w in sorted(weights, key=lambda x: (-x[2], x[0], x[1])):
        load, i = heapq.heappop(held)
        out.append((text, salt, w, i))
        heapq.heappush(held, (load + w, i))
    return out


def _running(of: str, *by: str, order: str) -> Column:
    """The sum of ``of`` over the rows before."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(of).over(window), F.lit(0))


def _goals(rooms: dict[int, int], before: list[float]) -> list[tuple[int, int, float]]:
    """(node, its right part, the left part's share) of nodes with room for several shards.

    ``before``: what the shards before each one are to take. A row for each node, at most as many as shards.
    """
    out = []
    for v, k in rooms.items():
        if k > 1:
            part = before[v + k] - before[v]
            out.append((v, v + k // 2, (before[v + k // 2] - before[v]) / part if part > 0 else (k // 2) / k))
    return out


def _of_node(values: dict[int, float | int], kind: str) -> Column:
    """What ``values`` has for a row's node, null for other nodes: a literal no longer than the list of shards, so that nothing is joined."""
    return F.get(F.array(*(F.lit(values.get(i)).cast(kind) for i in range(max(values) + 1))), F.col("node"))


def _split(table: DataFrame, goal: list[tuple[int, int, float]]) -> DataFrame:
    """``table`` with the node of the next level. ``goal``: (node, right, share), see ``_goals``."""
    share = _of_node({v: s for v, _, s in goal}, "double")
    spread = table.where(share.isNotNull()).select("node", "w", F.posexplode("at").alias("d", "b"))
    seen = spread.groupBy("node", "d", "b").agg(F.sum("w").alias("w"))
    # a node has at most BUCKETS rows for each dimension
    dimension, node = Window.partitionBy("node", "d"), Window.partitionBy("node")
    seen = seen.withColumn("span", F.max("b").over(dimension) - F.min("b").over(dimension))
    wide = F.max(F.struct("span", (-F.col("d")).alias("d"))).over(node)
    along = seen.withColumn("wide", -wide["d"]).where("d = wide")
    along = along.withColumns({"lower": _running("w", "node", order="b"), "aim": share * F.sum("w").over(node)})
    over = along.where(F.col("lower") + F.col("w") > F.col("aim"))
    edge = over.groupBy("node").agg(F.min(F.struct("b", "d", (F.col("aim") - F.col("lower")).alias("rest"))).alias("e"))
    edges = {r["node"]: r["e"] for r in edge.collect()}  # a row for each node
    if not edges:
        return table
    d, b, rest = (_of_node({v: e[c] for v, e in edges.items()}, kind) for c, kind in (("d", "int"), ("b", "int"), ("rest", "double")))
    at_d = F.get("at", d)
    inside = table.where(at_d == b)
    fine = inside.groupBy("node", F.shiftright("h", 18).alias("q")).agg(F.sum("w").alias("w"))
    fine = fine.withColumn("upto", _running("w", "node", order="q") + F.col("w"))
    ends = fine.select("node", F.struct(F.abs(F.col("upto") - rest).alias("off"), (F.col("q") + 1).alias("q")).alias("c"))
    cuts = {r["node"]: min(tuple(r["c"]), (abs(edges[r["node"]]["rest"]), 0))[1] << 18 for r in ends.groupBy("node").agg(F.min("c").alias("c")).collect()}
    right = _of_node({v: r for v, r, _ in goal if v in edges}, "int")
    stays = d.isNull() | (at_d < b) | ((at_d == b) & (F.col("h") < _of_node(cuts, "long")))
    moved = F.when(stays, F.col("node")).otherwise(right).cast("int")
    return table.select("_text", "_salt", "w", "at", "h", moved.alias("node"))


def kd_shards(
    docs: DataFrame,
    n_shards: int | None = None,
    target_bytes: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    metadata: tuple[str, ...] = ("source", "lang"),
    overhead: int = 16,
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of each row of ``docs``.

    Either ``n_shards`` is given or ``target_bytes``, from which it follows. ``size`` is the text's UTF-8 bytes plus
    ``overhead`` (null text: none). Dimensions of the tree: the size and a code of each ``metadata`` column there is.
    Copies of a text share a shard unless they weigh more than a shard's fair share of all bytes; only then are they dealt
    by id over as few shards as hold them (null ids by row). Null texts are copies of each other. Slots count from 0 in
    each shard without gaps, in an order by hash. Repeated rows are rows; null metadata is a value; fewer rows than shards
    leave some shards empty; an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    there = [c for c in metadata if c in docs.columns]
    body = F.col(f"`{text}`")
    size = (F.coalesce(F.octet_length(body), F.lit(0)) + F.lit(overhead)).cast("long")
    code = lambda c: F.crc32(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).cast("binary"))
    rows = materialize(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"), size.alias("size"), F.coalesce(
                F.crc32(body.cast("binary")), F.lit(0)
            ).cast("long").alias("text_crc32"),
            F.xxhash64(body.isNull(), body).alias("_text"), F.monotonically_increasing_id().alias("_row"), *(
                code(c).alias(f"_d{i}") for i, c in enumerate(there)
            ),
        ),
        "rows",
    )
    total, count, low, high = rows.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.min("size"), F.max("size")
    ).first()
    shards = n_shards or max(1, math.ceil(total / target_bytes))
    share = max(1.0, total / shards)
    # at most shards / HEAVY texts weigh so much
    heavy = rows.groupBy("_text").agg(F.sum("size").alias("w")).where(F.col("w") > share * HEAVY)
    heavy = materialize(heavy.select("_text", F.ceil(F.col("w") / F.lit(share)).cast("int").alias("_k")), "heavy")
    dealt = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), "_row")))
    salt = F.coalesce(F.pmod(dealt, F.col("_k")), F.lit(0)).cast("int")
    rows = rows.join(heavy, "_text", "left").withColumns(
        {"_salt": salt, "_heavy": F.col("_k").isNotNull()}
    ).drop("_k", "_row")
    pieces = rows.where("_heavy").groupBy("_text", "_salt").agg(F.sum("size").alias("w")).collect()
    placed = packed([tuple(r) for r in pieces], shards)
    fixed = spark.createDataFrame([(t, s, i) for t, s, _, i in placed], "_text long, _salt int, shard int")
    loads = [0] * shards
    for _, _, w, i in placed:
        loads[i] += w
    before = [0.0, *itertools.accumulate(max(0.0, share - w) for w in loads)]

    floor = math.log2(max(1, low or 1))
    span = max(1e-9, math.log2(max(2, high or 2)) - floor)
    dims = [
        F.least(
            F.lit(BUCKETS - 1), F.floor((F.log2(F.col("_size").cast("double")) - floor) / span * BUCKETS)
        ).cast("int")
    ]
    dims += [F.floor(F.col(f"_d{i}") / F.lit(float(1 << 32)) * BUCKETS).cast("int") for i in range(len(there))]
    groups = rows.where("NOT _heavy").groupBy("_text", "_salt")
    groups = groups.agg(
        F.sum("size").alias("w"),
        F.max("size").alias("_size"),
        *(F.min(f"_d{i}").alias(f"_d{i}") for i in range(len(there)))
    )
    h = F.pmod(F.xxhash64("_text", "_salt", F.lit(11)), F.lit(1 << 30))
    table = materialize(
        groups.select("_text", "_salt", "w", F.array(*dims).alias("at"), h.alias("h"), F.lit(0).alias("node")), "groups"
    )
    rooms = {0: shards}  # a node is named by its first shard
    while any(k > 1 for k in rooms.values()):
        new = _split(table, _goals(rooms, before))
        if new is not table:
            new = materialize(new, "groups")
            discard(table)
        table = new
        rooms = {
            n: r for v, k in rooms.items() for n, r in ([(v, k // 2), (v + k // 2, k - k // 2)] if k > 1 else [(v, k)])
        }
    leaves = table.select("_text", "_salt", F.col("node").alias("shard")).unionByName(fixed)
    keyed = rows.join(leaves, ["_text", "_salt"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        F.xxhash64("doc_id", "_text").alias("_key"),
        F.lit(1).cast("long").alias("_one"),
    )
    return prefix_sums(keyed, "shard", "_key", "doc_id", "_one", count).select(
        "doc_id", "size", "text_crc32", "shard", F.col("before").alias("slot")
    )
