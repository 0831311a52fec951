"""Prefix trie of conversations: every distinct beginning is a node, with what its subtree holds.

1. Conversations are sorted as sequences of turns. A turn is a digest; up to ``RADIX`` turns are a chunk, chunks of longer
   conversations get ranks and are chunked again, so that no row holds more than ``RADIX`` entries. Equal
   sequences are one element, with the number of its members.
2. The lcp of two neighbours, the number of turns that they begin with in common, stands at the boundary between them.
   The nearest smaller value at each side of a boundary spans the interval of elements that share its lcp turns:
   the Cartesian tree. Blocks of boundaries find theirs with a stack; what they can't is sought among the minima
   of blocks, of blocks of blocks and so on, then downwards.
3. Boundaries of one interval are one node. Depths without a boundary (a single way on) are filled in between a node and its
   parent, and from the last branch to the end of each element.
4. A subtree is an interval of elements and, in preorder, a run of nodes: counts and sums are differences of prefix sums,
   smallest members are range minima over the same blocks.

No task holds a conversation, a level or a subtree whole; windows and lists hold ``BLOCK`` or ``RADIX`` rows at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize

#: Entries of a chunk, boundaries of a block, and ids of a piece of text that is hashed.
RADIX, BLOCK, PIECE = 64, 1024, 4096
_WORD = r"[^\x20\x09-\x0D]+"
_TOP = (1 << 63) - 1
_NONE = hashlib.sha256(b"").hexdigest()


def indexed(df: DataFrame, *order) -> tuple[DataFrame, int, DataFrame]:
    """``df`` with ``i``, its rows' places in ``order`` from 0 on; the number of rows; the table that was written.

    Ranges are sorted apart and numbered by the rows of the ranges before, of which the driver sees one number each.
    """
    at = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).cast("int")
    sizes = at.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    starts, n = [], 0
    for r in sizes:
        starts.append((r["_part"], n))
        n += r["count"]
    first = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    out = at.withColumn("_part", part).join(F.broadcast(first), "_part")  # a row for each partition
    return out.withColumn("i", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_start"), n, at


def running(df: DataFrame, at: str, values: list[str], n: int) -> DataFrame:
    """``df`` with ``before_<value>``, the sum over the rows before; ``at`` numbers the ``n`` rows from 0 without gaps."""
    part = f"_{at}"
    if n > BLOCK:
        df = df.withColumn(part, F.expr(f"{at} div {BLOCK}"))
        sums = df.groupBy(part).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        sums = running(sums, part, [f"_{v}" for v in values], -(-n // BLOCK))
        df = df.join(sums.drop(*(f"_{v}" for v in values)), part)
    window = (Window.partitionBy(part) if n > BLOCK else Window).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    for v in values:
        within = F.coalesce(F.sum(v).over(window), F.lit(0))
        df = df.withColumn(f"before_{v}", within + F.col(f"before__{v}") if n > BLOCK else within)
    return df.drop(*([part, *(f"before__{v}" for v in values)] if n > BLOCK else []))


def numbered_turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, d, mark, words, n)``: turns by number from 1, the digest of role and text, the words of the text, and the
    number of turns of the conversation.

    Turns go by ``turn``, null first; equal ones by their digests. Null roles and texts are empty. Rows without a
    ``conv_id`` belong to no conversation and are left out. The order is that of a sort by ranges: a conversation may
    be spread over many tasks.
    """
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    mark = F.sha2(F.concat(F.length(said(role)).cast("string"), F.lit(":"), said(role), said(text)), 256)
    rows = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.substring(mark, 1, 32).alias("mark"),
        F.regexp_count(said(text), F.lit(_WORD)).cast("long").alias("words"),
        F.rand(1).alias("_deal"),  # spreads repeated rows, which are the same in any order
    ).where("conv_id IS NOT NULL")
    found, _, _ = indexed(rows, "conv_id", F.col("turn").asc_nulls_first(), "mark", "_deal")
    first = found.groupBy("conv_id").agg(F.min("i").alias("_first"), F.count(F.lit(1)).alias("n"))
    return found.join(first, "conv_id").select("conv_id", (F.col("i") - F.col("_first") + 1).alias("d"), "mark", "words", "n")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first one of their group: turns ``(conv_id, d, mark, words)`` and ``(conv_id, n)``.

    Conversation c takes the first h turns of conversation c - c % ``group`` (all if it has fewer, none if it isn't there),
    then its own after its first h; h is crc32 of its id in decimals, modulo ``most``. ``turns`` are numbered.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.where("d = 1").select(
        "conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    )
    heads = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("_there"))
    convs = materialize(
        convs.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("_there", F.lit(0)))).select(
            "conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")
        ),
        "rebuilt",
    )
    own = turns.drop("n").join(convs.select("conv_id", "h", "taken"), "conv_id").where("d > h")
    own = own.select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "mark", "words")
    begun = turns.where(F.col("d") < most).select(F.col("conv_id").alias("base"), "d", "mark", "words")
    begun = convs.select("conv_id", "base", "h").join(begun, "base").where("d <= h").select("conv_id", "d", "mark", "words")
    return own.unionByName(begun), convs.select("conv_id", "n")


def _common(x: Column, y: Column) -> Column:
    """Number of equal entries that two arrays begin with."""
    differ = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differ == 0, F.size(x)).otherwise(differ - 1).cast("long")


def _chunks(rows: DataFrame, value: str, at: Column) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(value).alias("v"))))
    return rows.groupBy("conv_id", F.floor(at / RADIX).alias("j")).agg(packed.alias("p")).select(
        "conv_id", "j", F.col("p.v").alias("seq")
    )


def _levels(turns: DataFrame) -> list[DataFrame]:
    """Chunks of turns, chunks of the ranks of chunks, and so on, up to one chunk for each conversation."""
    levels = [materialize(_chunks(turns, "mark", F.col("d") - 1), "chunks")]
    while (levels[-1].agg(F.max("j")).first()[0] or 0) > 0:
        low = levels[-1]
        ranks = materialize(
            low.select("seq").distinct().orderBy("seq").withColumn("rank", F.monotonically_increasing_id()), "ranks"
        )
        levels.append(materialize(_chunks(low.join(ranks, "seq"), "rank", F.col("j")), "chunks"))
        discard(ranks)
    return levels


def _lcp(elements: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``(i, lcp)`` of each element but the first with the one before: down from the first chunks that differ."""
    before = elements.select((F.col("i") + 1).alias("i"), F.col("first").alias("c2"), F.col("seq").alias("y"), F.col("n").alias("n2"))
    rows = elements.select("i", F.col("first").alias("c1"), F.col("seq").alias("x"), F.col("n").alias("n1")).join(before, "i")
    rows = rows.select("i", "c1", "c2", F.least("n1", "n2").alias("least"), _common(F.col("x"), F.col("y")).alias("at"))
    for low in reversed(levels[:-1]):
        x = low.select(F.col("conv_id").alias("c1"), F.col("j").alias("at"), F.col("seq").alias("x"))
        y = low.select(F.col("conv_id").alias("c2"), F.col("j").alias("at"), F.col("seq").alias("y"))
        rows = rows.join(x, ["c1", "at"], "left").join(y, ["c2", "at"], "left")
        # without a chunk there one sequence begins the other
        further = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("at") * RADIX + _common(F.col("x"), F.col("y")))
        rows = rows.select("i", "c1", "c2", "least", F.coalesce(further, F.lit(_TOP // RADIX // RADIX)).alias("at"))
    return rows.select("i", F.least("at", "least").alias("lcp"))


def _nearest(values: list[int]) -> tuple[list, list]:
    """The nearest smaller places at the left and right of each place; None where there is none among these."""
    left, right = [None] * len(values), [None] * len(values)
    stack: list[int] = []  # places that have no smaller one at their right so far
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = k
        if stack:
            left[k] = left[stack[-1]] if values[stack[-1]] == v else stack[-1]
        stack.append(k)
    return left, right


def _least(first: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The least of ``first`` in each of the half-open ``spans``, none of which is empty."""
    table = [first]
    while 2 << (len(table) - 1) <= len(first):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    out = np.empty(len(spans), np.int64)
    power = np.array([int(x).bit_length() - 1 for x in spans[:, 1] - spans[:, 0]], dtype=np.int64)
    for k, row in enumerate(table):
        own = power == k
        out[own] = np.minimum(row[spans[own, 0]], row[spans[own, 1] - (1 << k)])
    return out


_FOUND = pa.schema([("b", pa.int64()), ("block", pa.int64()), ("lcp", pa.int64()), ("l", pa.int64()), ("r", pa.int64()),
                    ("first", pa.int64()), ("onward", pa.int64()), ("upto", pa.int64())])


def _within(size: int):
    """For each place of a block: nearest smaller places in it, least member between them if both are, and the least members
    from the place to the block's end (``onward``) and from its start up to the place (``upto``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lcp, first in zip(*(c.to_pylist() for c in batch.columns)):
                firsts, n = np.array(first, np.int64), len(lcp)
                left, right = _nearest(lcp)
                both = [k for k in range(n) if left[k] is not None and right[k] is not None]
                least: list = [None] * n
                spans = np.array([(left[k], right[k]) for k in both], np.int64).reshape(-1, 2)
                for k, x in zip(both, _least(firsts, spans).tolist()):
                    least[k] = x
                onward = np.minimum.accumulate(firsts[::-1])[::-1]
                upto = np.append(_TOP, np.minimum.accumulate(firsts)[:-1])
                place = lambda xs: pa.array([None if x is None else block * size + x for x in xs], pa.int64())
                yield pa.record_batch(
                    [place(range(n)), pa.array([block] * n, pa.int64()), pa.array(lcp, pa.int64()), place(left), place(right),
                     pa.array(least, pa.int64()), pa.array(onward), pa.array(upto)], schema=_FOUND,
                )

    return run


def _blocks(places: DataFrame, at: str, size: int) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "lcp", "first")))
    return places.groupBy(F.expr(f"{at} div {size}").alias("block")).agg(packed.alias("p")).select(
        "block", F.col("p.lcp").alias("lcp"), F.col("p.first").alias("first")
    )


def _minima(places: DataFrame, n: int, size: int) -> list[DataFrame]:
    """Blocks of the places, blocks of the blocks' minima and so on, up to one block."""
    levels = [materialize(_blocks(places, "i", size), "blocks")]
    while (n := -(-n // size)) > 1:
        low = levels[-1].select("block", F.array_min("lcp").alias("lcp"), F.array_min("first").alias("first"))
        levels.append(materialize(_blocks(low, "block", size), "blocks"))
    return levels


def _sought(wanted: DataFrame, levels: list[DataFrame], size: int, rightward: bool) -> DataFrame:
    """``(block, lcp, place)``: the nearest smaller place outside the block, at its right or left.

    Up through the minima until a smaller one is met, then down into its block. Sentinels at both ends are below all.
    """
    smaller = lambda xs: F.transform(xs, lambda x: x < F.col("want"))
    within = (F.col("at") % size).cast("int")

    def step(rows: DataFrame, level: DataFrame, at: Column, inside: Column, found) -> DataFrame:
        return rows.withColumn("_in", at).join(level.select(F.col("block").alias("_in"), F.col("lcp").alias("xs")), "_in").withColumn(
            "hit", found(inside)
        ).drop("xs")

    def beside(k: Column) -> Column:  # offset of the nearest one beside place k, 0 if there is none
        xs = F.slice("xs", k + 2, F.lit(size)) if rightward else F.reverse(F.slice("xs", F.lit(1), k))
        return F.array_position(smaller(xs), True)

    open_ = wanted.select("block", F.col("lcp").alias("want"), F.col("block").alias("at"))
    out = None
    for k in range(1, len(levels)):
        tried = materialize(step(open_, levels[k], F.expr(f"at div {size}"), within, beside), "sought")
        hits = tried.where("hit > 0").select("block", "want", (F.col("at") + (F.col("hit") if rightward else -F.col("hit"))).alias("at"))
        for low in reversed(levels[:k]):
            xs = F.col("xs") if rightward else F.reverse("xs")
            down = step(hits, low, F.col("at"), F.lit(0), lambda _, xs=xs: F.array_position(smaller(xs), True))
            place = F.col("hit") - 1 if rightward else F.col("width") - F.col("hit")
            down = down.join(low.select(F.col("block").alias("_in"), F.size("lcp").alias("width")), "_in")
            hits = down.select("block", "want", (F.col("at") * size + place).alias("at"))
        out = hits if out is None else out.unionByName(hits)
        open_ = tried.where("hit = 0").select("block", "want", F.expr(f"at div {size}").alias("at"))
    return out.select("block", F.col("want").alias("lcp"), F.col("at").alias("place"))


def _range_min(queries: DataFrame, levels: list[DataFrame], k: int, size: int) -> DataFrame:
    """``(x, y, least)``: the least member over the places x to y - 1 of level ``k``, for each distinct row of ``queries``."""
    parts = queries.distinct().select("x", "y", F.expr(f"x div {size}").alias("a"), F.expr(f"(y - 1) div {size}").alias("z"))
    blocks = levels[k].select("block", F.col("first").alias("xs"))
    begin = parts.join(blocks.withColumnRenamed("block", "a"), "a").select(
        "x", "y", "z", "a",
        F.array_min(F.slice("xs", (F.col("x") % size + 1).cast("int"),
                            (F.least("y", (F.col("a") + 1) * size) - F.col("x")).cast("int"))).alias("least"),
    )
    if k + 1 == len(levels):
        return begin.select("x", "y", "least")
    end = parts.where("z > a").join(blocks.withColumnRenamed("block", "z"), "z").select(
        "x", "y", F.array_min(F.slice("xs", F.lit(1), ((F.col("y") - 1) % size + 1).cast("int"))).alias("least")
    )
    wide = parts.where("z > a + 1").select("x", "y", (F.col("a") + 1).alias("p"), F.col("z").alias("q"))
    inner = _range_min(wide.select(F.col("p").alias("x"), F.col("q").alias("y")), levels, k + 1, size)
    middle = wide.join(inner.select(F.col("x").alias("p"), F.col("y").alias("q"), "least"), ["p", "q"]).select("x", "y", "least")
    return begin.select("x", "y", "least").unionByName(end).unionByName(middle).groupBy("x", "y").agg(F.min("least").alias("least"))


def _intervals(places: DataFrame, n: int, size: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes of the Cartesian tree over places 0 to ``n - 1``, of which the ends are sentinels.

    ``(l, r, hi, merged, first)``: elements l to r - 1 share ``hi`` turns, at ``merged`` boundaries, and ``first`` is their
    smallest member; ``(b, first)`` tells it of each boundary's node. The list is of tables to delete.
    """
    levels = _minima(places, n, size)
    local = materialize(levels[0].mapInArrow(_within(size), "b long, block long, lcp long, l long, r long, first long, onward long, upto long"), "boundaries")
    found = local.where((F.col("b") > 0) & (F.col("b") < n - 1))
    for side, rightward in (("l", False), ("r", True)) if len(levels) > 1 else ():
        wanted = found.where(F.col(side).isNull()).select("block", "lcp").distinct()
        far = _sought(wanted, levels, size, rightward)
        found = found.join(far, ["block", "lcp"], "left").withColumn(side, F.coalesce(side, "place")).drop("place")
    found = materialize(found.select("b", "lcp", "l", "r", "first"), "boundaries")
    merged = materialize(
        found.groupBy("l", "r").agg(F.max("lcp").alias("hi"), F.count(F.lit(1)).alias("merged"), F.min("first").alias("first")), "intervals"
    )
    tables = [*levels, local, found, merged]
    if len(levels) > 1:
        wide = merged.where("first IS NULL").withColumns({"x": F.expr(f"l div {size} + 1"), "y": F.expr(f"r div {size}")})
        between = _range_min(wide.where("x < y").select("x", "y"), levels, 1, size)
        spans = wide.join(between, ["x", "y"], "left").join(
            local.select(F.col("b").alias("l"), "onward"), "l"
        ).join(local.select(F.col("b").alias("r"), "upto"), "r")
        told = spans.select("l", "r", "hi", "merged", F.least("onward", "upto", "least").alias("first"))
        merged = materialize(merged.where("first IS NOT NULL").unionByName(told), "intervals")
        tables.append(merged)
    of = found.select("b", "l", "r").join(merged.select("l", "r", "first"), ["l", "r"]).select("b", "first")
    return merged, of, tables


def _ends(members: DataFrame) -> DataFrame:
    """``(i, ends)``: SHA-256 of the ids of each element's members, ascending, in decimals, joined by commas.

    Pieces of the list are made where its ranges are sorted. The digest alone runs over an element's pieces in one
    task, as it must, and holds one of them at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            at = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
            cuts = [x for a, z in zip(at, np.append(at[1:], len(i))) for x in range(a, z, PIECE)] + [len(i)]
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.record_batch(
                [pa.array(i[cuts[:-1]]), pa.array(c[cuts[:-1]]), pa.array([",".join(map(str, c[a:z].tolist())) for a, z in spans], pa.string())],
                names=["i", "c", "ids"],
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running_ = None, None
        done: list[tuple[int, str]] = []
        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i != now:
                    if now is not None:
                        done.append((now, running_.hexdigest()))
                    now, running_ = i, hashlib.sha256(ids.encode())
                else:
                    running_.update(b"," + ids.encode())
            yield pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["i", "ends"])
            done = []
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.int64()), pa.array([running_.hexdigest()], pa.string())], names=["i", "ends"])

    listed = members.orderBy("i", "c").mapInArrow(pieces, "i long, c long, ids string")
    return listed.repartition("i").sortWithinPartitions("i", "c").select("i", "ids").mapInArrow(digests, "i long, ends string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int | None = None) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of each node.

    ``turns``: ``conv_id, d, mark, words``, numbered from 1 without gaps; ``conversations``: ``conv_id, n`` of all, those
    without turns too. A node is named by its smallest member and its depth; the root has depth 0 and no
    parent. Without conversations there is no node. Null ids are not taken; other columns are not read.
    """
    size = block or BLOCK
    turns = materialize(turns.select("conv_id", "d", "mark", "words"), "turns")
    levels = _levels(turns)
    scratch = [turns, *levels]
    top = conversations.select("conv_id", "n").join(levels[-1].select("conv_id", "seq"), "conv_id", "left")
    none = F.array().cast(levels[-1].schema["seq"].dataType)
    top = materialize(top.select("conv_id", "n", F.coalesce("seq", none).alias("seq")), "sequences")
    alike = top.groupBy("seq").agg(F.count(F.lit(1)).alias("w"), F.min("conv_id").alias("first"), F.max("n").alias("n"))
    elements, m, written = indexed(alike, "seq")
    scratch += [top, written]
    empty = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if m == 0:
        discard(*scratch)
        return turns.sparkSession.createDataFrame([], empty)
    ends = materialize(_ends(top.join(elements.select("seq", "i"), "seq").select("i", F.col("conv_id").alias("c"))), "ends")
    # places 0 to m: the boundary before each element, and one behind the last
    rows = elements.select("i", "w", "first", "n").join(_lcp(elements, levels), "i", "left")
    last = turns.sparkSession.createDataFrame([(m, 0, _TOP, -1, -1)], "i long, w long, first long, n long, lcp long")
    rows = materialize(rows.select("i", "w", "first", "n", F.coalesce("lcp", F.lit(-1)).cast("long").alias("lcp")).unionByName(last), "places")
    after = rows.select((F.col("i") - 1).alias("i"), F.col("lcp").alias("lcp2"))
    rows2 = rows.join(after, "i", "left").withColumns({
        "leaf": (F.coalesce("lcp2", F.lit(_TOP)) < F.col("n")).cast("long"), "own": F.col("n") - F.col("lcp")
    })
    places = materialize(running(rows2, "i", ["w", "leaf", "own"], m + 1), "places")
    merged, of, tables = _intervals(rows.select("i", "lcp", "first"), m + 1, size)
    scratch += [ends, rows, places, *tables]

    at_left = places.select(F.col("i").alias("l"), F.col("lcp").alias("lcp_l"), F.col("n").alias("n_l"), "before_own",
                            F.col("before_w").alias("w_l"), F.col("before_leaf").alias("leaf_l"))
    at_right = places.select(F.col("i").alias("r"), F.col("lcp").alias("lcp_r"), F.col("before_w").alias("w_r"), F.col("before_leaf").alias("leaf_r"))
    lo = F.greatest("lcp_l", "lcp_r")
    leaves = places.where((F.col("i") < m) & (F.col("n") > F.greatest("lcp", "lcp2"))).select(
        F.col("i").alias("l"), (F.col("i") + 1).alias("r"), F.col("n").alias("hi"), F.lit(0).cast("long").alias("merged"), "first"
    )
    ranges = merged.unionByName(leaves).join(at_left, "l").join(at_right, "r").select(
        "l", "r", "hi", "first", lo.alias("lo"), F.when(F.col("lcp_l") >= F.col("lcp_r"), F.col("l")).otherwise(F.col("r")).alias("b"),
        (F.col("w_r") - F.col("w_l")).alias("n_convs"), (F.col("leaf_r") - F.col("leaf_l")).alias("n_leaves"),
        (F.col("merged") + (F.col("n_l") > F.col("hi")).cast("long")).alias("branches"), "n_l",
        (F.col("before_own") - F.col("lcp_l") - 1).alias("shift"),
    )
    ranges = ranges.join(of.withColumnRenamed("first", "above"), "b", "left")
    # depths lo + 1 to hi, some at a time
    cut = F.explode(F.sequence(F.col("lo") + 1, F.col("hi"), F.lit(BLOCK))).alias("from")
    nodes = ranges.select("*", cut).select("*", F.explode(F.sequence("from", F.least("hi", F.col("from") + BLOCK - 1))).alias("depth"))
    said = turns.join(elements.select(F.col("first").alias("conv_id"), F.col("i").alias("l")), "conv_id").select(
        "l", F.col("d").alias("depth"), "words"
    )
    top_ = F.col("depth") == F.col("hi")
    nodes = nodes.join(said, ["l", "depth"], "left").select(
        "l", "r", "depth", "n_convs", "n_leaves", "n_l", F.col("first").alias("conv_id"),
        F.when(F.col("depth") > F.col("lo") + 1, F.col("first")).otherwise(F.col("above")).alias("parent_conv_id"),
        F.when(top_, F.col("branches")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("spared"), (F.col("shift") + F.col("depth")).alias("g"),
    )
    nodes = materialize(nodes, "nodes")
    n_nodes = nodes.count()
    summed = materialize(running(nodes, "g", ["spared"], n_nodes), "nodes")
    start = places.where(F.col("i") < m).select(F.col("i").alias("l"), (F.col("lcp") + 1).alias("depth"))
    begun = summed.select("l", "depth", "before_spared").join(start, ["l", "depth"]).select(F.col("l").alias("r"), F.col("before_spared").alias("upto"))
    total = summed.agg(F.lit(m).cast("long").alias("r"), F.sum("spared").alias("upto"))
    own = ends.select(F.col("i").alias("l"), F.col("ends"))
    out = summed.join(begun.unionByName(total), "r").join(own.withColumn("depth", F.lit(0)).drop("depth"), "l", "left")
    out = materialize(
        out.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("upto") - F.col("before_spared")).alias("saved_tokens"),
            F.when(F.col("depth") == F.col("n_l"), F.col("ends")).otherwise(_NONE).alias("ends_sha256"),
        ),
        "trie",
    )
    discard(*scratch, nodes, summed)
    return out


def conversation_trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The trie of ``conversations`` (``conv_id, turn, role, text``) that begin like the first one of their group.

    Null roles and texts are empty, null turns come first, equal ones go by their digests, repeated rows are turns of their own,
    rows with a null ``conv_id`` are left out; an empty table gives an empty trie; other columns are not read.
    """
    turns = materialize(numbered_turns(conversations), "turns")
    found = prefix_trie(*rebuilt(turns, group, most))
    discard(turns)
    return found
