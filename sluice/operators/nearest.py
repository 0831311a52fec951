"""Exact search for the most similar earlier row, in blocks of alike vectors that bounds let most rows skip.

``all_best_earlier`` asks for all rows at once: rows are cut into ranges of their order, each packed into leaves of alike vectors,
and two blocks of two ranges meet in one task, which skips leaves by their bounds. So a row travels once for each two ranges, not
for each block that it visits. ``best_earlier`` asks for some rows among some others, in blocks that are placed once:

Vectors go to the nearest of some pivots; large cells are cut by order, so a block is near in space and time. Of each block
the centre, the radius and the earliest row are known everywhere. No row of a block is more similar to ``a`` than
``a . centre + |a| radius``, whatever the lengths of the vectors, so a row visits the blocks that begin before it and whose
bound reaches what it has found so far. Rows of one block meet another block in one task: two blocks, never more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import apart, cut_lineage

#: Pivots at most, rows that are dealt at a time, and rows that a task gives at a time.
CELLS, STEP, GIVE = 1024, 1024, 8192
#: Rows of a block: at least, and at most; between them as many as have this many bytes. Each row travels once for each block
#: that it visits, so larger blocks mean less to shuffle; two of them lie in a task.
BLOCK, LARGEST, BLOCK_BYTES = 4096, 16384, 4 << 20
#: Products of rows that are held at a time: 4 MB, whatever the size of a block.
PRODUCTS = 1 << 19
#: Bytes of all centres at most; blocks get larger where there would be more.
SUMMARY = 128 << 20
_CUTS = 63
_FOUND = "_by string, idx long, s double, src long"
#: Rows of a leaf, leaves of a range at least (fewer are less alike), bytes of its vectors at most, pairs of blocks at most that meet at a time.
LEAF, LEAVES, RANGE_BYTES, MEETINGS = 512, 16, 32 << 20, 4096
_NONE = np.iinfo(np.int64).max
_PACKED = "_by string, at int, parts int, before long, idx binary, vec binary, firsts int, s binary, src binary, visits long, compared long"
_MET = "_by string, idx binary, s binary, src binary, visits long, compared long"


@dataclass
class Summary:
    """What every task knows of the blocks."""

    name: list[str]
    by: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray


@dataclass
class Places:
    """``rows``: ``_by, idx, vec, block``; ``blocks``: the broadcast summary, None without rows or if they are only listed.

    ``size``: rows of a block; ``many`` vectors of ``dim`` numbers.
    """

    rows: DataFrame
    blocks: object
    size: int
    many: int = 0
    dim: int = 0


@dataclass
class Leaf:
    """Rows with alike vectors, the first ``firsts`` of which have no earlier copy in their range; what each has found so far."""

    idx: np.ndarray
    x: np.ndarray
    firsts: int
    s: np.ndarray
    src: np.ndarray


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _ints(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _listed(vectors: DataFrame, order: str, vec: str, by: str | None) -> tuple[DataFrame, int, int]:
    """``_by, idx, vec`` of rows with a vector, how many they are, and the length of their vectors, which is one."""
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    base = vectors.where(F.col(vec).isNotNull()).select(
        group.alias("_by"), F.col(order).cast("long").alias("idx"), F.col(vec).cast("array<float>").alias("vec")
    )
    n, low, high = base.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if n and low != high:
        raise ValueError(f"vectors of {low} and of {high} numbers")
    return base, n, high or 0


def listed(vectors: DataFrame, order: str = "idx", vec: str = "vec", by: str | None = None, block: int | None = None) -> Places:
    """Rows for ``all_best_earlier``, which needs no blocks. Rows with a null vector are left out; all vectors have one length."""
    base, n, dim = _listed(vectors, order, vec, by)
    return Places(base, None, block or LEAF, n, dim)


def place(vectors: DataFrame, order: str = "idx", vec: str = "vec", by: str | None = None, block: int | None = None) -> Places:
    """Deal ``vectors`` to blocks. Rows with a null vector are left out; all vectors have one length."""
    spark = vectors.sparkSession
    base, n, high = _listed(vectors, order, vec, by)
    if not n:
        return Places(base.withColumn("block", F.lit("")), None, 1)
    cores = spark.sparkContext.defaultParallelism
    # pairs of blocks are dealt to tasks: some for each core are enough, as rows travel once for each block
    fewest = math.ceil(math.sqrt(8 * cores))
    most = max(BLOCK, min(LARGEST, BLOCK_BYTES // (4 * max(1, high))))
    size = min(most, max(64, math.ceil(n / fewest))) if block is None else block
    size = max(size, math.ceil(2 * n * 8 * (high + 4) / SUMMARY))
    k = min(CELLS, math.ceil(n / size))
    chosen = base.orderBy(F.xxhash64("idx", F.lit("pivot")), "idx").limit(k).select("vec").collect()  # CELLS rows at most
    pivots = spark.sparkContext.broadcast(np.array([r["vec"] for r in chosen], np.float64))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        half = (p * p).sum(axis=1) / 2
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                cell = np.argmax(_matrix(part.column(2)) @ p.T - half, axis=1)
                yield pa.record_batch([*part.columns, pa.array(cell.astype(np.int32))], names=["_by", "idx", "vec", "cell"])

    celled = cut_lineage(base.mapInArrow(cells, "_by string, idx long, vec array<float>, cell int"))
    cuts = celled.groupBy("_by", "cell").agg(
        F.count(F.lit(1)).alias("many"), F.percentile_approx("idx", [i / (_CUTS + 1) for i in range(1, _CUTS + 1)], F.lit(1000)).alias("cuts")
    )
    # a cell of p blocks takes every (64 / p)-th cut; one of more than 64 blocks is dealt by hash between two cuts too
    parts = F.least(F.ceil(F.col("many") / size), F.lit(_CUTS + 1))
    passed = F.size(F.filter("cuts", lambda c: c < F.col("idx")))
    deal = F.pmod(F.xxhash64("idx"), F.greatest(F.lit(1), F.ceil(F.col("many") / size / (_CUTS + 1))))
    name = F.concat_ws("/", "_by", "cell", F.floor(passed * parts / (_CUTS + 1)), deal)
    on = ["_by", "cell"]
    # every cell has its cuts; of a left join only they may be broadcast, not the vectors
    rows = cut_lineage(celled.join(cuts, on, "left").select("_by", "idx", "vec", name.alias("block")))

    def told(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("vec"))
        centre = x.mean(axis=0)
        radius = math.sqrt(((x - centre) ** 2).sum(axis=1).max())
        return pa.table({"block": [table.column("block")[0].as_py()], "_by": [table.column("_by")[0].as_py()],
                         "centre": [centre.tolist()], "radius": [radius], "first": [int(_ints(table.column("idx")).min())]})

    # SUMMARY bytes at most
    found = rows.groupBy("block").applyInArrow(told, "block string, _by string, centre array<double>, radius double, first long").collect()
    found.sort(key=lambda r: r["block"])
    summary = Summary([r["block"] for r in found], np.array([r["_by"] for r in found]), np.array([r["centre"] for r in found]),
                      np.array([r["radius"] for r in found]), np.array([r["first"] for r in found]))
    return Places(rows, spark.sparkContext.broadcast(summary), size, n, high)


def _aimed(queries: DataFrame, places: Places) -> DataFrame:
    """Each query once for each block that it visits, those that reach its floor: ``_by, idx, vec, floor, own, block``."""
    blocks = places.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = blocks.value
        away = np.sqrt((b.centre**2).sum(axis=1))
        names = pa.array(b.name)
        for batch in batches:
            step = max(1, min(STEP, PRODUCTS // len(names)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                idx = _ints(part.column(1))
                x, floor = _matrix(part.column(2)), part.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                length = np.sqrt((x * x).sum(axis=1))
                high = x @ b.centre.T + length[:, None] * b.radius
                high += 1e-9 * length[:, None] * (away + b.radius)  # more than rounding can take away
                by = part.column(0).to_numpy(zero_copy_only=False).astype(b.by.dtype)
                may = (b.first < idx[:, None]) & (b.by == by[:, None])
                may &= (high >= floor[:, None]) | np.isnan(floor)[:, None]
                q, to = np.nonzero(may)
                for k in range(0, len(q), GIVE):  # a row may visit all blocks
                    some, there = pa.array(q[k : k + GIVE]), pa.array(to[k : k + GIVE])
                    yield pa.record_batch([*(part.column(c).take(some) for c in range(5)), names.take(there)],
                                          names=["_by", "idx", "vec", "floor", "own", "block"])

    return queries.select("_by", "idx", "vec", F.col("floor").cast("double").alias("floor"), "block").mapInArrow(
        run, "_by string, idx long, vec array<float>, floor double, own string, block string"
    )


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best earlier row of the right block for each row of the left one that reaches its floor."""
    none = {"_by": pa.array([], pa.string()), "idx": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "src": pa.array([], pa.int64())}
    if not left.num_rows or not right.num_rows:
        return pa.table(none)
    order = np.argsort(_ints(right.column("idx")))
    at = _ints(right.column("idx"))[order]
    base = _matrix(right.column("vec").take(pa.array(order)))
    step = min(left.num_rows, max(1, PRODUCTS // len(at)))
    held = np.empty((step, len(at)))
    out: list[pa.Table] = []
    for k in range(0, left.num_rows, step):
        part = left.slice(k, step)
        idx, floor = _ints(part.column("idx")), part.column("floor").to_numpy().astype(np.float64)
        s = np.matmul(_matrix(part.column("vec")), base.T, out=held[: len(idx)])
        if at[-1] >= idx.min():
            s[at >= idx[:, None]] = -np.inf
        best = np.argmax(s, axis=1)  # the earliest of equal ones
        top = s[np.arange(len(idx)), best]
        ok = np.isfinite(top) & ~(top < floor)
        by = part.column("_by").filter(pa.array(ok))
        out.append(pa.table({"_by": by, "idx": pa.array(idx[ok], pa.int64()), "s": pa.array(top[ok]), "src": pa.array(at[best[ok]], pa.int64())}))
    return pa.concat_tables(out).combine_chunks()


def best_earlier(queries: DataFrame, base: DataFrame, places: Places) -> tuple[DataFrame, DataFrame]:
    """``(_by, idx, s, src)``: for each of ``queries`` the most similar earlier row of ``base``, the earliest of equal ones.

    ``queries``: ``_by, idx, vec, floor, block``; rows below their floor are not told; a null floor is none. ``base`` is a
    part of the rows that were placed. Also the visits ``(own, block, n)`` that it took.
    """
    aimed = _aimed(queries, places)
    visits = aimed.groupBy("own", "block").agg(F.count(F.lit(1)).alias("n"))
    # names of their own: both sides of the cogroup come from ``aimed``
    asked = visits.select(F.col("own").alias("visitor"), F.col("block").alias("host"))
    there = asked.join(apart(base.select(F.col("block").alias("host"), "idx", "vec")), "host")
    there = there.repartition("visitor", "host")  # else all that visit one block would meet it in one task
    met = aimed.groupBy("own", "block").cogroup(there.groupBy("visitor", "host")).applyInArrow(_compare, _FOUND)
    top = met.groupBy("_by", "idx").agg(F.max(F.struct("s", (-F.col("src")).alias("src"))).alias("m"))
    return top.select("_by", "idx", "m.s", (-F.col("m.src")).alias("src")), visits


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in parts of ``size`` at most, each cut in two between the means of its halves; no half gets less than an eighth."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        n = len(at)
        if n <= size:
            out.append(at)
            continue
        part = x[at].astype(np.float64)
        part -= part.mean(axis=0)
        square = part.T @ part
        v = square[:, np.argmax(np.diag(square))]
        for _ in range(8):  # the direction in which they differ most
            v = square @ (v / max(math.sqrt(v @ v), 1e-300))
        key = part @ v
        side = key > np.median(key)
        for _ in range(4):
            if side.all() or not side.any():
                break
            a, b = part[side].mean(axis=0), part[~side].mean(axis=0)
            key = part @ (a - b) - (a @ a - b @ b) / 2
            side = key > 0
        cut = min(max(n - int(side.sum()), max(1, n // 8)), n - max(1, n // 8))
        order = np.argpartition(key, cut)
        todo += [at[order[cut:]], at[order[:cut]]]
    return out


def _grown(idx: np.ndarray, x: np.ndarray, least: float | None, size: int) -> list[Leaf]:
    """The leaves of a range. Of equal vectors only the first can be the earliest best, so the others answer nobody."""
    order = np.argsort(idx, kind="stable")
    order = order[np.isfinite(x[order]).all(axis=1)]
    idx, x = idx[order], x[order] + np.float32(0)  # no negative zeros
    first = np.zeros(len(x), bool)
    if x.size:
        whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        first[np.unique(whole, return_index=True)[1]] = True
    out = []
    for at in _leaves(x, size) if x.size else []:
        at = np.concatenate([at[first[at]], at[~first[at]]])
        floor = np.full(len(at), -np.inf if least is None else least)
        out.append(Leaf(idx[at], x[at], int(first[at].sum()), floor, np.full(len(at), _NONE)))
    return out


def _meet(asked: list[Leaf], told: list[Leaf], own: bool) -> list[tuple[int, int]]:
    """Let rows of ``asked`` find their best earlier one in ``told``; ``own``: these are the same rows, else all are earlier.

    Products in single precision tell which rows can gain anything, those in double precision which pairs come near the best,
    and sums in the order of the numbers decide: equal vectors have equal similarities, wherever they lie. Also, for each leaf, the
    leaves that it visited and the pairs that were compared.
    """
    told = [b for b in told if b.firsts]
    if not told:
        return [(0, 0)] * len(asked)
    base, at = [b.x[: b.firsts] for b in told], [b.idx[: b.firsts] for b in told]
    centre = np.array([b.mean(axis=0, dtype=np.float64) for b in base])
    radius = np.array([math.sqrt(((b - c) ** 2).sum(axis=1).max()) for b, c in zip(base, centre)])
    longest = np.array([math.sqrt((b.astype(np.float64) ** 2).sum(axis=1).max()) for b in base])
    begin, end = np.array([a.min() for a in at]), np.array([a.max() for a in at])
    away, dim = (centre**2).sum(axis=1), centre.shape[1]
    work = []
    for q in asked:
        x = q.x.astype(np.float64)
        square = (x * x).sum(axis=1)
        length = np.sqrt(square)
        high = x @ centre.T
        apart_ = np.sqrt(np.maximum(0, square[:, None] + away - 2 * high))
        high += length[:, None] * radius
        high = np.minimum(high, (square[:, None] + longest**2 - np.maximum(0, apart_ - radius) ** 2) / 2)
        high += 1e-9 * (square[:, None] + away + longest**2)  # more than rounding can take away
        if own:
            high[begin >= q.idx[:, None]] = -np.inf
        highest = high.max(axis=0)
        visits = compared = 0
        for j in np.argsort(-highest, kind="stable"):
            if highest[j] == -np.inf or highest[j] < q.s.min():
                break
            rows = np.flatnonzero((high[:, j] >= q.s) & (high[:, j] > -np.inf))
            if not len(rows):
                continue
            visits, compared = visits + 1, compared + len(rows) * len(base[j])
            late = at[j] >= q.idx[rows][:, None] if own and end[j] >= q.idx[rows].min() else None
            with np.errstate(all="ignore"):
                near = q.x[rows] @ base[j].T
            if late is not None:
                near[late] = -np.inf
            fault = (dim + 4) * length[rows] * longest[j]
            good = ~(near.max(axis=1) + (2.0**-23 * fault + 1e-35) < q.s[rows])  # what is no number is looked at again
            if not good.any():
                continue
            rows, wide = rows[good], base[j].astype(np.float64)
            near = x[rows] @ wide.T
            if late is not None:
                near[late[good]] = -np.inf
            bar = np.maximum(near.max(axis=1), q.s[rows]) - (2.0**-51 * fault[good] + 1e-300)
            r, c = np.nonzero((near >= bar[:, None]) & (near > -np.inf))
            if not len(r):
                continue
            s, src = np.cumsum(x[rows[r]] * wide[c], axis=1)[:, -1], at[j][c]
            order = np.lexsort((src, -s, r))
            order = order[np.r_[True, np.diff(r[order]) > 0]]  # the best of each row
            r, s, src = rows[r[order]], s[order], src[order]
            new = (s > q.s[r]) | ((s == q.s[r]) & (src < q.src[r]))
            q.s[r[new]], q.src[r[new]] = s[new], src[new]
        work.append((visits, compared))
    return work


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of a leaf's that found one."""
    for batch in batches:
        for by, *blobs in zip(*(batch.column(c).to_pylist() for c in range(4))):
            idx, s, src = (np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.float64, np.int64)))
            ok = src != _NONE
            yield pa.record_batch([pa.array([by] * int(ok.sum()), pa.string()), pa.array(idx[ok]), pa.array(s[ok]), pa.array(src[ok])],
                                  names=["_by", "idx", "s", "src"])


def _dealt(packed: DataFrame) -> DataFrame:
    """Packed ranges once for each ``task`` of their block: with each ``other`` of the group, or with itself if it is alone. ``s, src`` go where they ask."""
    blocks = packed.where("parts > 1").withColumns({"block": F.expr("int(at div 2)"), "blocks": F.expr("int((parts + 1) div 2)")})
    both = blocks.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x <> block OR blocks = 1)")))
    high, low = F.greatest("block", "other").cast("long"), F.least("block", "other")
    asks = F.expr("other < block OR block = 0 AND other < 2")
    return both.select(
        (F.col("before") + (high * (high - 1) / 2).cast("long") + low).alias("task"), "_by", "at", "other", "firsts", "idx", "vec",
        *(F.when(asks, F.col(c)).alias(c) for c in ("s", "src")),
    )


def all_best_earlier(places: Places, least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(_by, idx, s, src)`` of all rows among all rows, and ``(visits, compared)``: pairs of leaves and of rows that met.

    The rows of a group are cut into ranges of their order. A range is packed in one task, where its rows first look among
    themselves; then each range meets every earlier one: two ranges are a block, and each two blocks have a task of their own, in
    which one block's two ranges meet too. A range has ``RANGE_BYTES`` of vectors at most, so a task is bounded, and there are as
    many as give each core a pair of blocks. A task gets its four ranges unsorted and reads them where they arrived, which takes
    no more memory than two of them sorted by Spark and copied. What a row found bars most leaves. So does ``least``, below which
    nothing is told. Rows without an order meet nothing.
    """
    dim, leaf = places.dim, min(LEAF, places.size)
    rows = places.rows.where("idx IS NOT NULL").select("_by", "idx", "vec")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = max(leaf * LEAVES, min(RANGE_BYTES // (4 * max(1, dim)), math.ceil(places.many / math.ceil(math.sqrt(8 * cores)))))
    top = max(1, math.ceil(places.many / size))
    steps = 8 * top
    cuts = rows.groupBy("_by").agg(
        F.count(F.lit(1)).alias("many"), F.percentile_approx("idx", [i / steps for i in range(1, steps)], F.lit(10000)).alias("cuts")
    ).where(F.col("many") > size)  # ``top`` groups at most
    blocks = F.ceil(F.ceil(F.col("many") / size) / 2)
    pairs = F.greatest(F.lit(1), (blocks * (blocks - 1) / 2).cast("long"))  # of a group's blocks, a single one with itself
    cuts = cuts.withColumn("before", F.sum(pairs).over(Window.orderBy("_by")) - pairs)
    parts = F.coalesce(F.ceil(F.col("many") / size), F.lit(1)).cast("int")
    passed = F.size(F.filter("cuts", lambda c: c < F.col("idx")))
    at = F.coalesce(F.floor(passed * parts / steps), F.lit(0)).cast("int")
    ranged = rows.join(F.broadcast(cuts), "_by", "left").select("_by", at.alias("at"), parts.alias("parts"), "before", "idx", "vec")

    def pack(table: pa.Table) -> pa.Table:
        vec = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        grown = _grown(_ints(table.column("idx")), vec.reshape(table.num_rows, -1), least, leaf)
        work = _meet(grown, grown, True)
        n, (by, at, parts, before) = len(grown), (table.column(c)[0].as_py() for c in ("_by", "at", "parts", "before"))
        blobs = {c: pa.array([getattr(g, f).tobytes() for g in grown], pa.binary()) for c, f in (("idx", "idx"), ("vec", "x"), ("s", "s"), ("src", "src"))}
        return pa.table({
            "_by": pa.array([by] * n, pa.string()), "at": pa.array([at] * n, pa.int32()), "parts": pa.array([parts] * n, pa.int32()),
            "before": pa.array([before] * n, pa.int64()), "idx": blobs["idx"], "vec": blobs["vec"],
            "firsts": pa.array([g.firsts for g in grown], pa.int32()), "s": blobs["s"], "src": blobs["src"],
            "visits": pa.array([v for v, _ in work], pa.int64()), "compared": pa.array([c for _, c in work], pa.int64()),
        })

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, late, early, ranges = None, 0, 0, {}
        for batch in batches:
            for by, at, other, firsts, *blobs in zip(*batch.columns):
                at, other = at.as_py(), other.as_py()
                late, early = max(at // 2, other), min(at // 2, other)
                idx, x, s, src = (np.frombuffer(b.as_buffer(), t) if b.is_valid else None for b, t in zip(blobs, (np.int64, np.float32, np.float64, np.int64)))
                asks = s is not None
                ranges.setdefault(at, []).append(Leaf(idx, x.reshape(len(idx), -1), firsts.as_py(), s.copy() if asks else None, src.copy() if asks else None))
        for at, asked in ranges.items():
            # a block's own ranges meet where it meets the one before it; those of the first where it meets the second, or is alone
            own = late - early < 2 and at // 2 in (late, 0)
            told = [b for k, leaves in ranges.items() if k // 2 < at // 2 or own and k < at and k // 2 == at // 2 for b in leaves]
            if not told:
                continue
            was = [q.src.copy() for q in asked]
            work = _meet(asked, told, False)
            new = [q.src != w for q, w in zip(asked, was)]
            found = [pa.array([getattr(q, f)[k].tobytes() for q, k in zip(asked, new)], pa.binary()) for f in ("idx", "s", "src")]
            yield pa.record_batch([pa.array([by.as_py()] * len(asked), pa.string()), *found, pa.array([v for v, _ in work], pa.int64()),
                                   pa.array([c for _, c in work], pa.int64())], names=["_by", "idx", "s", "src", "visits", "compared"])

    packed = cut_lineage(ranged.groupBy("_by", "at").applyInArrow(pack, _PACKED))
    met = packed.select("_by", "idx", "s", "src", "visits", "compared")
    if top > 1:
        both = _dealt(packed)
        most = top * top // 8 + 2 * top  # tasks at most, whatever the groups
        for k in range(0, most, MEETINGS):
            n = min(MEETINGS, most - k)
            now = both.where(F.col("task").between(k, k + n - 1)).repartitionById(n, (F.col("task") - k).cast("int")).drop("task")
            met = met.unionByName(cut_lineage(now.mapInArrow(meet, _MET)))
    found = met.select("_by", "idx", "s", "src").mapInArrow(_unpacked, _FOUND)
    best = found.groupBy("_by", "idx").agg(F.max(F.struct("s", (-F.col("src")).alias("src"))).alias("m"))
    work = met.agg(F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    return best.select("_by", "idx", "m.s", (-F.col("m.src")).alias("src")), work
