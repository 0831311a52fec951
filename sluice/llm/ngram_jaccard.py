"""N-gram Jaccard join: documents whose sets of word shingles are alike.

1. Every text becomes a sorted array of 64-bit shingle hashes. Texts with the same set are one node from here on,
   named by the set's fingerprint; a second sum and the size tell whether two sets have one name, and then all get others. Ids of documents come back only at the end, so repeated or null ids cut no link.
2. A set of n shingles shares one of its first ``n - ceil(t n) + 1`` shingles, in any fixed order of all shingles,
   with each set that is alike. The order puts shingles seen in many texts last, so that common passages and lines
   seldom bring texts together. Each such shingle with its sets is a tile, for two neighbouring bands of sizes.
   The first common shingle of two alike sets has all their common ones behind it, so in its tile the smaller set
   stands within its first ``n - need(n, n) + 1`` places (it is early). A later set stays in a tile only if an early
   one of fitting size is there. Sets of a very frequent shingle are dealt over several tasks.
3. Leader rounds: a set meets one or two leaders of its tiles, the same ones for all of a group of near copies.
   Pairs that hold make classes, so a large group becomes one class with a pair or two for each of its sets.
4. Tiles that still hold several classes are compared between classes, in blocks of bounded weight, on bitmap
   signatures. Bits of A that B lacks are shingles that B lacks, so bit counts bound the overlap from above. Blocks
   give the connected parts of what the bitmaps allow, never pairs: a row for each set at most.
5. Within such a part exact intersections of sorted arrays link classes (union-find); the links that joined two
   classes are given, one less than the classes at most.

No link is lost: the bounds are exact, and a skipped pair is within one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, materialize
from .words import mix, shingles, words_of

WIDTH, PERCENT = 5, 75
#: Weight of the sets of a tile that are compared at a time; a set weighs one, and one more for each HEAVY shingles.
BLOCK, HEAVY = 512, 8192
LEAST_BITS = 256
#: The most frequent shared shingles that tasks are told of (16 bytes each). It bounds a broadcast and bears on the
#: order alone: any order gives the same links.
HOT = 500_000
#: Sets of one shingle that one task is meant to hold; those of a more frequent one are dealt over several tasks.
TILE_ROWS = 50_000
PART = 40
#: Names of its tiles that a set tells others; two sets meet in the first common one that both tell, if there is one.
TOLD = 16
#: Leader rounds at most after the first, and the share of sets in open tiles with a pair that makes a round worthwhile.
#: Both bear on the work alone: what the rounds leave is compared in full.
ROUNDS, WORTH = 4, 0.05
#: Keeps fingerprints apart from other mixes of the same shingles, and from the sums that they are checked by.
_SALT, _CHECK = np.uint64(0x5851F42D4C957F2D), np.uint64(0xC6A4A7935BD1E995)


def _print(s: np.ndarray, salt: np.uint64) -> np.uint64:
    """Fingerprint of a set."""
    return np.uint64(len(s)) + mix(s ^ salt).sum(dtype=np.uint64)


def _signature(s: np.ndarray) -> bytes:
    """Bitmap of two to four bits a shingle; a power of two, so that it folds."""
    bits = max(LEAST_BITS, 1 << int(2 * len(s) - 1).bit_length())
    mark = np.zeros(bits, dtype=bool)
    mark[(s >> np.uint64(8)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(mark, bitorder="little").tobytes()


def _fold(sig: np.ndarray, size: int) -> np.ndarray:
    while len(sig) > size:
        sig = sig[: len(sig) // 2] | sig[len(sig) // 2 :]
    return sig


def _needed(na, nb, percent: int):
    """The least overlap of sets of these sizes that are alike: 100 i >= p (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def _alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets_of(column: pa.Array, width: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Rows of ``column``, a few MB at a time, and their sets."""
    for w in words_of(column, lower=True):
        yield w.rows, [shingles(w.hash[a:b], width) for a, b in zip(w.first[:-1], w.first[1:])]


PROFILE = "doc_id long, row long, id long, n long, check long, sig binary, hot boolean"
_PROFILE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()),
                      ("check", pa.int64()), ("sig", pa.binary()), ("hot", pa.bool_())])


def _profile(width: int, salt: np.uint64):
    """Rows of sets, and of the shingles that many texts of a few MB share (hot). A set has its bitmap once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def hot() -> pa.RecordBatch:
            s, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count >= max(4, len(held) // 500)
            k = int(keep.sum())
            none, long = pa.nulls(k, pa.int64()), pa.array(count[keep].astype(np.int64))
            return pa.record_batch([none, none, _signed(s[keep]), long, none, pa.nulls(k, pa.binary()), pa.array(np.ones(k, bool))],
                                   schema=_PROFILE)

        for batch in batches:
            for rows, sets in _sets_of(batch.column(2), width):
                prints, sigs = [_print(s, salt) for s in sets], []
                checks = _signed(np.array([_print(s, _CHECK) for s in sets], np.uint64))
                for p, s in zip(prints, sets):
                    new = len(s) > 0 and int(p) not in seen
                    sigs.append(_signature(s) if new else None)
                    if new:
                        seen.add(int(p))
                        held.append(s)
                        size += len(s)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.record_batch([batch.column(0)[rows], batch.column(1)[rows], _signed(np.array(prints, np.uint64)), pa.array(n),
                                       checks, pa.array(sigs, pa.binary()), pa.array(np.zeros(len(n), bool))], schema=_PROFILE)
                if size > 2_000_000:
                    yield hot()
                    held, size = [], 0
        if held:
            yield hot()

    return run


def _postings(width: int, percent: int, hot, salt: np.uint64):
    """(key, id, rank) for the first shingles of each set; a set once in a task.

    ``key`` is the shingle; ``rank`` is twice the size, plus one where the set is late. The bits of ``rank`` from
    ``PART`` on number the parts of a very frequent shingle, from 1 on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = hot.value
        seen = set()
        for batch in batches:
            for _, sets in _sets_of(batch.column(2), width):
                keys, ids, ranks, parts = [], [], [], []
                for s in sets:
                    n = len(s)
                    p = _print(s, salt)
                    if not n or int(p) in seen:
                        continue
                    seen.add(int(p))
                    take = n - -(-percent * n // 100) + 1
                    count = np.zeros(take, np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        rank = np.where(common[at] == s, often[at], 0)
                        if rank.any():
                            order = np.lexsort((s, rank))[:take]
                            s, count = s[order], rank[order]
                    keys.append(s[:take]), ids.append(np.full(take, p)), parts.append(count // TILE_ROWS)
                    ranks.append(2 * n + (np.arange(take) > n - _needed(n, n, percent)).astype(np.int64))
                if keys:
                    id_, many = np.concatenate(ids), np.concatenate(parts)
                    part = np.where(many > 0, 1 + (mix(id_) % (many + 1).astype(np.uint64)).astype(np.int64), 0)
                    yield pa.record_batch([_signed(np.concatenate(keys)), _signed(id_), pa.array(np.concatenate(ranks) + (part << PART))],
                                          names=["key", "id", "rank"])

    return run


def _bands(n: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)


def _tiles(percent: int):
    """(tile, id, lead, size) of the members of each tile of two or more.

    ``lead`` is the set with the smallest fingerprint of the own band, or of the other one for that set itself.
    ``size`` counts the members that this task sees.
    """

    def one(key: np.ndarray, ids: np.ndarray, rank: np.ndarray, told: set) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids, rank = key[fresh], ids[fresh], rank[fresh]
        if not len(key):
            return
        part = rank >> PART
        wide, n, early = part > 0, (rank - (part << PART)) >> 1, rank & 1 == 0
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(first) - 1
        before = np.maximum.accumulate(np.where(early, np.arange(len(key)), -1))  # the last early set up to here
        fits = early | wide | ((before >= 0) & (group[before] == group) & (100 * n[before] >= percent * n))
        many = fits & ((np.bincount(group[fits], minlength=group[-1] + 1)[group] >= 2) | wide)
        key, ids, wide, n, group = key[many], ids[many], wide[many], n[many], group[many]
        if not len(ids):
            return
        band = _bands(n, percent)
        head = np.ones(len(ids), bool)
        head[1:] = (group[1:] != group[:-1]) | (band[1:] != band[:-1])
        heads, place = np.flatnonzero(head), np.cumsum(head) - 1
        lead = np.minimum.reduceat(ids, heads)
        after = np.zeros(len(heads), bool)  # the band above has sets too
        after[:-1] = (group[heads[1:]] == group[heads[:-1]]) & (band[heads[1:]] == band[heads[:-1]] + 1)
        below = np.append(False, after[:-1])
        # sets that are alike are in one band or in neighbouring ones, so a tile has two bands; one where a band has no
        # neighbour. Whether a part of a frequent shingle has neighbours is not known here, so it is in both tiles.
        upper, lower = after[place] | ~below[place] | wide, below[place] | wide
        own = np.concatenate([place[upper], place[lower]])
        tile = np.concatenate([place[upper], place[lower] - 1])
        key, ids, wide, band = (np.concatenate([x[upper], x[lower]]) for x in (key, ids, wide, band))
        low = band - (np.arange(len(ids)) >= upper.sum())
        other = np.where(own == tile, np.minimum(tile + 1, len(lead) - 1), np.maximum(tile, 0))
        there = np.where(own == tile, after[own], below[own])
        led = np.where(ids != lead[own], lead[own], np.where(there, lead[other], ids))
        order = np.lexsort((ids, tile))
        key, ids, tile, led, wide, low = key[order], ids[order], tile[order], led[order], wide[order], low[order]
        begin = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (wide[1:] & (low[1:] != low[:-1]))))
        sizes = np.diff(np.append(begin, len(ids)))
        alone = ~wide[begin]
        name = np.add.reduceat(mix(ids.view(np.uint64)), begin)
        name = np.where(alone, name, mix(key[begin].view(np.uint64) + low[begin].astype(np.uint64) * _SALT))
        new = (sizes >= 2) | ~alone
        for i in np.flatnonzero(new & alone).tolist():
            x = int(name[i])
            new[i] = x not in told
            told.add(x)
        rows = np.repeat(new, sizes)
        if rows.any():
            led = pa.array(led[rows], mask=(led == ids)[rows])
            yield pa.record_batch([_signed(np.repeat(name, sizes)[rows]), pa.array(ids[rows]), led, pa.array(np.repeat(sizes, sizes)[rows])],
                                  names=["tile", "id", "lead", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = [[], [], []]
        told: set = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            for held, c in zip(rest, cols):
                held.append(c[:cut])
            if cut or next((x for x in reversed(rest[0]) if len(x)), cols[0])[-1] != cols[0][-1]:
                yield from one(*(np.concatenate(x) for x in rest), told)
                rest = [[], [], []]
            for held, c in zip(rest, cols):
                held.append(c[cut:])
        if rest[0]:
            yield from one(*(np.concatenate(x) for x in rest), told)

    return run


def _bound(percent: int):
    """Of rows (a, b, na, nb, sa, sb) the pairs whose bitmaps allow enough overlap."""

    def could(na: int, nb: int, sa: bytes, sb: bytes) -> bool:
        a, b = np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)
        size = min(len(a), len(b))
        a, b = _fold(a, size).view(np.uint64), _fold(b, size).view(np.uint64)
        need = _needed(na, nb, percent)
        return na - int(np.bitwise_count(a & ~b).sum()) >= need and nb - int(np.bitwise_count(b & ~a).sum()) >= need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([could(*x) for x in zip(*(c.to_pylist() for c in batch.columns[2:]))], pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _arrays(width: int, salt: np.uint64):
    """(id, shingles) of each set, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, sets in _sets_of(batch.column(2), width):
                ids, out = [], []
                for s in sets:
                    p = _print(s, salt)
                    if len(s) and int(p) not in seen:
                        seen.add(int(p))
                        ids.append(p), out.append(s.tobytes())
                if ids:
                    yield pa.record_batch(
                        [_signed(np.array(ids, np.uint64)), pa.array(out, pa.binary())], names=["id", "shingles"]
                    )

    return run


def _exact(percent: int):
    """Of rows (a, b, shingles of a, shingles of b) the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            keep = pa.array([_alike(x, y, percent) for x, y in zip(s, t)], pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _allowed(left: list[tuple], right: list[tuple], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For places in ``left`` the places in ``right`` of another class that sizes and bitmaps allow.

    Rows begin with id, n, class, bitmap. Where both are the same list, later places only.
    """
    size = min(len(r[3]) for r in left + right)
    put = lambda rs: (  # noqa: E731,E501
        np.array([r[1] for r in rs]),
        np.array([r[2] for r in rs]),
        np.stack([_fold(np.frombuffer(r[3], np.uint8), size) for r in rs]).view(np.uint64)
    )
    ln, lc, ls = put(left)
    rn, rc, rs = (ln, lc, ls) if right is left else put(right)
    for k in range(len(left)):
        may = (rc != lc[k]) & (100 * np.minimum(rn, ln[k]) >= percent * np.maximum(rn, ln[k]))
        if right is left:
            may[: k + 1] = False
        at = np.flatnonzero(may)
        if len(at):
            need = _needed(rn[at], ln[k], percent)
            short = np.bitwise_count(rs[at] & ~ls[k]).sum(axis=1, dtype=np.int64)
            over = np.bitwise_count(~rs[at] & ls[k]).sum(axis=1, dtype=np.int64)
            at = at[(rn[at] - short >= need) & (ln[k] - over >= need)]
            if len(at):
                yield k, at


class _Union(dict):
    """Union-find over any keys."""

    def root(self, x):
        while (up := self.setdefault(x, x)) != x:
            self[x] = self[up] = self.setdefault(up, up)
            x = self[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _blocks(percent: int):
    """Connected parts (part, id) of what the bitmaps allow between the classes of a block pair of a tile.

    Input: (tile, i, j, side, id, n, class, bitmap, tiles) sorted by (tile, i, j). Sets of side 0 meet those of side 1, or
    each other where i = j. Two sets whose ``tiles`` have a smaller one in common meet there. A part is named by its sets and by their classes, so that tiles with the same part
    give the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set = set()
        for (tile, i, j), rows in _groups(batches, 3):
            left = [r[1:] for r in rows if r[0] == 0]
            right = left if i == j else [r[1:] for r in rows if r[0] == 1]
            if not left or not right:
                continue
            up, met = _Union(), {}
            earlier = lambda r: frozenset(t for t in r[4] if t < tile)
            known: dict = {}
            for k, at in _allowed(left, right, percent):
                mine = earlier(left[k])
                here = [r for r in at.tolist() if mine.isdisjoint(known.setdefault(r, earlier(right[r])))]
                if here:
                    met[left[k][0]] = left[k][2]
                for r in here:
                    met[right[r][0]] = right[r][2]
                    up.join(left[k][0], right[r][0])
            parts: dict = {}
            for x in met:
                parts.setdefault(up.root(x), []).append(x)
            names, ids = [], []
            for part in parts.values():
                name = int(  # noqa: E501
                    mix(
                        np.array(
                            [x for m in part for x in (m, met[m])], np.int64
                        ).view(np.uint64).reshape(-1, 2) @ np.array([1, _SALT], np.uint64)
                    ).sum(dtype=np.uint64).view(np.int64)
                )
                if name not in told:
                    told.add(name)
                    names += [name] * len(part)
                    ids += part
            if ids:
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(ids, pa.int64())], names=["part", "id"])

    return run


def _forest(percent: int):
    """Links (a, b) that join the classes of a part. Input: (part, id, class, shingles) sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            met = [(r[0], len(s), r[1], _signature(s)) for r, s in zip(rows, sets)]
            up, out = _Union(), []
            for k, at in _allowed(met, met, percent):
                for r in at.tolist():
                    if up.root(met[k][2]) != up.root(met[r][2]) and _alike(sets[k], sets[r], percent):
                        up.join(met[k][2], met[r][2])
                        out.append((met[k][0], met[r][0]))
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return run


class _Join:
    """The tables of one join."""

    def __init__(self, source: DataFrame, width: int, percent: int):
        """``source``: doc_id, row, text."""
        self.source, self.width, self.percent = source, width, percent
        spark = source.sparkSession
        self.salt = _SALT
        while True:
            self.profile = materialize(source.mapInArrow(_profile(width, self.salt), PROFILE), "profile")
            self.sets = self.profile.where("NOT hot").select("doc_id", "row", "id", "n", "check", "sig")
            same = F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("n").alias("n0"), F.max("n").alias("n")
            nodes = self.sets.where("n > 0").groupBy("id").agg(*same, F.max("sig").alias("sig"))
            self.nodes = materialize(nodes, "nodes")
            if self.nodes.where("lo <> hi OR n0 <> n").isEmpty():
                break
            # two sets under one name, once among billions: all get other names
            discard(self.profile, self.nodes)
            self.salt = mix(self.salt.reshape(1))[0]
        self.scratch = self.nodes
        self.nodes = self.nodes.select("id", "n", "sig")
        hot = self.profile.where("hot").groupBy("id").agg(
            F.sum("n").alias("n")
        ).where("n >= 8").orderBy(F.desc("n"), "id").limit(HOT)
        hot = hot.toPandas().sort_values("id", key=lambda c: c.to_numpy(np.int64).view(np.uint64))
        self.hot = spark.sparkContext.broadcast(
            (hot["id"].to_numpy(np.int64).view(np.uint64), hot["n"].to_numpy(np.int64))
        )
        self.arrays: list[DataFrame] = []
        self.links: list[DataFrame] = []

    def members(self) -> DataFrame:
        posted = self.source.mapInArrow(_postings(self.width, self.percent, self.hot, self.salt), "key long, id long, rank long")
        tiled = posted.repartition("key", F.shiftright("rank", PART)).sortWithinPartitions("key", "rank", "id")
        tiled = tiled.mapInArrow(_tiles(self.percent), "tile long, id long, lead long, size long").distinct()
        return materialize(tiled, "tiles")

    def known(self) -> DataFrame:
        out = self.arrays[0]
        for more in self.arrays[1:]:
            out = out.unionByName(more)
        return out

    def fetch(self, ids: DataFrame) -> None:
        """Get the arrays of ``ids`` that are not known yet."""
        if self.arrays:
            ids = ids.join(self.known().select("id"), "id", "left_anti")
        ids = materialize(ids, "wanted")
        if not ids.isEmpty():
            found = self.source.mapInArrow(_arrays(self.width, self.salt), "id long, shingles binary").join(ids, "id", "left_semi")
            self.arrays.append(materialize(found.dropDuplicates(["id"]), "arrays"))
        discard(ids)

    def allowed(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those that sizes and bitmaps allow."""
        side = lambda x: self.nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
        fits = F.expr(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
        return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_bound(self.percent), "a long, b long")

    def exact(self, pairs: DataFrame) -> DataFrame:
        """Of pairs whose arrays are known those that are alike."""
        side = lambda x: self.known().select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(
            _exact(self.percent), "a long, b long"
        )

    def classes(self) -> DataFrame:
        """(id, class) of each set with a link."""
        links = self.links[0]
        for more in self.links[1:]:
            links = links.unionByName(more)
        found = components(links, "a", "b")
        return materialize(found.select(F.col("node").alias("id"), F.col("component").alias("class")), "classes")

    def lead(self, members: DataFrame) -> None:
        """The first round: each set meets the least leader of its tiles and that of its smallest tile."""
        led = members.where("lead IS NOT NULL").groupBy("id")
        led = led.agg(F.min("lead").alias("least"), F.min(F.struct("size", "lead")).alias("near"))
        pairs = _pairs(led.select("id", F.explode(F.array("least", "near.lead")).alias("lead"))).distinct()
        allowed = materialize(self.allowed(pairs), "pairs")
        self.fetch(allowed.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        self.links.append(materialize(self.exact(allowed), "links") if self.arrays else allowed)
        self.tested = [allowed]

    def open(self, members: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
        """(tile, id, class, size, lead) of tiles of several classes; ``lead`` is of another class, or null."""
        there = members.select("tile", "id").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
        order = F.struct(F.xxhash64("id", F.lit(turn)).alias("o"), "id", "class")
        tiles = there.groupBy("tile").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("size"),
                                          F.min(order).alias("l1"), F.max(order).alias("l2")).where("lo <> hi")
        lead = F.when(F.col("class") != F.col("l1.class"), F.col("l1.id")).when(
            F.col("class") != F.col("l2.class"), F.col("l2.id")
        )
        return materialize(there.join(tiles, "tile").select("tile", "id", "class", "size", lead.alias("lead")), "open")

    def again(self, rest: DataFrame, turn: int) -> float:
        """One more round among sets whose arrays are known; the share of the sets with a pair, 0 if it is not worthwhile."""
        led = rest.where("lead IS NOT NULL").groupBy("id").agg(
            F.min_by("lead", F.xxhash64("lead", F.lit(turn))).alias("lead")
        )
        pairs = _pairs(led).distinct()
        for old in self.tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        for side in ("a", "b"):
            pairs = pairs.join(self.known().select(F.col("id").alias(side)), side, "left_semi")
        allowed = materialize(self.allowed(pairs), "pairs")
        share = allowed.count() / max(1, rest.select("id").distinct().count())
        if share < WORTH:
            discard(allowed)
            return 0.0
        self.tested.append(allowed)
        self.links.append(materialize(self.exact(allowed), "links"))
        return share

    def finish(self, rest: DataFrame) -> bool:
        """Compare the classes of the open tiles in full; whether there was anything to compare."""
        told = rest.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("tile")), 1, TOLD).alias("tiles"))
        rows = _chunks(rest.join(self.nodes, "id").join(told, "id"))
        rows = rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")
        parts = rows.select(
            "tile", "i", "j", "side", "id", "n", "class", "sig", "tiles"
        ).mapInArrow(_blocks(self.percent), "part long, id long")
        parts = materialize(parts.distinct().join(rest.select("id", "class").distinct(), "id"), "parts")
        found = not parts.isEmpty()
        if found:
            self.fetch(parts.select("id").distinct())
            rows = parts.join(self.known(), "id").repartition("part").sortWithinPartitions("part")
            forest = rows.select("part", "id", "class", "shingles").mapInArrow(_forest(self.percent), "a long, b long")
            self.links.append(materialize(forest.distinct(), "links"))
        discard(parts)
        return found


def _pairs(led: DataFrame) -> DataFrame:
    return led.where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows of open tiles once for each block pair (tile, i, j, side) in which they meet others.

    A tile's classes of at least half a block have blocks of their own, others share some; two blocks of one class do not
    meet, so a large class costs no more than its meetings with other ones.
    """
    rows = rows.withColumn("w", 1 + F.floor(F.col("n") / HEAVY))
    tiles = rows.groupBy("tile").agg(F.sum("w").alias("weight"))
    small = rows.join(tiles.where(F.col("weight") <= BLOCK).select("tile"), "tile", "left_semi")
    small = small.select(
        "tile",
        "id",
        "class",
        "n",
        "sig",
        "tiles",
        F.lit(0).cast("long").alias("i"),
        F.lit(0).cast("long").alias("j"),
        F.lit(0).alias("side"),
    )
    large = rows.join(tiles.where(F.col("weight") > BLOCK).select("tile"), "tile", "left_semi")
    shares = large.groupBy("tile", "class").agg(F.sum("w").alias("share"))
    mixed = shares.where(F.col("share") * 2 < BLOCK).groupBy("tile").agg(F.sum("share").alias("mixed"))
    dealt: Column = F.when(
        F.col("share") * 2 >= BLOCK, F.xxhash64("class", F.pmod(F.xxhash64("id"), F.ceil(F.col("share") / BLOCK)))
    )
    dealt = dealt.otherwise(F.pmod(F.xxhash64("class"), F.ceil(F.col("mixed") / BLOCK)))
    pure = F.when(F.col("share") * 2 >= BLOCK, F.col("class"))
    large = large.join(shares, ["tile", "class"]).join(mixed, "tile", "left").select(
        "tile", "id", "class", "n", "sig", "tiles", dealt.alias("at"), pure.alias("pure")
    )
    names = large.select("tile", "at", "pure").distinct()
    pairs = names.select("tile", F.col("at").alias("i"), F.col("pure").alias("p")).join(
        names.select("tile", F.col("at").alias("j"), F.col("pure").alias("q")), "tile"
    )
    pairs = pairs.where("(i < j OR (i = j AND p IS NULL)) AND NOT coalesce(p = q, false)").select("tile", "i", "j")
    sides = pairs.select("tile", F.col("i").alias("at"), "i", "j", F.lit(0).alias("side"))
    sides = sides.unionByName(
        pairs.where("i < j").select("tile", F.col("j").alias("at"), "i", "j", F.lit(1).alias("side"))
    )
    return small.unionByName(
        large.join(sides, ["tile", "at"]).select("tile", "id", "class", "n", "sig", "tiles", "i", "j", "side")
    )


def _linked(source: DataFrame, width: int, percent: int) -> tuple[_Join, DataFrame]:
    """The join's tables, and ``(id, class)`` of each set with a link."""
    join = _Join(source, width, percent)
    members = join.members()
    join.lead(members)
    classes = join.classes()
    rest = join.open(members, classes, 0)
    discard(members)  # a tile of one class stays one
    for turn in range(ROUNDS if join.arrays else 0):
        if rest.isEmpty() or not join.again(rest, turn):
            break
        discard(classes)
        classes, before = join.classes(), rest
        rest = join.open(before, classes, turn + 1)
        discard(before)
    if not rest.isEmpty() and join.finish(rest):
        discard(classes)
        classes = join.classes()
    discard(rest, *join.arrays, *join.links, *join.tested)
    return join, classes


def _source(docs: DataFrame, doc_id: str, text: str, row: Column) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), row.alias("row"), F.col(text).cast("string").alias("text")
    )


def jaccard_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Two texts link when 100 times their common shingles are at least ``percent`` times all of theirs. ``component_id`` is
    the smallest id that links reach. Words are runs of other than ASCII white space with A-Z lower-cased; a text of
    fewer than ``width`` words is one shingle, and a null, empty or blank text has none and links with nothing, not even
    its like. Long texts are read whole. Rows with equal ids are rows of their own, each linked by its own text; a null id
    links like others, and its row's ``component_id`` is the smallest id that is not null, or null if all are. Equal sets
    are one class. An empty table gives an empty one. Other columns of ``docs`` are not read.
    """
    join, classes = _linked(_source(docs, doc_id, text, F.lit(None).cast("long")), width, percent)
    least = join.sets.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"))
    of = least.join(classes, "id")
    reached = of.groupBy("class").agg(F.min("least").alias("reached"))
    own = least.join(classes.join(reached, "class").select("id", "reached"), "id", "left")
    own = materialize(own.select("id", F.coalesce("reached", "least").alias("component_id")), "own")
    discard(classes, join.scratch)
    rows = join.sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("id")).alias("id"))
    out = rows.join(own, "id", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """One row of each class of ``docs``: that with the smallest id.

    Ids that are not null go first. Of rows of a class with equal ids one stays, chosen by a hash of its values; of wholly
    equal rows one. Texts without words are in no class, so all such rows stay, with their repeats. All columns are kept,
    whatever their names.
    """
    values = [F.col(f"`{c}`") for c in docs.columns]
    tag = F.xxhash64(*values)
    join, classes = _linked(_source(docs, doc_id, text, tag), width, percent)
    rows = join.sets.where("n > 0").join(classes, "id", "left").select(
        "doc_id", "row", F.coalesce("class", "id").alias("class")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first")
    best = rows.groupBy("class").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "first")
    marked = rows.join(best, "class").groupBy("doc_id", "row").agg(
        F.max(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))).alias("stays"),
        F.count(F.lit(1)).alias("n"),
    )
    marked = materialize(marked, "marked")
    discard(classes, join.scratch, join.profile)
    whole = docs.select(F.struct(*values).alias("doc"), F.col(doc_id).cast("long").alias("_id"), tag.alias("_row"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_row") == F.col("row"))
    kept = whole.join(marked.where("NOT stays"), same, "left_anti")
    twice = marked.where("stays AND n > 1")
    if twice.isEmpty():
        return kept.select("doc.*")
    once = kept.join(twice, same, "left_semi").groupBy("_id", "_row").agg(F.first("doc").alias("doc"))
    return kept.join(twice, same, "left_anti").select("doc.*").unionByName(once.select("doc.*"))
