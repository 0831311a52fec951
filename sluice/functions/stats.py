"""Intervals and rates as column expressions; resampling as mergeable or grouped Arrow functions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the interval's z, the master seed and the number of replicates
Z, MASTER_SEED, REPLICATES = 1.96, 20260917, 10_000
#: Rows of a series that the exact resampling takes into one task; longer ones go to ``poisson_bootstrap`` and ``percentile_bootstrap``.
EXACT_ROWS = 100_000


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """``struct(lo, hi)`` of the score interval of k in n, within 0 and 1; (0, 0) for n <= 0; fails for k outside 0..n."""
    p, d = k / F.nullif(n, F.lit(0)), 1 + z * z / F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / d
    half = z * F.sqrt(
        p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * F.nullif(n, F.lit(0)))
    ) / d
    out = F.struct(F.greatest(F.lit(0.0), mid - half).alias("lo"), F.least(F.lit(1.0), mid + half).alias("hi"))
    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    return F.when(n <= 0, zero).when(
        (k < 0) | (k > n), F.raise_error(F.lit("k is outside 0..n")).cast("struct<lo:double,hi:double>")
    ).otherwise(out)


def newcombe(k_a: Column, n_a: Column, k_b: Column, n_b: Column, z: float = Z) -> Column:
    """``struct(diff, lo, hi)`` of p_b - p_a by the hybrid score method."""
    p, q, a, b = ratio(k_a, n_a), ratio(k_b, n_b), wilson(k_a, n_a, z), wilson(k_b, n_b, z)
    down = F.sqrt(F.pow(q - b["lo"], 2) + F.pow(a["hi"] - p, 2))
    up = F.sqrt(F.pow(b["hi"] - q, 2) + F.pow(p - a["lo"], 2))
    return F.struct((q - p).alias("diff"), (q - p - down).alias("lo"), (q - p + up).alias("hi"))


#: Powers of two that a decimal holds.
_TWOS = 126


def py_round(x: Column, digits: int) -> Column:
    """``x`` (a double) rounded to ``digits`` (0 to 9) places, half to even on its binary value, as Python's ``round`` does.

    A double is m / 2^k with whole m, so m * 5^digits and 2^(k - digits) say exactly which side of a half it is on.
    """
    whole = "decimal(38,0)"
    size = F.abs(x)
    k = F.lit(53) - F.floor(F.log2(size)).cast("int")  # large enough for a whole m, whatever the logarithm's last bit
    m = (size * F.pow(F.lit(2.0), k)).cast("long").cast("decimal(19,0)") * F.lit(Decimal(5**digits)).cast("decimal(8,0)" if digits < 10 else whole)
    s = k - digits
    two = F.element_at(F.array(*(F.lit(Decimal(1 << i)).cast(whole) for i in range(_TWOS + 1))), F.least(s, F.lit(_TWOS)) + 1)
    m = m.cast(whole)
    rest = m % two
    floor = ((m - rest) / two).cast(whole)
    half = two - rest  # below, at or above the rest
    up = (rest > half) | ((rest == half) & (floor % 2 == 1))
    near = (floor + F.when(up, 1).otherwise(0)).cast("double") / 10.0**digits
    signed = F.when(x < 0, -near).otherwise(near)
    # no number, or so large that the places are finer than its own; too small for a half; whole at this scale already
    return F.when(x.isNull() | F.isnan(x) | (size == 0) | (size >= 2.0**53 / 10**digits), x).when(
        size < 10.0 ** -(digits + 1), x * 0.0
    ).when(s <= 0, x).otherwise(signed)


def separated(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)


def derive_seed(*parts: Column | str | int, master: int = MASTER_SEED) -> Column:
    """A 32-bit seed from the first 8 hex digits of SHA-256 over the parts joined by ``|``."""
    cols = [F.lit(str(master)), *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 8), 16, 10).cast("long")


def hash_rank_key(seed: int, *key: Column) -> Column:
    """A random order that any engine can repeat: SHA-256 of the seed and the key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)), 256)


def _draws(n: int, seed: int, replicates: int) -> Iterator[np.ndarray]:
    """Rows of the replicates' index matrix, a few at a time; the stream is that of one call."""
    rng, rows = np.random.default_rng(seed), max(1, 4_000_000 // max(1, n))
    for at in range(0, replicates, rows):
        yield rng.integers(0, n, size=(min(rows, replicates - at), n))


def resample(values: np.ndarray, seed: int, stat, replicates: int = REPLICATES) -> tuple[np.ndarray, str]:
    """``stat`` of each replicate (rows of one or more columns), and the first 16 hex digits of the index matrix's SHA-256."""
    if not len(values):
        return np.zeros((0, 1)), ""
    mark, out = hashlib.sha256(), []
    for idx in _draws(len(values), seed, replicates):
        mark.update(np.ascontiguousarray(idx, dtype="<i8").tobytes())
        out.append(np.atleast_2d(stat(values[idx]).T).T)
    return np.concatenate(out), mark.hexdigest()[:16]


STATS = {
    "mean": lambda x: x.mean(axis=1),
    "sum": lambda x: x.sum(axis=1),
    "percentiles": lambda x: np.percentile(x, [50, 95, 99], axis=1).T,
    "p99": lambda x: np.percentile(x, 99, axis=1),
}
_NAMES = {"percentiles": ("p50", "p95", "p99")}
CI = "quantity string, lo double, hi double, idx_sha string, n long"


def bootstrap_ci(
    series: DataFrame,
    keys: list[str],
    value: str,
    order: str,
    seed: str,
    stat: str = "mean",
    replicates: int = REPLICATES,
) -> DataFrame:
    """Percentile bootstrap of each group's series, in ``order``; ``seed`` is a long column.

    The series of a group are those of one run and are resampled whole, so a group of more than
    ``EXACT_ROWS`` rows fails; ``poisson_bootstrap`` takes series of any length. ``stat`` is one of ``STATS``.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > EXACT_ROWS:
            raise ValueError(f"{len(rows)} rows in one series; use poisson_bootstrap")
        rows = rows.sort_values("_order")
        found, sha = resample(rows["_value"].to_numpy(float), int(rows["_seed"].iloc[0]), STATS[stat], replicates)
        return pd.DataFrame([(*key, name, *np.percentile(found[:, i], [2.5, 97.5]), sha, len(rows)) for i, name in enumerate(_NAMES.get(stat, (stat,)))])

    narrow = series.select(
        *keys, F.col(value).cast("double").alias("_value"), F.col(order).alias("_order"), F.col(seed).alias("_seed")
    ).where("_value IS NOT NULL")
    schema = ", ".join([*(f"`{k}` {dict(series.dtypes)[k]}" for k in keys), CI])
    return narrow.groupBy(*keys).applyInPandas(run, schema)


def paired_bootstrap(
    pairs: DataFrame,
    keys: list[str],
    a: str,
    b: str,
    order: str,
    seed: str,
    stat: str = "mean",
    replicates: int = REPLICATES,
) -> DataFrame:
    """``(diff, lo, hi, idx_sha, n, separated)`` of stat(a) - stat(b), both resampled by the same rows."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > EXACT_ROWS:
            raise ValueError(f"{len(rows)} pairs in one comparison; use poisson_bootstrap on their differences")
        rows = rows.sort_values("_order")
        both = rows[["_a", "_b"]].to_numpy(float)
        of = STATS[stat]
        found, sha = resample(both, int(rows["_seed"].iloc[0]), lambda x: of(x[:, :, 0]) - of(x[:, :, 1]), replicates)
        diff = float(of(both[None, :, 0])[0] - of(both[None, :, 1])[0])
        lo, hi = np.percentile(found[:, 0], [2.5, 97.5])
        return pd.DataFrame([(*key, diff, lo, hi, sha, len(rows), bool(lo > 0 or hi < 0))])

    narrow = pairs.select(
        *keys,
        F.col(a).cast("double").alias("_a"),
        F.col(b).cast("double").alias("_b"),
        F.col(order).alias("_order"),
        F.col(seed).alias("_seed"),
    ).where("_a IS NOT NULL AND _b IS NOT NULL")
    schema = ", ".join(
        [
            *(f"`{k}` {dict(pairs.dtypes)[k]}" for k in keys),
            "diff double, lo double, hi double, idx_sha string, n long, separated boolean",
        ]
    )
    return narrow.groupBy(*keys).applyInPandas(run, schema)


# fixed values: how many of 2**32 hash values draw at most 0, 1, .. 9 of a Poisson(1)
_UP_TO = [int(sum(np.exp(-1.0) / math.factorial(i) for i in range(k + 1)) * (1 << 32)) for k in range(10)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_bootstrap(
    series: DataFrame, keys: list[str], value: str, row_id: str, replicates: int = 1000, seed: int = MASTER_SEED
) -> DataFrame:
    """``(mean, lo, hi, n)`` of each group's mean, for series of any length.

    Every row counts Poisson(1) times in each replicate, by a hash of its id and the replicate, so that sums of
    replicates are added up in each task and then merged; no series comes together anywhere.
    """
    step = max(1, 2_000_000 // replicates)
    salt = _mixed(np.arange(replicates, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            *named, x, row = batch.columns
            names = list(zip(*(c.to_pylist() for c in named)))
            x, row = x.to_numpy(), row.to_numpy().view(np.uint64)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(names):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                sums = held.setdefault(key, np.zeros((2, replicates)))
                for first in range(0, len(at), step):
                    some = at[first : first + step]
                    h = (_mixed(row[some][:, None] + salt) >> np.uint64(32)).astype(np.uint32)
                    w = np.zeros(h.shape, np.uint8)
                    for t in _UP_TO:
                        w += h >= np.uint32(t)
                    sums[0] += x[some] @ w
                    sums[1] += w.sum(axis=0, dtype=np.int64)
        keyed = list(zip(*held)) if held else [()] * len(keys)
        arrays = [pa.array(k, t.type) for k, t in zip(keyed, batch.schema)] if held else []
        if held:
            yield pa.record_batch(
                [
                    *arrays,
                    pa.array([v[0].tolist() for v in held.values()]),
                    pa.array([v[1].tolist() for v in held.values()])
                ],
                names=[*keys, "s", "w"],
            )

    narrow = series.select(
        *keys, F.col(value).cast("double").alias("_value"), F.xxhash64(row_id, F.lit(seed)).alias("_row")
    ).where("_value IS NOT NULL")
    schema = ", ".join([*(f"`{k}` {dict(series.dtypes)[k]}" for k in keys), "s array<double>, w array<double>"])
    # the draws cost far more than the rows' way to other tasks
    dealt = narrow.repartition(series.sparkSession.sparkContext.defaultParallelism, "_row")
    sums = dealt.mapInArrow(run, schema).select(
        *keys, F.posexplode(F.arrays_zip("s", "w")).alias("rep", "x")
    ).groupBy(*keys, "rep").agg((F.sum("x.s") / F.nullif(F.sum("x.w"), F.lit(0.0))).alias("m"))
    ci = sums.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    means = narrow.groupBy(*keys).agg(F.avg("_value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.join(ci, keys).select(
        *keys, "mean", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), "n"
    )


#: Values that one task ranks, and cuts of a group's range in each pass before.
RANKED, CUTS = 65_536, 4096


def exact_percentiles(rows: DataFrame, by: list[str], value: str, levels: tuple[float, ...]) -> DataFrame:
    """``(by, p)``: exact, interpolated percentiles of each group, in the order of ``levels``; groups without values give no row.

    A group of few values is ranked as it is. For a larger one the range that holds each rank is cut into ``CUTS`` parts, values are
    counted by part, and the part with the rank is the next range, until it holds few distinct values or one only. Counts are
    pre-aggregated; no task holds a group's values. NaN is above all numbers.
    """
    from ..sources.tables import cut_lineage

    spark = rows.sparkSession
    narrow = rows.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col(value).cast("double").alias("_v")
    ).where("_v IS NOT NULL")
    keys = [f"_k{i}" for i in range(len(by))]
    types = [dict(rows.dtypes)[k] for k in by]
    same = lambda other: [F.col(f"c.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]
    counts = cut_lineage(narrow.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))  # a row for each distinct value
    whole = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    # the ranks on both sides of each level
    rank = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("_n") - 1) * level).alias("at")) for i, level in enumerate(levels))))
    wanted = whole.select("*", rank.alias("r")).select(*keys, "_d", "lo", "hi", "r.i", F.col("r.at").alias("at"), F.explode(F.array(F.floor("r.at"), F.ceil("r.at"))).alias("rank"))
    open_ = cut_lineage(wanted.distinct().withColumn("below", F.lit(0).cast("long")))
    done = []
    while True:
        few = open_.where(f"_d <= {RANKED}")
        if not few.isEmpty():
            # the values of a range once for each place in it, as ranges are few and small
            inside = counts.alias("c").join(few.select(*keys, "lo", "hi").distinct().alias("f"), same("f") or F.lit(True)).where("_v >= lo AND _v <= hi")
            upto = F.sum("_c").over(Window.partitionBy(*[f"c.{k}" for k in keys], "lo", "hi").orderBy("_v"))
            inside = inside.select(*(F.col(f"c.{k}").alias(k) for k in keys), "lo", "hi", "_v", "_c", upto.alias("_upto"))
            met = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "lo", "hi")]
            here = few.alias("a").join(inside.alias("b"), met).where("rank < below + _upto AND rank >= below + _upto - _c")
            done.append(cut_lineage(here.select(*(F.col(f"a.{k}").alias(k) for k in keys), "i", "at", "rank", F.col("_v"))))
        large = open_.where(f"_d > {RANKED}")
        if large.isEmpty():
            break
        ends = lambda c: F.least(F.greatest(F.col(c), F.lit(-1.7e308)), F.lit(1.7e308)) / CUTS  # noqa: E731  finite, and no overflow
        spread = (ends("_v") - ends("lo")) / F.nullif(ends("hi") - ends("lo"), F.lit(0.0))
        part = F.least(F.floor(F.coalesce(spread, F.lit(0.0)) * CUTS), F.lit(CUTS - 1))
        ranges = large.select(*keys, "lo", "hi").distinct()
        held = counts.alias("c").join(F.broadcast(ranges).alias("f"), same("f") or F.lit(True)).where("_v >= lo AND _v <= hi")  # a few rows for each group
        cut = held.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys], "lo", "hi", part.alias("part")).agg(
            F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d2"), F.min("_v").alias("lo2"), F.max("_v").alias("hi2")
        )
        before = F.sum("_n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("part"))
        cut = cut.withColumn("_upto", before)
        met = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "lo", "hi")]
        next_ = large.alias("a").join(cut.alias("b"), met).where("rank < below + _upto AND rank >= below + _upto - _n")
        open_ = cut_lineage(next_.select(
            *(F.col(f"a.{k}").alias(k) for k in keys), F.col("_d2").alias("_d"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "i", "at", "rank",
            (F.col("below") + F.col("_upto") - F.col("_n")).alias("below"),
        ))
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(keys, types)), "i int, at double, rank long, _v double"])
    found = spark.createDataFrame([], schema)
    for part in done:
        found = found.unionByName(part)
    x = F.min("_v") + (F.max("_v") - F.min("_v")) * (F.col("at") - F.floor("at"))
    each = found.groupBy(*keys, "i", "at").agg(F.when(F.min("_v") == F.max("_v"), F.min("_v")).otherwise(x).alias("x"))
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return listed.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(by)), F.transform("p", lambda e: e["x"]).alias("p"))


def hash_bootstrap(
    series: DataFrame, keys: list[str], value: str, row_id: str, replicates: int = 200, seed: int = MASTER_SEED
) -> DataFrame:
    """``(mean, lo, hi, n)`` of each group's mean by Poisson weights that are hashes, so that any engine can repeat them.

    A row counts as often as the first 32 bits of ``md5(seed|replicate|row)`` say. SQL functions only; sums are
    pre-aggregated in each task. Replicates are fewer than elsewhere, as each costs a hash a row.
    """
    rows = series.select(
        *keys, F.col(value).cast("double").alias("_x"), F.col(row_id).cast("string").alias("_row")
    ).where("_x IS NOT NULL")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
    h = F.conv(
        F.substring(
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_rep").cast("string"), "_row").cast("binary")), 1, 8
        ),
        16,
        10,
    ).cast("long")
    w = sum((F.when(h >= F.lit(t), 1).otherwise(0) for t in _UP_TO), F.lit(0))
    sums = each.withColumn("_w", w).groupBy(*keys, "_rep").agg(
        (F.sum(F.col("_x") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0))).alias("m")
    )
    ci = sums.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    means = rows.groupBy(*keys).agg(F.avg("_x").alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.join(ci, keys).select(
        *keys, "mean", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), "n"
    )


#: Levels are looked up in quantiles this fine; replicates are drawn this many at a time.
STEPS, BLOCK = 2000, 500


def _classes(series: DataFrame, keys: list[str], levels: list[float], sides: int) -> DataFrame:
    """Counts of the values ``_v0, _v1..`` that a replicate's percentiles may fall on, all others between them as one class.

    Around each level lie the values that 8 standard deviations and 40 rows reach (``_in``: one class for each value);
    the rest of a series is cut to the intervals in between, each named by the window's end below it.
    """
    quantiles = [
        F.percentile_approx(
            f"_v{i}", [k / STEPS for k in range(STEPS + 1)], 10_000
        ).alias(f"_q{i}") for i in range(sides)
    ]
    marks = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *quantiles)
    ends = []
    for i in range(sides):
        for k, p in enumerate(levels):
            margin = 8 * F.sqrt(p * (1 - p) / F.col("_n")) + 40 / F.col("_n") + 2e-4
            low, high = F.floor((p - margin) * STEPS).cast("int"), F.ceil((p + margin) * STEPS).cast("int")
            ends += [
                F.when(low <= 0, float("-inf")).otherwise(F.get(f"_q{i}", low)).alias(f"_lo{i}{k}"),
                F.when(high >= STEPS, float("inf")).otherwise(F.get(f"_q{i}", high)).alias(f"_hi{i}{k}"),
            ]
    windows = marks.select(*(F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)), *ends)
    same = [F.col(k).eqNullSafe(F.col(f"_key{j}")) for j, k in enumerate(keys)]
    rows, named = series.join(F.broadcast(windows), same), []
    for i in range(sides):
        v, inside, below = F.col(f"_v{i}"), F.lit(False), [F.lit(float("-inf"))]
        for k in range(len(levels)):
            inside = inside | v.between(F.col(f"_lo{i}{k}"), F.col(f"_hi{i}{k}"))
            below.append(F.when(F.col(f"_hi{i}{k}") < v, F.col(f"_hi{i}{k}")))
        named += [
            F.when(inside, v).otherwise(F.greatest(*below) if len(below) > 1 else below[0]).alias(f"_at{i}"),
            inside.alias(f"_in{i}"),
        ]
    rows = rows.select(*keys, "_seed", *named)
    return rows.groupBy(
        *keys, *[f"{c}{i}" for i in range(sides) for c in ("_at", "_in")]
    ).agg(F.count(F.lit(1)).alias("_c"), F.min("_seed").alias("_seed"))


def _replicates(series: DataFrame, keys: list[str], levels: list[float], sides: int, replicates: int) -> DataFrame:
    """``(side, level, rep, x)``: the percentiles of each replicate, both sides resampled by the same rows."""
    blocks = -(-replicates // BLOCK)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([f"{c}{i}" for i in range(sides) for c in ("_at", "_in")])
        counts, block = rows["_c"].to_numpy(np.int64), int(key[-1])
        n, size = int(counts.sum()), min(BLOCK, replicates - block * BLOCK)
        rng, out = np.random.default_rng([int(rows["_seed"].iloc[0]), block]), []
        sorted_sides = []
        for i in range(sides):
            at, inside = rows[f"_at{i}"].to_numpy(float), rows[f"_in{i}"].to_numpy(bool)
            order = np.lexsort((~inside, at))
            sorted_sides.append((order, at[order], inside[order]))
        step = max(1, 2_000_000 // len(counts))
        for first in range(0, size, step):
            w = rng.multinomial(n, counts / n, size=min(step, size - first))
            reps = block * BLOCK + first + np.arange(len(w))
            for side, (order, at, inside) in enumerate(sorted_sides):
                upto = w[:, order].cumsum(axis=1)
                for level, p in enumerate(levels):
                    h = (n - 1) * p
                    low = int(h)
                    a, b = ((upto > r).argmax(axis=1) for r in (low, min(low + 1, n - 1)))
                    if not (inside[a].all() and inside[b].all()):
                        raise ValueError("a replicate's percentile lies outside the values that were kept")
                    out.append(
                        pd.DataFrame(
                            {"side": side, "level": level, "rep": reps, "x": at[a] + (at[b] - at[a]) * (h - low)}
                        )
                    )
        drawn = pd.concat(out)
        for j, k in enumerate(keys):
            drawn.insert(j, k, key[j])
        return drawn

    types = dict(series.dtypes)
    spread = _classes(series, keys, levels, sides).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    return spread.groupBy(*keys, "_block").applyInPandas(
        run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "side int, level int, rep int, x double"])
    )


def percentile_bootstrap(
    series: DataFrame,
    keys: list[str],
    value: str,
    seed: str,
    levels: tuple[int, ...] = (50, 95, 99),
    replicates: int = REPLICATES,
) -> DataFrame:
    """``(quantity, lo, hi, n)`` of each group's percentiles, for series of any length.

    How often the values are drawn is multinomial, as in resampling the rows. Only the values near a level get a
    count of their own (see ``_classes``), so no series comes together anywhere; a replicate that fell outside would fail.
    """
    narrow = series.select(
        *keys, F.col(value).cast("double").alias("_v0"), F.col(seed).alias("_seed")
    ).where("_v0 IS NOT NULL")
    drawn = _replicates(narrow, keys, [p / 100 for p in levels], 1, replicates)
    ci = drawn.groupBy(*keys, "level").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    ns = narrow.groupBy(*(F.col(k).alias(f"_key{j}") for j, k in enumerate(keys))).agg(F.count(F.lit(1)).alias("n"))
    named = F.get(F.array(*[F.lit(f"p{p}") for p in levels]), F.col("level"))
    return ci.join(F.broadcast(ns), [F.col(k).eqNullSafe(F.col(f"_key{j}")) for j, k in enumerate(keys)]).select(
        *keys, named.alias("quantity"), F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), "n"
    )


def paired_percentile_bootstrap(
    pairs: DataFrame, keys: list[str], a: str, b: str, seed: str, level: int = 99, replicates: int = REPLICATES
) -> DataFrame:
    """``(diff, lo, hi, n, separated)`` of percentile(a) - percentile(b), both resampled by the same rows, for any number of pairs."""
    narrow = pairs.select(
        *keys, F.col(a).cast("double").alias("_v0"), F.col(b).cast("double").alias("_v1"), F.col(seed).alias("_seed")
    ).where("_v0 IS NOT NULL AND _v1 IS NOT NULL")
    drawn = _replicates(narrow, keys, [level / 100], 2, replicates)
    of = drawn.groupBy(*keys, "rep").agg(
        F.sum(F.when(F.col("side") == 0, F.col("x")).otherwise(-F.col("x"))).alias("x")
    )
    ci = of.groupBy(*keys).agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    named = [F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)]
    sides = [exact_percentiles(narrow, keys, f"_v{i}", (level / 100,)).select(*named, F.get("p", F.lit(0)).alias(f"_p{i}")) for i in (0, 1)]
    both = [F.col(f"s0._key{j}").eqNullSafe(F.col(f"s1._key{j}")) for j in range(len(keys))]
    tails = sides[0].alias("s0").join(sides[1].alias("s1"), both).select("s0.*", (F.col("_p0") - F.col("_p1")).alias("diff"))
    ns = narrow.groupBy(*named).agg(F.count(F.lit(1)).alias("n"))
    both = [F.col(f"t._key{j}").eqNullSafe(F.col(f"u._key{j}")) for j in range(len(keys))]
    whole = tails.alias("t").join(ns.alias("u"), both).select("t.*", "n")
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return ci.join(F.broadcast(whole), [F.col(k).eqNullSafe(F.col(f"_key{j}")) for j, k in enumerate(keys)]).select(
        *keys, "diff", lo.alias("lo"), hi.alias("hi"), "n", separated(lo, hi).alias("separated")
    )
