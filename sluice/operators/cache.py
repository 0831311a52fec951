"""Cache decisions: exact replay, growing-prefix similarity, and the live cache that stores misses only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_percentiles
from ..functions.text import has_error, is_blank
from ..sources.tables import apart, cut_lineage
from .nearest import _ints, _matrix, all_best_earlier, best_earlier, listed, place

#: Open rows that one task decides in order.
FINISH = 4096


def key_digest(rows: DataFrame, key: str) -> Column:
    """What stands for a key in shuffles and states: SHA-256 of a text, as keys may be whole texts; other keys themselves. Null stays null."""
    return F.sha2(F.col(key), 256) if dict(rows.dtypes)[key] == "string" else F.col(key)


def seen_earlier(rows: DataFrame, key: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``first_idx`` and ``seen``: whether ``key`` occurs before, in ``order``, within ``by``. Orders are unique within ``by``.

    The first of each key is a pre-aggregated minimum, joined back, so that a key with
    a third of all rows is split by the skew join and never sorted in one task.
    """
    digest = key_digest(rows, key)
    first = rows.groupBy(*by, digest.alias("_key")).agg(F.min(order).alias("first_idx"))
    rows = rows.withColumn("_digest", digest)
    on = [F.col(f"r.{b}").eqNullSafe(F.col(f"f.{b}")) for b in by] + [F.col("r._digest") == F.col("f._key")]
    return rows.alias("r").join(first.alias("f"), on, "left").select(
        "r.*", "f.first_idx", F.coalesce(F.col(f"r.{order}") > F.col("f.first_idx"), F.lit(False)).alias("seen")
    ).drop("_digest")


def exact_replay(
    outcomes: DataFrame, key: str = "norm_key", order: str = "idx", by: tuple[str, ...] = ("frac",)
) -> DataFrame:
    """Baseline rows as an exact cache would answer them: ``is_hit, hit_source_idx, replay_cost, replay_tokens_in, replay_tokens_out``.

    Only successful rows with an answer take part. The first of a key is a miss with its own cost, later ones cost nothing.
    """
    good = outcomes.where(~has_error(F.col("error")) & ~is_blank(F.col("answer_text")))
    marked = seen_earlier(good, key, order, by)
    free = lambda c: F.when(F.col("seen"), F.lit(0)).otherwise(F.col(c))
    return marked.withColumnsRenamed({"seen": "is_hit"}).withColumn("seen", F.col("is_hit")).select(
        *outcomes.columns,
        "is_hit",
        F.when(F.col("seen"), F.col("first_idx")).alias("hit_source_idx"),
        free("cost_usd").alias("replay_cost"),
        free("tokens_in").alias("replay_tokens_in"),
        free("tokens_out").alias("replay_tokens_out"),
    )


def replay_summary(replay: DataFrame, outcomes: DataFrame, by: str = "frac") -> DataFrame:
    """One row for each ``by``: hits, cost and latency of the replay; a hit takes the median latency of measured exact hits."""
    hits = outcomes.where(F.col("kind") == "cache_exact").where(~has_error(F.col("error")))
    measured = exact_percentiles(hits, [by], "latency_ms", (0.5,)).select(by, F.get("p", F.lit(0)).alias("hit_ms"))
    rows = replay.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_hit").alias("n_hits"),
        F.sum("replay_cost").alias("cost_usd"),
        F.sum("replay_tokens_in").alias("tokens_in"),
        F.sum("replay_tokens_out").alias("tokens_out"),
        F.sum(F.when(~F.col("is_hit"), F.col("latency_ms"))).alias("_miss_ms"),
    )
    mean = (F.coalesce("_miss_ms", F.lit(0.0)) + F.col("n_hits") * F.coalesce("hit_ms", F.lit(0.0))) / F.col("n_rows")
    return rows.join(measured, by, "left").select(
        by,
        "n_rows",
        "n_hits",
        (F.col("n_hits") / F.col("n_rows")).alias("hit_rate"),
        "cost_usd",
        "tokens_in",
        "tokens_out",
        "hit_ms",
        mean.alias("mean_ms"),
    )


def prefix_best(
    vectors: DataFrame, order: str = "idx", vec: str = "vec", by: str | None = None, block: int | None = None, least: float | None = None
) -> DataFrame:
    """``(by, idx, best, best_src)``: the largest similarity to any earlier row, the earliest on ties; 0 and null for the first row.

    All earlier rows count, hits and ineligible ones too. Negative best similarities stay as they are. A row with a null
    vector is like a first row, and none is similar to it. The search is exact (``nearest``). A row to which none has a
    similarity of ``least`` is told as a first row, if that is given; then fewer rows are compared.
    """
    top = all_best_earlier(listed(vectors, order, vec, by, block), least)[0]
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    all_rows = vectors.select(group.alias("_by"), F.col(order).cast("long").alias("idx"))
    out = all_rows.join(apart(top), ["_by", "idx"], "left").select(
        "_by", "idx", F.coalesce("s", F.lit(0.0)).alias("best"), F.col("src").alias("best_src")
    )
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")


def _leaders(threshold: float):
    """Of a block's open rows those that no earlier leader of the block is similar to."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(_ints(table.column("idx")))
        x, keep = _matrix(table.column("vec"))[order], table.column("keep").to_numpy()[order]
        left, out = np.arange(len(order)), []
        while len(left):
            out.append(left[0])
            near = keep[left[0]] & (x[left[1:]] @ x[left[0]] >= threshold)
            left = left[1:][~near]
        return table.select(["idx"]).take(pa.array(order[out]))

    return run


def _in_order(threshold: float):
    """``(idx, status, s, src)`` of a bounded number of rows, decided one after the other: 1 stored, 2 similar, 3 neither, 4 exact."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(_ints(table.column("idx")))
        table = table.take(pa.array(order))
        idx, key, keep, old = (table.column(c).to_pylist() for c in ("idx", "k", "keep", "old"))
        there = np.flatnonzero(table.column("vec").is_valid().to_numpy())
        x = _matrix(table.column("vec").take(pa.array(there)))
        row = dict(zip(there.tolist(), range(len(there))))
        owner: dict = {}
        held, n = np.empty(len(there), np.int64), 0  # the places in x of stored rows
        out: list[tuple] = []
        for i in range(len(idx)):
            found = None
            if not old[i]:
                if key[i] is not None and key[i] in owner:
                    found = (4, 1.0, owner[key[i]])
                elif i in row and n:
                    s = x[held[:n]] @ x[row[i]]
                    best = int(np.argmax(s))  # the earliest of equal ones
                    found = (2, float(s[best]), idx[there[held[best]]]) if s[best] >= threshold else None
            if found is None:
                found = (1 if keep[i] else 3, None, None)
                if keep[i]:
                    owner.setdefault(key[i], idx[i])
                    if i in row:
                        held[n] = row[i]
                        n += 1
            out.append(found)
        return pa.table({"idx": pa.array(idx, pa.int64()), "status": pa.array([o[0] for o in out], pa.int32()),
                         "s": pa.array([o[1] for o in out], pa.float64()), "src": pa.array([o[2] for o in out], pa.int64())})

    return run


_DECIDED = "idx long, status int, s double, src long"


def greedy_cache(
    requests: DataFrame,
    threshold: float,
    order: str = "idx",
    vec: str = "vec",
    key: str | None = None,
    storable: str | None = None,
    stored: str | None = None,
    block: int | None = None,
    ask: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """``(idx, kind, similarity, hit_source_idx)`` of the live cache: a request is compared with stored misses only.

    An exact key goes before similarity; a miss is stored if ``storable``. Rows for which the column ``stored`` is true are in
    the cache from the start and get no row. A row with a null vector is answered by its key only.

    Each round elects rows that are decided misses: leaders of their blocks, to which no earlier open row anywhere is similar,
    and of whose key none is open. They then answer all later rows at once, so a group of m near copies
    costs m rows, never a pair of each two. The last ``FINISH`` open rows, a bounded number, are decided in order by one task,
    as are tables of no more rows; the outcome is the same. Each round is checkpointed; the most similar stored row of
    each hit is sought at the end. Rows never pass through the driver: no table of them is broadcast.

    ``ask(misses, round)`` answers the decided misses (``idx``) of a round and tells ``(idx, keep)``, whether each can be stored;
    then all rows are decided in rounds, and only misses are asked for.
    """
    name = key_digest(requests, key).cast("string") if key else F.col(order).cast("string")
    keep = F.coalesce(F.col(storable), F.lit(False)) if storable else F.lit(True)
    was = F.coalesce(F.col(stored), F.lit(False)) if stored else F.lit(False)
    few = requests.select(
        F.col(order).cast("long").alias("idx"), name.alias("k"), F.col(vec).cast("array<float>").alias("vec"), (keep | was).alias("keep"),
        was.alias("old"), F.lit(0).alias("all"),
    )
    if ask is None and few.limit(FINISH + 1).count() <= FINISH:
        told = few.groupBy("all").applyInArrow(_in_order(threshold), _DECIDED).join(few.where("old").select("idx"), "idx", "left_anti")
        kind = F.when(F.col("status") == 4, "cache_exact").when(F.col("status") == 2, "cache_semantic").otherwise("miss")
        return told.select("idx", kind.alias("kind"), F.col("s").alias("similarity"), F.col("src").alias("hit_source_idx"))
    places = place(requests, order, vec, block=block)
    state = cut_lineage(requests.select(
        F.col(order).cast("long").alias("idx"), name.alias("k"), (keep | was).alias("keep"), F.when(was, 1).otherwise(0).alias("status")
    ))
    floor = F.lit(threshold).alias("floor")
    among = lambda rows, of: rows.join(apart(of.select("idx")), "idx", "left_semi").withColumn("floor", floor)

    def answered(state: DataFrame, fresh: DataFrame) -> DataFrame:
        """Open rows become hits where one of ``fresh`` is earlier and similar, or stored under their key."""
        open_ = state.where("status = 0")
        near = best_earlier(among(places.rows, open_), among(places.rows, fresh), places)[0] if places.blocks else places.rows
        near = near.select("idx", F.lit(True).alias("near"))
        owners = fresh.groupBy("k").agg(F.min("idx").alias("owner"))
        seen = state.join(apart(near), "idx", "left").join(apart(owners), "k", "left")
        hit = (F.col("status") == 0) & (F.coalesce("near", F.lit(False)) | F.coalesce(F.col("owner") < F.col("idx"), F.lit(False)))
        return cut_lineage(seen.select("idx", "k", "keep", F.when(hit, 2).otherwise(F.col("status")).alias("status")))

    if stored:
        state = answered(state, state.where("status = 1"))
    turn = 0
    while (left := state.where("status = 0").count()) > (0 if ask else FINISH) and (places.blocks or ask):
        open_ = state.where("status = 0")
        first = open_.select("idx")
        if places.blocks:
            rows = places.rows.join(apart(open_.select("idx", "keep")), "idx")
            leaders = cut_lineage(rows.groupBy("block").applyInArrow(_leaders(threshold), "idx long"))
            barred = best_earlier(among(places.rows, leaders), among(places.rows, open_.where("keep")), places)[0].select("idx")
            bare = first.join(apart(places.rows.select("idx")), "idx", "left_anti")  # rows without a vector
            first = leaders.join(apart(barred), "idx", "left_anti").unionByName(bare)
        next_ = open_.where("keep").groupBy("k").agg(F.min("idx").alias("next"))
        sure = first.join(apart(open_), "idx").join(apart(next_), "k", "left").where("next IS NULL OR next >= idx").select("idx", "k", "keep")
        if ask:
            told = ask(cut_lineage(sure.select("idx")), turn).select("idx", F.col("keep").alias("good"))
            sure = sure.join(apart(told), "idx").select("idx", "k", (F.col("keep") & F.col("good")).alias("keep"))
        sure, turn = cut_lineage(sure), turn + 1
        mine = sure.select("idx", F.when(F.col("keep"), 1).otherwise(3).alias("mine"))
        state = state.join(apart(mine), "idx", "left").withColumn("status", F.coalesce("mine", "status")).drop("mine")
        state = answered(state, sure.where("keep"))
    if left:
        rest = state.where("status = 0").join(apart(places.rows.select("idx", "vec")), "idx", "left").withColumns({"all": F.lit(0), "old": F.lit(False)})
        # FINISH rows at most, or a table without vectors
        done = rest.groupBy("all").applyInArrow(_in_order(threshold), _DECIDED).select(
            "idx", F.when(F.col("status") == 4, 2).otherwise(F.col("status")).alias("status")
        ) if places.blocks else _by_key(rest)
        state = state.join(apart(done.withColumnRenamed("status", "now")), "idx", "left").withColumn("status", F.coalesce("now", "status")).drop("now")
        state = cut_lineage(state)
    kept = state.where("status = 1")
    owners = kept.groupBy("k").agg(F.min("idx").alias("owner"))
    out = state.join(apart(owners), "k", "left")
    if stored:
        out = out.join(apart(requests.where(was).select(F.col(order).cast("long").alias("idx"))), "idx", "left_anti")
    exact, semantic = (F.col("status") == 2) & (F.col("owner") < F.col("idx")), F.col("status") == 2
    if places.blocks:
        asked = out.where(semantic & ~F.coalesce(exact, F.lit(False)))
        top = best_earlier(among(places.rows, asked), among(places.rows, kept), places)[0].drop("_by")
        out = out.join(apart(top), "idx", "left")
    else:
        out = out.withColumns({"s": F.lit(None).cast("double"), "src": F.lit(None).cast("long")})
    return out.select(
        "idx",
        F.when(exact, "cache_exact").when(semantic, "cache_semantic").otherwise("miss").alias("kind"),
        F.when(exact, 1.0).when(semantic, F.col("s")).alias("similarity"),
        F.when(exact, F.col("owner")).when(semantic, F.col("src")).alias("hit_source_idx"),
    )


def _by_key(open_: DataFrame) -> DataFrame:
    """Rows without vectors: the first storable row of a key answers the later ones."""
    first = open_.where("keep").groupBy("k").agg(F.min("idx").alias("first"))
    late = F.coalesce(F.col("first") < F.col("idx"), F.lit(False))
    return open_.join(apart(first), "k", "left").select("idx", F.when(late, 2).when(F.col("keep"), 1).otherwise(3).cast("int").alias("status"))


def served(decisions: DataFrame, store: DataFrame) -> DataFrame:
    """Decisions with the stored answer that each hit returns."""
    return decisions.join(
        store.select(
            F.col("idx").alias("hit_source_idx"),
            F.col("answer_text").alias("stored_answer"),
            F.col("served_by").alias("stored_by"),
        ),
        "hit_source_idx",
        "left",
    )


def latest_by_key(store: DataFrame, key: str = "norm_key", order: str = "idx") -> DataFrame:
    """The store as last written: the latest row of each key."""
    return store.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in store.columns if c != key]), order).alias("r")
    ).select(key, "r.*")
