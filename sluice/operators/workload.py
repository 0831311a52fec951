"""Workloads: samples, repeats, follower order and group-wise splits, in orders that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hash_rank_key
from ..functions.text import group_name, request_text


def sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows by hash order, ties by key: a top-n, so each task sends n rows at most."""
    return rows.withColumn("_h", hash_rank_key(seed, *map(F.col, key))).orderBy("_h", *key).limit(n).drop("_h")


def split_groups(rows: DataFrame, group: str, share: float = 0.5, seed: int = 7) -> DataFrame:
    """Add ``half``: ``tune`` for the first ``int(n * share)`` groups in hash order, else ``report``; a group is never split.

    The cut is the n-th hash: counts of 65536 ranges of hashes say in which range it lies, and only that range is ordered.
    """
    groups = rows.select(group).where(F.col(group).isNotNull()).distinct().withColumn(
        "_h", hash_rank_key(seed, F.col(group))
    )
    groups = groups.withColumn("_b", F.substring("_h", 1, 4))
    n = int(groups.count() * share)
    counts = groups.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("_before", before).where((F.col("_before") < n) & (F.col("_before") + F.col("_c") >= n))  # one row
    nth = groups.join(F.broadcast(at), "_b").withColumn("_r", F.row_number().over(Window.orderBy("_h")))
    edge = nth.where(F.col("_r") == n - F.col("_before")).agg(F.max("_h").alias("edge"))
    told = groups.crossJoin(F.broadcast(edge)).select(  # edge is one row
        group, F.when(F.col("_h") <= F.col("edge"), "tune").otherwise("report").alias("half")
    )
    return rows.join(told, group)


def pilot(rows: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """The first ``n`` rows of a workload, for a trial run: a top-n, so each task sends n rows at most."""
    return rows.orderBy(order).limit(n)


def fraction_seed(frac: Column, seed: int) -> Column:
    """The seed of a fraction's workload: ``seed`` and the code points of its name."""
    points = F.transform(F.filter(F.split(frac, ""), lambda c: c != ""), F.ascii)
    return (F.lit(seed) + F.aggregate(points, F.lit(0), lambda a, x: a + x)).cast("long")


def write_fractions(parts: dict[str, DataFrame], path: str, meta: dict) -> None:
    """Write each fraction's workload as a partition of one table, and ``meta`` beside it."""
    from ..sources.tables import write_json

    for frac, rows in parts.items():
        rows.withColumn("frac", F.lit(frac)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("frac").parquet(f"{path}/workload")
    write_json(next(iter(parts.values())).sparkSession, f"{path}/meta.json", meta)


def split_balance(split: DataFrame, group: str) -> DataFrame:
    return split.groupBy("half").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))


def exact_repeats(novel: DataFrame, draws: DataFrame, seed: int, order: str = "idx") -> DataFrame:
    """For each row of ``draws`` (``draw`` long) a row of ``novel``, uniform with replacement: hash modulo the number of rows."""
    n = novel.count()
    if n == 0:
        raise ValueError("no novel rows to repeat")
    rank = numbered(novel, order, "_at")
    at = F.pmod(
        F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("draw")), 256), 1, 8), 16, 10).cast("long"),
        F.lit(n),
    )
    return draws.withColumn("_at", at).join(rank, "_at").drop("_at")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Dense numbers from 0 in ``order``: counts of range partitions give each its start."""
    part = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    from ..sources.tables import cut_lineage

    part = cut_lineage(part.withColumn("_m", F.monotonically_increasing_id()))
    counts = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_f"))
    start = counts.withColumn(  # a row for each partition
        "_s", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return part.join(F.broadcast(start), "_p").withColumn(
        name, F.col("_s") + F.col("_m") - F.col("_f")
    ).drop("_p", "_m", "_c", "_f", "_s")


def anchors(workload: DataFrame, by: tuple[str, ...] = ("frac",)) -> DataFrame:
    """Each follower (not novel) with the ``anchor_idx`` of its group: its last novel row."""
    novel = workload.where("dup_type = 'novel'").groupBy(*by, "group_id").agg(F.max("idx").alias("anchor_idx"))
    return workload.where("dup_type <> 'novel'").join(novel, [*by, "group_id"], "left")


def resolve(followers: DataFrame, known: DataFrame, text: str = "request") -> DataFrame:
    """``followers`` with the ``group_id`` of their text in ``known`` (``text, group_id``); a text of no group fails the query."""
    groups = known.groupBy(F.col(text).alias("_text")).agg(F.max("group_id").alias("_group"))
    lost = F.raise_error(F.concat(F.lit("no group for: "), F.substring(F.coalesce(F.col(text), F.lit("null")), 1, 80))).cast("string")
    out = followers.drop("group_id").join(groups, F.col(text) == F.col("_text"), "left")
    return out.withColumn("group_id", F.when(F.col("_group").isNotNull(), F.col("_group")).otherwise(lost)).drop("_text", "_group")


def waiting_time(seed: int, *key: Column) -> Column:
    """An exponential variate that any engine can repeat: -ln of the first 52 bits of SHA-256 of the seed and the key."""
    bits = F.conv(F.substring(hash_rank_key(seed, *key), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52))


def follower_order(workload: DataFrame, seed: int, by: tuple[str, ...] = ("frac",), row: str = "idx") -> DataFrame:
    """Add ``rank_key``: a random order, uniform at every step over the rows whose anchor is already placed.

    Each row waits an exponential time once it may be placed, a follower after its group's anchor. What is left to wait of such a
    time does not depend on how long it has run, so the next row is any of the ready ones with equal chance. A follower
    without an anchor may be placed from the start.
    """
    own = waiting_time(seed, F.col(row))
    anchor = workload.where("dup_type = 'novel'").groupBy(*by, "group_id").agg(F.max(own).alias("_a"))
    key = own + F.when(F.col("dup_type") != "novel", F.coalesce("_a", F.lit(0.0))).otherwise(0.0)
    return workload.join(anchor, [*by, "group_id"], "left").withColumn("rank_key", key).drop("_a")


def build(pairs: DataFrame, n: int, paraphrases: float, traps: float, exact: float, seed: int, frac: str) -> DataFrame:
    """A workload of ``n`` requests: anchors of sampled pairs, fillers, their paraphrases, traps, and exact repeats, in follower order.

    ``pairs`` has ``id, sentence1, sentence2, label`` (1: same meaning). ``n`` is a parameter of a benchmark run, so the sample is small.
    Raises where the pairs don't suffice.
    """
    p, t, e = round(paraphrases * n), round(traps * n), round(exact * n)
    novel = n - p - t - e
    if novel < p + t:
        raise ValueError("too few novel rows for the followers")
    # of pairs with one anchor text that with the smallest id
    once = lambda rows: rows.groupBy("sentence1").agg(F.min(F.struct("id", "sentence2")).alias("p")).select("sentence1", "p.*")
    same = sample(once(pairs.where("label = 1")), p, seed, "id")
    other = sample(once(pairs.where("label = 0")).join(same.select("sentence1"), "sentence1", "left_anti"), t, seed + 1, "id")
    taken = same.select("id", "sentence1", "sentence2", F.lit("paraphrase").alias("d")).unionByName(
        other.select("id", "sentence1", "sentence2", F.lit("trap").alias("d"))
    )
    rest = sample(once(pairs).join(taken.select("sentence1"), "sentence1", "left_anti"), novel - p - t, seed + 2, "id")
    base = numbered(
        taken.select("sentence1", "sentence2", "d", "id").unionByName(
            rest.select(
                "sentence1", F.lit(None).cast("string").alias("sentence2"), F.lit(None).cast("string").alias("d"), "id"
            )
        ),
        "id",
        "g",
    ).withColumn("group_id", group_name(F.col("g")))
    have = {r["d"]: r["count"] for r in base.groupBy("d").count().collect()}
    if (have.get("paraphrase", 0), have.get("trap", 0), sum(have.values())) != (p, t, novel):
        raise ValueError(f"{have} distinct anchors for {novel} novel rows, {p} paraphrases and {t} traps")
    first = base.select(F.col("sentence1").alias("s"), F.lit("novel").alias("dup_type"), "group_id")
    after = base.where("d IS NOT NULL").select(F.col("sentence2").alias("s"), F.col("d").alias("dup_type"), "group_id")
    draws = pairs.sparkSession.range(e).select(F.col("id").alias("draw"))
    again = exact_repeats(first, draws, seed + 3, "group_id").select("s", F.lit("exact").alias("dup_type"), "group_id", "draw")
    # a name for each row: its group and kind, and the number of the draw for repeats
    named = first.unionByName(after).withColumn("_k", F.concat_ws("|", "group_id", "dup_type")).unionByName(
        again.withColumn("_k", F.concat_ws("|", "group_id", "dup_type", "draw")).drop("draw")
    )
    ranked = follower_order(named.withColumn("frac", F.lit(frac)), seed + 4, row="_k")
    out = numbered(ranked, "rank_key", "idx")
    return out.select(
        "frac",
        F.col("idx").cast("long").alias("idx"),
        request_text(F.col("s")).alias("request"),
        "dup_type",
        "group_id",
    )


def user_text(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, text)``: a conversation's user turns in order, joined by newlines; blank ones are dropped, as are conversations without any.

    A conversation is bounded by what one request can hold, so its turns are gathered.
    """
    own = turns.where("role = 'user' AND text IS NOT NULL").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")
    )
    out = own.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.btrim(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), F.lit(" \t\r\n")).alias("text"),
    )
    return out.where("text <> ''")


def last_answer(turns: DataFrame) -> DataFrame:
    """The assistant's last turn of each conversation."""
    return turns.where("role = 'assistant'").groupBy("conv_id").agg(
        F.max_by(F.struct("turn", "text"), "turn").alias("a")
    ).select("conv_id", "a.turn", "a.text")
