"""Runs of a workload under one configuration: waves of requests, calls with retries, and resumption.

A follower waits for its anchor, so followers are the wave after novel requests. Within a wave requests are decided in rounds, as if one after
the other in ``idx`` order; only misses are asked for. A call's outcome is written before anything depends on it,
by wave and round, and a wave's outcomes and stored answers by wave. A run that was stopped goes on from what is there: no
call that was written is made again, no wave that is done is decided again.

Below ``config=.../frac=...`` of the root: ``calls``, ``outcomes`` and ``items``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_error, is_blank, normalize_exact
from ..sources.tables import OUTCOMES, cut_lineage, read_table
from .cache import greedy_cache
from .routing import cascade, heuristic, priced
from .workload import anchors

ITEMS = "idx bigint, request string, norm_key string, group_id string, answer_text string, model string, vec array<float>"
CALLED = "idx bigint, tier string, answer_text string, tokens_in bigint, tokens_out bigint, model_ms double, attempts int, error string"
# fixed value: what a provider says of requests that it will never answer
BLOCKED = "content-blocked"

#: ``client(tier, request, budget)`` gives ``(text, tokens_in, tokens_out, ms)`` or raises.
Client = Callable[[str, str, int], tuple[str, int, int, float]]


def ask_one(client: Client, tier: str, request: str, budget: int, retries: int) -> tuple:
    """``(text, tokens_in, tokens_out, ms, attempts, error)`` of a request.

    A blank answer is asked for again with twice the budget, and both calls are billed. What raises is tried again up
    to ``retries`` times, unless the provider blocks the content; the last error is the outcome.
    """
    for attempt in range(1, retries + 2):
        try:
            text, t_in, t_out, ms = client(tier, request, budget)
            if not text.strip():
                text, more_in, more_out, more_ms = client(tier, request, 2 * budget)
                t_in, t_out, ms = t_in + more_in, t_out + more_out, ms + more_ms
            return text, t_in, t_out, ms, attempt, None
        except Exception as e:
            error = f"{type(e).__name__}: {str(e)[:200]}"
            if BLOCKED in str(e):
                break
    return "", 0, 0, 0.0, attempt, error


def call(rows: DataFrame, provider: Callable[[], Client], budgets: dict[str, int], retries: int) -> DataFrame:
    """``rows`` (``idx, tier, request``) answered: a client for each task, an outcome for each row, errors too.

    Spark may run a task again, so callers write the result before they use it.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = provider()
        for part in parts:
            got = [ask_one(client, t, q, budgets[t], retries) for t, q in zip(part["tier"], part["request"])]
            names = ["answer_text", "tokens_in", "tokens_out", "model_ms", "attempts", "error"]
            yield pd.concat([part[["idx", "tier"]].reset_index(drop=True), pd.DataFrame(got, columns=names)], axis=1)

    return rows.select("idx", "tier", "request").mapInPandas(run, CALLED)


def waves(workload: DataFrame) -> DataFrame:
    """``workload`` of one run with ``wave``: 0, or 1 for followers whose anchor is in it."""
    late = anchors(workload, ()).where("anchor_idx IS NOT NULL").select("idx", F.lit(1).alias("late"))
    return workload.join(late, "idx", "left").withColumn("wave", F.coalesce("late", F.lit(0))).drop("late")


def _is_there(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as they were written to ``path`` before, or else now."""
    if not _is_there(rows.sparkSession, path):
        rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_config(
    workload: DataFrame,
    config: str,
    frac: str,
    root: str,
    provider: Callable[[], Client],
    threshold: float,
    prices: dict[str, tuple[float, float]],
    budgets: dict[str, int],
    retries: int = 2,
    stop_after: int | None = None,
) -> DataFrame:
    """Outcomes of ``workload`` (``idx, request, dup_type, group_id, vec``) under ``config``; written, and read back.

    ``prices`` and ``budgets`` are by tier. ``baseline`` asks the expensive tier for every request. The others look among stored
    answers first; ``router_heuristic`` gives easy requests to the cheap tier, ``router_cascade`` all, and those with a
    blank or doubtful answer to the expensive one too, and pays for both. Failed and blank answers are not stored.
    Unique ``idx``; a null vector is looked up by its key only. ``stop_after`` ends the run after some waves, as a failure would.
    """
    spark = workload.sparkSession
    base = f"{root}/config={config}/frac={frac}"
    rows = cut_lineage(waves(workload.select("idx", "request", "dup_type", "group_id", "vec")).withColumn("norm_key", normalize_exact(F.col("request"))))
    easy = ~heuristic(F.col("request"))["hard"] if config == "router_heuristic" else F.lit(config == "router_cascade")
    tiers = rows.select("idx", F.when(easy, "cheap").otherwise("expensive").alias("tier"), "request")

    def asked(misses: DataFrame, path: str) -> DataFrame:
        """Calls for ``misses``; a cascade's second calls are rows of their own."""
        first = _kept(call(tiers.join(misses, "idx"), provider, budgets, retries), f"{path}/first")
        if config != "router_cascade":
            return first
        up = first.where(~has_error(F.col("error")) & cascade(F.col("answer_text"))).select("idx", F.lit("expensive").alias("tier"))
        second = _kept(call(up.join(rows.select("idx", "request"), "idx"), provider, budgets, retries), f"{path}/second")
        return first.unionByName(second)

    def outcome(calls: DataFrame) -> DataFrame:
        """One row for each call or pair of calls: the last answer, the sum of what they cost."""
        last = F.max_by(F.struct("tier", "answer_text", "error"), F.when(F.col("tier") == "expensive", 1).otherwise(0)).alias("last")
        cost = priced(calls, prices, "tier").groupBy("idx").agg(
            last, *(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "model_ms", "cost_usd"))
        )
        return cost.select("idx", "last.*", "tokens_in", "tokens_out", "model_ms", "cost_usd")

    good = (~has_error(F.col("error")) & ~is_blank(F.col("answer_text"))).alias("keep")
    for wave in range(2):
        if stop_after is not None and wave >= stop_after:
            break
        if _is_there(spark, f"{base}/outcomes/wave={wave}"):
            continue
        mine = rows.where(F.col("wave") == wave)
        paths = [f"{base}/calls/wave={wave}/round=0"]
        if config == "baseline":
            asked(mine.select("idx"), paths[0])
            told = mine.select("idx", F.lit("model_direct").alias("kind"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("hit_source_idx"))
        else:
            paths.clear()

            def ask(misses: DataFrame, turn: int) -> DataFrame:
                paths.append(f"{base}/calls/wave={wave}/round={turn}")
                return outcome(asked(misses, paths[-1])).select("idx", good)

            items = _items(spark, base, wave)
            known = items.select("idx", "norm_key", "vec", F.lit(True).alias("old"))
            table = mine.select("idx", "norm_key", "vec", F.lit(False).alias("old")).unionByName(known)
            told = greedy_cache(table, threshold, key="norm_key", stored="old", ask=ask)
        parts = [f"{p}/{x}" for p in paths for x in (("first", "second") if config == "router_cascade" else ("first",))]
        calls = spark.read.schema(CALLED).parquet(*parts) if parts else spark.createDataFrame([], CALLED)
        done = mine.join(told, "idx").join(outcome(calls), "idx", "left")
        hit = F.col("kind").isin("cache_exact", "cache_semantic")
        fresh = done.where(~hit & good).select("idx", F.col("answer_text").alias("from_text"), F.col("tier").alias("from_tier"))
        if config != "baseline":
            fresh = fresh.unionByName(items.select("idx", F.col("answer_text").alias("from_text"), F.col("model").alias("from_tier")))
        done = done.join(fresh.withColumnRenamed("idx", "hit_source_idx"), "hit_source_idx", "left")
        cost = lambda c, zero=0: F.coalesce(F.col(c), F.lit(zero)).alias(c)
        none = lambda c: F.lit(None).cast("double").alias(c)
        fields = {
            "seq": F.col("idx"), "config": F.lit(config), "frac": F.lit(frac), "served_by": F.when(hit, F.col("from_tier")).otherwise(F.col("tier")),
            "latency_ms": cost("model_ms", 0.0), "embed_ms": none("embed_ms"), "lookup_ms": none("lookup_ms"), "model_ms": cost("model_ms", 0.0),
            "tokens_in": cost("tokens_in"), "tokens_out": cost("tokens_out"), "cost_usd": cost("cost_usd", 0.0),
            "answer_text": F.when(hit, F.col("from_text")).otherwise(F.coalesce("answer_text", F.lit(""))), "error": F.when(~hit, F.col("error")),
        }
        names = [c.split()[0] for c in OUTCOMES.split(", ")]
        done = cut_lineage(done.select(*(fields[c].alias(c) if c in fields else F.col(c) for c in names), "vec", "norm_key"))
        if config != "baseline":
            new = done.where(~F.col("kind").isin("cache_exact", "cache_semantic") & good)
            new.select("idx", "request", "norm_key", "group_id", "answer_text", F.col("served_by").alias("model"), "vec").write.mode("overwrite").parquet(
                f"{base}/items/wave={wave}"
            )
        done.select(*names).write.mode("overwrite").parquet(f"{base}/outcomes/wave={wave}")
    there = [f"{base}/outcomes/wave={w}" for w in range(2) if _is_there(spark, f"{base}/outcomes/wave={w}")]
    return spark.read.schema(OUTCOMES).parquet(*there) if there else spark.createDataFrame([], OUTCOMES)


def _items(spark: SparkSession, base: str, before: int) -> DataFrame:
    """Stored answers of the waves before one; none where no wave stored any."""
    out = spark.createDataFrame([], ITEMS)
    for w in range(before):
        out = out.unionByName(read_table(spark, f"{base}/items/wave={w}", ITEMS))
    return out
