"""Judgements of answers against the baseline's: equal texts without a call, one judge for the rest, two for a sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hash_rank_key
from ..functions.text import is_blank, judge_prompt, parse_score
from ..sources.tables import KEY, pending

# fixed value: the note of a row that no judge saw
IDENTICAL = "identical to baseline, no judge call"


def sampled(outcomes: DataFrame, n: int, seed: int) -> DataFrame:
    """Keys of the ``n`` first rows of each run in hash order, over all its rows, judged or not.

    A resumed run draws the same rows. Each task sends ``n`` rows of a run at most (a top-n window).
    """
    key = hash_rank_key(seed, *map(F.col, KEY))
    order = Window.partitionBy("config", "frac").orderBy("_h", "idx")
    ranked = outcomes.select(*KEY, key.alias("_h")).withColumn("_r", F.row_number().over(order))
    return ranked.where(F.col("_r") <= n).select(*KEY)


def judge_run(outcomes: DataFrame, baseline: DataFrame, ask1: Callable[[Column], Column], ask2: Callable[[Column], Column],
              rubric: str, n_second: int, seed: int, done: DataFrame | None = None) -> DataFrame:
    """A judgement of each outcome whose baseline (same ``frac`` and ``idx``) has an answer.

    ``ask1`` and ``ask2`` give a judge's reply to a prompt column, as an expression or an Arrow function of a client. They
    are asked only for answers that differ from the baseline's; equal ones score 2. The second judge gets a sample of
    ``n_second`` rows of each run. Rows whose key is in ``done`` are left out, as their verdicts are paid for. Outcomes
    without an answer text are judged as empty; a null baseline is none.
    """
    base = baseline.where(~is_blank(F.col("answer_text"))).select(
        "frac", "idx", F.col("answer_text").alias("baseline_text")
    )
    todo = pending(outcomes, done) if done is not None else outcomes
    chosen = sampled(outcomes, n_second, seed).withColumn("_second", F.lit(True))
    rows = todo.select(
        *KEY, "request", "dup_type", F.coalesce("answer_text", F.lit("")).alias("answer_text")
    ).join(base, ["frac", "idx"])
    rows = rows.join(F.broadcast(chosen), KEY, "left")  # n_second rows of each run
    rows = rows.withColumn("sampled_for_judge2", F.coalesce("_second", F.lit(False))).drop("_second")
    same, prompt = F.col("answer_text") == F.col("baseline_text"), judge_prompt(
        rubric, F.col("request"), F.col("baseline_text"), F.col("answer_text")
    )
    none = F.lit(None).cast("string")
    equal = rows.where(same).select(
        "*", none.alias("judge1_raw"), none.alias("judge2_raw"), F.lit(IDENTICAL).alias("note")
    )
    other = rows.where(~same)
    once = other.where("NOT sampled_for_judge2").select(
        "*", ask1(prompt).alias("judge1_raw"), none.alias("judge2_raw"), F.lit("").alias("note")
    )
    twice = other.where("sampled_for_judge2").select(
        "*", ask1(prompt).alias("judge1_raw"), ask2(prompt).alias("judge2_raw"), F.lit("").alias("note")
    )
    out = equal.unionByName(once).unionByName(twice).withColumn("identical", same)
    score1 = F.when(F.col("identical"), 2).otherwise(parse_score(F.col("judge1_raw")))
    return out.select(
        *KEY, "request", "dup_type", "answer_text", "baseline_text", "identical", score1.cast("int").alias("judge1_score"),
        parse_score(F.col("judge2_raw")).alias("judge2_score"), "judge1_raw", "judge2_raw", "sampled_for_judge2",
        F.lit("").alias("human_label"), "note",
    )
