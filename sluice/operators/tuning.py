"""Threshold tuning: labels, a sweep in one pass, and the choices made from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .cache import seen_earlier

# fixed values: first threshold, step and number of the grid; ratios of a false hit's loss to a missed one's
GRID_START, GRID_STEP, GRID_SIZE = 0.30, 0.005, 140
LOSS_RATIOS = (1, 3, 10, 30, 100)
CONTROL_SEED, CONTROL_DRAWS = 20260908, 64


def grid(start: float = GRID_START, step: float = GRID_STEP, size: int = GRID_SIZE) -> list[float]:
    return [round(start + step * i, 4) for i in range(size)]


def control_draws(
    low: float = 0.30, high: float = 0.995, n: int = CONTROL_DRAWS, seed: int = CONTROL_SEED
) -> list[float]:
    """Random thresholds between the ends of the grid."""
    return [float(x) for x in np.random.default_rng(seed).uniform(low, high, n)]


def replay_labels(
    workload: DataFrame, key: str = "norm_key", order: str = "idx", by: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``eligible`` (the key was not seen earlier) and ``should_hit`` (eligible and a paraphrase)."""
    marked = seen_earlier(workload, key, order, by)
    return marked.withColumn("eligible", ~F.col("seen")).withColumn(
        "should_hit", F.col("eligible") & (F.col("dup_type") == "paraphrase")
    ).drop("seen", "first_idx")


def label_counts(labelled: DataFrame, by: str = "frac") -> DataFrame:
    return labelled.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("should_hit").alias("n_should_hit"),
        F.count_if("eligible").alias("n_eligible"),
    )


def sweep(best: DataFrame, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, threshold, tp, fp, fn, tn, precision, recall, f1, false_hit_rate)`` over eligible rows; a hit is ``best >= threshold``.

    Rows are counted by the number of thresholds that they reach, in one pass; the sweep is made from these few counts.
    """
    steps = sorted(thresholds)
    reach = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("best")))
    counts = best.where("eligible").groupBy(*by, reach.alias("reach")).agg(
        F.count_if("should_hit").alias("yes"), F.count_if(~F.col("should_hit")).alias("no")
    )
    at = counts.select("*", F.posexplode(F.array(*map(F.lit, steps))).alias("i", "threshold"))
    hit = F.col("reach") > F.col("i")
    of = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    return rates(
        at.groupBy(*by, "threshold").agg(
            of("yes", hit).alias("tp"),
            of("no", hit).alias("fp"),
            of("yes", ~hit).alias("fn"),
            of("no", ~hit).alias("tn"),
        )
    )


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "precision": p,
            "recall": r,
            "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)),
            "false_hit_rate": ratio(fp, tp + fp),
        }
    )


def pooled(swept: DataFrame) -> DataFrame:
    """Counts added up over the groups of a sweep, and the rates of the sums."""
    return rates(swept.groupBy("threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))))


def best_f1(swept: DataFrame) -> DataFrame:
    """The threshold with the largest F1, the largest threshold on ties."""
    return swept.agg(
        F.max(F.struct("f1", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "false_hit_rate")).alias("b")
    ).select("b.*")


def cost_weighted(swept: DataFrame, ratios: tuple[int, ...] = LOSS_RATIOS) -> DataFrame:
    """For each loss ratio r the threshold with the least r * fp + fn, the lowest on ties."""
    each = swept.select(
        "*", F.explode(F.array(*map(F.lit, ratios))).alias("r")
    ).withColumn("loss", F.col("r") * F.col("fp") + F.col("fn"))
    return each.groupBy("r").agg(F.min(F.struct("loss", "threshold", "fp", "fn")).alias("b")).select("r", "b.*")


def control(best: DataFrame, draws: list[float]) -> DataFrame:
    """Mean and maximum F1 over random thresholds."""
    return sweep(best, draws).agg(
        F.avg("f1").alias("mean_f1"), F.max("f1").alias("max_f1"), F.count(F.lit(1)).alias("n")
    )


def loss_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "threshold double, tp long, fp long, fn long, tn long")
