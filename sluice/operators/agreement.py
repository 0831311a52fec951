"""Agreement of two raters, label coverage, and the queue of rows for people to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import checked_label, is_blank

KEY = ["config", "frac", "idx"]
TIERS = (1, 2, 3, 4)
# fixed values: why a row is in its tier, and the columns of the file that people fill in
REASONS = {
    1: "semantic hit judged incorrect (false hit)",
    2: "judge passes disagree",
    3: "cascade escalation",
    4: "other judged row",
}
QUEUE = (
    "priority",
    "priority_reason",
    "config",
    "frac",
    "idx",
    "kind",
    "served_by",
    "similarity",
    "hit_source_idx",
    "dup_type",
    "request",
    "answer_text",
    "baseline_text",
    "judge1_score",
    "judge2_score",
    "human_label",
)


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of categories; rows that either rater left out are left out."""
    return rows.where(
        F.col(a).isNotNull() & F.col(b).isNotNull()
    ).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, observed, expected, kappa)`` in one row; NaN kappa where chance alone explains all, nulls and n = 0 without pairs."""
    table = contingency(rows, a, b)
    total = table.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"),
    )
    side = lambda c: table.groupBy(F.col(c).alias("c")).agg(F.sum("n").alias(f"n_{c}"))
    chance = side("a").join(side("b"), "c").agg(
        F.coalesce(F.sum(F.col("n_a").cast("double") * F.col("n_b")), F.lit(0.0)).alias("x")
    )
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    out = total.crossJoin(chance).select(  # one row each
        F.col("n"), (F.col("same") / n).alias("observed"), (F.col("x") / (n * n)).alias("expected")
    )
    value = F.when(F.col("expected") == 1, F.lit(float("nan"))).otherwise(
        (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))
    )
    return out.withColumn("kappa", value)


def human_agreement(
    rows: DataFrame, label: str = "human_label", scores: tuple[str, ...] = ("judge1_score", "judge2_score")
) -> dict[str, DataFrame]:
    """Kappa of each judge against people's labels; a cell that is no label fails the query."""
    known = rows.withColumns({c: checked_label(F.col(c).cast("string")) for c in (label, *scores)})
    return {s: kappa(known, s, label) for s in scores}


def coverage(rows: DataFrame, label: str = "human_label", least: float = 0.5) -> DataFrame:
    filled = F.count_if(~is_blank(F.col(label).cast("string")))
    out = rows.agg(filled.alias("filled"), F.count(F.lit(1)).alias("total"))
    share = F.when(F.col("total") > 0, F.col("filled") / F.col("total")).otherwise(0.0)
    return out.withColumn("coverage", share).withColumn("enough", F.col("coverage") >= least)


def priority(strict: bool = False) -> Column:
    """Tier of a judged row, first match: wrong semantic hit, judges differ, escalated, rest. ``strict`` takes hits out of the third."""
    escalated = (F.col("config") == "router_cascade") & (F.col("served_by") == "expensive")
    if strict:
        escalated &= F.col("kind") == "miss"
    one, two = F.col("judge1_score"), F.col("judge2_score")
    return F.when(
        (F.col("kind") == "cache_semantic") & (one == 0), 1
    ).when(one != two, 2).when(escalated, 3).otherwise(4)


def judged_rows(judged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Judgements with their outcomes; a (config, frac, idx) that names two outcomes fails the query."""
    more = [c for c in ("similarity", "hit_source_idx") if c in outcomes.columns and c not in judged.columns]
    once = outcomes.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in ("kind", "served_by", *more))
    )
    sure = F.when(
        F.col("_n") > 1, F.raise_error(F.lit("outcomes are not one for each key")).cast("string")
    ).otherwise(F.col("kind"))
    return judged.join(once.withColumn("kind", sure).drop("_n"), KEY, "left")


def triage(judged: DataFrame, outcomes: DataFrame, limit: int | None = 60, strict: bool = False) -> DataFrame:
    """The rows to label first: by tier, config, frac and idx; ``limit`` of them, as the queue is a bounded report."""
    rows = judged_rows(judged, outcomes).withColumn("priority", priority(strict))
    rows = rows.select("priority", *KEY, "kind", "served_by", "judge1_score", "judge2_score")
    return rows.orderBy("priority", *KEY).limit(limit) if limit else rows


def human_queue(judged: DataFrame, outcomes: DataFrame, limit: int = 60, strict: bool = False) -> DataFrame:
    """The file for people: the first ``limit`` rows by tier, config, frac and idx, all cells as text, ``human_label`` empty.

    Scores are whole numbers; what is missing is an empty cell. The file is a function of the tables alone.
    """
    rows = judged_rows(judged, outcomes).withColumn("priority", priority(strict))
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[F.col("priority")]
    rows = rows.withColumns(
        {"priority_reason": reason, "human_label": F.lit("")}
    ).orderBy("priority", *KEY).limit(limit)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select("priority", "priority_reason", "config", "frac", "idx", *(text(c) for c in QUEUE[5:]))


def tier_counts(rows: DataFrame) -> DataFrame:
    """Rows of each tier, 0 where there are none."""
    tiers = rows.sparkSession.createDataFrame([(t,) for t in TIERS], "priority int")
    return tiers.join(
        rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n")), "priority", "left"
    ).select("priority", F.coalesce("n", F.lit(0)).alias("n"))
