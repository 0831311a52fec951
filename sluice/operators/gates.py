"""Gates: pass or fail of a whole run, each with what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the bars of the gates, their names, and what is observed where there is nothing to judge
FALSE_HIT_BAR, COVERAGE_BAR = 0.05, 0.50
OTHERS, FRACS = ("cache", "router_cascade", "router_heuristic"), ("low", "high")
COST, FALSE_HIT, TUNED = "baseline_costs_more_", "false_hit_rate_within_bound_", "tuned_threshold_beats_random_control"
COVERAGE, INDEPENDENCE = "human_label_coverage", "judge_independence"
NO_RUN, NO_RATE, NO_TUNING, NO_ROWS = (
    "run not present (resume incomplete)",
    "run not present or unjudged",
    "tuning record absent or non-numeric",
    "csv empty",
)


def expected_runs(spark: SparkSession, configs: tuple[str, ...] = OTHERS) -> DataFrame:
    return spark.createDataFrame([(c, f) for c in configs for f in FRACS], "config string, frac string")


def _name(prefix: str):
    return F.concat(F.lit(prefix), "frac", F.lit("_"), "config").alias("name")


def cost_gates(metrics: DataFrame) -> DataFrame:
    """Each configuration costs less than the baseline; an absent run fails."""
    base = metrics.where("config = 'baseline'").select("frac", F.col("cost_usd").alias("base"))
    rows = expected_runs(metrics.sparkSession).join(
        metrics.select("config", "frac", "cost_usd"), ["config", "frac"], "left"
    )
    rows = rows.join(base, "frac", "left")
    seen = F.when(F.col("cost_usd").isNull() | F.col("base").isNull(), NO_RUN)
    seen = seen.otherwise(F.format_string("baseline %.4f vs %s %.4f", "base", "config", "cost_usd"))
    passed = F.coalesce(F.col("cost_usd") < F.col("base"), F.lit(False))
    return rows.select(_name(COST), passed.alias("passed"), seen.alias("observed"))


def false_hit_gates(rates: DataFrame, bar: float = FALSE_HIT_BAR) -> DataFrame:
    """The false-hit rate of each configuration that serves stored answers is within the bar; an absent rate fails."""
    rates = rates.select("config", "frac", "k", "n", "false_hit_rate")
    rows = expected_runs(rates.sparkSession).join(rates, ["config", "frac"], "left")
    told = F.format_string(f"%.4f (%d of %d semantic hits) vs bar {bar:.4f}", "false_hit_rate", "k", "n")
    seen = F.when(F.col("false_hit_rate").isNull(), NO_RATE).otherwise(told)
    passed = F.coalesce(F.col("false_hit_rate") <= bar, F.lit(False))
    return rows.select(_name(FALSE_HIT), passed.alias("passed"), seen.alias("observed"))


def tuned_gate(best: DataFrame, control: DataFrame) -> DataFrame:
    """The tuned F1 is above the best of the random thresholds."""
    rows = best.select("threshold", "f1").crossJoin(control.select("max_f1", "mean_f1"))  # one row each
    told = F.format_string(
        "tuned %s f1 %.4f vs control max %.4f (mean %.4f)", F.col("threshold").cast("string"), "f1", "max_f1", "mean_f1"
    )
    none = F.col("f1").isNull() | F.col("max_f1").isNull() | F.col("mean_f1").isNull()
    passed = F.coalesce(F.col("f1") > F.col("max_f1"), F.lit(False))
    return rows.select(
        F.lit(TUNED).alias("name"), passed.alias("passed"), F.when(none, NO_TUNING).otherwise(told).alias("observed")
    )


def coverage_gate(coverage: DataFrame, bar: float = COVERAGE_BAR) -> DataFrame:
    share = F.format_string("%d/%d = %.3f", "filled", "total", "coverage")
    seen = F.when(F.col("total") > 0, share).otherwise(NO_ROWS)
    passed = (F.col("total") > 0) & (F.col("coverage") >= bar)
    return coverage.select(F.lit(COVERAGE).alias("name"), passed.alias("passed"), seen.alias("observed"))


def independence_gate(agreement: DataFrame, judge1: str, judge2: str) -> DataFrame:
    """Fails while both judges are one model, whose kappa (``agreement``, one row) is self-consistency."""
    if judge1 == judge2:
        told = f"primary {judge1} == secondary {judge2}; kappa %s (n=%d) is self-consistency"
        seen = F.format_string(told, F.format_number("kappa", 4), "n")
    else:
        seen = F.lit(f"primary {judge1} vs secondary {judge2}")
    return agreement.select(
        F.lit(INDEPENDENCE).alias("name"), F.lit(judge1 != judge2).alias("passed"), seen.alias("observed")
    )


def gate_table(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(gates: DataFrame) -> DataFrame:
    passed = F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_gates_passed")
    return gates.agg(passed, F.count(F.lit(1)).alias("n_gates"), F.count_if("passed").alias("n_passed"))
