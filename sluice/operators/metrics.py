"""Run metrics, quality, false hits, reconciliation and comparisons, all runs in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.stats import ratio
from ..functions.text import has_error
from ..sources.tables import cut_lineage

RUN = ["config", "frac"]
# fixed values: the published comparisons (id, a, b, quantity), each for both fractions
COMPARISONS = (
    ("cost-cache-baseline", "cache", "baseline", "cost"),
    ("cost-heur-base", "router_heuristic", "baseline", "cost"),
    ("cost-heur-casc", "router_heuristic", "router_cascade", "cost"),
    ("qual-heur-casc", "router_heuristic", "router_cascade", "quality"),
    ("p99-heur-base", "router_heuristic", "baseline", "p99"),
    ("fhr-casc-heur", "router_cascade", "router_heuristic", "fhr"),
)
BINS, LOG_LOW, LOG_HIGH = 28, -0.3010299956639812, 5.0


def succeeded(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(~has_error(F.col("error")))


def warm(ok: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Rows but the first (by ``seq``) of each run with more than one; the first is found by an aggregate, not by a sort of the run."""
    first = ok.groupBy(*by).agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return ok.join(first, by).where("seq <> _first OR _n = 1").drop("_first", "_n")


def run_metrics(outcomes: DataFrame, by: list[str] = RUN) -> DataFrame:
    """One row for each run: rows, errors, tokens, cost, calls, kinds, hit rate, latency of the first and of warm requests.

    Over successful rows, but for ``n_rows`` and ``n_errors``. Percentiles are exact and interpolated.
    """
    is_ok = ~has_error(F.col("error"))
    narrow = cut_lineage(outcomes.select(
        *by, "seq", "kind", "served_by", "tokens_in", "tokens_out", "cost_usd", "latency_ms", is_ok.alias("_ok")
    ))
    of = lambda c: F.when(F.col("_ok"), F.col(c))
    kind, call = (lambda *k: F.count_if(F.col("_ok") & F.col("kind").isin(*k))), (
        lambda t: F.count_if(F.col("_ok") & (F.col("served_by") == t) & (F.col("tokens_out") > 0))
    )
    # one pass for all that can be counted or summed; an empty run has nulls, not zeros
    some = lambda c: F.when(F.col("n_ok") > 0, F.col(c)).alias(c)
    sums = narrow.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("_ok")).alias("n_errors"), F.count_if("_ok").alias("n_ok"),
        F.sum(of("tokens_in")).alias("tokens_in"), F.sum(of("tokens_out")).alias("tokens_out"), F.sum(of("cost_usd")).alias("cost_usd"),
        call("cheap").alias("cheap_calls"), call("expensive").alias("expensive_calls"), kind("cache_exact").alias("n_exact"),
        kind("cache_semantic").alias("n_semantic"), kind("miss", "model_direct").alias("n_miss"),
        F.min_by("latency_ms", of("seq")).alias("first_latency_ms"), F.min(of("seq")).alias("_first"),
    )
    counts = ("n_ok", "cheap_calls", "expensive_calls", "n_exact", "n_semantic", "n_miss")
    sums = cut_lineage(sums)
    firsts = sums.select(*by, "_first", "n_ok")
    lat = latency_percentiles(narrow.where("_ok").join(firsts, by).where("seq <> _first OR n_ok = 1").select(*by, "latency_ms"), by)
    sums = sums.select(*by, "n_rows", "n_errors", *(c if c not in counts else some(c) for c in sums.columns[len(by) + 2 : -1]))
    out = sums.join(lat, by, "left")
    return out.withColumn("hit_rate", ratio(F.col("n_exact") + F.col("n_semantic"), F.col("n_ok")))


def latency_percentiles(rows: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Exact percentiles and the mean of each run's latencies, which are written once and read for each."""
    rows = cut_lineage(rows.select(*by, "latency_ms"))
    p = stats.exact_percentiles(rows, by, "latency_ms", (0.5, 0.95, 0.99)).join(
        rows.groupBy(*by).agg(F.avg("latency_ms").alias("mean_ms")), by
    )
    return p.select(
        *by, *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))), "mean_ms"
    )


def latency_histogram(rows: DataFrame, by: list[str] = RUN, value: str = "latency_ms") -> DataFrame:
    """Counts in 28 bins of log10 from 0.5 to 1e5; values beyond go to the outer bins."""
    x = F.log10(F.greatest(F.col(value), F.lit(1e-9)))
    b = F.least(F.greatest(((x - LOG_LOW) / (LOG_HIGH - LOG_LOW) * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1))
    return rows.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def hit_rates(outcomes: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Hit rate of each run with its interval."""
    rows = succeeded(outcomes).groupBy(*by).agg(
        F.count_if(F.col("kind").isin("cache_exact", "cache_semantic")).alias("k"), F.count(F.lit(1)).alias("n")
    )
    return rows.withColumn("ci", stats.wilson(F.col("k"), F.col("n"))).select(
        *by, "k", "n", ratio(F.col("k"), F.col("n")).alias("hit_rate"), "ci.lo", "ci.hi"
    )


def effective_score(identical: Column, score: Column) -> Column:
    """2 for an answer equal to the baseline's, else the judge's score, or null."""
    return F.when(identical, 2).otherwise(score)


def quality(judged: DataFrame, by: list[str] = RUN) -> DataFrame:
    scored = judged.withColumn("score", effective_score(F.col("identical"), F.col("judge1_score")))
    return scored.groupBy(*by).agg(
        F.count("score").alias("n_scored"), F.avg("score").alias("mean_score"), (F.avg("score") / 2).alias("quality")
    )


def false_hits(judged: DataFrame, outcomes: DataFrame, strict: bool = False) -> DataFrame:
    """Rate of wrong answers among semantic hits, with its interval; null where a run has no semantic hit.

    The published numerator counts judged paraphrases and traps with score 0 and another text, hits or not; ``strict`` counts semantic hits only.
    """
    semantic = succeeded(outcomes).groupBy(*RUN).agg(F.count_if(F.col("kind") == "cache_semantic").alias("n"))
    wrong = ~F.col("identical") & (F.col("judge1_score") == 0)
    if strict:
        # (config, frac, idx) names one row on each side
        bad = judged.where(wrong).join(
            succeeded(outcomes).where("kind = 'cache_semantic'").select(*RUN, "idx"), [*RUN, "idx"]
        )
    else:
        bad = judged.where(wrong & F.col("dup_type").isin("paraphrase", "trap"))
    out = semantic.join(
        bad.groupBy(*RUN).agg(F.count(F.lit(1)).alias("k")), RUN, "left"
    ).withColumn("k", F.coalesce("k", F.lit(0)))
    ci = F.when(F.col("n") > 0, stats.wilson(F.least("k", "n"), F.col("n")))
    return out.withColumn("ci", ci).select(
        *RUN, "k", "n", ratio(F.col("k"), F.col("n"), None).alias("false_hit_rate"), "ci.lo", "ci.hi"
    )


def false_hit_rows(judged: DataFrame) -> DataFrame:
    """``(config, frac, idx)`` of the published numerator: judged paraphrases and traps with score 0 and another text."""
    wrong = ~F.col("identical") & (F.col("judge1_score") == 0) & F.col("dup_type").isin("paraphrase", "trap")
    return judged.where(wrong).select(*RUN, "idx")


def exact_proxy(judged: DataFrame, exact_idx: DataFrame) -> DataFrame:
    """Scores of judged rows whose (frac, idx) is an exact hit in the replay: judged, score_0..2, unjudged."""
    rows = judged.join(exact_idx.select("frac", "idx"), ["frac", "idx"], "left_semi").withColumn(
        "s", effective_score(F.col("identical"), F.col("judge1_score"))
    )
    return rows.groupBy(*RUN).agg(
        F.count("s").alias("judged"),
        *(F.count_if(F.col("s") == i).alias(f"score_{i}") for i in range(3)),
        F.count_if(F.col("s").isNull()).alias("unjudged"),
    )


def pairs_of(rows: DataFrame, a: str, b: str, value: str, by: str = "frac") -> DataFrame:
    """``(by, idx, a, b)``: values of two configurations for the requests that both have."""
    side = lambda c, name: rows.where(F.col("config") == c).select(by, "idx", F.col(value).alias(name))
    return side(a, "a").join(side(b, "b"), [by, "idx"])


def paired_difference(rows: DataFrame, a: str, b: str, value: str, by: str = "frac") -> DataFrame:
    return pairs_of(rows, a, b, value, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg(F.col("a") - F.col("b")).alias("diff"),
    )


def newcombe_rates(rates: DataFrame, a: str, b: str, by: str = "frac") -> DataFrame:
    """Difference of two configurations' rates (b - a) from tables of ``k`` and ``n``."""
    side = lambda c, x: rates.where(F.col("config") == c).select(
        by, F.col("k").alias(f"k_{x}"), F.col("n").alias(f"n_{x}")
    )
    both = side(a, "a").join(side(b, "b"), by).withColumn(
        "d", stats.newcombe(F.col("k_a"), F.col("n_a"), F.col("k_b"), F.col("n_b"))
    )
    return both.select(
        by,
        "k_a",
        "n_a",
        "k_b",
        "n_b",
        "d.diff",
        "d.lo",
        "d.hi",
        stats.separated(F.col("d.lo"), F.col("d.hi")).alias("separated"),
    )


def paired_series(outcomes: DataFrame, judged: DataFrame) -> DataFrame:
    """``(quantity, config, frac, idx, value)``: costs, halved effective scores, and latencies without each run's first row by ``idx``."""
    good = succeeded(outcomes)
    first = good.groupBy(*RUN).agg(F.min("idx").alias("_first"))
    of = lambda rows, quantity, value: rows.select(
        F.lit(quantity).alias("quantity"), *RUN, "idx", value.cast("double").alias("value")
    )
    scores = effective_score(F.col("identical"), F.col("judge1_score")) / 2
    rows = of(good, "cost", F.col("cost_usd")).unionByName(of(judged, "quality", scores))
    return rows.unionByName(
        of(good.join(first, RUN).where("idx <> _first"), "p99", F.col("latency_ms"))
    ).where("value IS NOT NULL")


def comparison_pairs(series: DataFrame, specs=COMPARISONS) -> DataFrame:
    """``(id, a, b, frac, quantity, seed, idx, x, y)``: what both configurations of each paired comparison have for a request."""
    table = [(i, a, b, q) for i, a, b, q in specs if q != "fhr"]
    spec = F.broadcast(series.sparkSession.createDataFrame(table, "id string, a string, b string, quantity string"))
    x = series.join(spec, "quantity").where("config = a").select(
        "id", "a", "b", "frac", "quantity", "idx", F.col("value").alias("x")
    )
    y = series.join(spec, "quantity").where("config = b").select("id", "frac", "idx", F.col("value").alias("y"))
    seed = stats.derive_seed(F.col("frac"), F.concat_ws("-vs-", "a", "b"), F.col("quantity"))
    return x.join(y, ["id", "frac", "idx"]).withColumn("seed", seed)


def comparison_points(outcomes: DataFrame, judged: DataFrame, specs=COMPARISONS) -> DataFrame:
    """What needs no resampling of each comparison: seeds, shared rows and differences, and score intervals of false-hit rates."""
    pairs = comparison_pairs(paired_series(outcomes, judged), specs)
    pairs, names = cut_lineage(pairs), ["id", "a", "b", "frac", "quantity", "seed"]
    mean = F.avg("x") - F.avg("y")
    paired = pairs.groupBy(*names).agg(F.count(F.lit(1)).alias("n_shared"), mean.alias("_m"))
    for side in ("x", "y"):
        tail = stats.exact_percentiles(pairs.where("quantity = 'p99'"), ["id", "frac"], side, (0.99,))
        paired = paired.join(tail.select("id", "frac", F.get("p", F.lit(0)).alias(f"_{side}")), ["id", "frac"], "left")
    paired = paired.withColumn("_p", F.col("_x") - F.col("_y"))
    none = lambda t: F.lit(None).cast(t)
    diff = F.when(F.col("quantity") == "p99", F.col("_p")).otherwise(F.col("_m"))
    empty = {
        "k_a": "long",
        "n_a": "long",
        "k_b": "long",
        "n_b": "long",
        "lo": "double",
        "hi": "double",
        "separated": "boolean",
    }
    out = paired.select(
        "id",
        "a",
        "b",
        "frac",
        "quantity",
        F.lit("paired").alias("method"),
        "seed",
        "n_shared",
        diff.alias("diff"),
        *(none(t).alias(c) for c, t in empty.items())
    )
    rates = false_hits(judged, outcomes).select(*RUN, F.least("k", "n").alias("k"), "n")
    for i, a, b, q in specs:
        if q == "fhr":
            told = newcombe_rates(rates, a, b)
            label = [F.lit(x).alias(c) for c, x in (("id", i), ("a", a), ("b", b))]
            out = out.unionByName(
                told.select(
                    *label,
                    "frac",
                    F.lit(q).alias("quantity"),
                    F.lit("newcombe").alias("method"),
                    none("long").alias("seed"),
                    none("long").alias("n_shared"),
                    "diff",
                    *empty
                )
            )
    return out.withColumn("id", F.concat_ws("-", "id", "frac"))


def comparisons(
    outcomes: DataFrame, judged: DataFrame, specs=COMPARISONS, replicates: int = stats.REPLICATES
) -> DataFrame:
    """``comparison_points`` with bootstrap intervals for the paired ones, for series of any length.

    ``n`` counts the rows behind each: shared requests, or the denominators of both rates. Means take Poisson weights,
    percentiles multinomial counts. ``published_comparisons`` gives the published index marks.
    """
    keys = ["id", "frac"]
    pairs = comparison_pairs(paired_series(outcomes, judged), specs)
    means = stats.poisson_bootstrap(
        pairs.where("quantity <> 'p99'").withColumn("diff", F.col("x") - F.col("y")), keys, "diff", "idx", replicates
    )
    tails = stats.paired_percentile_bootstrap(pairs.where("quantity = 'p99'"), keys, "x", "y", "seed", 99, replicates)
    told = means.select(*keys, "lo", "hi").unionByName(tails.select(*keys, "lo", "hi"))
    told = told.select(F.concat_ws("-", *keys).alias("id"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    out = comparison_points(outcomes, judged, specs).join(told, "id", "left").withColumns(
        {"lo": F.coalesce("lo", "_lo"), "hi": F.coalesce("hi", "_hi")}
    )
    rows = F.coalesce("n_shared", F.col("n_a") + F.col("n_b"))
    return out.withColumns({"separated": stats.separated(F.col("lo"), F.col("hi")), "n": rows}).drop("_lo", "_hi")


def published_comparisons(
    outcomes: DataFrame, judged: DataFrame, specs=COMPARISONS, replicates: int = stats.REPLICATES
) -> DataFrame:
    """``(id, frac, diff, lo, hi, idx_sha, n, separated)`` by the published index streams, for series of up to ``stats.EXACT_ROWS`` pairs."""
    pairs = comparison_pairs(paired_series(outcomes, judged), specs)
    keys = ["id", "frac"]
    means = stats.paired_bootstrap(pairs.where("quantity <> 'p99'"), keys, "x", "y", "idx", "seed", "mean", replicates)
    return means.unionByName(
        stats.paired_bootstrap(pairs.where("quantity = 'p99'"), keys, "x", "y", "idx", "seed", "p99", replicates)
    )


def reconcile_exact(replay: DataFrame, cache_run: DataFrame, by: str = "frac") -> DataFrame:
    """Exact hits that the replay makes available, those a cache run observed, and those its semantic tier absorbed."""
    available = replay.where("is_hit").select(by, "idx")
    seen = cache_run.select(by, "idx", "kind")
    return available.join(seen, [by, "idx"], "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("available"),
        F.count_if(F.col("kind") == "cache_exact").alias("observed"),
        F.count_if(F.coalesce(F.col("kind"), F.lit("")) != "cache_exact").alias("absorbed"),
    )
