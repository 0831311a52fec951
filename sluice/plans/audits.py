"""Queries of the audit; importing this completes the other modules of queries.

Reports are rendered as Markdown from the runs' figures, some of them changed by a hash of their place, as texts go out of
date; the audit reads nothing but the texts. Every query gives what is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import py_round
from ..operators import audit, metrics, tuning
from ..sources import surrogate, tables
from ..sources.surrogate import load
from . import catalog, runs
from .catalog import ORACLE, QUERIES, query, rounded

__all__ = ["ORACLE", "QUERIES"]

DOCS = ("README", "REPORT")
#: Columns of the headline table: (name, metric, places, tolerance).
HEADLINE = (("cost", "cost_usd", 4, 1e-4), ("p50", "p50_ms", 1, 0.06), ("p95", "p95_ms", 1, 0.06), ("p99", "p99_ms", 1, 0.06), ("hit rate", "hit_rate", 4, 1e-4))
NAMES = {"cache": "cache", "baseline": "baseline", "cascade": "router_cascade", "heuristic": "router_heuristic"}


def _stale(*place) -> Column:
    """Whether the text at a place is out of date."""
    mark = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in place))
    return F.substring(F.md5(mark.cast("binary")), 1, 1).isin("0", "1")


def _stale_sql(*place: str) -> str:
    return f"substr(md5({chr(39)}{chr(39)} || " + " || '|' || ".join(place) + "), 1, 1) IN ('0', '1')"


def _said(value: Column, places: int, stale: Column) -> Column:
    return F.format_string(f"%.{places}f", py_round(value, places) + F.when(stale, 1.0).otherwise(0.0))


def _runs(spark, d) -> DataFrame:
    m = rounded(metrics.run_metrics(surrogate.outcomes(spark, d)))
    rates = catalog.hit_rate_wilson(spark, d).select("config", "frac", "k", "n", "lo", "hi")
    return tables.cut_lineage(m.join(rates, ["config", "frac"]).where("p50_ms IS NOT NULL"))


def _joined(rows: DataFrame, by: str, order: str, line: Column) -> DataFrame:
    """A text of each group's lines; a report has a line for each run."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.struct(order, line.alias("l"))))["l"], "\n").alias("lines"))


def reports(spark, d) -> DataFrame:
    """``(doc_id, text)``: the headline tables of both fractions, cost-weighted thresholds, verdicts, figures and sentences."""
    doc, r = F.col("doc_id"), _runs(spark, d)
    each = r.select("*", F.explode(F.array(*map(F.lit, DOCS))).alias("doc_id"))
    old = lambda c, f="number": _stale(doc, F.col("frac"), F.col("config"), c, f)
    shown = [_said(F.col(m), places, old(c)) for c, m, places, _ in HEADLINE]
    k = (F.col("k") + F.when(old("hit rate", "k"), 1).otherwise(0)).cast("string")
    shown[-1] = F.concat(shown[-1], F.lit(" ("), k, F.lit(" of "), F.col("n"), F.lit(") [95% "), _said(F.col("lo"), 4, old("hit rate", "lo")),
                         F.lit("-"), _said(F.col("hi"), 4, old("hit rate", "hi")), F.lit("]"))
    row = F.concat(F.lit("| "), F.col("config"), F.lit(" | as run | "), F.concat_ws(" | ", *shown), F.lit(" |"))
    figure = F.when(~_stale(doc, F.col("frac"), F.col("config"), "figure"), F.concat(F.lit("![latency](latency_"), "config", F.lit("_"), "frac", F.lit(".svg)")))
    parts = each.withColumn("key", F.concat_ws("/", "doc_id", "frac"))
    text = _joined(parts, "key", "config", row).join(_joined(parts, "key", "config", F.coalesce(figure, F.lit(""))).withColumnRenamed("lines", "figures"), "key")
    header = f"| config | recipe | {' | '.join(c for c, *_ in HEADLINE)} |\n|---|---|{'---:|' * len(HEADLINE)}\n"
    frac = F.split("key", "/")[1]
    section = F.concat(F.lit("## "), frac, F.lit(" duplicate fraction\n\nAll runs of the half.\n\n"), F.lit(header), "lines", F.lit("\n\n"), "figures", F.lit("\n"))
    sections = text.select(F.split("key", "/")[0].alias("doc_id"), frac.alias("frac"), section.alias("text"))
    whole = sections.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("frac", "text")))["text"], "\n").alias("text"))

    chosen = catalog.cost_weighted_threshold(spark, d).select("r", "threshold", "fp", F.explode(F.array(*map(F.lit, DOCS))).alias("doc_id"))
    line = F.concat(F.lit("| "), "r", F.lit(" | "), _said(F.col("threshold"), 3, _stale(doc, "r", F.col("r"))), F.lit(" | "), "fp", F.lit(" |"))
    chosen = _joined(chosen, "doc_id", "r", line).withColumnRenamed("lines", "chosen")
    diff = catalog.newcombe_diff(spark, d).select("*", F.explode(F.array(*map(F.lit, DOCS))).alias("doc_id"))
    verdict = F.when(F.col("separated") != _stale(doc, F.col("frac"), "claim"), "separated").otherwise("not separated")
    told = _joined(diff, "doc_id", "frac", F.concat(F.lit("| "), "frac", F.lit(" | "), verdict, F.lit(" |"))).withColumnRenamed("lines", "verdicts")
    names = list(NAMES)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    said = [
        F.concat(F.lit(f"The {a} run is cheaper than the {b} run"), F.when(_stale(doc, a, b, "interval"), " [0.1, 0.2]").otherwise(""), F.lit("."))
        for a, b in pairs
    ]
    out = whole.join(chosen, "doc_id").join(told, "doc_id")
    return tables.cut_lineage(out.select("doc_id", F.concat(
        F.lit("# Results\n\n"), "text", F.lit("\n## Cost-weighted thresholds\n\n| r | threshold | false hits |\n|--:|--:|--:|\n"), "chosen",
        F.lit("\n\n## Hit rates\n\n| fraction | verdict |\n|---|---|\n"), "verdicts", F.lit("\n\n## In words\n\n"), F.concat_ws(" ", *said), F.lit("\n"),
    ).alias("text")))


def _typed(spark, d) -> DataFrame:
    lines = audit.sections(reports(spark, d), r"^## (\w+)")
    return tables.cut_lineage(audit.typed(audit.cells(lines)))


def _actual(spark, d, fields: tuple[str, ...]) -> DataFrame:
    cell = lambda column, field, value, tolerance: F.struct(
        F.lit(column).alias("column"), F.lit(field).alias("field"), F.col(value).cast("double").alias("value"), F.lit(tolerance).alias("tolerance")
    )
    known = [cell(c, "number", m, t) for c, m, _, t in HEADLINE] if "number" in fields else []
    known += [cell("hit rate", f, f, 1e-4 if f in ("lo", "hi") else 0.0) for f in fields if f != "number"]
    return _runs(spark, d).select(F.col("frac").alias("section"), F.col("config").alias("name"), F.explode(F.array(*known)).alias("c")).select("section", "name", "c.*")


_R = f"m AS ({ORACLE['run_metrics']}), hw AS ({ORACLE['hit_rate_wilson']}), r AS (SELECT m.*, hw.k, hw.n, hw.lo, hw.hi FROM m JOIN hw USING (config, frac) WHERE p50_ms IS NOT NULL), docs AS (SELECT unnest(['README', 'REPORT']) AS doc_id)"


def _cells_sql(parts: list[tuple[str, str, str, int]]) -> str:
    """Cells ``(column, field, value, places)`` as they are claimed and as they are."""
    each = [
        f"SELECT doc_id, frac AS section, config AS name, '{c}' AS \"column\", '{f}' AS field, printf('%.{p}f', {v}::DOUBLE + 0e0)::DOUBLE + CASE WHEN {_stale_sql('doc_id', 'frac', 'config', repr(c), repr(f))} THEN 1 ELSE 0 END AS claimed, {v}::DOUBLE AS actual FROM r, docs"
        for c, f, v, p in parts
    ]
    return " UNION ALL ".join(each)


_NUMBERS = _cells_sql([(c, "number", m, p) for c, m, p, _ in HEADLINE])
_ENDS = _cells_sql([("hit rate", "lo", "lo", 4), ("hit rate", "hi", "hi", 4), ("hit rate", "k", "k", 0)])
_WRONG = "SELECT doc_id, section, name, \"column\", field, round(claimed, 6) AS claimed, round(actual, 6) AS actual FROM c WHERE abs(claimed - actual) > 5e-1"


@query(f"WITH {_R}, c AS ({_NUMBERS}) {_WRONG}")
def audit_headline_cells(spark, d):
    found = _typed(spark, d).where(F.col("column").isin(*(c for c, *_ in HEADLINE)))
    return rounded(audit.figure_mismatches(found, _actual(spark, d, ("number",)), ["section", "name"], ("number",)))


@query(f"WITH {_R}, c AS ({_ENDS}) {_WRONG}")
def audit_interval_cells(spark, d):
    """Both ends of intervals, and counts, as cells state them."""
    found = _typed(spark, d).where("column = 'hit rate'")
    return rounded(audit.figure_mismatches(found, _actual(spark, d, ("lo", "hi", "k", "n")), ["section", "name"], ("lo", "hi", "k", "n")))


@query(f"WITH {_R}, c AS ({_NUMBERS}) SELECT section, name, \"column\", count(DISTINCT doc_id)::BIGINT AS n_docs, round(min(claimed), 6) AS low, round(max(claimed), 6) AS high FROM c GROUP BY section, name, \"column\" HAVING min(claimed) <> max(claimed)")
def audit_documents_agree(spark, d):
    """Figures that the two reports state differently."""
    found = _typed(spark, d).where(F.col("column").isin(*(c for c, *_ in HEADLINE)))
    return rounded(audit.disagreements(found, ["section", "name"]))


@query(f"WITH w AS ({ORACLE['cost_weighted_threshold']}) SELECT doc_id, r, round(threshold + 1, 6) AS claimed, round(threshold, 6) AS actual FROM w, unnest(['README', 'REPORT']) u(doc_id) WHERE {_stale_sql('doc_id', repr('r'), 'r')}")
def audit_cost_table(spark, d):
    """Thresholds of the cost-weighted table, by its header's names."""
    lines = audit.sections(reports(spark, d), r"^## (.*)")
    found = audit.typed(audit.cells(lines).where("section = 'Cost-weighted thresholds' AND column = 'threshold'"))
    actual = catalog.cost_weighted_threshold(spark, d).select(
        F.col("r").cast("string").alias("name"), F.lit("threshold").alias("column"), F.lit("number").alias("field"), F.col("threshold").alias("value"), F.lit(1e-4).alias("tolerance")
    )
    wrong = audit.figure_mismatches(found, actual, ["name"], ("number",))
    return rounded(wrong.select("doc_id", F.col("name").cast("long").alias("r"), "claimed", "actual"))


@query(f"WITH n AS ({ORACLE['newcombe_diff']}) SELECT doc_id, frac, NOT separated AS separated, round(lo, 6) AS lo, round(hi, 6) AS hi FROM n, unnest(['README', 'REPORT']) u(doc_id) WHERE {_stale_sql('doc_id', 'frac', repr('claim'))}")
def audit_verdicts(spark, d):
    """Verdicts that the registered intervals do not bear out."""
    lines = audit.sections(reports(spark, d), r"^## (.*)")
    said = audit.cells(lines).where("section = 'Hit rates' AND column = 'verdict'").select(
        "doc_id", F.col("name").alias("frac"), (F.col("cell") == "separated").alias("separated")
    )
    known = catalog.newcombe_diff(spark, d).select("frac", "lo", "hi")
    return audit.verdict_mismatches(said.join(known, "frac"), F.col("lo"), F.col("hi")).select("doc_id", "frac", "separated", "lo", "hi")


_NAMED = ", ".join(f"{{'w': '{w}', 'c': '{c}', 'i': {i}}}" for i, (w, c) in enumerate(NAMES.items()))
_KNOWN = ", ".join(f"'{min(a, b)}|{max(a, b)}'" for _, a, b, _ in metrics.COMPARISONS)


@query(f"WITH nm AS (SELECT unnest([{_NAMED}], recursive := true)), p AS (SELECT doc_id, x.w AS x, y.w AS y, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b FROM nm x JOIN nm y ON x.i < y.i, unnest(['README', 'REPORT']) u(doc_id)) SELECT doc_id, a, b FROM p WHERE a || '|' || b NOT IN ({_KNOWN}) AND NOT ({_stale_sql('doc_id', 'x', 'y', repr('interval'))})")
def audit_comparisons(spark, d):
    """Sentences that compare runs without an interval and beyond the registered comparisons."""
    found = audit.sentences(reports(spark, d))
    registered = spark.createDataFrame([(a, b) for _, a, b, _ in metrics.COMPARISONS], "a string, b string")
    return audit.unregistered_comparisons(found, registered, NAMES).select("doc_id", "a", "b")


@query(f"WITH {_R}, f AS (SELECT config, frac, 'latency_' || config || '_' || frac || '.svg' AS name FROM r), s AS (SELECT DISTINCT name FROM f, docs WHERE NOT ({_stale_sql('doc_id', 'frac', 'config', repr('figure'))})), k AS (SELECT name FROM f WHERE config <> 'baseline' UNION ALL SELECT 'old.svg') SELECT name, 'dangling' AS problem FROM s WHERE name NOT IN (SELECT name FROM k) UNION ALL SELECT name, 'orphan' FROM k WHERE name NOT IN (SELECT name FROM s)")
def audit_figures(spark, d):
    """Figures that the reports show and that were drawn, which the baseline's were not."""
    files = _runs(spark, d).where("config <> 'baseline'").select(F.concat(F.lit("latency_"), "config", F.lit("_"), "frac", F.lit(".svg")).alias("name"))
    return audit.loose_references(reports(spark, d), files.unionByName(spark.createDataFrame([("old.svg",)], "name string")))


_PAIRS = f"""SELECT DISTINCT k::BIGINT AS k, n::BIGINT AS n FROM (
  SELECT unnest([n_exact + n_semantic, n_exact, n_exact, n_ok]) AS k, unnest([n_ok, greatest(n_exact + n_semantic, 1), n_ok + n_errors, n_ok + n_errors]) AS n FROM ({ORACLE['run_metrics']})
  UNION ALL SELECT k, n FROM ({ORACLE['false_hit_wilson']})
  UNION ALL SELECT n_scored, n_ok FROM ({ORACLE['quality_by_config']}) JOIN ({ORACLE['run_metrics']}) USING (config, frac)
  UNION ALL SELECT unnest([score_0, judged]), unnest([judged, n_ok]) FROM ({ORACLE['exact_proxy']}) JOIN ({ORACLE['run_metrics']}) USING (config, frac) WHERE judged > 0
  UNION ALL SELECT unnest([tp, fp]), unnest([tp + fp + fn + tn, tp + fp]) FROM ({ORACLE['best_f1_threshold']})
  UNION ALL SELECT s.fp, s.fp + s.tp FROM ({ORACLE['cost_weighted_threshold']}) w JOIN ({ORACLE['threshold_sweep']}) s USING (threshold)
  UNION ALL SELECT n, n FROM ({ORACLE['kappa_judges']}) WHERE n > 0
  UNION ALL SELECT unnest([ceil(5e-1 * total)::BIGINT, filled]), unnest([total, total]) FROM ({ORACLE['label_coverage']}) WHERE total > 0) WHERE k IS NOT NULL AND n IS NOT NULL"""


def _known_pairs(spark, d) -> DataFrame:
    swept = tables.cut_lineage(tuning.sweep(catalog._best(spark, d), catalog.GRID))
    weighted = tuning.cost_weighted(swept).select("threshold").join(swept.select("threshold", "tp", "fp"), "threshold")
    return audit.all_known_pairs(
        metrics.run_metrics(surrogate.outcomes(spark, d)), catalog.false_hit_wilson(spark, d), catalog.quality_by_config(spark, d),
        catalog.exact_proxy(spark, d), tuning.best_f1(swept.withColumn("f1", F.round("f1", 12))), weighted, catalog.kappa_judges(spark, d), catalog.label_coverage(spark, d),
    )


@query(_PAIRS)
def audit_known_pairs(spark, d):
    return _known_pairs(spark, d)


@query(f"WITH kn AS ({_PAIRS}), c AS ({ORACLE['audit_numbers']}) SELECT doc_id, claim FROM c WHERE kind = 'pair' AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.k = try_cast(regexp_extract(claim, '([0-9]+) of ([0-9]+)', 1) AS BIGINT) AND kn.n = try_cast(regexp_extract(claim, '([0-9]+) of ([0-9]+)', 2) AS BIGINT))")
def audit_unsupported_pairs(spark, d):
    return audit.unsupported_pairs(audit.claims(load(spark, d, "documents")), _known_pairs(spark, d)).select("doc_id", "claim")


_SHARES = ", ".join(repr(x) + "e0" for shares in runs.FRACTIONS.values() for x in shares)
_PERCENTS = f"""SELECT DISTINCT round(v, 6) AS value FROM (
  SELECT unnest([hit_rate, n_exact::DOUBLE / nullif(n_ok + n_errors, 0), n_exact::DOUBLE / nullif(n_exact + n_semantic, 0), CASE WHEN m.config <> 'baseline' THEN (b.c - cost_usd) / nullif(b.c, 0) END]) * 100 AS v
    FROM ({ORACLE['run_metrics']}) m LEFT JOIN (SELECT frac, cost_usd AS c FROM ({ORACLE['run_metrics']}) WHERE config = 'baseline') b USING (frac)
  UNION ALL SELECT unnest([false_hit_rate, recall]) * 100 FROM ({ORACLE['threshold_sweep']})
  UNION ALL SELECT false_hit_rate * 100 FROM ({ORACLE['false_hit_wilson']}) UNION ALL SELECT quality * 100 FROM ({ORACLE['quality_by_config']})
  UNION ALL SELECT unnest([{_SHARES}]) * 100 UNION ALL SELECT unnest([50e0, 2e0, 5e0])) WHERE v IS NOT NULL"""


def _percentages(spark, d) -> DataFrame:
    swept = catalog.threshold_sweep(spark, d)
    rates = catalog.false_hit_wilson(spark, d).select(F.col("false_hit_rate").alias("value")).unionByName(
        catalog.quality_by_config(spark, d).select(F.col("quality").alias("value"))
    )
    shares = spark.createDataFrame([(x,) for shares in runs.FRACTIONS.values() for x in shares], "value double")
    m = rounded(metrics.run_metrics(surrogate.outcomes(spark, d)))
    return rounded(audit.known_percentages(m, swept, rates=rates, shares=shares)).distinct()


@query(_PERCENTS)
def audit_known_percentages(spark, d):
    return _percentages(spark, d)


@query(f"WITH kn AS ({_PERCENTS}), c AS (SELECT *, regexp_extract(claim, '([0-9]+(?:\\.[0-9]+)?)%', 1) AS s FROM ({ORACLE['audit_numbers']}) WHERE kind = 'percent') SELECT doc_id, claim FROM c WHERE NOT EXISTS (SELECT 1 FROM kn WHERE abs(kn.value - s::DOUBLE) <= 5e-1 * pow(10, -CASE WHEN contains(s, '.') THEN length(split_part(s, '.', 2)) ELSE 0 END) + 2e-2)")
def audit_unsupported_percentages(spark, d):
    told = audit.unsupported_percentages(audit.claims(load(spark, d, "documents")), _percentages(spark, d))
    return told.select("doc_id", "claim")
