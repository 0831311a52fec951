"""Audit: what documents claim, against what tables hold. Every check gives the rows that are wrong, so none is good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_OF_N, PERCENT = r"([0-9]+) of ([0-9]+)", r"([0-9]+(?:\.[0-9]+)?)%"
INTERVAL = r"([0-9]+\.[0-9]+)-([0-9]+\.[0-9]+)"
#: What a stated percentage may be off beyond half its last decimal.
SLACK = 0.02


def claims(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kind, claim)``: every ``k of n`` and ``N%`` in the texts, repeats included; null texts claim nothing."""

    def found(pattern: str, kind: str) -> DataFrame:
        each = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(kind).alias("kind"), each.alias("claim"))

    return found(K_OF_N, "pair").unionByName(found(PERCENT, "percent"))


def known_pairs(metrics: DataFrame) -> DataFrame:
    """``(k, n)``: counts and denominators that documents may state of each run (``n_ok, n_errors, n_exact, n_semantic``)."""
    hits, rows = F.col("n_exact") + F.col("n_semantic"), F.col("n_ok") + F.col("n_errors")
    pairs = (
        (hits, F.col("n_ok")),
        (F.col("n_exact"), F.greatest(hits, F.lit(1))),
        (F.col("n_exact"), rows),
        (F.col("n_ok"), rows),
    )
    each = F.array(*(F.struct(k.cast("long").alias("k"), n.cast("long").alias("n")) for k, n in pairs))
    return metrics.select(F.explode(each).alias("p")).select("p.*").where("k IS NOT NULL AND n IS NOT NULL").distinct()


def pairs_of(rows: DataFrame, *pairs: tuple) -> DataFrame:
    """``(k, n)`` of each row's pairs of columns, once each; those with a null are none."""
    each = F.array(*(F.struct(k.cast("long").alias("k"), n.cast("long").alias("n")) for k, n in pairs))
    return rows.select(F.explode(each).alias("p")).select("p.*").where("k IS NOT NULL AND n IS NOT NULL").distinct()


def all_known_pairs(
    metrics: DataFrame, false_hits: DataFrame, quality: DataFrame, proxy: DataFrame, tuned: DataFrame, weighted: DataFrame,
    kappa: DataFrame, labels: DataFrame, bar: float = 0.5,
) -> DataFrame:
    """``(k, n)``: every count and denominator that documents may state.

    Of each run its hits and rows (``known_pairs``), false hits over semantic hits (``k, n``), judged rows (``n_scored``) over rows, and
    of the proxy judged rows over rows and score 0 over judged ones; of the chosen threshold (``tp, fp, fn, tn``) true hits over all and
    false ones over hits; false ones over hits of each cost-weighted choice (``tp, fp``); the judges' pairs (``n``); and of
    people's labels (``filled, total``) what is there and what the bar asks for.
    """
    run, c = ["config", "frac"], F.col
    rows = metrics.select(*run, "n_ok")
    all_tuned = c("tp") + c("fp") + c("fn") + c("tn")
    parts = [
        known_pairs(metrics),
        pairs_of(false_hits, (c("k"), c("n"))),
        pairs_of(quality.join(rows, run), (c("n_scored"), c("n_ok"))),
        pairs_of(proxy.join(rows, run).where("judged > 0"), (c("score_0"), c("judged")), (c("judged"), c("n_ok"))),
        pairs_of(tuned, (c("tp"), all_tuned), (c("fp"), c("tp") + c("fp"))),
        pairs_of(weighted, (c("fp"), c("fp") + c("tp"))),
        pairs_of(kappa.where("n > 0"), (c("n"), c("n"))),
        pairs_of(labels.where("total > 0"), (F.ceil(F.lit(bar) * c("total")), c("total")), (c("filled"), c("total"))),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


def known_percentages(
    metrics: DataFrame, swept: DataFrame, bars: tuple[float, ...] = (50.0, 2.0, 5.0), rates: DataFrame | None = None, shares: DataFrame | None = None
) -> DataFrame:
    """``value``: percentages that documents may state: rates of runs, what they save, rates of the sweep, and bars.

    ``rates`` has more rates of runs (``value``, as shares of one: false hits, quality), ``shares`` those of a workload.
    """
    more = [x.select((F.col("value") * 100).alias("value")) for x in (rates, shares) if x is not None]
    base = metrics.where("config = 'baseline'").select("frac", F.col("cost_usd").alias("_base"))
    hits, rows = F.col("n_exact") + F.col("n_semantic"), F.col("n_ok") + F.col("n_errors")
    saved = F.when(
        (F.col("config") != "baseline") & (F.col("_base") != 0), (F.col("_base") - F.col("cost_usd")) / F.col("_base")
    )
    of_run = F.array(
        F.col("hit_rate"),
        F.col("n_exact") / F.nullif(rows, F.lit(0)),
        F.col("n_exact") / F.nullif(hits, F.lit(0)),
        saved,
    )
    percent = lambda rows, each: rows.select(F.explode(each).alias("value")).select((F.col("value") * 100).alias("value"))
    of_runs = percent(metrics.join(base, "frac", "left"), of_run)
    of_sweep = percent(swept, F.array("false_hit_rate", "recall"))
    fixed = metrics.sparkSession.createDataFrame([(float(b),) for b in bars], "value double")
    out = of_runs.unionByName(of_sweep).unionByName(fixed)
    for x in more:
        out = out.unionByName(x)
    return out.where("value IS NOT NULL").distinct()


def unsupported_pairs(claimed: DataFrame, known: DataFrame) -> DataFrame:
    """Claims ``k of n`` that ``known`` (``k, n``) doesn't hold. Numbers beyond 64 bits are held by no table."""
    part = lambda i: F.regexp_extract("claim", K_OF_N, i).try_cast("long")
    return claimed.where("kind = 'pair'").withColumns({"k": part(1), "n": part(2)}).join(
        known.select("k", "n").distinct(), ["k", "n"], "left_anti"
    )


def unsupported_percentages(claimed: DataFrame, known: DataFrame) -> DataFrame:
    """Claims ``N%`` with no known percentage (``value``) within half of the last stated decimal and ``SLACK``.

    The widest tolerance is that of a whole percentage, so values meet by equal cells of that width and their neighbours:
    an equi-join in place of a comparison of all.
    """
    stated = F.regexp_extract("claim", PERCENT, 1)
    decimals = F.length(F.regexp_extract("claim", r"\.([0-9]+)%", 1))
    told = claimed.where("kind = 'percent'").withColumns(
        {"value": stated.cast("double"), "tolerance": 0.5 * F.pow(F.lit(10.0), -decimals) + SLACK}
    )
    cell = lambda c: F.floor(c / (0.5 + SLACK))
    near = known.select(
        F.col("value").alias("known_value"),
        F.explode(F.array(*(cell(F.col("value")) + i for i in (-1, 0, 1)))).alias("_cell")
    )
    match = (F.col("a._cell") == F.col("b._cell")) & (
        F.abs(F.col("a.value") - F.col("b.known_value")) <= F.col("a.tolerance")
    )
    return told.withColumn("_cell", cell(F.col("value"))).alias("a").join(
        near.distinct().alias("b"), match, "left_anti"
    ).drop("_cell")


def table_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line, cells)`` of each line of a pipe table: trimmed cells between its outer bars; rulers are left out."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "_l"))
    body = F.regexp_replace(F.trim("_l"), r"^\||\|$", "")
    rows = lines.where(F.trim("_l").rlike(r"^\|.*\|$") & ~F.trim("_l").rlike(r"^[|\s:-]+$"))
    return rows.select(
        "doc_id",
        F.col("line").cast("long").alias("line"),
        F.transform(F.split(body, r"\|"), lambda c: F.trim(c)).alias("cells"),
    )


def interval_of(cell: Column) -> Column:
    """``struct(lo, hi)`` of an interval such as ``0.81-1.04`` in a cell; null where there is none."""
    lo, hi = (F.regexp_extract(cell, INTERVAL, i).try_cast("double") for i in (1, 2))
    return F.when(cell.rlike(INTERVAL), F.struct(lo.alias("lo"), hi.alias("hi")))


def missing_runs(expected: DataFrame, actual: DataFrame, key: tuple[str, ...] = ("config", "frac")) -> DataFrame:
    return expected.join(actual.select(*key).distinct(), list(key), "left_anti")


def cell_mismatches(
    claimed: DataFrame, actual: DataFrame, key: list[str], value: str, tolerance: float = 1e-4
) -> DataFrame:
    """Claimed cells that differ from the table's by more than ``tolerance``, or that it lacks."""
    both = claimed.withColumnRenamed(value, "claimed").join(
        actual.select(*key, F.col(value).alias("actual")), key, "left"
    )
    return both.where(F.col("actual").isNull() | (F.abs(F.col("claimed") - F.col("actual")) > tolerance))


def verdict_mismatches(registered: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Registered comparisons whose stored ``separated`` is not what their interval says."""
    return registered.where(F.col("separated") != ((lo > 0) | (hi < 0)))


def attempted_mismatches(metrics: DataFrame) -> DataFrame:
    """Runs whose rows are not their successes and errors."""
    return metrics.where("n_rows <> coalesce(n_ok, 0) + n_errors")


def gate_registry(
    gates: DataFrame, registered: DataFrame, must_fail: tuple[str, ...] = ("human_label_coverage", "judge_independence")
) -> DataFrame:
    """``(name, problem)``: gates that are not registered, registered ones (``name``) that are absent, and those that should fail but passed."""
    told = lambda df, problem: df.select("name", F.lit(problem).alias("problem"))
    new = told(gates.join(registered, "name", "left_anti"), "not registered")
    gone = told(registered.join(gates, "name", "left_anti"), "absent")
    return new.unionByName(gone).unionByName(
        told(gates.where(F.col("name").isin(*must_fail) & F.col("passed")), "should fail")
    )


def cost_order(metrics: DataFrame) -> DataFrame:
    """Runs that cost as much as the baseline of their fraction, or more."""
    base = metrics.where("config = 'baseline'").select("frac", F.col("cost_usd").alias("baseline_cost"))
    return metrics.where("config <> 'baseline'").join(base, "frac").where("cost_usd >= baseline_cost").select(
        "config", "frac", "cost_usd", "baseline_cost"
    )


def missing_phrases(docs: DataFrame, phrases: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, phrase)`` of each phrase that a document is to hold (``phrases``: ``doc_id, phrase``) but doesn't; an absent or null document holds none."""
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    both = phrases.join(held, "doc_id", "left")
    return both.groupBy("doc_id", "phrase").agg(
        F.bool_or(F.coalesce(F.contains("_text", "phrase"), F.lit(False))).alias("_there")
    ).where("NOT _there").drop("_there")


def loose_references(docs: DataFrame, files: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures that documents show but ``files`` (``name``) lacks, and files that no document shows: ``(name, problem)``."""
    pattern = F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)")
    shown = docs.select(F.explode(F.regexp_extract_all(F.col(text), pattern, F.lit(1))).alias("name")).distinct()
    problem = F.when(F.col("name").contains("://"), "external").otherwise("dangling").alias("problem")
    gone = shown.join(files, "name", "left_anti").select("name", problem)
    return gone.unionByName(
        files.select("name").distinct().join(shown, "name", "left_anti").select(
            "name", F.lit("orphan").alias("problem")
        )
    )


def sections(docs: DataFrame, heading: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line, body, section)``: lines with the nearest line at or above that ``heading`` matches, as its first group."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).where("_t IS NOT NULL").select(
        "doc_id", F.posexplode(F.split("_t", "\n")).alias("line", "body")
    )
    named = F.when(F.col("body").rlike(heading), F.regexp_extract("body", heading, 1))
    return lines.select("doc_id", "line", "body", _above(named).alias("section"))


def _above(value: Column) -> Column:
    """The last value that is not null, from a document's start to the line. A document is bounded by what people read."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))


def cells(lines: DataFrame) -> DataFrame:
    """``(doc_id, section, line, name, column, cell)``: cells of pipe tables by the names in their header.

    A header is the line above a ruler; a row belongs to the nearest header above it with no other line than rows in between, and is named by its first
    cell. Cells beyond the header have no column and are left out. ``lines`` are those of ``sections``.
    """
    body = F.trim("body")
    bar, ruler = body.rlike(r"^\|.*\|$"), body.rlike(r"^\|[\s:|-]*-[\s:|-]*\|$")
    split = F.transform(F.split(F.regexp_replace(body, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    here = Window.partitionBy("doc_id").orderBy("line")
    rows = lines.select(
        "doc_id", "section", "line", bar.alias("bar"), ruler.alias("ruler"), F.when(bar, split).alias("parts"),
        F.coalesce(F.lead(ruler).over(here), F.lit(False)).alias("head"),
    )
    # a new table begins at each header and at each line that is no row of one
    mark = F.when(F.col("head") & F.col("bar"), F.struct("parts")).when(~F.col("bar"), F.struct(F.array().cast("array<string>").alias("parts")))
    known = rows.withColumn("names", F.last(mark, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))["parts"])
    body = known.where("bar AND NOT ruler AND NOT head AND size(names) > 0")
    each = F.posexplode(F.arrays_zip(F.slice("names", 2, 1000).alias("column"), F.slice("parts", 2, 1000).alias("cell")))
    return body.select("doc_id", "section", F.col("line").cast("long").alias("line"), F.get("parts", F.lit(0)).alias("name"), each.alias("_i", "_c")).select(
        "doc_id", "section", "line", "name", "_c.column", "_c.cell"
    ).where("column IS NOT NULL AND cell IS NOT NULL")


def typed(found: DataFrame) -> DataFrame:
    """Cells with what they say: the leading ``number``, an interval ``lo, hi`` and counts ``k`` of ``n``; null where they don't."""
    number = F.regexp_extract("cell", r"^(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    pair = lambda i: F.regexp_extract("cell", K_OF_N, i).try_cast("long")
    span = interval_of(F.col("cell"))
    return found.withColumns({"number": number, "lo": span["lo"], "hi": span["hi"], "k": pair(1), "n": pair(2)})


def figure_mismatches(
    found: DataFrame, actual: DataFrame, key: list[str], fields: tuple[str, ...] = ("number", "lo", "hi", "k", "n")
) -> DataFrame:
    """``(doc_id, key, column, field, claimed, actual)``: what typed cells say otherwise than ``actual`` (``key, column, field, value, tolerance``).

    A claim about what ``actual`` does not hold has a null ``actual``; what a cell does not say is no claim.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("claimed")) for f in fields))).alias("c")
    said = found.select("doc_id", *key, "column", each).select("doc_id", *key, "column", "c.*").where("claimed IS NOT NULL")
    both = said.join(actual, [*key, "column", "field"], "left")
    wrong = F.col("value").isNull() | (F.abs(F.col("claimed") - F.col("value")) > F.col("tolerance"))
    return both.where(wrong).select("doc_id", *key, "column", "field", "claimed", F.col("value").alias("actual"))


def disagreements(found: DataFrame, key: list[str]) -> DataFrame:
    """``(key, column, n_docs, low, high)``: figures that documents state differently under one key."""
    said = found.where("number IS NOT NULL").groupBy(*key, "column").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.min("number").alias("low"), F.max("number").alias("high")
    )
    return said.where("low <> high")


# fixed value: words by which a sentence compares
COMPARING = ("lower", "higher", "cheaper", "faster", "slower", "fewer", "more", "less", "better", "worse", "than", "beats", "versus")


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, sentence, body)``: sentences of running text, numbered from 0; headings, tables and figures are none. They end at . ! or ? before white
    space and a capital, a digit or a mark, and at blank lines."""
    kept = F.filter(F.split(F.col(text), "\n"), lambda line: ~line.rlike(r"^\s*(#|\||!\[)"))
    flat = F.regexp_replace(F.array_join(kept, "\n"), r"\n[ \t]*\n+", "\u0000")
    parts = F.split(F.regexp_replace(flat, r"\s+", " "), "\u0000|(?<=[.!?]) (?=[\\p{Lu}0-9`\"(*])")
    each = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("sentence", "body"))
    return each.withColumn("body", F.trim("body")).where("body <> ''")


def unregistered_comparisons(found: DataFrame, registered: DataFrame, names: dict[str, str], marks: str = r"\[[^\]]*,[^\]]*\]|±|not separated") -> DataFrame:
    """Sentences that compare two configurations, without an interval beside them, on a pair that no registered comparison (``a, b``) holds.

    ``names`` gives words for configurations. A sentence compares if it has a comparing word and names two of them or more. ``marks``
    matches what shows that an interval is given.
    """
    word = lambda w: rf"(?i)(?<![\w-]){w}(?![\w-])"
    who = F.array_compact(F.array(*(F.when(F.col("body").rlike(word(w)), F.lit(c)) for w, c in names.items())))
    rows = found.withColumn("who", F.array_sort(F.array_distinct(who))).where(F.size("who") >= 2)
    rows = rows.where(F.col("body").rlike(word(f"(?:{'|'.join(COMPARING)})")) & ~F.col("body").rlike(marks))
    pairs = rows.select("doc_id", "sentence", "body", F.explode("who").alias("a"), "who").select("*", F.explode("who").alias("b")).where("a < b")
    known = registered.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti").select("doc_id", "sentence", "a", "b")
