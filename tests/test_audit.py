"""The audit's parsers on texts as people write them."""

from sluice.operators import audit

TEXT = """# Results

All 3 runs. The cache is cheaper than the baseline. It took 2.5 hours. Nothing else
is said here (cascade and heuristic).

## low duplicate fraction

| config | cost | hit rate |
|:--|--:|---|
| cache | 1.25 (95% boot 1.10-1.40) | 0.3050 (61 of 200) [0.2453-0.3721] |
| baseline | 2 | - |
| short |

The cascade is faster than the heuristic run, 0.4 [0.1, 0.7].

| not a table |
| config | p99 |
|---|---|
| cache | 12.5 ms | stray |

## high duplicate fraction
The cascade costs less than the baseline! `Heuristic` routing beats the cache.
![a](x.svg)
"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_cells_by_their_headers(spark):
    lines = audit.sections(docs(spark, TEXT, None, "", "| a |\n|---|"), r"^## (\w+)")
    got = {(r["section"], r["name"], r["column"]): r["cell"] for r in audit.cells(lines).collect()}
    assert got == {
        ("low", "cache", "cost"): "1.25 (95% boot 1.10-1.40)", ("low", "cache", "hit rate"): "0.3050 (61 of 200) [0.2453-0.3721]",
        ("low", "baseline", "cost"): "2", ("low", "baseline", "hit rate"): "-", ("low", "cache", "p99"): "12.5 ms",
    }
    typed = {(r["name"], r["column"]): (r["number"], r["lo"], r["hi"], r["k"], r["n"]) for r in audit.typed(audit.cells(lines)).collect()}
    assert typed == {
        ("cache", "cost"): (1.25, 1.10, 1.40, None, None), ("cache", "hit rate"): (0.305, 0.2453, 0.3721, 61, 200),
        ("baseline", "cost"): (2.0, None, None, None, None), ("baseline", "hit rate"): (None,) * 5, ("cache", "p99"): (12.5, None, None, None, None),
    }


def test_cells_against_a_table(spark):
    found = audit.typed(audit.cells(audit.sections(docs(spark, TEXT, TEXT.replace("| 2 |", "| 3 |")), r"^## (\w+)")))
    actual = spark.createDataFrame(
        [("low", "cache", "cost", "number", 1.25, 1e-4), ("low", "cache", "cost", "lo", 1.1, 1e-4), ("low", "cache", "cost", "hi", 1.5, 1e-4),
         ("low", "cache", "hit rate", "number", 0.305, 1e-4), ("low", "cache", "hit rate", "lo", 0.2453, 1e-4), ("low", "cache", "hit rate", "hi", 0.3721, 1e-4),
         ("low", "cache", "hit rate", "k", 61.0, 0.0), ("low", "cache", "hit rate", "n", 201.0, 0.0), ("low", "baseline", "cost", "number", 2.0, 1e-4)],
        "section string, name string, column string, field string, value double, tolerance double",
    )
    wrong = {(r["doc_id"], r["name"], r["column"], r["field"], r["actual"]) for r in audit.figure_mismatches(found, actual, ["section", "name"]).collect()}
    both = {(d, *x) for d in ("d0", "d1") for x in (("cache", "cost", "hi", 1.5), ("cache", "hit rate", "n", 201.0), ("cache", "p99", "number", None))}
    assert wrong == both | {("d1", "baseline", "cost", "number", 2.0)}
    differ = audit.disagreements(found, ["section", "name"]).collect()
    assert [(r["name"], r["column"], r["low"], r["high"]) for r in differ] == [("baseline", "cost", 2.0, 3.0)]


def test_sentences_that_compare(spark):
    found = audit.sentences(docs(spark, TEXT, None, "\n\n"))
    bodies = [r["body"] for r in found.orderBy("sentence").collect()]
    assert bodies == [
        "All 3 runs.", "The cache is cheaper than the baseline.", "It took 2.5 hours.", "Nothing else is said here (cascade and heuristic).",
        "The cascade is faster than the heuristic run, 0.4 [0.1, 0.7].", "The cascade costs less than the baseline!", "`Heuristic` routing beats the cache.",
    ]
    names = {"cache": "cache", "baseline": "baseline", "cascade": "router_cascade", "heuristic": "router_heuristic"}
    known = spark.createDataFrame([("baseline", "cache")], "a string, b string")
    got = {(r["a"], r["b"]) for r in audit.unregistered_comparisons(found, known, names).collect()}
    assert got == {("baseline", "router_cascade"), ("cache", "router_heuristic")}


def test_percentages_of_runs(spark):
    runs = spark.createDataFrame(
        [("baseline", "low", 10.0, 0.0, 0, 0, 90, 10), ("cache", "low", 4.0, 0.5, 30, 15, 90, 10)],
        "config string, frac string, cost_usd double, hit_rate double, n_exact long, n_semantic long, n_ok long, n_errors long",
    )
    swept = spark.createDataFrame([(0.25, 0.75)], "false_hit_rate double, recall double")
    more = spark.createDataFrame([(0.11,)], "value double")
    got = {round(r["value"], 6) for r in audit.known_percentages(runs, swept, rates=more, shares=more).collect()}
    assert got == {0.0, 50.0, 30.0, round(200 / 3, 6), 60.0, 25.0, 75.0, 11.0, 2.0, 5.0}
