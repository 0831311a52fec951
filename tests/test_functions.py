import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import stats, text, vectors


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("k,n,lo,hi", [(0, 10, 0.0, 0.2775), (4, 45, 0.0351, 0.2073), (0, 0, 0.0, 0.0)])
def test_wilson(spark, k, n, lo, hi):
    got = one(spark, stats.wilson(F.lit(k), F.lit(n)))
    assert got["lo"] == pytest.approx(lo, abs=5e-5) and got["hi"] == pytest.approx(hi, abs=5e-5)


def test_wilson_rejects_more_hits_than_rows(spark):
    with pytest.raises(Exception, match="outside"):
        one(spark, stats.wilson(F.lit(11), F.lit(10)))


@pytest.mark.parametrize(
    "a,b,want", [((6, 86), (10, 80), (0.0552, -0.0375, 0.1527)), ((6, 44), (6, 41), (0.0100, -0.1420, 0.1659))]
)
def test_newcombe(spark, a, b, want):
    got = one(spark, stats.newcombe(*map(F.lit, (*a, *b))))
    assert tuple(got) == pytest.approx(want, abs=6e-5)


# fixed values: seeds, series lengths and the published marks of their index matrices
GOLDENS = [
    (1872326506, 237, "557b3de95315dfdf"),
    (634598869, 236, "acb3ed48153c50f7"),
    (3798808762, 238, "017e38959df88ede"),
    (497, 0, ""),
]


@pytest.mark.parametrize("seed,n,mark", GOLDENS)
def test_resampling_stream(seed, n, mark):
    assert stats.resample(np.zeros(n), seed, stats.STATS["mean"])[1] == mark


def test_seed(spark):
    assert one(spark, stats.derive_seed("low", "cost")) == int(hashlib.sha256(b"20260917|low|cost").hexdigest()[:8], 16)


def test_bootstrap_against_plain_numpy(spark):
    x = np.random.default_rng(1).normal(size=50)
    rows = spark.createDataFrame([("a", i, float(v), 9) for i, v in enumerate(x)], "g string, i long, v double, s long")
    got = stats.bootstrap_ci(rows, ["g"], "v", "i", "s", "mean", 500).first()
    m = x[np.random.default_rng(9).integers(0, 50, size=(500, 50))].mean(axis=1)
    assert (got["lo"], got["hi"]) == pytest.approx(tuple(np.percentile(m, [2.5, 97.5])))
    with pytest.raises(Exception, match="poisson"):
        old, stats.EXACT_ROWS = stats.EXACT_ROWS, 10
        try:
            stats.bootstrap_ci(rows, ["g"], "v", "i", "s").collect()
        finally:
            stats.EXACT_ROWS = old


def test_paired_bootstrap_sign(spark):
    rows = spark.createDataFrame(
        [("x", i, 2.0 + i % 3, 1.0, 5) for i in range(30)], "g string, i long, a double, b double, s long"
    )
    got = stats.paired_bootstrap(rows, ["g"], "a", "b", "i", "s", "mean", 300).first()
    assert got["diff"] == pytest.approx(2.0) and got["lo"] > 0 and got["separated"]


def test_poisson_bootstrap_covers_the_mean(spark):
    rows = spark.range(2000).select(F.lit("g").alias("g"), "id", (F.col("id") % 100).cast("double").alias("v"))
    got = stats.poisson_bootstrap(rows, ["g"], "v", "id", 200).first()
    assert got["n"] == 2000 and got["lo"] < got["mean"] < got["hi"] and got["hi"] - got["lo"] < 6


def test_percentile_bootstrap_against_resampled_rows(spark):
    x = np.random.default_rng(3).exponential(50, 3000).round(2)
    rows = spark.createDataFrame(
        [("a" if i % 2 else None, i, float(v), 9) for i, v in enumerate(x)], "g string, i long, v double, s long"
    )
    got = {
        (r["g"], r["quantity"]): r for r in stats.percentile_bootstrap(rows, ["g"], "v", "s", replicates=4000).collect()
    }
    want = {
        (r["g"], r["quantity"]): r for r in stats.bootstrap_ci(
            rows, ["g"], "v", "i", "s", "percentiles", 4000
        ).collect()
    }
    assert got.keys() == want.keys() and len(got) == 6
    for k, w in want.items():
        assert got[k]["n"] == w["n"] == 1500
        assert (got[k]["lo"], got[k]["hi"]) == pytest.approx((w["lo"], w["hi"]), abs=0.15 * (w["hi"] - w["lo"]))


def test_paired_percentile_bootstrap_against_resampled_rows(spark):
    rng = np.random.default_rng(4)
    a = rng.exponential(50, 1500)
    rows = spark.createDataFrame(
        [("x", i, float(v), float(w), 5) for i, (v, w) in enumerate(zip(a, a * 0.9 + rng.exponential(5, 1500)))],
        "g string, i long, a double, b double, s long",
    )
    got = stats.paired_percentile_bootstrap(rows, ["g"], "a", "b", "s", replicates=4000).first()
    want = stats.paired_bootstrap(rows, ["g"], "a", "b", "i", "s", "p99", 4000).first()
    assert got["diff"] == pytest.approx(want["diff"]) and got["n"] == 1500
    assert (got["lo"], got["hi"]) == pytest.approx((want["lo"], want["hi"]), abs=0.15 * (want["hi"] - want["lo"]))


def test_intervals_read_whole_series(spark):
    from sluice.operators import metrics
    from sluice.plans import catalog
    from sluice.sources import surrogate

    d = "/root/testdata/sf0.01"
    n = {
        (r["config"], r["frac"]): r["count"] for r in metrics.succeeded(
            surrogate.outcomes(spark, d)
        ).groupBy("config", "frac").count().collect()
    }
    assert {(r["config"], r["frac"]): r["n"] for r in catalog.bootstrap_ci(spark, d).collect()} == n
    warm = {(r["config"], r["frac"]): r["n"] for r in catalog.bootstrap_percentiles(spark, d).collect()}
    assert warm == {k: v - 1 for k, v in n.items()}
    compared = {r["id"]: r["n"] for r in catalog.paired_bootstrap(spark, d).collect()}
    assert min(n for i, n in compared.items() if i.startswith(("cost", "p99"))) > 500
    # few rows have scores of both configurations
    assert len(compared) == 12 and min(compared.values()) > 400
    long = spark.range(stats.EXACT_ROWS + 20_000).select(
        F.lit("g").alias("g"), (F.col("id") % 997).cast("double").alias("v"), F.lit(1).cast("long").alias("s")
    )
    got = {r["quantity"]: r for r in stats.percentile_bootstrap(long, ["g"], "v", "s", replicates=500).collect()}
    assert got["p50"]["n"] == stats.EXACT_ROWS + 20_000 and got["p50"]["lo"] <= 498 <= got["p50"]["hi"]


@pytest.mark.parametrize(
    "raw,want", [("  Hello   WORLD\n", "hello world"), ("Straße", "strasse"), ("", ""), (None, None)]
)
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize_exact(F.lit(raw).cast("string"))) == want
    assert one(spark, text.normalize_exact(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "reply,want",
    [("2", 2), ("Score: 1.", 1), ("(0) wrong", 0), ("10 of 12", None), ("x1y", 1), ("", None), (None, None)],
)
def test_parse_score(spark, reply, want):
    assert one(spark, text.parse_score(F.lit(reply).cast("string"))) == want


@pytest.mark.parametrize(
    "raw,want", [("2.0", "correct"), (" Partial ", "partial"), ("nan", None), (None, None), ("odd", "odd")]
)
def test_labels(spark, raw, want):
    assert one(spark, text.normalize_label(F.lit(raw).cast("string"))) == want


def test_unknown_label_fails(spark):
    with pytest.raises(Exception, match="not a label"):
        one(spark, text.checked_label(F.lit("mostly fine")))


@pytest.mark.parametrize("raw,want", [(None, False), ("nan", False), ("", False), ("RuntimeError: boom", True)])
def test_error_flag(spark, raw, want):
    assert one(spark, text.has_error(F.lit(raw).cast("string"))) is want


def test_completion_defaults(spark):
    got = one(spark, text.completion_fields(F.lit('{"choices": [{"message": {"content": "hi"}}]}')))
    assert (got["text"], got["tokens_in"], got["tokens_out"]) == ("hi", 0, 0)


def test_vectors(spark):
    v = one(spark, vectors.hashed_ngrams(F.lit("the cat sat"), 16))
    assert math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-9)
    assert one(spark, vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0


def test_folding_is_pythons_for_every_letter(spark):
    """Every code point, and texts of several, against ``str.casefold`` and Python's white space."""
    import re

    texts = [f"a{chr(c)}B" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["Straße İstanbul ﬁne ΑΣ ΣΑ ẞß", " \x1c a　\x85B  ", "ŉǰΐ" * 3, "", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = rows.select("i", text.fold(F.col("t")).alias("f"), text.normalize_exact(F.col("t")).alias("n"), text.is_blank(F.col("t")).alias("b")).collect()
    wrong = [(texts[r["i"]], r["f"]) for r in got if r["f"] != texts[r["i"]].casefold()]
    assert not wrong, wrong[:5]
    wrong = [(texts[r["i"]], r["n"]) for r in got if r["n"] != re.sub(r"\s+", " ", texts[r["i"]].casefold()).strip()]
    assert not wrong, wrong[:5]
    assert all(r["b"] == (not texts[r["i"]].strip()) for r in got)


def test_rounding_is_pythons(spark):
    """Half to even on the binary value."""
    r = random.Random(3)
    xs = [2.675, 0.125, -0.125, 0.375, 2.5, 3.5, -2.5, 1.005, 0.0, -0.0, 1e-30, -1e-9, 5e-324, 1e15 + 0.5, 4503599627370497.5, 1e22, -1e300, 0.5, 1.5, 1e-7]
    xs += [r.uniform(-10, 10) * 10 ** r.randrange(-8, 12) for _ in range(3000)] + [k / 2 ** r.randrange(1, 30) for k in range(-500, 500)]
    xs += [round(r.uniform(0, 1000), 3) + 0.0005 for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x double").repartition(4)
    for digits in (0, 1, 2, 4, 6, 9):
        for q in rows.select("i", stats.py_round(F.col("x"), digits).alias("r")).collect():
            want = round(xs[q["i"]], digits)
            assert q["r"] == want and math.copysign(1, q["r"]) == math.copysign(1, want), (xs[q["i"]], digits, q["r"], want)
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),)], "x double").select(stats.py_round(F.col("x"), 2).alias("r")).collect()
    assert odd[0]["r"] is None and odd[1]["r"] == float("inf") and math.isnan(odd[2]["r"])


def test_percentiles_of_large_groups_by_narrowing_ranges(spark, monkeypatch):
    """Few cuts and few ranked values at a time, ties, extremes, null keys and infinite values."""
    monkeypatch.setattr(stats, "RANKED", 7)
    monkeypatch.setattr(stats, "CUTS", 4)
    r, levels = random.Random(6), (0.0, 0.25, 0.5, 0.99, 1.0)
    groups = {
        None: [r.lognormvariate(0, 3) for _ in range(400)],
        "ties": [float(r.randrange(12)) for _ in range(500)],
        "one": [2.5] * 60,
        "wide": [1e300, -1e300, 5e-324, 0.0] + [r.gauss(0, 1) for _ in range(120)],
        "two": [1.0, 2.0],
    }
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("two", None), ("none", None)], "g string, v double").repartition(5)
    got = {q["g"]: q["p"] for q in stats.exact_percentiles(rows, ["g"], "v", levels).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx([float(np.percentile(xs, 100 * p)) for p in levels], rel=1e-12), g
    many = [float("inf"), float("-inf")] * 3 + [float(i) for i in range(40)]
    told = stats.exact_percentiles(spark.createDataFrame([(x,) for x in many], "v double"), [], "v", (0.0, 0.5, 1.0)).first()["p"]
    assert told == [float("-inf"), 19.5, float("inf")]


def test_plain_texts_are_not_folded_letter_by_letter(spark):
    """Texts whose letters ``lower`` folds don't reach the table; those with other letters do, and a folded text is computed once for all phrases."""
    texts = ["Straße ΟΔΟΣ Ünï", "中文 Текст É", "ſee", "ﬁt", "Ꭰ", "İ", "plain WHY"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    common = F.col("t")
    for c, f in text._COMMON.items():
        common = F.replace(common, F.lit(c), F.lit(f))
    got = rows.orderBy("i").select(common.rlike(text._ODD).alias("odd"), text.fold(F.col("t")).alias("f")).collect()
    assert [r["odd"] for r in got] == [False, False, True, True, True, True, False]
    assert [r["f"] for r in got] == [t.casefold() for t in texts]
    plan = lambda c: rows.select(c)._jdf.queryExecution().optimizedPlan().toString().count("translate(")
    assert plan(text.contains_any(F.col("t"), ("why", "how", "compare"))) == plan(text.fold(F.col("t")))
