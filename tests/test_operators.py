import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.operators import agreement, audit, cache, gates, metrics, nearest, routing, tuning, workload
from sluice.sources import tables

VEC = "idx long, vec array<float>, k string, keep boolean"


def vectors(n, seed=0, dim=8):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("block", [7, 1000])
def test_prefix_best_is_the_sequential_loop(spark, block):
    x = vectors(40)
    rows = spark.createDataFrame([(i, v.tolist(), "", True) for i, v in enumerate(x)], VEC)
    got = {r["idx"]: (r["best"], r["best_src"]) for r in cache.prefix_best(rows, block=block).collect()}
    assert got[0] == (0.0, None)
    for i in range(1, 40):
        s = x[:i].astype(float) @ x[i].astype(float)
        assert got[i][0] == pytest.approx(s.max()) and got[i][1] == int(s.argmax())


def one_by_one(x, keys, keep, threshold, stored=()):
    stored, out = list(stored), {}
    for i in range(len(x)):
        if i in stored:
            continue
        earlier = [j for j in stored if j < i]
        same = [j for j in earlier if keys[j] == keys[i]]
        sims = [(float(x[i].astype(float) @ x[j].astype(float)), -j) for j in earlier if x[i] is not None and x[j] is not None]
        if same:
            out[i] = ("cache_exact", min(same))
        elif sims and max(sims)[0] >= threshold:
            out[i] = ("cache_semantic", -max(sims)[1])
        else:
            out[i] = ("miss", None)
            if keep[i]:
                stored.append(i)
    return out


@pytest.mark.parametrize("finish,block", [(4096, None), (3, 9), (0, 1000)])
def test_greedy_cache_is_the_sequential_loop(spark, finish, block, monkeypatch):
    monkeypatch.setattr(cache, "FINISH", finish)
    x, r = list(vectors(60, 3)), random.Random(1)
    keys, keep = [f"k{r.randrange(25)}" for _ in x], [r.random() > 0.2 for _ in x]
    x[7] = x[20] = x[21] = None
    stored = {0, 4, 30, 31}
    rows = spark.createDataFrame(
        [(i, None if v is None else v.tolist(), k, s, i in stored) for i, (v, k, s) in enumerate(zip(x, keys, keep))], VEC + ", s boolean"
    )
    told = lambda df: {q["idx"]: (q["kind"], q["hit_source_idx"]) for q in df.collect()}
    assert told(cache.greedy_cache(rows, 0.6, key="k", storable="keep", block=block)) == one_by_one(x, keys, keep, 0.6)
    assert told(cache.greedy_cache(rows, 0.6, key="k", storable="keep", stored="s", block=block)) == one_by_one(x, keys, keep, 0.6, sorted(stored))
    bare = rows.withColumn("vec", F.lit(None).cast("array<float>"))
    assert told(cache.greedy_cache(bare, 0.6, key="k", storable="keep")) == one_by_one([None] * 60, keys, keep, 0.6)
    assert told(cache.greedy_cache(rows.where("false"), 0.6)) == {}


def test_a_group_of_near_copies_costs_no_pairs(spark):
    """20,000 near copies of five vectors: rows written stay below a few for each request."""
    r = np.random.default_rng(2)
    x = vectors(5, 9, 16)[r.integers(0, 5, 20_000)] + r.normal(size=(20_000, 16)) * 0.001
    rows = spark.createDataFrame(list(zip(range(20_000), x.astype(np.float32).tolist())), "idx long, vec array<float>").repartition(8)
    got = cache.greedy_cache(rows, 0.9)
    assert {q["kind"]: q["count"] for q in got.groupBy("kind").count().collect()} == {"miss": 5, "cache_semantic": 19_995}
    places = nearest.place(rows)
    one = places.rows.where("idx < 5").withColumn("floor", F.lit(0.9))
    met = nearest.best_earlier(places.rows.withColumn("floor", F.lit(0.9)), one.select("block", "idx", "vec"), places)[0]
    assert met.count() <= 20_000


def test_bounds_spare_most_comparisons(spark):
    """Clustered vectors: exact results with less than a fifth of the pairs."""
    r = np.random.default_rng(4)
    centres = vectors(40, 1, 32)
    x = centres[r.integers(0, 40, 6000)] + r.normal(size=(6000, 32)) * 0.02
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame(list(zip(range(6000), x.tolist())), "idx long, vec array<float>").repartition(8)
    found, work = nearest.all_best_earlier(nearest.place(rows, block=100))
    s = x.astype(float) @ x.astype(float).T
    s[np.triu_indices(6000)] = -np.inf
    got = {q["idx"]: (q["s"], q["src"]) for q in found.collect()}
    assert len(got) == 5999 and all(got[i][0] == pytest.approx(s[i].max()) and s[i, got[i][1]] == pytest.approx(s[i].max()) for i in got)
    done = work.first()
    assert done["compared"] < 6000 * 5999 / 2 / 5 and done["visits"] < 60 * 60


def test_search_within_groups_and_of_any_length(spark):
    x = np.random.default_rng(8).normal(size=(90, 5)) * np.random.default_rng(9).uniform(0.1, 9, size=(90, 1))
    rows = spark.createDataFrame([(i, v.astype(np.float32).tolist(), "ab"[i % 2] if i % 9 else None) for i, v in enumerate(x)], "idx long, vec array<float>, g string")
    group = [("ab"[i % 2] if i % 9 else "") for i in range(90)]
    got = {q["idx"]: (q["best"], q["best_src"], q["g"]) for q in cache.prefix_best(rows, by="g", block=6).collect()}
    x = x.astype(np.float32).astype(float)
    for i in range(90):
        sims = [(float(x[i] @ x[j]), -j) for j in range(i) if group[j] == group[i]]
        assert got[i][2] == group[i]
        assert got[i][:2] == ((pytest.approx(max(sims)[0]), -max(sims)[1]) if sims else (0.0, None))


def test_exact_replay_skips_failures_and_blanks(spark):
    rows = spark.createDataFrame(
        [
            ("low", 0, "a", "err", "x"),
            ("low", 1, "a", None, " "),
            ("low", 2, "a", None, "x"),
            ("low", 3, "a", None, "y"),
        ],
        "frac string, idx long, norm_key string, error string, answer_text string",
    ).selectExpr("*", "1.0D AS cost_usd", "1L AS tokens_in", "1L AS tokens_out")
    got = {r["idx"]: (r["is_hit"], r["hit_source_idx"], r["replay_cost"]) for r in cache.exact_replay(rows).collect()}
    assert got == {2: (False, None, 1.0), 3: (True, 2, 0.0)}


def test_sweep_counts_and_empty_denominators(spark):
    rows = spark.createDataFrame(
        [(1, 0.95, True, True), (2, 0.4, True, True), (3, 0.92, False, True), (4, 0.99, False, False)],
        "idx long, best double, should_hit boolean, eligible boolean",
    )
    got = {r["threshold"]: r for r in tuning.sweep(rows, [0.5, 0.9, 0.999]).collect()}
    assert (got[0.9]["tp"], got[0.9]["fp"], got[0.9]["fn"], got[0.9]["tn"]) == (1, 1, 1, 0)
    assert got[0.999]["precision"] == got[0.999]["f1"] == 0.0
    assert tuning.best_f1(tuning.sweep(rows, [0.5, 0.9])).first()["threshold"] == 0.9
    assert len(tuning.grid()) == 140 and tuning.grid()[-1] == 0.995


def test_microaverage_golden(spark):
    got = tuning.rates(tuning.loss_table(spark, [(0.79, 118, 26, 0, 261)])).first()
    assert got["f1"] == pytest.approx(0.9007634, abs=1e-6) and got["false_hit_rate"] == pytest.approx(
        0.1805556, abs=1e-6
    )


@pytest.mark.parametrize(
    "request_,hard",
    [("x" * 500, True), ("Explain why it rains because", True), ("The cat sat on the mat.", False), (None, False)],
)
def test_heuristic(spark, request_, hard):
    assert spark.range(1).select(
        routing.heuristic(F.lit(request_).cast("string")).alias("r")
    ).first()["r"]["hard"] is hard


@pytest.mark.parametrize(
    "answer,up",
    [
        ("I am not sure about this answer", True),
        ("   ", True),
        ("The cat sat on the mat.", False),
        ("I don’t know.", True),
    ],
)
def test_cascade(spark, answer, up):
    assert spark.range(1).select(routing.cascade(F.lit(answer)).alias("r")).first()["r"] is up


def test_prices(spark):
    rows = spark.createDataFrame([("m", 1000, 500)], "model string, tokens_in long, tokens_out long")
    assert routing.priced(rows, {"m": (1.5, 6.0)}).first()["cost_usd"] == pytest.approx(0.0045)
    with pytest.raises(Exception, match="no price"):
        routing.priced(rows, {"other": (1.0, 1.0)}).collect()


def test_blank_answers_are_asked_again(spark):
    s = lambda t, i, o, ms: F.struct(
        F.lit(t).alias("text"), F.lit(i).alias("tokens_in"), F.lit(o).alias("tokens_out"), F.lit(ms).alias("ms")
    )
    got = spark.range(1).select(
        routing.retry_blank(s("", 10, 512, 1.0), s("answer", 10, 40, 1.0)).alias("r")
    ).first()["r"]
    assert tuple(got) == ("answer", 20, 552, 2.0)


def test_provider(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "c")], "idx long, request string")
    got = routing.complete(rows, lambda: lambda texts: [(t.upper(), len(t), 1) for t in texts])
    assert {(r["idx"], r["answer_text"], r["tokens_in"]) for r in got.collect()} == {(1, "AB", 2), (2, "C", 1)}


def human(spark):
    rows = [
        ("0.0", "0.0", "incorrect"),
        ("0.0", "nan", "correct"),
        ("2.0", "1.0", "correct"),
        ("1.0", "2.0", "partial"),
        ("2.0", "2.0", "2"),
        ("2.0", "nan", ""),
        ("nan", "nan", ""),
    ]
    return spark.createDataFrame(rows, "judge1_score string, judge2_score string, human_label string")


def test_kappa_of_people_and_judges(spark):
    got = {k: v.first() for k, v in agreement.human_agreement(human(spark)).items()}
    assert tuple(got["judge1_score"]) == pytest.approx((5, 0.8, 0.36, 0.6875))
    assert tuple(got["judge2_score"]) == pytest.approx((4, 0.5, 0.375, 0.2))


def test_kappa_without_pairs_or_chance(spark):
    none = agreement.kappa(spark.createDataFrame([(None, "x")], "a string, b string"), "a", "b").first()
    assert none["n"] == 0 and none["kappa"] is None
    all_same = agreement.kappa(spark.createDataFrame([("2", "2"), ("2", "2")], "a string, b string"), "a", "b").first()
    assert np.isnan(all_same["kappa"])


def test_coverage_and_tiers(spark):
    assert agreement.coverage(human(spark)).first()["filled"] == 5
    rows = spark.createDataFrame(
        [
            ("cache", "cache_semantic", "cheap", 0, None),
            ("cache", "miss", "cheap", 2, 1),
            ("router_cascade", "cache_exact", "expensive", 2, None),
            ("cache", "miss", "cheap", 2, 2),
        ],
        "config string, kind string, served_by string, judge1_score int, judge2_score int",
    )
    assert [r[0] for r in rows.select(agreement.priority()).collect()] == [1, 2, 3, 4]
    assert rows.select(agreement.priority(strict=True)).collect()[2][0] == 4


def test_judged_rows_need_one_outcome_each(spark):
    o = spark.createDataFrame(
        [("c", "low", 1, "miss", "cheap")] * 2, "config string, frac string, idx long, kind string, served_by string"
    )
    with pytest.raises(Exception, match="one for each key"):
        agreement.judged_rows(o.select("config", "frac", "idx").limit(1), o).collect()


def outcomes(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "seq long, config string, frac string, idx long, kind string, served_by string, latency_ms double, tokens_in long, tokens_out long, cost_usd double, error string",
    )


def test_run_metrics_and_warm_rows(spark):
    rows = outcomes(
        spark,
        [
            ("cache", "low", 0, "miss", "expensive", 500.0, 1, 2, 0.5, None),
            ("cache", "low", 1, "cache_exact", "expensive", 0.0, 0, 0, 0.0, "nan"),
            ("cache", "low", 2, "miss", "cheap", 100.0, 1, 1, 0.25, ""),
            ("cache", "low", 3, "miss", "cheap", 9.0, 1, 1, 9.0, "boom"),
        ],
    )
    got = metrics.run_metrics(rows).first()
    assert (got["n_rows"], got["n_errors"], got["n_ok"], got["n_exact"], got["cheap_calls"]) == (4, 1, 3, 1, 1)
    assert (got["first_latency_ms"], got["p50_ms"], got["p95_ms"]) == (500.0, 50.0, 95.0)
    assert got["hit_rate"] == pytest.approx(1 / 3)


def test_gates_fail_for_absent_runs(spark):
    m = spark.createDataFrame(
        [("baseline", "low", 2.0), ("cache", "low", 1.0)], "config string, frac string, cost_usd double"
    )
    got = {r["name"]: (r["passed"], r["observed"]) for r in gates.cost_gates(m).collect()}
    assert got["baseline_costs_more_low_cache"] == (True, "baseline 2.0000 vs cache 1.0000") and len(got) == 6
    assert got["baseline_costs_more_high_cache"] == (False, "run not present (resume incomplete)")
    assert not gates.summary(gates.cost_gates(m)).first()["all_gates_passed"]


def test_workload_has_its_fractions_and_order(spark):
    pairs = spark.createDataFrame(
        [(f"p{i:03d}", f"anchor {i}", f"follower {i}", i % 2) for i in range(120)], tables.PAIRS
    )
    rows = [r.asDict() for r in workload.build(pairs, 40, 0.2, 0.1, 0.25, 5, "low").orderBy("idx").collect()]
    count = lambda d: sum(r["dup_type"] == d for r in rows)
    assert [
        count(d) for d in ("paraphrase", "trap", "exact", "novel")
    ] == [8, 4, 10, 18] and [r["idx"] for r in rows] == list(range(40))
    first = {r["group_id"]: r["idx"] for r in rows if r["dup_type"] == "novel"}
    assert all(first[r["group_id"]] < r["idx"] for r in rows if r["dup_type"] != "novel")
    with pytest.raises(ValueError):
        workload.build(pairs, 40, 0.5, 0.4, 0.2, 5, "low")


def test_order_is_uniform_over_ready_rows(spark):
    """Shares of followers right behind their anchor, and of followers by place, are those of drawing ready rows one by one."""
    n, m = 200, 100

    def drawn(seed):
        r = random.Random(seed)
        ready, out = [("n", i) for i in range(n)], []
        while ready:
            k = r.randrange(len(ready))
            ready[k], ready[-1] = ready[-1], ready[k]
            out.append(ready.pop())
            if out[-1][0] == "n" and out[-1][1] < m:
                ready.append(("f", out[-1][1]))
        return out

    def told(orders):
        next_, first, total = 0, 0, 0
        for out in orders:
            at = {x: i for i, x in enumerate(out)}
            assert all(at["n", g] < at["f", g] for g in range(m))
            total += m
            next_ += sum(at["f", g] == at["n", g] + 1 for g in range(m))
            first += sum(at["f", g] < (n + m) / 2 for g in range(m))
        return next_ / total, first / total

    rows = [(s, "novel", f"g{i}", f"n{i}") for s in range(40) for i in range(n)] + [(s, "trap", f"g{i}", f"f{i}") for s in range(40) for i in range(m)]
    table = spark.createDataFrame([(f, d, g, f"{f}|{k}") for f, d, g, k in rows], "frac int, dup_type string, group_id string, idx string")
    by = {}
    for r in workload.follower_order(table, 5).orderBy("frac", "rank_key").collect():
        k = r["idx"].split("|")[1]
        by.setdefault(r["frac"], []).append((k[0], int(k[1:])))
    (next_a, first_a), (next_b, first_b) = told(by.values()), told(drawn(s) for s in range(400))
    assert abs(next_a - next_b) < 0.006 and abs(first_a - first_b) < 0.03 and next_a < 0.03


def test_a_follower_of_no_group_fails(spark):
    known = spark.createDataFrame([("a", "g0"), ("b", "g1")], "request string, group_id string")
    rows = spark.createDataFrame([(0, "b"), (1, "a")], "idx long, request string")
    assert {r["idx"]: r["group_id"] for r in workload.resolve(rows, known).collect()} == {0: "g1", 1: "g0"}
    with pytest.raises(Exception, match="no group for: c"):
        workload.resolve(rows.unionByName(spark.createDataFrame([(2, "c")], "idx long, request string")), known).collect()


def test_split_keeps_groups_whole(spark):
    rows = spark.range(200).select("id", (F.col("id") % 11).cast("string").alias("g"))
    got = workload.split_groups(rows, "g").select("g", "half").distinct().collect()
    assert len(got) == 11 and sum(r["half"] == "tune" for r in got) == 5


def test_user_text(spark):
    rows = spark.createDataFrame(
        [
            (1, 2, "user", "b"),
            (1, 0, "user", "a"),
            (1, 1, "assistant", "x"),
            (2, 0, "user", "  "),
            (3, 0, "assistant", "y"),
        ],
        "conv_id long, turn int, role string, text string",
    )
    assert [tuple(r) for r in workload.user_text(rows).collect()] == [(1, 2, "a\nb")]


def test_audit_finds_claims_without_a_source(spark):
    docs = spark.createDataFrame(
        [(1, "4 of 45 hits, 8.9% and 12.5%"), (2, "5 of 45"), (3, None)], "doc_id long, text string"
    )
    found = audit.claims(docs)
    assert [
        r["claim"] for r in audit.unsupported_pairs(found, spark.createDataFrame([(4, 45)], "k long, n long")).collect()
    ] == ["5 of 45"]
    assert [
        r["claim"] for r in audit.unsupported_percentages(
            found, spark.createDataFrame([(8.89,)], "value double")
        ).collect()
    ] == ["12.5%"]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("c", "low", 1), ("c", "low", 2)], "config string, frac string, idx long")
    path = str(tmp_path / "t")
    assert tables.read_table(spark, path, "idx long").count() == 0
    tables.append_rows(rows.limit(1), path)
    tables.append_rows(rows.where("idx = 2"), path)
    assert tables.pending(rows, spark.read.parquet(path)).count() == 0
    tables.write_json(spark, f"file://{tmp_path}/x.json", {"b": 1, "a": "ü"})
    assert tables.read_json(spark, f"file://{tmp_path}/x.json") == {"a": "ü", "b": 1} and tables.read_json(
        spark, f"file://{tmp_path}/no.json"
    ) is None


def test_full_grid_reaches_near_copies(spark, monkeypatch):
    from sluice.operators import tuning
    from sluice.plans import catalog

    rows = [(i, 0.5 + 0.001 * i, i >= 400, True) for i in range(490)]
    monkeypatch.setattr(
        catalog,
        "_best",
        lambda s, d: s.createDataFrame(rows, "idx long, best double, should_hit boolean, eligible boolean"),
    )
    swept = {r["threshold"] for r in catalog.threshold_sweep_full(spark, "").collect()}
    assert set(tuning.grid()) == set(catalog.GRID) and set(tuning.grid()) <= swept
    assert catalog.best_f1_threshold_full(spark, "").first()["threshold"] == 0.9
    assert {r["threshold"] for r in catalog.cost_weighted_threshold_full(spark, "").collect()} == {0.9}
    assert catalog.control_thresholds_full(spark, "").first()["max_f1"] > 0.5
    assert all(
        "range(160)" in catalog.ORACLE[f"{n}_full"] for n in (
            "threshold_sweep", "best_f1_threshold", "cost_weighted_threshold", "gate_table", "all_gates"
        )
    )


def test_keys_that_are_texts_are_not_shuffled(spark):
    """Rows meet by a digest of their key: no exchange carries the texts."""
    rows = spark.range(6).select(F.col("id").alias("idx"), F.concat(F.lit("text "), (F.col("id") % 3).cast("string")).alias("norm_key"))
    out = cache.seen_earlier(rows, "norm_key", "idx").select("idx", "seen", "first_idx")
    assert sorted(map(tuple, out.collect())) == [(i, i > 2, i % 3) for i in range(6)]
    lines = out._jdf.queryExecution().analyzed().toString().splitlines()
    grouped, joined = ([x for x in lines if w in x] for w in ("Aggregate [", "Join "))
    assert all("sha2(" in x for x in grouped) and all("_digest" in x and "norm_key" not in x for x in joined) and grouped and joined


def test_a_floor_spares_visits_and_loses_nothing_above_it(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8))
    x[200:] = x[:200] + r.normal(size=(200, 8)) * r.uniform(0, 0.8, (200, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, vec array<float>")
    told = lambda df: sorted((r["idx"], round(r["best"], 12), r["best_src"]) for r in df.where("best >= 0.9").collect())
    assert told(cache.prefix_best(rows)) == told(cache.prefix_best(rows, least=0.9))
    places = nearest.place(rows, block=40)
    plain, spared = (nearest.all_best_earlier(places, least)[1].first()["compared"] for least in (None, 0.9))
    assert spared < 0.9 * plain
    assert nearest.place(rows).size >= 400 / np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism))  # fewer blocks, fewer copies of rows


def test_blocks_meet_in_little_memory():
    """What a task holds of two blocks' products does not grow with the blocks."""
    rng = np.random.default_rng(5)

    def table(first: int, n: int) -> pa.Table:
        x = rng.normal(size=(n, 8)).astype(np.float32)
        return pa.table({"_by": [""] * n, "idx": np.arange(first, first + n), "vec": pa.array(list(x), pa.list_(pa.float32())), "floor": pa.nulls(n, pa.float64())})

    for first in (4000, 0):  # all of the other block is earlier, or some of it
        left, right = table(first, 4000), table(0, 4000)
        tracemalloc.start()
        got = nearest._compare(left, right)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16e6
        s = nearest._matrix(left["vec"]) @ nearest._matrix(right["vec"]).T
        s[np.arange(4000) >= np.arange(first, first + 4000)[:, None]] = -np.inf
        assert got["idx"].to_pylist() == [first + i for i in range(4000) if np.isfinite(s[i]).any()]
        assert got["src"].to_pylist() == s.argmax(axis=1)[np.isfinite(s).any(axis=1)].tolist()


def test_rounds_of_the_cache_send_no_rows_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(cache, "FINISH", 50)
    x = vectors(300, seed=3)
    rows = spark.createDataFrame([(i, x[i].tolist(), f"k{i}", True) for i in range(300)], VEC)
    out = cache.greedy_cache(rows, 0.8, key="k", storable="keep")
    assert len(out.collect()) == 300
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize("least", [None, 0.8])
def test_ranges_meet_and_equal_vectors_tie_by_order(spark, monkeypatch, least):
    """Many ranges and leaves, groups of copies, vectors of any length: the sequential loop, the earliest of equal vectors to the last bit."""
    monkeypatch.setattr(nearest, "LEAVES", 1)
    r = np.random.default_rng(11)
    x = r.normal(size=(600, 6)) * r.uniform(0.2, 2, size=(600, 1))
    x[200:] = x[r.integers(0, 200, 400)] + r.normal(size=(400, 6)) * r.choice([0, 0.05], size=(400, 1))
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(3 * i - 500, v.tolist(), "ab"[i % 5 == 0]) for i, v in enumerate(x)], "idx long, vec array<float>, g string").repartition(7)
    odd = spark.createDataFrame([(None, x[0].tolist(), "a"), (2000, [float("nan")] * 6, "a"), (2001, None, "b")], rows.schema)
    got = cache.prefix_best(rows.unionByName(odd), by="g", block=5, least=least).collect()
    told = {q["idx"]: (q["best"], q["best_src"]) for q in got}
    assert len(got) == 603 and told[None] == told[2000] == told[2001] == (0.0, None)
    dot = lambda a, b: float(np.cumsum(a.astype(float) * b.astype(float))[-1])
    for i in range(600):
        sims = [(dot(x[i], x[j]), -(3 * j - 500)) for j in range(i) if (i % 5 == 0) == (j % 5 == 0)]
        s, src = max(sims, default=(-np.inf, 0))
        want = (s, -src) if sims and (least is None or s >= least) else (0.0, None)
        assert told[3 * i - 500] == want


def test_a_row_travels_once_for_each_range(spark):
    """What two ranges need meets in one task, packed: no exchange of the search has a row for each block that a row visits."""
    x = vectors(3000, 5, 16)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, vec array<float>").repartition(4)
    places = nearest.listed(rows, block=10)
    assert (places.many, places.dim, places.size, places.blocks) == (3000, 16, 10, None)
    found, work = nearest.all_best_earlier(places)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert found.count() == 2999 and "FlatMapCoGroups" not in plan and work.first()["compared"] >= 2999


@pytest.mark.parametrize("parts", [2, 3, 4, 7])
def test_a_range_travels_once_for_each_two_ranges(spark, parts):
    """Each two ranges of a group share the one task where they meet; none holds more than four, and a range goes to half as many tasks as there are ranges."""
    schema = "_by string, at int, parts int, before long, idx binary, vec binary, firsts int, s binary, src binary"
    blob = bytearray(8)
    rows = [("a", k, parts, 0, blob, blob, 1, blob, blob) for k in range(parts)] + [("b", k, 2, 50, blob, blob, 1, blob, blob) for k in range(2)]
    rows += [("c", 0, 1, None, blob, blob, 1, blob, blob)]
    tasks: dict = {}
    for r in nearest._dealt(spark.createDataFrame(rows, schema)).collect():
        tasks.setdefault(r["task"], {})[r["_by"], r["at"]] = r
    blocks = -(-parts // 2)
    assert sorted(tasks) == [*range(max(1, blocks * (blocks - 1) // 2)), 50] and all(len(t) <= 4 and len({by for by, _ in t}) == 1 for t in tasks.values())
    for k in range(parts):
        assert sum(("a", k) in t for t in tasks.values()) == max(1, blocks - 1)
        for j in range(k):
            both = [t for t in tasks.values() if ("a", k) in t and ("a", j) in t]
            assert both and (k // 2 == j // 2 or len(both) == 1) and any(t["a", k]["s"] is not None for t in both)
    assert set(tasks[50]) == {("b", 0), ("b", 1)}


@pytest.mark.parametrize("at_a_time", [2, 4096])
def test_blocks_of_ranges_meet_some_at_a_time(spark, monkeypatch, at_a_time):
    """Groups of one, two, three and many ranges; more pairs of blocks than meet at a time; repeated and null orders; a group of one vector only."""
    monkeypatch.setattr(nearest, "LEAVES", 1)
    monkeypatch.setattr(nearest, "MEETINGS", at_a_time)
    r = np.random.default_rng(21)
    x = r.normal(size=(500, 6)).astype(np.float32)
    x[100:130] = x[0]
    group = np.array(["a"] * 280 + ["b"] * 90 + ["c"] * 125 + ["d"] * 5)
    rows = spark.createDataFrame([(i, x[i].tolist(), str(group[i])) for i in r.permutation(500).tolist()], "idx long, vec array<float>, g string")
    found, work = nearest.all_best_earlier(nearest.listed(rows, by="g", block=5))
    got = {(q["_by"], q["idx"]): (q["s"], q["src"]) for q in found.collect()}
    dot = lambda a, b: float(np.cumsum(a.astype(float) * b.astype(float))[-1])
    want = {}
    for i in range(500):
        if sims := [(dot(x[i], x[j]), -j) for j in range(i) if group[j] == group[i]]:
            want[group[i], i] = (max(sims)[0], -max(sims)[1])
    assert got == want and work.first()["compared"] <= sum(n * (n - 1) // 2 for n in (280, 90, 125, 5)) * 1.2
    same = spark.createDataFrame([(7, [1.0, 0.0], "a")] * 40 + [(None, [1.0, 0.0], "a")] * 3 + [(i, [1.0, 0.0], "b") for i in range(60)], rows.schema)
    told = nearest.all_best_earlier(nearest.listed(same, by="g", block=5))[0].collect()
    assert sorted((q["_by"], q["idx"], q["s"], q["src"]) for q in told) == [("b", i, 1.0, 0) for i in range(1, 60)]
