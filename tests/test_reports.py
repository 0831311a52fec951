"""Judging, comparisons, results, the store, the gateway and the audit against hand values and plain loops."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import stats
from sluice.operators import agreement, audit, cache, gates, judging, metrics, results, routing, tuning, workload
from sluice.plans import catalog, reports
from sluice.sources import tables
from sluice.streaming import gateway

# fixed values: published intervals with their seeds, lengths and marks of the index matrix
MARKS = [
    ("low_baseline_cost", 1872326506, 237, "557b3de95315dfdf"),
    ("low_baseline_latency", 634598869, 236, "acb3ed48153c50f7"),
    ("low_cache_cost", 3798808762, 238, "017e38959df88ede"),
    ("low_cache_latency", 636691886, 237, "533cc775c7739c1a"),
    ("low_cache_quality", 2244370175, 224, "4bf63cb8f273d78c"),
    ("low_router_cascade_cost", 3218223914, 238, "c51c48de1ab21b36"),
    ("low_router_cascade_latency", 140886244, 237, "bfe8395c26fedbc1"),
    ("low_router_cascade_quality", 522499443, 227, "27cade37b92194c7"),
    ("low_router_heuristic_cost", 847910825, 237, "d460ec96e0f5cad9"),
    ("low_router_heuristic_latency", 84048863, 236, "5bcd1e2d74f2d02c"),
    ("low_router_heuristic_quality", 1010817347, 233, "95b379640b9f3f9c"),
    ("low_exact_only_cost", 2966119837, 237, "3b0ab277398e416f"),
    ("low_exact_only_latency", 164756683, 236, "0e4ba529bbc1f9ea"),
    ("high_baseline_cost", 732496050, 246, "ac4f666173ef2bae"),
    ("high_baseline_latency", 3798023334, 245, "b05ac56f90e89056"),
    ("high_cache_cost", 70105351, 246, "051e4025d1899b8b"),
    ("high_cache_latency", 1967652109, 245, "8f690d5f4f7ea6c5"),
    ("high_cache_quality", 2005578569, 235, "2528f830e30f0936"),
    ("high_router_cascade_cost", 1540928459, 246, "ffe5195fe7c28df7"),
    ("high_router_cascade_latency", 1305358876, 245, "46f9f6de07985145"),
    ("high_router_cascade_quality", 3166951345, 239, "56bd5f81ae788613"),
    ("high_router_heuristic_cost", 1611333067, 246, "59b45acceff427f1"),
    ("high_router_heuristic_latency", 4225867777, 245, "cd474bb1d902eeb5"),
    ("high_router_heuristic_quality", 2521982787, 242, "5ef813d3135395e3"),
    ("high_exact_only_cost", 959501047, 246, "7f519bfaed23e9ae"),
    ("high_exact_only_latency", 1708418205, 245, "e404a6a9d5713757"),
    ("cost-cache-baseline-low", 1037964175, 237, "cbb9b47fd895675a"),
    ("cost-cache-baseline-high", 1966031038, 246, "3872f1b725aaa5a6"),
    ("cost-heur-base-low", 2326746730, 237, "1592c64d516aa191"),
    ("cost-heur-base-high", 592576371, 246, "084e8072512b2c7a"),
    ("cost-heur-casc-low", 3034792341, 237, "5b03de7abcede605"),
    ("cost-heur-casc-high", 232833033, 246, "a0ac5bd1fa3f61a9"),
    ("qual-heur-casc-low", 4294697592, 223, "ad2fc361d2d8f52d"),
    ("qual-heur-casc-high", 3044800987, 235, "94d140f76bfccacc"),
    ("p99-heur-base-low", 632255338, 236, "a784b99ca0f1cea9"),
    ("p99-heur-base-high", 3825843895, 245, "f318e14af0f2d111"),
]


@pytest.mark.parametrize("name,seed,n,mark", MARKS)
def test_published_marks(name, seed, n, mark):
    assert stats.resample(np.zeros(n), seed, lambda x: x[:, :1].sum(axis=1), 10_000)[1] == mark


def test_published_seeds(spark):
    pairs = {f"{i}-{f}": (f, f"{a}-vs-{b}", q) for i, a, b, q in metrics.COMPARISONS for f in gates.FRACS}
    parts = [
        (n, *(pairs[n] if n in pairs else (n.split("_")[0], *n.split("_", 1)[1].rsplit("_", 1)))) for n, *_ in MARKS
    ]
    rows = spark.createDataFrame(parts, "name string, frac string, config string, quantity string")
    got = {
        r["name"]: r["s"] for r in rows.select(
            "name", stats.derive_seed(F.col("frac"), F.col("config"), F.col("quantity")).alias("s")
        ).collect()
    }
    assert got == {n: s for n, s, *_ in MARKS}


def test_control_draws_lie_within_the_grid():
    want = np.random.default_rng(tuning.CONTROL_SEED).uniform(0.30, 0.995, 64)
    assert tuning.control_draws() == want.tolist() and 0.30 < min(want) and max(want) < 0.995


def test_exact_percentiles_with_ties(spark):
    rng = np.random.default_rng(1)
    data = {
        "a": rng.exponential(10, 5000).round(1),
        "b": np.repeat([1.0, 2.0], [700, 300]),
        "c": np.array([5.0]),
        None: rng.normal(size=11),
    }
    rows = spark.createDataFrame(
        [(g, float(v)) for g, x in data.items() for v in x] + [("d", None)], "g string, v double"
    )
    got = {r["g"]: r["p"] for r in stats.exact_percentiles(rows, ["g"], "v", (0.0, 0.5, 0.95, 0.99, 1.0)).collect()}
    assert got.keys() == data.keys()
    for g, x in data.items():
        assert got[g] == pytest.approx(np.percentile(x, [0, 50, 95, 99, 100]).tolist())


def test_split_has_its_share_of_groups(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("g"))
    hashes = [r["g"] for r in rows.orderBy(stats.hash_rank_key(7, F.col("g"))).collect()]
    got = {r["g"] for r in workload.split_groups(rows, "g", 0.3).where("half = 'tune'").collect()}
    assert got == set(hashes[:900])
    assert workload.split_groups(rows.limit(1), "g").first()["half"] == "report"


def judged_tables(spark):
    o = [
        ("cache", "low", i, f"q{i}", "novel", "same" if i % 3 == 0 else f"b{i}") for i in range(12)
    ] + [("cache", "low", 12, "q12", "trap", None)]
    b = [("low", i, "" if i == 1 else "same") for i in range(13) if i != 2]
    schema = "config string, frac string, idx long, request string, dup_type string, answer_text string"
    return spark.createDataFrame(o, schema), spark.createDataFrame(b, "frac string, idx long, answer_text string")


def test_judge_run_and_its_resumption(spark):
    o, b = judged_tables(spark)
    ask1, ask2 = (lambda p: F.concat(F.lit("Score: "), F.length(p) % 3)), (lambda p: F.lit("none"))
    out = judging.judge_run(o, b, ask1, ask2, "R", 4, 1).collect()
    rows = {r["idx"]: r for r in out}
    assert sorted(rows) == [0, *range(3, 13)]  # no baseline for 2, a blank one for 1
    assert all(rows[i]["judge1_score"] == 2 and rows[i]["judge1_raw"] is None and rows[i]["note"] for i in (0, 3, 6, 9))
    assert rows[4]["judge1_raw"].startswith("Score") and rows[12]["answer_text"] == ""
    drawn = {r["idx"] for r in judging.sampled(o, 4, 1).collect()}
    assert len(drawn) == 4 and all(r["sampled_for_judge2"] == (r["idx"] in drawn) for r in out)
    assert all(
        (r["judge2_raw"] is not None) == (
            r["idx"] in drawn and not r["identical"]
        ) and r["judge2_score"] is None for r in out
    )
    done = o.where("idx < 6")
    again = judging.judge_run(o, b, ask1, ask2, "R", 4, 1, done).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in out if r["idx"] >= 6)


def test_queue_for_people(spark, tmp_path):
    j = spark.createDataFrame(
        [
            ("cache", "low", 3, "trap", "q", "a", "b", False, 0, None),
            ("cache", "low", 1, "novel", "q", "a", "b", False, 2, 1),
            ("router_cascade", "high", 2, "novel", None, "a", "b", False, 2, None),
        ],
        "config string, frac string, idx long, dup_type string, request string, answer_text string, baseline_text string, identical boolean, judge1_score int, judge2_score int",
    )
    o = spark.createDataFrame(
        [
            ("cache", "low", 3, "cache_semantic", "cheap", 0.87, 1),
            ("cache", "low", 1, "miss", "cheap", None, None),
            ("router_cascade", "high", 2, "miss", "expensive", None, None),
        ],
        "config string, frac string, idx long, kind string, served_by string, similarity double, hit_source_idx long",
    )
    out = agreement.human_queue(j, o)
    assert tuple(out.columns) == agreement.QUEUE
    rows = [r.asDict() for r in out.collect()]
    assert [
        r["priority"] for r in rows
    ] == [1, 2, 3] and rows[0]["similarity"] == "0.87" and rows[0]["judge1_score"] == "0"
    assert rows[1]["similarity"] == "" == rows[2]["request"] and rows[2]["priority_reason"] == "cascade escalation"
    tables.write_queue(out, f"file://{tmp_path}/queue", ["priority", "config", "frac", "idx"], 2)
    back = tables.read_csv_text(spark, f"file://{tmp_path}/queue")
    assert tuple(back.columns) == agreement.QUEUE and back.count() == 2


def compared(spark):
    rng = np.random.default_rng(2)
    rows = [
        (
            f, c, i, float(rng.random()), float(rng.random() * 100), None, "cache_semantic" if i % 2 else "miss"
        ) for f in gates.FRACS for c in tables.CONFIGS for i in range(40)
    ]
    o = spark.createDataFrame(
        [(k, *r) for k, r in enumerate(rows)],
        "seq long, frac string, config string, idx long, cost_usd double, latency_ms double, error string, kind string",
    )
    j = o.where("config <> 'baseline'").select(
        "config",
        "frac",
        "idx",
        (F.col("idx") % 3 == 0).alias("identical"),
        (F.col("idx") % 2).cast("int").alias("judge1_score"),
        F.lit("trap").alias("dup_type"),
    )
    return o, j, rows


def test_comparisons(spark):
    o, j, rows = compared(spark)
    points = {r["id"]: r for r in metrics.comparison_points(o, j).collect()}
    assert len(points) == 12
    of = lambda c, k: {r[2]: r[k] for r in rows if r[0] == "low" and r[1] == c}
    a, b = of("cache", 3), of("baseline", 3)
    assert points["cost-cache-baseline-low"]["diff"] == pytest.approx(
        np.mean([a[i] - b[i] for i in a])
    ) and points["cost-cache-baseline-low"]["seed"] == 1037964175
    a, b = of("router_heuristic", 4), of("baseline", 4)
    warm = range(1, 40)
    assert points["p99-heur-base-low"]["n_shared"] == 39
    assert points["p99-heur-base-low"]["diff"] == pytest.approx(
        np.percentile([a[i] for i in warm], 99) - np.percentile([b[i] for i in warm], 99)
    )
    assert points["fhr-casc-heur-low"]["method"] == "newcombe" and points["fhr-casc-heur-low"]["n_a"] == 20
    exact = {f"{r['id']}-{r['frac']}": r for r in metrics.published_comparisons(o, j, replicates=2000).collect()}
    near = {r["id"]: r for r in metrics.comparisons(o, j, replicates=2000).collect()}
    assert len(exact) == 10 and len(near) == 12
    for name, r in exact.items():
        assert near[name]["diff"] == pytest.approx(r["diff"]) and near[name]["separated"] is not None
        assert (near[name]["lo"], near[name]["hi"]) == pytest.approx((r["lo"], r["hi"]), abs=0.3 * (r["hi"] - r["lo"]))


def test_results_document(spark, tmp_path):
    g = spark.createDataFrame([("one", True, "x"), ("two", False, "y")], "name string, passed boolean, observed string")
    m = spark.createDataFrame([("cache", "low", 3, 0.5)], "config string, frac string, n long, rate double")
    cells = results.long_form("gates", g, "name", (), ("passed", "observed")).unionByName(
        results.long_form("metrics", m, "concat(frac, '_', config)", ("n", "rate"))
    )
    path = f"file://{tmp_path}/results.json"
    for run in ("first", "second"):  # a second writing replaces the first
        results.write_results(spark, path, cells, run)
    told = tables.read_json(spark, path)
    assert told["run_name"] == "second" and told["all_gates_passed"] is False and told["metrics"]["low_cache"] == {
        "n": 3.0, "rate": 0.5
    }
    assert json.loads((tmp_path / "results.json").read_text()) == told


def test_store_round_trip_and_last_writer(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            (1, "a", "k", "g", "old", "m", [1.0]),
            (2, "b", "k2", "g", "other", "m", [0.0]),
            (3, "A", "k", "g", "new", "m", [2.0]),
        ],
        tables.STORE,
    )
    path = f"file://{tmp_path}/store"
    tables.write_table(cache.latest_by_key(rows), path)
    back = tables.read_table(spark, path, tables.STORE)
    assert {
        (r["norm_key"], r["idx"], r["answer_text"]) for r in back.collect()
    } == {("k", 3, "new"), ("k2", 2, "other")}
    hits = spark.createDataFrame([(9, 3), (10, None)], "idx long, hit_source_idx long")
    served = cache.served(hits, back.withColumn("served_by", F.lit("cheap"))).collect()
    assert {(r["idx"], r["stored_answer"]) for r in served} == {(9, "new"), (10, None)}
    assert tables.read_table(spark, f"file://{tmp_path}/none", tables.STORE).count() == 0
    (tmp_path / "store" / "part-x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        tables.read_table(spark, path, tables.STORE).collect()


def test_runs_are_found_by_their_folders(spark, tmp_path):
    rows = spark.createDataFrame(
        [("cache", "low", 1), ("cache", "high", 2), ("baseline", "low", 3)], "config string, frac string, idx long"
    )
    tables.append_rows(rows, f"file://{tmp_path}/runs")
    found = tables.read_runs(spark, f"file://{tmp_path}/runs", "config string, frac string, idx long")
    assert sorted(map(tuple, found.select("config", "frac", "idx").collect())) == sorted(map(tuple, rows.collect()))
    workload.write_fractions(
        {"low": rows.select("idx"), "high": rows.select("idx").limit(1)}, f"file://{tmp_path}/w", {"seed": 1}
    )
    back = tables.read_table(spark, f"file://{tmp_path}/w/workload", "idx long, frac string")
    assert back.where("frac = 'low'").count() == 3 and back.where("frac = 'high'").count() == 1
    assert tables.read_json(spark, f"file://{tmp_path}/w/meta.json") == {"seed": 1}


def test_pairs_from_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,sentence1,sentence2,label\n1,"a ""b""\nc",d,1\n')
    assert [
        tuple(r) for r in tables.read_pairs(spark, f"file://{tmp_path}/p.csv").collect()
    ] == [("1", 'a "b"\nc', "d", 1)]


def test_audit_checks(spark):
    docs = spark.createDataFrame(
        [
            (1, "| config | cost |\n|---|:-:|\n| cache | 0.81-1.04 |\nno | table"),
            (2, "1234567% and 99999999999999999999 of 3"),
            (3, None),
        ],
        "doc_id long, text string",
    )
    got = audit.table_rows(docs).select(
        "line", "cells", audit.interval_of(F.get("cells", F.lit(1))).alias("i")
    ).collect()
    assert [(r["line"], r["cells"]) for r in got] == [
        (0, ["config", "cost"]), (2, ["cache", "0.81-1.04"])
    ] and tuple(got[1]["i"]) == (0.81, 1.04)
    found = audit.claims(docs)
    assert {r["claim"] for r in found.collect()} == {"1234567%", "99999999999999999999 of 3"}
    assert audit.unsupported_pairs(found, spark.createDataFrame([(3, 3)], "k long, n long")).count() == 1
    told = spark.createDataFrame(
        [("percent", "9%"), ("percent", "8.4%"), ("percent", "8.9%"), ("percent", "8.86%")], "kind string, claim string"
    )
    wrong = audit.unsupported_percentages(told, spark.createDataFrame([(8.89,)], "value double"))
    assert {r["claim"] for r in wrong.collect()} == {"8.4%", "8.86%"}  # half of the last decimal and 0.02 are allowed
    registry = spark.createDataFrame([("human_label_coverage",), ("gone",)], "name string")
    held = spark.createDataFrame([("human_label_coverage", True), ("new", True)], "name string, passed boolean")
    assert sorted(map(tuple, audit.gate_registry(held, registry).collect())) == [
        ("gone", "absent"), ("human_label_coverage", "should fail"), ("new", "not registered")
    ]


def test_gateway_modes_errors_and_size(spark, tmp_path):
    asked = spark.createDataFrame(
        [(0, "hi", None), (1, " ", "cache"), (2, "hi", "turbo"), (3, "hi", "cheap"), (4, "hi", "expensive")],
        "idx long, request string, mode string",
    )
    assert {(r["idx"], r["status"]) for r in gateway.rejected(asked).collect()} == {(1, 400), (2, 400)}
    side = lambda t, n: F.struct(F.lit(t).alias("text"), F.lit(n).alias("tokens_in"), F.lit(n).alias("tokens_out"))
    out = {
        r["idx"]: r for r in gateway.by_mode(
            gateway.accepted(asked).withColumns({"cheap": side("I am not sure", 3), "dear": side("yes", 5)})
        ).collect()
    }
    assert (
        out[0]["served_by"], out[0]["answer_text"], out[0]["tokens_in"], out[0]["escalated"]
    ) == ("expensive", "yes", 8, True)
    assert (
        out[3]["served_by"], out[3]["tokens_out"]
    ) == ("cheap", 3) and (out[4]["served_by"], out[4]["tokens_in"]) == ("expensive", 5)
    bad = gateway.failed(asked.withColumn("error", F.when(F.col("idx") == 0, "set the variable")), "BASE_URL").collect()
    assert [(r["status"], r["error_type"], r["param"]) for r in bad] == [(500, "upstream_unavailable", "BASE_URL")]


def test_reasons(spark):
    got = spark.range(1).select(
        routing.heuristic(F.lit("The cat sat.")).alias("a"),
        routing.heuristic(F.lit("why?")).alias("b"),
        routing.cascade_reason(F.lit("")).alias("c"),
        routing.cascade_reason(F.lit("Yes.")).alias("d"),
    ).first()
    assert (got["a"]["reason"], got["b"]["reason"]) == ("short and no reasoning cue", "long=False cue=True")
    assert (got["c"]["reason"], got["d"]["reason"]) == ("cheap answer uncertain or empty", "cheap answer confident")


def test_null_vectors_meet_nothing(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, 0.0])], "idx long, vec array<float>")
    got = {r["idx"]: (r["best"], r["best_src"]) for r in cache.prefix_best(rows).collect()}
    assert got == {0: (0.0, None), 1: (0.0, None), 2: (1.0, 0)}


def test_parts_of_the_results_share_their_tables(spark, monkeypatch):
    """The search for similar vectors runs once, and all parts read outcomes and judgements that were written once."""
    from sluice.plans import reports
    from sluice.sources import surrogate

    calls: dict[str, int] = {}

    def counted(module, name):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: calls.update({name: calls.get(name, 0) + 1}) or f(*a, **k))

    counted(cache, "prefix_best"), counted(cache, "exact_replay"), counted(surrogate, "outcomes"), counted(surrogate, "judgements")
    d = "/root/testdata/sf0.001"
    cells = {(r["section"], r["name"], r["field"]): (r["number"], r["text"]) for r in reports.QUERIES["results_document"](spark, d).collect()}
    assert calls == {"prefix_best": 1, "exact_replay": 1, "outcomes": 1, "judgements": 1}
    for r in reports.QUERIES["exact_proxy"](spark, d).collect():
        assert cells["exact_proxy", f"{r['frac']}_{r['config']}", "judged"] == (r["judged"], None)
    for r in reports.QUERIES["cost_weighted_threshold_full"](spark, d).collect():
        assert cells["cost_weighted", f"r{r['r']}", "threshold"] == (r["threshold"], None)


def documents(spark, folder):
    """A table of documents with equal keys, a key that half the rows have, null, empty and blank texts, and null and repeated ids."""
    rows = [(2, " A  b"), (1, "a B"), (5, "a\tb"), (6, "a b"), (6, "a b"), (10, "x"), (3, None), (4, ""), (14, " \n "), (18, None), (22, "C"), (None, "c"), (None, "d")]
    rows += [(i, "Hot  TEXT" if i % 2 else "hot text") for i in range(30, 50)]
    few = spark.createDataFrame([(i, t, None if i == 6 else f"s{i}") for i, t in rows], "doc_id long, text string, source string")
    few.withColumn("lang", F.lit("en")).write.parquet(f"{folder}/documents.parquet")
    return rows


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_replay_labels_fold_each_text_once(spark, tmp_path):
    rows = documents(spark, tmp_path)
    fold = lambda t: t if t is None else " ".join(t.lower().split())
    first = {}
    for i, t in rows:
        if i is not None:
            first[fold(t)] = min(i, first.get(fold(t), i))
    told = []
    for i, t in rows:
        new = t is None or i is None or i == first[fold(t)]
        told.append((i, new, None if i is None else new and i % 4 == 2))
    df = catalog.replay_labels(spark, str(tmp_path))
    got = [tuple(r) for r in df.select("idx", "eligible", "should_hit").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    assert sorted(got, key=key) == sorted(((i, n, bool(h)) for i, n, h in told), key=key)
    assert "FileScan" not in final_plan(df)  # the join's sides do not read and fold the documents again


def test_store_upsert_moves_digests_not_texts(spark, tmp_path):
    rows = documents(spark, tmp_path)
    last = {}
    for i, t in rows:
        if t and (k := " ".join(t.lower().split())):
            last[k] = max((j for j in (last.get(k), i) if j is not None), default=None)
    df = reports.store_upsert(spark, str(tmp_path))
    got = {(r["idx"], r["model"], r["key_sha"]) for r in df.collect()}
    model = lambda i: None if i in (None, 6) else f"s{i}"
    assert got == {(i, model(i), hashlib.sha256(k.encode()).hexdigest()) for k, i in last.items()}
    plan = final_plan(df)
    assert "hashpartitioning(key_sha" in plan and "hashpartitioning(norm_key" not in plan
