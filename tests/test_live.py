"""The live gateway against one request after the other: batches, restarts, repeated batches, expiry, state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.streaming import gateway
from sluice.streaming.live import REQUESTS, Live


def requests(n=48, seed=3):
    r, x = random.Random(seed), np.random.default_rng(seed).normal(size=(8, 6))
    rows = []
    for i in range(n):
        v = x[r.randrange(8)] + np.array([r.gauss(0, 0.25) for _ in range(6)])
        v = (v / np.linalg.norm(v)).astype(np.float32).tolist()
        text = r.choice([f"Question {r.randrange(30)}?", f"  question {r.randrange(30)}? ", " "])
        mode = r.choice(["cache", "cache", "router", "cheap", "expensive", None, "turbo"])
        cheap = (r.choice(["yes", "I am not sure", ""]), 1, 2)
        dear = (r.choice(["well", f"answer {i}", "  "]), 3, 4)
        rows.append((i, text, mode, None if i % 7 == 3 else v, cheap, dear, "set it" if r.random() < 0.15 else None))
    return rows


def one_by_one(rows, threshold, keep=lambda j, i: True):
    """Answers by ``idx`` and errors; ``keep(j, i)`` says whether what ``j`` stored is still there for ``i``."""
    stored, answers, errors = [], {}, {}
    for i, text, mode, vec, cheap, dear, error in rows:
        key, mode = " ".join(text.lower().split()), mode or "router"
        if not key or mode == "turbo":
            errors[i] = 400
            continue
        there = [s for s in stored if keep(s[0], i)]
        exact = [s for s in there if s[1] == key]
        sims = [(float(np.array(vec, float) @ np.array(s[2], float)), -s[0], s) for s in there if vec is not None and s[2] is not None]
        hit = None
        if mode != "expensive":
            hit = ("cache_exact", exact[0]) if exact else ("cache_semantic", max(sims)[2]) if sims and max(sims)[0] >= threshold else None
        if hit:
            answers[i] = (hit[0], hit[1][0], hit[1][3], hit[1][4], 0)
            continue
        doubt = not cheap[0].strip() or "not sure" in cheap[0]
        low = mode == "cheap" or (mode == "router" and not doubt)
        said, who = (cheap[0], "cheap") if low else (dear[0], "expensive")
        cost = cheap[1] if low else dear[1] + (cheap[1] if mode == "router" else 0)
        if error:
            errors[i] = 500
            continue
        answers[i] = ("model_direct" if mode == "expensive" else "miss", None, said, who, cost)
        if mode != "expensive" and said.strip():
            stored.append((i, key, vec, said, who))
    return answers, errors, stored


def told(live):
    answers = live.table("answers").collect()
    assert len(answers) == len({r["idx"] for r in answers})
    return ({r["idx"]: (r["kind"], r["hit_source_idx"], r["answer_text"], r["served_by"], r["tokens_in"]) for r in answers},
            {r["idx"]: r["status"] for r in live.table("errors").collect()})


def frame(spark, rows):
    return spark.createDataFrame(rows, REQUESTS)


def test_batches_are_as_one_after_the_other(spark, tmp_path):
    rows = requests()
    answers, errors, stored = one_by_one(rows, 0.8)
    live, source = Live(spark, str(tmp_path / "tables"), 0.8), str(tmp_path / "in")
    for half in (rows[:24], rows[24:]):  # stopped and started in between
        for part in (half[:12], half[12:]):
            frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
        live.serve(stream, str(tmp_path / "state")).awaitTermination()
    assert told(live) == (answers, errors)
    assert live.health().first().asDict() == {"ok": True, "cache_size": len(stored)}
    assert {k for k, *_ in answers.values()} == {"miss", "model_direct", "cache_exact", "cache_semantic"} and set(errors.values()) == {400, 500}
    live.take(frame(spark, rows[36:]), 3)  # the last batch once more
    assert told(live) == (answers, errors)


def test_stored_answers_expire(spark, tmp_path):
    rows = [r for r in requests(36, 5) if r[6] is None]
    batch = {r[0]: k // 8 for k, r in enumerate(rows)}
    answers, errors, _ = one_by_one(rows, 0.8, keep=lambda j, i: batch[j] >= batch[i] - 1)
    live = Live(spark, str(tmp_path / "tables"), 0.8, keep=1)
    for k in range(max(batch.values()) + 1):
        live.take(frame(spark, [r for r in rows if batch[r[0]] == k]), k)
    assert told(live) == (answers, errors)
    assert len(live._batches("stored")) <= 2


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    live = Live(spark, str(tmp_path / "tables"), 0.8)
    live.take(frame(spark, [(0, "a", "cache", None, ("x", 1, 1), ("y", 1, 1), None)]), 0)
    (tmp_path / "tables" / "stored" / "batch=0" / "_SUCCESS").unlink()
    live.take(frame(spark, [(1, "A", "cache", None, ("x", 1, 1), ("z", 1, 1), None)]), 1)
    assert live.table("answers", since=1).first()["kind"] == "miss"
    assert live.table("answers", before=0).count() == 0 and live.health().first()["cache_size"] == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_state_of_first_answers(spark, tmp_path, parts):
    schema = "idx long, mode string, request string, answer_text string, served_by string, error string"
    rows = [(i, "expensive" if i % 10 == 9 else None, f"Q {i % 7}" if i % 5 else " ", "" if i % 7 == 2 else f"a{i}", "cheap", "e" if i % 7 == 4 else None) for i in range(60)]
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    gateway.first_answers(stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert gateway.health_of_state(spark, str(tmp_path / "state")).first().asDict() == {"ok": True, "cache_size": 5}
    state = spark.read.format("statestore").load(str(tmp_path / "state")).select(F.col("key.norm_key").alias("k"), F.col("value.min.idx").alias("i"))
    good = [r for r in rows if r[1] is None and r[2].strip() and r[3] and not r[5]]
    got = {r["k"]: r["i"] for r in state.collect()}
    assert got == {f"q {k}": min(r[0] for r in good if r[2] == f"Q {k}") for k in (0, 1, 3, 5, 6)}


def test_a_batch_keeps_each_text_once(spark, monkeypatch):
    """What a batch checkpoints has the key, not the request or the other side's answer; states hold digests of keys."""
    from sluice.operators import cache
    from sluice.streaming import live

    seen = []
    for module in (live, cache):
        plain = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, plain=plain: (seen.append(df), plain(df))[1])
    side = "named_struct('text', 'a', 'tokens_in', 1L, 'tokens_out', 1L)"
    text = "repeat('long text ', 30)"
    asked = spark.range(8).selectExpr(
        "id AS idx", f"concat({text}, id % 2) AS request", "'cache' AS mode", "cast(NULL AS array<float>) AS vec", f"{side} AS cheap", f"{side} AS dear", "cast(NULL AS string) AS error"
    )
    monkeypatch.setattr(cache, "FINISH", 1)
    answers, errors, stored = live.decide(asked, spark.createDataFrame([], live.STORED), 2.0, "P")
    assert sorted((r["idx"], r["hit_source_idx"]) for r in answers.collect()) == [(i, i % 2 if i > 1 else None) for i in range(8)]
    assert errors.isEmpty() and stored.count() == 2
    assert seen and not {"request", "cheap", "dear"} & {c for df in seen for c in df.columns}
    keys = [r["k"] for df in seen if "k" in df.columns for r in df.select("k").collect()]
    assert keys and max(map(len, keys)) == 64
