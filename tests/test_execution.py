"""Runs in waves against one request after the other: calls, retries, resumption."""

import random

import numpy as np
import pytest

from sluice.operators import execution
from sluice.sources import tables

PRICES, BUDGETS = {"cheap": (1.0, 1.0), "expensive": (2.0, 2.0)}, {"cheap": 100, "expensive": 200}
SCHEMA = "idx long, request string, dup_type string, group_id string, vec array<float>"


def workload(n=40, seed=1):
    r, x = random.Random(seed), np.random.default_rng(seed).normal(size=(6, 5))
    rows, groups = [], []
    for i in range(n):
        v = x[r.randrange(6)] + np.array([r.gauss(0, 0.3) for _ in range(5)])
        v = (v / np.linalg.norm(v)).astype(np.float32).tolist() if i % 9 else None
        if groups and r.random() < 0.4:
            rows.append((i, f"why {r.randrange(i)}", r.choice(["paraphrase", "trap", "exact"]), r.choice([*groups, "lost"]), v))
        else:
            groups.append(f"g{i}")
            rows.append((i, f"why {i}", "novel", f"g{i}", v))
    return rows


def model():
    budgets = tuple(BUDGETS.values())

    def said(tier, request, budget):  # sent to workers as it is, which can't import this file
        i = int(request.split()[1])
        if i % 7 == 3:
            raise ValueError("content-blocked")
        if i % 8 == 5 and budget in budgets:
            return " ", 1, 0, 1.0
        if i % 8 == 6 and tier == "cheap":
            return "I am not sure", 2, 2, 1.0
        return f"{tier} {i}", 3, 3, 1.0

    return said


said = model()


def one_by_one(rows, config, threshold):
    novel = {g: i for i, _, d, g, _ in rows if d == "novel"}
    wave = {i: int(d != "novel" and g in novel) for i, _, d, g, _ in rows}
    stored, out = [], {}
    for i, request, _, _, v in sorted(rows, key=lambda r: (wave[r[0]], r[0])):
        key = request.lower()
        there = sorted(s for s in stored if s[0] < i)
        exact = [s for s in there if s[1] == key]
        sims = [(float(np.array(v, float) @ np.array(s[2], float)), -s[0], s) for s in there if v is not None and s[2] is not None]
        hit = ("cache_exact", exact[0]) if exact else ("cache_semantic", max(sims)[2]) if sims and max(sims)[0] >= threshold else None
        if config != "baseline" and hit:
            out[i] = (hit[0], hit[1][0], hit[1][3], 0, None)
            continue
        tiers = {"router_cascade": ["cheap", "expensive"]}.get(config, ["expensive"])
        text, tokens, error = "", 0, None
        for tier in tiers:
            text, t, _, _, _, error = execution.ask_one(said, tier, request, BUDGETS[tier], 1)
            tokens += t
            if error or (text.strip() and "not sure" not in text):
                break
        out[i] = ("model_direct" if config == "baseline" else "miss", None, text, tokens, error)
        if not error and text.strip():
            stored.append((i, key, v, text))
    return out


def told(df):
    return {r["idx"]: (r["kind"], r["hit_source_idx"], r["answer_text"], r["tokens_in"], r["error"]) for r in df.collect()}


@pytest.mark.parametrize("config", ["cache", "router_cascade", "baseline"])
def test_a_stopped_run_goes_on(spark, tmp_path, config):
    rows, log, answer = workload(), tmp_path / "calls", said
    log.mkdir()

    def provider():
        import uuid

        def client(tier, request, budget):
            (log / f"{tier}-{request.split()[1]}-{budget}-{uuid.uuid4().hex}").touch()
            return answer(tier, request, budget)

        return client

    def run(stop=None):
        table = spark.createDataFrame(rows, SCHEMA).repartition(3)
        return told(execution.run_config(table, config, "low", str(tmp_path / "runs"), provider, 0.8, PRICES, BUDGETS, 1, stop))

    want = one_by_one(rows, config, 0.8)
    wave = {r["idx"]: r["wave"] for r in execution.waves(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert run(1) == {i: x for i, x in want.items() if wave[i] == 0} and set(wave.values()) == {0, 1}
    (tmp_path / "runs" / f"config={config}" / "frac=low" / "outcomes" / "wave=0" / "_SUCCESS").unlink()  # as if it was stopped before it wrote
    before = len(list(log.iterdir()))
    run(1)
    assert len(list(log.iterdir())) == before  # calls that were written are not made again
    assert run() == want == run()
    made = [f.name.rsplit("-", 1)[0] for f in log.iterdir()]
    blocked = [x for x in made if int(x.split("-")[1]) % 7 == 3 and x.startswith("expensive")]
    if config != "router_cascade":
        same = [r[1] for r in rows if int(r[1].split()[1]) % 7 == 3]
        assert blocked and len(blocked) <= len(same)  # one call each, none again
    whole = tables.read_runs(spark, str(tmp_path / "runs"), tables.OUTCOMES, "outcomes")
    assert whole.where(f"config = '{config}'").count() == len(rows)


def test_retries_and_both_bills():
    def failing(times, error):
        left = [times]

        def client(tier, request, budget):
            if left[0]:
                left[0] -= 1
                raise OSError(error)
            return (" ", 2, 0, 1.0) if budget == 100 else ("yes", 3, 4, 2.0)

        return client

    assert execution.ask_one(failing(0, ""), "cheap", "q", 100, 2) == ("yes", 5, 4, 3.0, 1, None)
    assert execution.ask_one(failing(2, "busy"), "cheap", "q", 100, 2) == ("yes", 5, 4, 3.0, 3, None)
    assert execution.ask_one(failing(3, "busy"), "cheap", "q", 100, 2) == ("", 0, 0, 0.0, 3, "OSError: busy")
    assert execution.ask_one(failing(9, "content-blocked: x"), "cheap", "q", 100, 2) == ("", 0, 0, 0.0, 1, "OSError: content-blocked: x")
