"""The prefix trie against a plain one, over many shapes and block sizes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import catalog, prefix_trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, d int, `n x` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mark(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows, group=20, most=4):
    """Nodes of the trie from ``(conv_id, turn, role, text)`` rows, one dictionary entry for each beginning."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, mark(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    told = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (c % group if c >= 0 else -(-c % group))
        told[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, t in told.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        spare = (len(members[s]) - 1) * len(WORD.findall(s[-1][1])) if s else 0
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = spare + sum(saved[x] for x in children[s])
    ends = lambda s: ",".join(str(c) for c in sorted(members[s]) if told[c] == s)
    return sorted(
        (min(members[s]), len(s), min(members[s[:-1]]) if s else -1, len(members[s]), len(children[s]), leaves[s], saved[s],
         hashlib.sha256(ends(s).encode()).hexdigest()) for s in members
    )


def found(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA).repartition(3)


def shapes():
    r = random.Random(11)
    few = [(c, t, r.choice("ua"), r.choice(["x", "y y", "z z z"])) for c in range(60) for t in range(r.randrange(1, 6))]
    chain = [(c, t, "u", "same words") for c in range(0, 400, 20) for t in range(c // 20 + 1)]
    long = [(c, t, "u", f"w{t if t < 150 else c % 2}") for c in (1, 2, 3, 20, 41) for t in range(200 if c != 3 else 130)]
    copies = [(c, t, "u", f"turn {t}") for c in range(100) for t in range(3)]
    odd = [(None, 1, "u", "lost"), (5, None, None, None), (5, None, "u", ""), (5, 2, "u", "b"), (5, 2, "u", "b"), (5, 2, "u", "a"),
           (-3, 1, "u", "neg"), (-25, 0, "u", "q"), (-20, 0, "u", "p"), (7, 1, "", ""), (8, 1, None, None)]
    short = [(c, 0, "u", "only") for c in range(1, 19)]
    return {"few": few, "chain": chain, "long": long, "copies": copies, "odd": odd, "short": short, "one": [(9, 1, "u", "a b")]}


@pytest.mark.parametrize("name", shapes())
def test_against_a_plain_trie(spark, name, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "RADIX", 4)
    rows = shapes()[name]
    assert found(prefix_trie.conversation_trie(frame(spark, rows))) == plain(rows)


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = catalog.op13_prefix_trie(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert found(got) == plain(rows)


def test_empty_table(spark):
    got = prefix_trie.conversation_trie(frame(spark, [(None, 1, "u", "x")]))
    assert got.count() == 0 and got.columns == catalog.op13_prefix_trie(spark, SF).columns


def test_nearest_smaller_places_and_least():
    import numpy as np

    r = random.Random(2)
    for _ in range(200):
        v = [r.randrange(4) for _ in range(r.randrange(1, 40))]
        left, right = prefix_trie._nearest(v)
        for k, x in enumerate(v):
            assert left[k] == max((j for j in range(k) if v[j] < x), default=None)
            assert right[k] == min((j for j in range(k + 1, len(v)) if v[j] < x), default=None)
        spans = np.array([(a, z) for a in range(len(v)) for z in range(a + 1, len(v) + 1)])
        assert prefix_trie._least(np.array(v), spans).tolist() == [min(v[a:z]) for a, z in spans]


def test_prefix_sums_over_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    df = spark.range(50).select(F.col("id").alias("at"), (F.col("id") * 7 % 11).alias("v"))
    got = {r["at"]: r["before_v"] for r in prefix_trie.running(df, "at", ["v"], 50).collect()}
    assert got == {k: sum(i * 7 % 11 for i in range(k)) for k in range(50)}
