"""Ranked search against a plain scan over all documents, and on odd tables."""

import math
import random
import re
from collections import Counter

import pytest

from sluice.llm import catalog, lexical

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, item_id string, term int, `k y` string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    said = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in said), sum(len(t) for _, t in said)
    counts = [(i, len(t), Counter(t)) for i, t in said]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for name, text in items:
        found = []
        for i, n, count in counts:
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if t in count:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * count[t]) // (1000 * count[t] + 8 * (10 + (90 * n * n_docs) // n_terms)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(name, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 3, "z") for i, t in docs], SCHEMA).repartition(5),
            spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string"))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n=300):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "日本語", "A", "a", "x-y", "don't"]
    some = lambda: " ".join(r.choice(words[: r.randrange(1, len(words))]) for _ in range(r.randrange(1, 60)))
    docs = [(i, some()) for i in range(n)] + [(900, None), (901, ""), (902, " .,; "), (903, "w1 " * 5000), (None, "w2 w3"), (None, "w2 w3")]
    docs += [(1000 + i, docs[7][1]) for i in range(50)] + [docs[5], docs[5]]
    items = [(i, some()) for i in range(25)] + [(30, None), (31, "?"), (32, "unheard of"), (33, "W1 w1 W2"), (33, "W1 w1 W2"), (None, "w2 w3"), (34, "日本語 a")]
    return docs, items


@pytest.mark.parametrize("sizes", [(8192, 1_000_000, 1_000_000), (7, 40, 60)])
def test_against_a_plain_scan(spark, monkeypatch, sizes):
    for name, value in zip(("DOCS", "POSTINGS", "TERMS"), sizes):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    for k in (1, 10):
        assert found(lexical.search(*frames(spark, docs, items), k=k)) == plain(docs, items, k)


def test_bounds_hold(spark):
    import numpy as np

    share = np.arange(0, 1_000_000, 7)
    byte = -(-share // lexical.STEP)
    assert byte.max() <= 255 and (byte * lexical.STEP >= share).all() and ((byte - 1) * lexical.STEP < share).all()


def test_query_over_the_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect() for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert found(catalog.op11_lexical_search(spark, SF)) == plain([tuple(d) for d in docs], [tuple(i) for i in items])


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("false"), items.where("false"))):
        got = lexical.search(d, i)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
