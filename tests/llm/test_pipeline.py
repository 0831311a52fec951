"""The pipeline's rows against its stages done by hand."""

from collections import Counter, defaultdict

import corpus_pipeline
from sluice.llm import mixing, quality

from test_llm_operators import WORD, classes, leaks

def word_count(t):
    return len(WORD.findall(t or ""))


SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r["doc_id"]: r for r in docs.collect()}
    body = {
        r["doc_id"]: r["cleaned"] if r["failed_lines"] else held[
            r["doc_id"]
        ]["text"] for r in quality.judge_documents(docs).where("kept").collect()
    }
    ids = sorted(body)
    told = classes([body[j] for j in ids])
    kept = [i for k, i in enumerate(ids) if told[k][1] == k]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {kept[k] for k, _ in leaks([body[j] for j in kept], items)}
    clean = [i for i in kept if i not in gone]
    out = corpus_pipeline.run(spark, SF).collect()
    got = Counter(r["doc_id"] for r in out)
    assert set(got) <= set(clean) and max(got.values()) <= 2
    by = defaultdict(int)
    for i in clean:
        by[held[i]["source"]] += word_count(body[i])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    for name, budget in zip(
        names, mixing.targets([by[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    ):
        mine = [i for i in clean if held[i]["source"] == name]
        taken = sum(got[i] * word_count(body[i]) for i in mine)
        assert budget - 1 <= taken <= budget + max(map(word_count, (body[i] for i in mine)))
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(40))
