"""The learned encoder against numpy's decomposition, on copies, and as a stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import encoder

SF = "/root/testdata/sf0.001"


def plain(texts, dim):
    """Unit TF-IDF rows of texts with words, as a dense matrix, and the idf."""
    rows = [encoder.features(t, dim) for t in texts]
    x = np.zeros((len(texts), dim))
    for i, (at, tf) in enumerate(rows):
        x[i, at] = tf
    x = x[x.any(axis=1)]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x = x * idf
    return x / np.linalg.norm(x, axis=1, keepdims=True), idf


def corpus():
    r = random.Random(2)
    topics = [[f"t{k}w{i}" for i in range(20)] for k in range(12)]
    return [" ".join(r.choices(topics[i % 12], weights=range(1, 21), k=40)) for i in range(240)] + [None, "", " . "]


def test_directions_are_those_of_a_full_decomposition(spark):
    texts = corpus()
    model = encoder.learn(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5), dim=512, rank=10, rounds=8)
    x, idf = plain(texts, 512)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.idf, idf) and np.allclose(model.singular, s[:10], rtol=1e-3)
    assert np.allclose(model.basis.T @ model.basis, np.eye(10), atol=1e-8)
    inside = np.linalg.svd(vt[:10] @ model.basis, compute_uv=False)  # cosines between the two spaces
    assert inside.min() > 0.99


def test_near_copies_are_near(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) > 400")
    model = encoder.learn(docs)
    r = random.Random(1)
    for row in docs.limit(40).collect():
        words = row["text"].split()
        for _ in range(max(1, len(words) // 40)):
            words[r.randrange(len(words))] = "changed"
        a, b = model.vector(row["text"]), model.vector(" ".join(words))
        assert a @ a == pytest.approx(1) and a @ b > 0.9
    assert not model.vector(None).any() and not model.vector(" .. ").any()


def test_tables_and_streams_are_encoded_alike(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, "v") for i, t in enumerate(corpus())], "id long, text string, vec string").repartition(3)
    model = encoder.learn(rows, dim=256, rank=8, rounds=3)
    rows.write.parquet(str(tmp_path / "in"))
    stream = encoder.encode(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), model)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    told = lambda df: sorted((r["id"], r["text"], r["vec"]) for r in df.collect() if r["text"] is not None)
    got = encoder.encode(rows, model)
    assert got.columns == ["id", "text", "vec"] and told(spark.read.parquet(str(tmp_path / "out"))) == told(got)
    assert got.where(F.size("vec") != 8).isEmpty()
    empty = encoder.learn(rows.where("false"), dim=64, rank=4)
    assert not empty.basis.any() and encoder.encode(rows.where("id = 1"), empty).first()["vec"] == [0.0] * 4


def test_products_are_held_for_a_bounded_number_of_features(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encoder, "HELD", 10)
    rows = [[1, 2, 3], [4] * 12, [], [5] * 6, [6] * 4, [7], []]
    batch = pa.record_batch([pa.array(rows, pa.list_(pa.int32()))], names=["at"])
    parts = [p.column(0).to_pylist() for p in encoder._pieces(batch)]
    assert [row for p in parts for row in p] == rows
    assert all(len(p) == 1 or sum(map(len, p)) <= 10 for p in parts)
    sliced = batch.slice(3, 4)
    assert [row for p in encoder._pieces(sliced) for row in p.column(0).to_pylist()] == rows[3:]


def test_sums_do_not_grow_with_the_parts_of_the_texts(spark, monkeypatch):
    """A round writes one sum for each core, however many parts the texts have; the directions stay the same."""
    kind, parts = type(spark.range(1)), []
    plain = kind.mapInArrow

    def watched(self, func, schema, *a, **k):
        if schema == "f int, v array<double>":
            parts.append(self.rdd.getNumPartitions())
        return plain(self, func, schema, *a, **k)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    docs = spark.createDataFrame(list(enumerate(corpus())), "id long, text string")
    few, many = (encoder.learn(docs.repartition(n), dim=128, rank=4, rounds=2) for n in (2, 40))
    assert len(parts) == 6 and max(parts) <= spark.sparkContext.defaultParallelism
    assert np.allclose(few.singular, many.singular) and np.allclose(few.idf, many.idf)
