"""An encoder learned from the corpus: unit vectors of texts by a truncated singular value decomposition of TF-IDF rows.

Words are hashed to ``dim`` features. The leading directions are found by power iterations: every task adds up X'(XQ) of its
rows, these sums of ``dim`` x ``rank`` numbers are merged by feature, and only the merged matrix, whose size is
that of the parameters, comes to the driver to be made orthogonal again. All rows take part; none is gathered.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

WORD = re.compile(r"\w+")
#: Features, directions, power iterations, and directions beyond those that are kept while iterating.
DIM, RANK, ROUNDS, SPARE = 1 << 13, 32, 5, 8
#: Texts that are cut at a time, and features whose products are held at a time.
TEXTS, HELD = 256, 1 << 16
_ROWS = "n int, packed binary"


@dataclass
class Encoder:
    """``idf`` by feature and the orthonormal ``basis`` (features x directions), largest singular value first."""

    idf: np.ndarray
    basis: np.ndarray
    singular: np.ndarray

    def vector(self, text: str | None) -> np.ndarray:
        """The unit vector of a text; zeros where it has no word, or none that the basis knows."""
        at, tf = features(text, len(self.idf))
        x = tf * self.idf[at]
        v = x @ self.basis[at] if len(at) else np.zeros(self.basis.shape[1])
        length = np.sqrt(v @ v)
        return v / length if length > 0 else v


def features(text: str | None, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a text, in order, and 1 + ln of how often each occurs."""
    count: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        count[zlib.crc32(word.encode()) % dim] += n
    at = np.array(sorted(count), np.int64)
    return at, 1 + np.log(np.array([count[i] for i in at.tolist()], np.float64)) if len(at) else np.zeros(0)


def _sparse(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, features and TF-IDF values of a batch, each row at length 1."""
    at, tf = batch.column(0), batch.column(1)
    size = np.diff(at.offsets.to_numpy())
    where = np.repeat(np.arange(len(size)), size)
    feature = at.flatten().to_numpy().astype(np.int64)
    x = tf.flatten().to_numpy().astype(np.float64) * idf[feature]
    length = np.sqrt(np.bincount(where, x * x, len(size)))
    return where, feature, x / np.where(length > 0, length, 1)[where]


def _packed(found: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Features of some texts as compressed Arrow data, a small part of what rows of arrays take."""
    batch = pa.record_batch([pa.array([at for at, _ in found], pa.list_(pa.int32())), pa.array([tf for _, tf in found], pa.list_(pa.float32()))], names=["at", "tf"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("packed"):
            yield from pa.ipc.open_stream(packed.as_buffer())


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``HELD`` features, or of one row."""
    ends = np.cumsum(np.diff(batch.column(0).offsets.to_numpy()))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def learn(docs: DataFrame, text: str = "text", dim: int = DIM, rank: int = RANK, rounds: int = ROUNDS, seed: int = 7) -> Encoder:
    """An encoder of ``docs``. Null and blank texts teach nothing; without any other the basis is empty of meaning (zeros)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                found = [features(t.as_py(), dim) for t in batch.column(0).slice(k, TEXTS)]
                found = [(at, tf) for at, tf in found if len(at)]
                yield pa.record_batch([pa.array([len(found)], pa.int32()), pa.array([_packed(found)], pa.binary())], names=["n", "packed"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, np.int64)
        for batch in _opened(batches):
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=dim)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["f", "n"])

    rows = cut_lineage(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(cut, _ROWS))
    n = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = np.zeros(dim)
    for r in rows.mapInArrow(seen, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # dim rows at most
        df[r["f"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    width = min(rank + SPARE, dim)
    spark = docs.sparkSession

    def times(q: np.ndarray) -> np.ndarray:
        """X'(XQ), a task's rows at a time."""
        shared = spark.sparkContext.broadcast((q, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, weight = shared.value
            sums = np.zeros((held.shape[1], dim))
            columns = np.ascontiguousarray(held.T)
            for piece in (p for batch in _opened(batches) for p in _pieces(batch)):
                where, feature, x = _sparse(piece, weight)
                for column, total in zip(columns, sums):
                    xq = np.bincount(where, x * column[feature], piece.num_rows)
                    total += np.bincount(feature, x * xq[where], dim)
            total = sums.T
            some = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["f", "v"])

        def merged(table: pa.Table) -> pa.Table:
            v = np.array(table.column("v").to_pylist()).sum(axis=0)
            return pa.table({"f": table.column("f").slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

        # sums of ``dim`` x ``rank`` numbers for each core, however many parts the texts have
        sums = rows.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "f int, v array<double>").groupBy("f").applyInArrow(merged, "f int, v array<double>")
        out = np.zeros((dim, q.shape[1]))
        for r in sums.collect():  # dim rows at most
            out[r["f"]] = r["v"]
        shared.unpersist()
        return out

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times(q))[0]
    value, turn = np.linalg.eigh(q.T @ times(q))
    order = np.argsort(value)[::-1][:rank]
    basis = q @ turn[:, order]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] + 1e-300)  # signs that don't depend on the start
    value = np.maximum(value[order], 0)
    return Encoder(idf, basis * (value > 1e-9), np.sqrt(value))


def encode(rows: DataFrame, model: Encoder, text: str = "text", name: str = "vec") -> DataFrame:
    """``rows`` with the unit vector of each text (``array<float>``); of a table or of a stream. All columns are kept."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.vector(t.as_py()).astype(np.float32) for t in batch.column("_text")]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*columns, pa.array(made, pa.list_(pa.float32()))], names=[*batch.schema.names[:-1], name])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{name}` array<float>"])
    return rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)
