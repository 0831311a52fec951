"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training documents. The weights are
fitted on a bounded sample for each language by follow-the-regularised-leader with
elastic-net penalties, and a temperature is then calibrated on a part of
the sample that was kept out. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize
from .words import texts_of

BITS = 13
#: Expected number of training documents for each language, one in five of them for calibration.
PER_CLASS = 500
UND = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
#: Code points of a text that are turned to features at a time.
BLOCK = 1 << 20


def ngram_counts(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the lower-cased letters (all else is one space); None without letters.

    Blocks go on where the one before ended, so the counts are those of the whole text, with a space at each of its ends.
    """
    total, any_letter = np.zeros(1 << bits, np.int64), False
    shift = np.uint32(32 - bits)
    text = (text or "").lower()
    held = np.zeros(0, np.uint32)  # the last two code points that were kept
    for at in range(0, len(text) + 1, BLOCK):
        c = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _LETTER[c]
        any_letter |= bool(letter.any())
        first, last = at == 0, at + BLOCK > len(text)
        c = np.concatenate([[32] if first else [], np.where(letter, c, 32), [32] if last else []]).astype(np.uint32)
        before = np.concatenate([held[-1:] if len(held) else [0], c[:-1]])
        c = c[(c != 32) | (before != 32)]
        n, c = len(held), np.concatenate([held, c])
        one = (c + np.uint32(1)) * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for x in (one[n:], two[max(n - 1, 0) :], three[max(n - 2, 0) :]):
            total += np.bincount(x >> shift, minlength=1 << bits)
        held = c[-2:]
    return total if any_letter else None


@dataclass
class Model:
    """``weights`` (feature x class) of scaled TF-IDF vectors, ``bias``, and the calibrated ``temperature``."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.log1p(n) * self.idf[at]
        norm = np.sqrt(x @ x)
        return at, x / norm if norm else x

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        at, x = self.vector(at, n)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if self.classes else None
        if counts is None:
            return UND, 0.0
        at = np.flatnonzero(counts)
        p = softmax(self.logits(at, counts[at]) / self.temperature)
        k = int(np.argmax(p))
        return self.classes[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    classes: list[str],
    idf: np.ndarray,
    rows: list[tuple[str, np.ndarray, np.ndarray]],
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    epochs: int = 3,
) -> Model:
    """Follow-the-regularised-leader over ``rows`` (label, features, counts), then the temperature on every fifth row."""
    d, k = len(idf), len(classes)
    model = Model(classes, idf, np.zeros((d, k)), np.zeros(k))
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))
    train, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]

    def leader(at: np.ndarray) -> np.ndarray:
        return np.where(
            np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0
        )

    vectors = [(classes.index(label), *model.vector(at, n)) for label, at, n in train]
    for _ in range(epochs):
        for y, at, x in vectors:
            at, x = np.append(at, d), np.append(x, 1.0)
            w = leader(at)
            g = softmax(x @ w)
            g[y] -= 1
            grad = np.outer(x, g)
            sigma = (np.sqrt(n[at] + grad**2) - np.sqrt(n[at])) / alpha
            z[at] += grad - sigma * w
            n[at] += grad**2
    full = leader(np.arange(d + 1))
    model.weights, model.bias = full[:d], full[d]
    if held:
        logits = np.array([model.logits(at, n) for _, at, n in held])
        y = np.array([classes.index(label) for label, *_ in held])
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
        model.temperature = float(
            min(grid, key=lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean())
        )
    return model


def train(labelled: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of ``labelled`` (``doc_id, text, lang``).

    Document frequencies cover all rows; the weights are fitted on rows chosen by a hash of id and text, about
    ``per_class`` for each language, so repeated or null ids don't come together; wholly equal rows do. Rows without
    letters or without a language teach nothing; an empty table gives a model that calls every text ``und``. Other
    columns are not read, whatever their names.
    """
    spark = labelled.sparkSession
    labelled = labelled.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where("lang IS NOT NULL")
    count = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = spark.createDataFrame(
        [(lang, min(1.0, per_class / n)) for lang, n in count.items()], "lang string, share double"
    )
    chosen = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000)) < F.col("share") * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << BITS, np.int64), 0
        names = ["feature", "n", "lang", "counts"]
        for batch in batches:
            kept = []
            texts = (t for _, part in texts_of(batch.column(1)) for t in part)
            for doc_id, text, lang, pick in zip(batch.column(0).to_pylist(), texts, *(c.to_pylist() for c in batch.columns[2:])):
                counts = ngram_counts(text)
                if counts is not None:
                    rows += 1
                    df += counts > 0
                    if pick:
                        at = np.flatnonzero(counts)
                        kept.append((doc_id, lang, np.concatenate([at, counts[at]]).astype(np.int32).tobytes()))
            yield pa.record_batch(
                [
                    pa.nulls(len(kept), pa.int32()),
                    pa.array([k[0] for k in kept], pa.int64()),
                    pa.array([k[1] for k in kept], pa.string()),
                    pa.array([k[2] for k in kept], pa.binary())
                ],
                names=names,
            )
        at = np.flatnonzero(df)
        yield pa.record_batch(
            [
                pa.array(np.append(at, -1).astype(np.int32)),
                pa.array(np.append(df[at], rows)),
                pa.nulls(len(at) + 1, pa.string()),
                pa.nulls(len(at) + 1, pa.binary()),
            ],
            names=names,
        )

    told = materialize(
        labelled.join(F.broadcast(share), "lang").select("doc_id", "text", "lang", chosen.alias("pick")).mapInArrow(
            run, "feature int, n long, lang string, counts binary"
        ),
        "langid",
    )
    df = np.zeros(1 << BITS)
    total = 0
    for r in told.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r["feature"] < 0:
            total = r["n"]
        else:
            df[r["feature"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = told.where("lang IS NOT NULL").orderBy(
        F.xxhash64("n", "counts", F.lit("order")), "n"
    ).select("lang", "counts").collect()
    discard(told)
    rows = [(r["lang"], *np.frombuffer(r["counts"], np.int32).reshape(2, -1)) for r in sample]
    return fit(sorted({label for label, *_ in rows}), idf, rows)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row; ``und`` and 0 for a text that is null or has no letter.

    Only the text is read. Rows with equal or null ids each get theirs; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for _, part in texts_of(batch.column(1)) for t in part]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64())
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are not learned from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
