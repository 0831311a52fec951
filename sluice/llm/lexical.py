"""Ranked lexical search: exact top documents of many queries, with a two-level quantised index.

Level one holds a byte for each term of a document: its share of the score, rounded upwards in steps of 1/255 of the
largest share there is. A document's bytes, weighed by the terms, bound its score from above, and a step less from
below. Level two holds the counts from which the score is computed in whole numbers. Documents are dealt to blocks;
each block lists its postings by term, so that a query reads its own terms only.

1. One pass cuts texts into terms, writes the blocks, and counts documents, terms, and documents of each term.
2. Each block finds its best lower bounds of each query; the k-th best of all is the query's bar.
3. Each block rescores all documents whose upper bound reaches the bar, exactly. The best k of all are the result.

Nothing but documents that k others surpass is left out, so the result is exact at any size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize
from .words import buffers

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# fixed values: the score's constants
K, B, SHARE, TF = 100, 90, 1_000_000_000, 1000
#: No share is larger: ``SHARE * tf div (TF * tf + ...)`` is below ``SHARE / TF``. A byte counts steps of ``STEP``.
STEP = -(-(SHARE // TF) // 255)
#: Documents and postings of a block at most (one document at least).
DOCS, POSTINGS = 8192, 1_000_000
#: Terms, with repeats between queries, that are searched at a time: they are broadcast, some 50 bytes each. More queries
#: are searched in further passes.
TERMS = 1_000_000

_BLOCK = pa.schema([("term", pa.int32()), ("df", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64()), ("ids", pa.binary()),
                    ("lengths", pa.binary()), ("at", pa.binary()), ("who", pa.binary()), ("tf", pa.binary())])
_BLOCK_SQL = "term int, df long, docs long, terms long, ids binary, lengths binary, at binary, who binary, tf binary"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that isn't ASCII; A to Z as lower case."""
    return TERM.findall(text.lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def shares(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share of a document's score, before its weight."""
    m = K - B + (B * length * n_docs) // n_terms
    return (SHARE * tf) // (TF * tf + 8 * m)


@dataclass
class Queries:
    """Queries as lists of numbered terms: query ``i`` has ``terms[start[i]:start[i + 1]]``."""

    names: list
    vocabulary: list[bytes]
    start: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Queries:
        number: dict[bytes, int] = {}
        lists = [[number.setdefault(t, len(number)) for t in terms] for _, terms in rows]
        start = np.cumsum([0, *map(len, lists)])
        return cls([name for name, _ in rows], list(number), start, np.array([t for x in lists for t in x], np.int64))


def _blocks(vocabulary: list[bytes]):
    """Blocks of an index over ``vocabulary``; the counts of terms come as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary.value)}
        df = np.zeros(len(number), np.int64)
        ids: list = []
        lengths: list[int] = []
        found: list[tuple[list, list]] = []
        docs = terms = postings = 0

        def block() -> pa.RecordBatch:
            at = np.repeat(np.arange(len(found), dtype=np.int32), [len(x[0]) for x in found])
            what = np.array([t for x in found for t in x[0]], np.int32)
            tf = np.array([n for x in found for n in x[1]], np.int32)
            order = np.argsort(what, kind="stable")
            known, first = np.unique(what[order], return_index=True)
            df[known] += np.diff(np.append(first, len(what)))
            pairs = np.stack([known, first]).astype(np.int32)
            told = np.array([(0, 0) if i is None else (1, i) for i in ids], np.int64).reshape(-1, 2)
            row = [None, None, None, None, told.tobytes(), np.array(lengths, np.int64).tobytes(), pairs.tobytes(),
                   at[order].tobytes(), tf[order].tobytes()]
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            data, at = buffers(batch.column(1))
            view = memoryview(data)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                said = terms_of(bytes(view[a:b]))
                docs, terms = docs + bool(said), terms + len(said)
                count = Counter(x for x in map(number.get, said) if x is not None)
                if count:
                    ids.append(doc_id), lengths.append(len(said)), found.append((list(count), list(count.values())))
                    postings += len(count)
                    if len(ids) >= DOCS or postings >= POSTINGS:
                        yield block()
                        ids, lengths, found, postings = [], [], [], 0
        if found:
            yield block()
        known = np.flatnonzero(df)
        none = pa.nulls(len(known) + 1, pa.binary())
        one = np.zeros(len(known) + 1, np.int64)
        one[-1] = 1
        yield pa.record_batch(
            [pa.array(np.append(known, -1).astype(np.int32)), pa.array(np.append(df[known], 0)), pa.array(one * docs),
             pa.array(one * terms), none, none, none, none, none], schema=_BLOCK,
        )

    return run


class _Block:
    """A block of the index as arrays."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        told = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
        self.ids, self.null = told[:, 1], told[:, 0] == 0
        known, first = np.frombuffer(row["at"], np.int32).reshape(2, -1)
        self.who, tf = np.frombuffer(row["who"], np.int32), np.frombuffer(row["tf"], np.int32).astype(np.int64)
        self.span = dict(zip(known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(self.who)])))
        self.share = shares(tf, np.frombuffer(row["lengths"], np.int64)[self.who], n_docs, n_terms)
        self.byte = (-(-self.share // STEP)).astype(np.uint8)
        self.weights = weights

    def _gather(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and postings of ``terms``, and the weight of each posting."""
        spans = [(self.span[t], self.weights[t]) for t in terms.tolist() if t in self.span and self.weights[t] > 0]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([np.arange(a, b) for (a, b), _ in spans]), np.repeat([w for _, w in spans], [b - a for (a, b), _ in spans])

    def bounds(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of every document's score, from the bytes alone."""
        at, w = self._gather(terms)
        who, n = self.who[at], len(self.ids)
        high = np.zeros(n, np.int64)
        high += np.bincount(who, w * self.byte[at], n).astype(np.int64) * STEP  # whole numbers below 2^53
        low = high - np.bincount(who, w, n).astype(np.int64) * STEP
        low += np.bincount(who, minlength=n)  # a share is at least one above the step below
        return high, np.maximum(low, 0)

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of some documents."""
        at, w = self._gather(terms)
        chosen = np.zeros(len(self.ids), bool)
        chosen[docs] = True
        keep = chosen[self.who[at]]
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.who[at[keep]], w[keep] * self.share[at[keep]])
        return out[docs]


def _by_query(queries, stats, work, schema: pa.Schema):
    """``work(block, query number, its terms)`` gives rows for each block and query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, (weights, n_docs, n_terms) = queries.value, stats.value
        for batch in batches:
            for row in batch.to_pylist():
                block, rows = _Block(row, weights, n_docs, n_terms), []
                for q in range(len(asked.names)):
                    rows.extend(work(block, q, asked.terms[asked.start[q] : asked.start[q + 1]]))
                yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _search(docs: DataFrame, rows: list[tuple], k: int) -> DataFrame:
    """Exact best ``k`` documents of the queries ``rows`` (name and terms), as ``query, doc_id, score, rank``."""
    spark = docs.sparkSession
    asked = Queries.of(rows)
    told, words = spark.sparkContext.broadcast(asked), spark.sparkContext.broadcast(asked.vocabulary)
    index = materialize(docs.select("doc_id", "text").mapInArrow(_blocks(words), _BLOCK_SQL), "lexical-index")
    # a row for each term of the queries
    counts = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect()
    df = {r["term"]: r["df"] for r in counts}
    n_docs, n_terms = next(((r["docs"], r["terms"]) for r in counts if r["term"] == -1), (0, 0))
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(asked.vocabulary))], np.int64)
    stats = spark.sparkContext.broadcast((weights, n_docs, n_terms))
    blocks = index.where("term IS NULL").drop("term", "df", "docs", "terms")

    def lowest(block: _Block, q: int, terms: np.ndarray) -> list[tuple]:
        low = block.bounds(terms)[1]
        low = low[low > 0]
        return [(q, x) for x in (np.partition(low, len(low) - k)[-k:] if len(low) > k else low).tolist()]

    bound = pa.schema([("q", pa.int32()), ("low", pa.int64())])
    lows = blocks.mapInArrow(_by_query(told, stats, lowest, bound), "q int, low long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
    # a row for each query
    bars = np.zeros(len(rows), np.int64)
    for r in lows.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).collect():
        bars[r["q"]] = r["low"]
    bar = spark.sparkContext.broadcast(bars)

    def best(block: _Block, q: int, terms: np.ndarray) -> list[tuple]:
        high = block.bounds(terms)[0]
        able = np.flatnonzero((high > 0) & (high >= bar.value[q]))
        score = block.scores(terms, able)
        able, score = able[score > 0], score[score > 0]
        order = np.lexsort((block.ids[able], block.null[able], -score))[:k]
        return [(q, None if block.null[d] else int(block.ids[d]), int(s)) for d, s in zip(able[order], score[order])]

    found = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
    top = blocks.mapInArrow(_by_query(told, stats, best, found), "q int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    top = materialize(top.withColumn("rank", place).where(F.col("rank") <= k), "lexical-top")
    discard(index)
    return top


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
    query_id: str = "item_id", query_text: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each query the ``k`` documents of the highest score above 0, equal ones by id.

    Statistics cover all documents. A null text has no terms and is never found; rows with equal ids are documents of their
    own, a null id comes after all others of its score. Repeated queries are each answered. Empty tables and
    queries without terms give no rows; other columns are not read, whatever their names. Queries are taken in passes of
    ``TERMS`` terms, each over all documents.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = queries.select(F.col(f"`{query_id}`").cast("long").alias("name"), F.col(f"`{query_text}`").cast("string").alias("text"))
    out, rows, size = [], [], 0
    schema = "q int, doc_id long, score long, rank int"

    def search_rows() -> None:
        names = docs.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(rows)], "q int, item_id long")
        out.append(_search(docs, rows, k).join(F.broadcast(names), "q"))  # a row for each query of the pass

    for r in asked.toLocalIterator():
        terms = sorted(set(terms_of((r["text"] or "").encode())))
        if terms:
            if rows and size + len(terms) > TERMS:
                search_rows()
                rows, size = [], 0
            rows.append((r["name"], terms))
            size += len(terms)
    if rows:
        search_rows()
    if not out:
        out.append(docs.sparkSession.createDataFrame([], schema + ", item_id long"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB's SQL, over all pairs of an item and a document that share a term.
ORACLE = r"""
WITH said AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
stats AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM said),
postings AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
    FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM said) GROUP BY r, term),
items AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM postings, stats WHERE term IN (SELECT term FROM items) GROUP BY term),
scores AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM items JOIN weights USING (term) JOIN postings USING (term), stats GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
