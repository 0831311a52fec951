"""Benchmark decontamination: which documents hold most of a benchmark item.

Items are partitioned by size. The smallest shingle hashes of an item (its bottom-k MinHash sketch)
are looked up among all shingles of every document; k is taken, for each size partition, so that a document
with ``containment`` of an item's shingles can miss at most k - 1 of them, whatever its own
length, so one hit at least is certain. Candidates are verified by exact containment of the shingles themselves. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

WIDTH, PERCENT = 5, 75
#: Shingles of benchmark items up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, whatever the optimizer merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(w: Column, width: int, of) -> Column:
    """``of(i)`` for the first word of each shingle; one for a shorter text; none without words."""
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), of))


def shingle_hashes(text: Column, width: int) -> Column:
    """Distinct hashes of the shingles of ``text``; null without words."""
    full = lambda h: lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))
    return F.array_distinct(
        _let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: _windows(h, width, full(h)))
    )


def shingle_strings(text: Column, width: int) -> Column:
    """Distinct shingles of ``text``; null without words."""
    return F.array_distinct(
        _let(words(text), lambda w: _windows(w, width, lambda i: F.array_join(F.slice(w, i + 1, width), " ")))
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """``(doc_id, item_id, n_item, n_common, containment)``: documents with ``percent`` of an item's distinct shingles or more.

    Words are lower-cased runs of other than ASCII white space. An item of fewer
    than ``width`` words is one shingle, found only in a document that is just those words. Items and documents that are
    null or blank match nothing. Of rows with equal ids the best counts; rows with a
    null id are left out. An empty table on either side gives an empty result. Other columns are not read.
    """
    item = items.select(
        F.col(item_id).alias("item_id"), F.col(item_text).alias("body")
    ).where("item_id IS NOT NULL").dropDuplicates().withColumn("item", F.xxhash64("item_id", "body"))
    grams = materialize(
        item.select(
            "item", "item_id", "body", shingle_hashes(F.col("body"), width).alias("hashes")
        ).where("hashes IS NOT NULL").withColumn("n_item", F.size("hashes")),
        "items",
    )
    # the largest size of the item's partition: one less than the next power of two
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_item").cast("double"))) + 1).cast("long") - 1
    k = F.least(F.col("n_item"), largest - F.ceil(largest * percent / 100) + 1).cast("int")
    sketches = materialize(
        grams.select("item", "n_item", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), k)).alias("hash")),
        "sketches",
    )
    rows, full = sketches.count(), grams.agg(F.coalesce(F.sum("n_item"), F.lit(0))).first()[0]

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    # explode_outer: for explode the optimizer would compute the hashes once more, to filter empty arrays
    probes = source.select(
        "doc_id", F.xxhash64("text").alias("row"), F.explode_outer(shingle_hashes(F.col("text"), width)).alias("hash")
    )
    hits = probes.join(_small(sketches, rows), "hash")
    candidates = materialize(
        hits.groupBy("doc_id", "row", "item").agg(F.count(F.lit(1)).alias("sketch_hits")), "candidates"
    )

    wanted = grams.select(
        "item", "item_id", shingle_strings(F.col("body"), width).alias("shingles")
    ).withColumn("n_item", F.size("shingles"))
    exact = _small(wanted.select("item", "item_id", "n_item", F.explode("shingles").alias("shingle")), full)
    # only candidates' texts are read again, by a join that broadcasts the candidates if they are few
    again = source.withColumn("row", F.xxhash64("text")).join(
        candidates.select("doc_id", "row").distinct(), ["doc_id", "row"]
    )
    found = again.select(
        "doc_id", "row", F.explode_outer(shingle_strings(F.col("text"), width)).alias("shingle")
    ).join(exact, "shingle")
    common = found.groupBy("doc_id", "row", "item", "item_id", "n_item").agg(
        F.countDistinct("shingle").alias("n_common")
    ).join(candidates.select("doc_id", "row", "item"), ["doc_id", "row", "item"], "left_semi")
    held = common.where(F.col("n_common") * 100 >= F.col("n_item") * percent)
    best = held.groupBy("doc_id", "item_id").agg(
        F.max(
            F.struct(
                (F.col("n_common") / F.col("n_item")).alias("containment"),
                F.col("n_item").cast("long").alias("n_item"),
                "n_common",
            )
        ).alias("b")
    )
    return best.select("doc_id", "item_id", "b.n_item", "b.n_common", "b.containment")


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no item of ``items``.

    A leak is one of the text, so rows with equal or null ids are judged each by its own. Null, empty and blank texts hold
    none and stay. All columns are kept, whatever their names; an empty table on either side keeps all rows.
    """
    body = F.xxhash64(F.col(f"`{text}`").cast("string"))
    named = docs.select(body.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    leaks = find_leaks(named, items).select(F.col("doc_id").alias("_leak")).distinct()
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.when(F.col(f"`{text}`").isNotNull(), body).alias("_body"),
    )
    return whole.join(leaks, F.col("_body") == F.col("_leak"), "left_anti").select("doc.*")


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS sh
  FROM w WHERE id IS NOT NULL AND len(w) > 0
), n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_common, count(*)::DOUBLE / any_value(n.n_item) AS containment
FROM s i JOIN s d ON d.sh = i.sh AND d.kind = 'd' JOIN n ON n.id = i.id
WHERE i.kind = 'i'
GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(n.n_item) * 75
"""
