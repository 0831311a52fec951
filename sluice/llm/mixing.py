"""Mixing sources to target weights.

Documents get hash-random keys and are range-sorted within their source; distributed prefix sums of token counts find
where each source's budget ends. The document at the cut gives just the rest of the budget, and a budget above the
source's size starts over. Sources are a table of their own, never a list on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.workload import numbered
from .prefix import prefix_sums
from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Budgets of a short list of sources, as ``with_targets`` gives them for a table."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]] if total else []
        for i in full or open_:
            out[i] = most * sizes[i] if full else left * weights[i] / total if total else 0.0
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def with_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to a table of ``size`` and ``weight``: ``share`` of all sizes by weight, none above ``most`` times its size.

    What a source can't take is shared again by weight among those below their limit, until none is above. Each turn reads
    sums of the table; one turn at least fills a source, and few are needed. Rounded to six places.
    """
    limit, aim = F.col("size") * F.lit(float(most)), F.lit(False)
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level = 0.0
    while True:
        row = sizes.agg(
            F.coalesce(F.sum(F.when(aim, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~aim, F.col("weight"))), F.lit(0.0)),
            F.count_if(aim),
        ).first()
        full, open_weight, n_full = row
        level = (share * total - full) / open_weight if open_weight > 0 else 0.0
        above = aim | (F.lit(level) * F.col("weight") > limit)
        if open_weight <= 0 or sizes.where(above).count() == n_full:
            break
        aim = F.lit(level) * F.col("weight") > limit
    return sizes.withColumn(
        "target", F.round(F.when(aim, limit).otherwise(F.lit(level) * F.col("weight")).cast("double"), 6)
    )


def _columns(doc_id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    body, key = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    # 60 bits of a hash that any engine has, moved to the middle of the 64-bit range; a null id is hashed by its text
    named = F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.md5(body.cast("binary"))), F.lit("none"))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), named).cast("binary")), 1, 15), 16, 10).cast("long")
    return {"_name": F.col(f"`{source}`"), "_id": key, "_key": (bits - (1 << 59)) * 16, "_text": F.xxhash64(body)}


def _placed(
    docs: DataFrame,
    doc_id: str,
    text: str,
    source: str,
    weights: tuple[float, ...],
    share: float,
    most: float,
    seed: int,
) -> DataFrame:
    """``_name, _id, _key, _text, size, source_size, target, before`` of each row."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = materialize(
        docs.select(*(c.alias(n) for n, c in _columns(doc_id, text, source, seed).items()), size.alias("size")), "sizes"
    )
    sizes = narrow.groupBy("_name").agg(F.sum("size").alias("size"))
    # code point order, null last
    ranked = numbered(
        sizes.withColumn(
            "_o", F.struct(F.col("_name").isNull().alias("no"), F.col("_name").cast("string").alias("name"))
        ),
        "_o",
        "_source",
    ).drop("_o")
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod(F.col("_source"), F.lit(len(weights))).cast("int")]
    named = materialize(
        with_targets(materialize(ranked.withColumn("weight", weight), "sources"), share, most), "targets"
    )
    named = named.select(
        F.col("_name").alias("_named"),
        F.col("_source").cast("long").alias("_source"),
        F.col("size").alias("source_size"),
        "target",
    )
    # whether a row for each source is broadcast depends on its size
    rows = narrow.join(named, F.col("_name").eqNullSafe(F.col("_named"))).drop("_named")
    return prefix_sums(
        rows.withColumn("_tie", F.struct("_id", "_text")), "_source", "_key", "_tie", "size", narrow.count()
    )


def mixture(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` of each document.

    ``weights`` go round the sources in code point order, null last (a null source is a source of its own). ``size``
    counts words (null: 0). ``taken`` is the number of words that the mix takes, repeats included; at most ``ceil(most)``
    times ``size``. A source's ``taken`` adds up to its target, rounded down. Documents with equal ids (none of them null)
    follow each other in the order; reruns agree. Sources without words have target 0. An empty table gives an empty one.
    Other columns are not read.
    """
    placed = _placed(docs, doc_id, text, source, weights, share, most, seed)
    cut = F.floor("target")
    epochs = math.ceil(most) + 1  # a target is at most ``most`` times its source
    taken = sum(
        (
            F.greatest(
                F.lit(0), F.least(F.col("size"), cut - e * F.col("source_size") - F.col("before"))
            ) for e in range(epochs)
        ),
        F.lit(0),
    )
    return placed.select(
        F.col("_id").alias("doc_id"),
        F.col("_name").alias("source"),
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
    )


def repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each epoch that takes words of them.

    A document at the cut is taken whole. Rows with equal or null ids each have their own number of epochs; only rows with
    equal id, source and text are taken together. Rows without words are not taken. All columns are kept, whatever their
    names. The order is by key, so a source's whole epochs and the last key that its rest reaches say what each row gets:
    a row for each source is joined, and no text is moved.
    """
    placed = _placed(docs, doc_id, text, source, weights, share, most, seed).where("size > 0")
    whole = F.expr("floor(target) div source_size")
    rest = F.floor("target") - whole * F.col("source_size")
    order = F.struct("_key", "_id", "_text")
    cuts = placed.groupBy(F.col("_name").alias("_named")).agg(
        F.max(whole).alias("_whole"), F.max(F.when(F.col("before") < rest, order)).alias("_last")
    )
    cuts = materialize(cuts, "cuts")
    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        *(c.alias(n) for n, c in _columns(doc_id, text, source, seed).items()),
        F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]").alias("_words"),
    )
    taken = marked.where("_words").join(cuts, F.col("_name").eqNullSafe(F.col("_named")))
    more = F.coalesce(order <= F.col("_last"), F.lit(False)).cast("int")
    times = taken.withColumn("_times", (F.col("_whole") + more).cast("int")).where("_times > 0")
    return times.select("doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("doc.*")


#: The same rows in SQL, for ids that are not null and not repeated.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5('0|' || doc_id), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
t AS (SELECT sum(source_size)::DOUBLE AS total FROM s),
r AS (SELECT *, 2e0 * source_size / weight AS ratio, row_number() OVER (ORDER BY 2e0 * source_size / weight, source) AS k FROM s),
l AS (SELECT k, ratio, (15e-1 * total - coalesce(sum(2e0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r, t),
c AS (SELECT level FROM l WHERE level <= ratio ORDER BY k LIMIT 1),
b AS (SELECT source, source_size, round(least(2e0 * source_size, coalesce((SELECT level FROM c), 1e300) * weight), 6) AS target FROM s),
p AS (SELECT d.*, b.source_size, b.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - source_size - before)) + greatest(0, least(size, floor(target)::BIGINT - 2 * source_size - before)))::BIGINT AS taken FROM p
"""
