"""The corpus pipeline: rules, near duplicates, benchmark leaks, mixture, shards.

Each stage reads all rows that the one before it kept. All but the last return the columns of documents. All stages take
null values in any column, empty and very long texts, ties, repeated rows, empty tables (which stay empty) and further
columns of any name, which are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, mixing, ngram_jaccard, quality, sharding
from sluice.llm.shared import discard, load, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
N_SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a text that lost lines is its cleaned text, with ``n_chars`` counted anew.

    Null, empty and blank texts fail the rules, as do all texts of under 50 words. Repeated rows are judged alike and all
    stay or go; null ids and other nulls don't matter.
    """
    judged = quality.judge_documents(docs.select(*COLUMNS), carry=COLUMNS[1:]).where("kept")
    changed = F.col("failed_lines") > 0
    text = F.when(changed, F.col("cleaned")).otherwise(F.col("text")).alias("text")
    n_chars = F.when(changed, F.length("cleaned").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return judged.select("doc_id", text, "lang", "source", n_chars)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id.

    A null id stays only if its class has no other; of equal ids or equal rows of a class one stays. Texts without words
    are in no class and all stay.
    """
    return ngram_jaccard.keep_one(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is judged by its own text, whatever its id; a null text holds none."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once for each epoch.

    A null source is a source of its own. Texts without words are not taken. Rows with null or equal ids each have their
    own epochs; rows with equal id, source and text share theirs.
    """
    return mixing.repeats(docs.select(*COLUMNS))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mix: ``(doc_id, size, text_crc32, shard, slot)``, null and repeated rows too."""
    return sharding.kd_shards(docs, n_shards=N_SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixture", mixture),
    ("sharding", shards),
]

#: The near-duplicate classes and the tree of shards are beyond one SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            after = materialize(after, name.replace(" ", "-"))
            discard(docs)
        docs = after
    return docs
