"""Queries of the operators over their whole tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lexical, licenses, mixing, ngram_jaccard, prefix_trie, quality, sharding, token_counts, url_filter, warc
from .shared import load

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MERGES = "/opt/tokenizers/byte_bpe_50k.json"
#: (host, path, action), as the URL contract fixes them.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_classes(load(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    fold = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~fold).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.judge_urls(load(spark, sf_dir, "pages"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), token_counts.read_ranks(VOCABULARY))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(load(spark, sf_dir, "documents"), cleaned=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(load(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(load(spark, sf_dir, "documents"), n_shards=40)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), bpe.Merges.read(MERGES))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(load(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {
        f.__name__: f for f in (
            op1_ngram_jaccard_join,
            op2_language_id,
            op3_url_filter,
            op4_token_counts,
            op5_benchmark_decontamination,
            op6_quality_rules,
            op7_warc,
            op8_license_scan,
            op9_mixture,
            op10_sharding,
            op11_lexical_search,
            op12_bpe,
            op13_prefix_trie,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_benchmark_decontamination": decontaminate.ORACLE,
        "op9_mixture": mixing.ORACLE,
        "op11_lexical_search": lexical.ORACLE,
    }
