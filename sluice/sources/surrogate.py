"""The engine's tables, mapped from the test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import group_name, normalize_exact
from .tables import CONFIGS

# fixed value: assumed price of a million tokens in and out
PRICES = {"flash": (1.5, 6.0)}
_DUPS = ("novel", "exact", "paraphrase", "trap")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(names: tuple[str, ...], at) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    kind = F.expr("CASE event_type WHEN 'view' THEN 'cache_exact' WHEN 'click' THEN 'cache_semantic' WHEN 'signup' THEN 'model_direct' ELSE 'miss' END")
    tokens_in, tokens_out = F.get_json_object("props", "$.k").cast("long"), F.floor(F.col("value") * 10).cast("long")
    return e.select(
        F.col("event_id").alias("seq"),
        _pick(CONFIGS, F.expr("(event_id div 2) % 4")).alias("config"),
        F.when(F.col("event_id") % 2 == 0, "low").otherwise("high").alias("frac"),
        F.expr("event_id div 8").alias("idx"),
        F.concat(F.lit("q"), F.col("user_id")).alias("request"),
        _pick(_DUPS, F.col("user_id") % 4).alias("dup_type"),
        group_name(F.col("user_id")).alias("group_id"),
        kind.alias("kind"),
        F.when(F.col("user_id") % 3 == 0, "cheap").otherwise("expensive").alias("served_by"),
        F.expr("CASE event_type WHEN 'view' THEN 1.0D WHEN 'click' THEN round(0.7D + (event_id % 30) / 100D, 2) END").alias("similarity"),
        F.when(F.col("event_type").isin("view", "click"), F.expr("event_id div 16")).alias("hit_source_idx"),
        F.col("value").alias("latency_ms"),
        tokens_in.alias("tokens_in"),
        tokens_out.alias("tokens_out"),
        (tokens_in / 1e6 * PRICES["flash"][0] + tokens_out / 1e6 * PRICES["flash"][1]).alias("cost_usd"),
        F.concat(F.lit("a"), F.col("user_id") % 50).alias("answer_text"),
        F.when(F.col("event_type") == "error", "UpstreamError").alias("error"),
    )


def judgements(spark: SparkSession, sf_dir: str, given: DataFrame | None = None) -> DataFrame:
    """Rows of other configurations than the baseline's, of ``given`` outcomes if there are any."""
    o = outcomes(spark, sf_dir) if given is None else given
    base = o.where("config = 'baseline'").select("frac", "idx", F.col("answer_text").alias("baseline_text"))
    score1 = F.when(F.col("seq") % 17 != 0, (F.floor("latency_ms") % 3).cast("int"))
    score2 = F.when(F.col("seq") % 5 == 0, (F.floor(F.col("latency_ms") * 7) % 3).cast("int"))
    return o.where("config <> 'baseline'").join(base, ["frac", "idx"]).select(
        "seq",
        "config",
        "frac",
        "idx",
        "request",
        "dup_type",
        "answer_text",
        "baseline_text",
        (F.col("answer_text") == F.col("baseline_text")).alias("identical"),
        score1.alias("judge1_score"),
        score2.alias("judge2_score"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"),
        F.col("text").alias("request"),
        normalize_exact(F.col("text")).alias("norm_key"),
        F.col("lang"),
        F.col("source"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    dup = F.expr("CASE vec_id % 4 WHEN 2 THEN 'paraphrase' WHEN 3 THEN 'trap' ELSE 'novel' END")
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"), dup.alias("dup_type")
    )


#: The same outcomes and judgements as SQL.
SQL = """
o AS (
  SELECT event_id AS seq, CASE (event_id // 2) % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'cache' WHEN 2 THEN 'router_cascade' ELSE 'router_heuristic' END AS config,
    CASE WHEN event_id % 2 = 0 THEN 'low' ELSE 'high' END AS frac, event_id // 8 AS idx, 'q' || user_id AS request,
    CASE user_id % 4 WHEN 0 THEN 'novel' WHEN 1 THEN 'exact' WHEN 2 THEN 'paraphrase' ELSE 'trap' END AS dup_type,
    CASE event_type WHEN 'view' THEN 'cache_exact' WHEN 'click' THEN 'cache_semantic' WHEN 'signup' THEN 'model_direct' ELSE 'miss' END AS kind,
    CASE WHEN user_id % 3 = 0 THEN 'cheap' ELSE 'expensive' END AS served_by, value AS latency_ms,
    CASE event_type WHEN 'view' THEN 1e0 WHEN 'click' THEN round(7e-1 + (event_id % 30) / 1e2, 2) END AS similarity, CASE WHEN event_type IN ('view', 'click') THEN event_id // 16 END AS hit_source_idx,
    json_extract_string(props, '$.k')::BIGINT AS tokens_in, floor(value * 10)::BIGINT AS tokens_out,
    json_extract_string(props, '$.k')::BIGINT / 1e6 * 1.5e0 + floor(value * 10)::BIGINT / 1e6 * 6e0 AS cost_usd,
    'a' || (user_id % 50) AS answer_text, CASE WHEN event_type = 'error' THEN 'UpstreamError' END AS error
  FROM events
), ok AS (SELECT * FROM o WHERE error IS NULL),
j AS (
  SELECT o.seq, o.config, o.frac, o.idx, o.dup_type, o.kind, o.served_by, o.answer_text, b.answer_text AS baseline_text, o.answer_text = b.answer_text AS identical,
    CASE WHEN o.seq % 17 <> 0 THEN floor(o.latency_ms)::BIGINT % 3 END AS judge1_score, CASE WHEN o.seq % 5 = 0 THEN floor(o.latency_ms * 7)::BIGINT % 3 END AS judge2_score
  FROM o JOIN o b ON b.config = 'baseline' AND b.frac = o.frac AND b.idx = o.idx WHERE o.config <> 'baseline'
)
"""
