"""Rules of the gateway: modes, errors, envelopes; and the first answer of each key as the state of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_error, is_blank, normalize_exact
from ..operators.routing import cascade

# fixed values: modes of a request, and errors as clients see them
MODES = ("router", "cache", "cheap", "expensive")
NO_TEXT, BAD_MODE = "no user message with text content", "x-bench-mode must be one of "
def first_answers(requests: DataFrame) -> DataFrame:
    """``(norm_key, first)``: of each key of a stream the first storable answer by ``idx``, with ``answer_text, served_by``.

    A streaming aggregate: partial minima of a micro-batch meet the state, which holds one answer for each key; rows of one
    key are never gathered. ``expensive`` passes the cache by; failed and blank answers are not stored.
    """
    good = ~has_error(F.col("error")) & ~is_blank(F.col("answer_text")) & (F.coalesce("mode", F.lit("router")) != "expensive")
    rows = requests.where(good & ~is_blank(F.col("request"))).withColumn("norm_key", normalize_exact(F.col("request")))
    return rows.groupBy("norm_key").agg(
        F.min(F.struct("idx", "answer_text", "served_by")).alias("first")
    )


def health_of_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(ok, cache_size)`` as the state of a stopped ``first_answers`` stream has it; nothing that it wrote is read.

    ``ok`` says that the checkpoint's operator is the one that keeps answers.
    """
    kept = spark.read.format("statestore").load(checkpoint).agg(F.count(F.lit(1)).alias("cache_size"))
    known = spark.read.format("state-metadata").load(checkpoint).agg(
        F.coalesce(F.bool_and(F.col("operatorName") == "stateStoreSave"), F.lit(False)).alias("ok")
    )
    return known.crossJoin(kept)  # a row each


def _fault() -> Column:
    unknown = ~F.coalesce("mode", F.lit("router")).isin(*MODES)
    return F.when(is_blank(F.col("request")), NO_TEXT).when(unknown, BAD_MODE + ", ".join(MODES))


def rejected(requests: DataFrame) -> DataFrame:
    """Requests that the gateway answers with an error of 400: no text, or an unknown mode."""
    bad = requests.withColumn("error_message", _fault()).where("error_message IS NOT NULL")
    return bad.withColumns({"error_type": F.lit("invalid_request_error"), "status": F.lit(400)})


def accepted(requests: DataFrame) -> DataFrame:
    """The other requests; without a mode they are routed."""
    return requests.where(_fault().isNull()).withColumn("mode", F.coalesce("mode", F.lit("router")))


def failed(requests: DataFrame, param: str) -> DataFrame:
    """Requests whose upstream failed (``error``): an error of 500 that names the setting to mend."""
    bad = requests.where(has_error(F.col("error"))).withColumnRenamed("error", "error_message")
    return bad.withColumns({"error_type": F.lit("upstream_unavailable"), "param": F.lit(param), "status": F.lit(500)})


def by_mode(requests: DataFrame) -> DataFrame:
    """What answers a request that no stored answer serves: ``escalated, served_by, answer_text, tokens_in, tokens_out``.

    ``cheap`` and ``dear`` are structs of ``text, tokens_in, tokens_out``. A routed request whose cheap answer is blank or
    voices doubt gets the dear one, and pays both.
    """
    up = (F.col("mode") == "router") & cascade(F.col("cheap.text"))
    low = (F.col("mode") == "cheap") | ((F.col("mode") == "router") & ~up)
    tokens = lambda c: F.when(low, F.col(f"cheap.{c}")).when(
        up, F.col(f"cheap.{c}") + F.col(f"dear.{c}")
    ).otherwise(F.col(f"dear.{c}"))
    return requests.withColumns({
        "escalated": up, "served_by": F.when(low, "cheap").otherwise("expensive"),
        "answer_text": F.when(low, F.col("cheap.text")).otherwise(F.col("dear.text")),
        "tokens_in": tokens("tokens_in"), "tokens_out": tokens("tokens_out"),
    })


def envelope(decisions: DataFrame) -> DataFrame:
    """Each decision as the gateway reports it: usage and what decided it, with ``latency_ms`` where it was measured."""
    similarity = F.when(F.col("kind") == "cache_exact", 1.0).alias("similarity")
    measured = F.round("latency_ms", 1) if "latency_ms" in decisions.columns else F.lit(None).cast("double")
    info = F.struct("mode", "hit", "kind", similarity, "served_by", measured.alias("latency_ms"))
    usage = F.struct(
        F.col("tokens_in").alias("prompt_tokens"),
        F.col("tokens_out").alias("completion_tokens"),
        (F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"),
    )
    return decisions.select("idx", info.alias("x_gateway"), usage.alias("usage"), "answer_text")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run over what is there now and return the rows from an in-memory table; for tests and small replays."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
