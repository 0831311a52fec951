"""Queries of the live gateway; importing this completes ``reports`` and ``catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..sources import tables
from ..sources.surrogate import load
from ..streaming import gateway
from ..streaming.live import Live
from . import catalog, reports
from .catalog import NORM, ORACLE, QUERIES, THRESHOLD, query, rounded

__all__ = ["ORACLE", "QUERIES"]

SLICES = 4
_LIVE = """asked AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS x, label, CASE vec_id % 9 WHEN 5 THEN 'router' WHEN 7 THEN 'expensive' WHEN 8 THEN 'turbo' ELSE 'cache' END AS mode,
  vec_id % 4 = 1 AS doubt, CASE WHEN vec_id % 13 = 6 THEN 'UpstreamError' END AS error FROM embeddings),
q AS (SELECT *, row_number() OVER (ORDER BY idx) AS rn FROM asked WHERE mode IN ('router', 'cache')),
e AS (SELECT a.idx AS a, b.idx AS b, list_dot_product(a.x, b.x) AS s FROM q a JOIN q b ON b.idx < a.idx WHERE list_dot_product(a.x, b.x) >= 35e-2),
n AS (SELECT q.rn, q.idx, q.error IS NULL AS keep, coalesce(list(e.b) FILTER (WHERE e.b IS NOT NULL), []) AS near FROM q LEFT JOIN e ON e.a = q.idx GROUP BY ALL)"""
_STORED = """g AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS stored UNION ALL SELECT n.rn, CASE WHEN list_has_any(n.near, g.stored) OR NOT n.keep THEN g.stored ELSE list_append(g.stored, n.idx) END FROM g JOIN n ON n.rn = g.rn + 1),
f AS (SELECT unnest(stored) AS idx FROM (SELECT stored FROM g ORDER BY rn DESC LIMIT 1)),
h AS (SELECT e.a AS idx, max(s) AS s, arg_max(e.b, s) AS src FROM e JOIN f ON f.idx = e.b GROUP BY 1),
m AS (SELECT asked.*, h.idx IS NOT NULL AND mode IN ('router', 'cache') AS hit, h.s, h.src, mode = 'router' AND doubt AS up FROM asked LEFT JOIN h USING (idx)),
r AS (SELECT m.*, CASE WHEN mode = 'router' AND NOT up THEN 'cheap' ELSE 'expensive' END AS who FROM m WHERE mode <> 'turbo')"""


def _served(spark, d) -> Live:
    """A gateway that has taken the whole table of vectors in ``SLICES`` micro-batches, and was stopped and started in between."""
    root = f"{tables.shared_folder(spark)}/live-{uuid.uuid4().hex}"
    n = F.col("vec_id")
    side = lambda text, extra: F.struct(
        text.alias("text"), (F.col("label") + extra).cast("long").alias("tokens_in"), F.lit(extra).cast("long").alias("tokens_out")
    )
    answer = F.concat(F.lit("label "), F.col("label"))
    asked = load(spark, d, "embeddings").select(
        n.alias("idx"), F.concat(F.lit("v"), n).alias("request"),
        F.expr("CASE vec_id % 9 WHEN 5 THEN 'router' WHEN 7 THEN 'expensive' WHEN 8 THEN 'turbo' ELSE 'cache' END").alias("mode"),
        F.col("embedding").alias("vec"), side(F.when(n % 4 == 1, "I am not sure").otherwise(answer), 10).alias("cheap"),
        side(answer, 20).alias("dear"), F.when(n % 13 == 6, "UpstreamError").alias("error"),
    )
    last = asked.agg(F.max("idx")).first()[0] or 0
    live = Live(spark, f"{root}/tables", THRESHOLD)
    for half in range(2):
        for part in range(half * SLICES // 2, (half + 1) * SLICES // 2):
            rows = asked.where(F.floor(F.col("idx") * SLICES / (last + 1)) == part)
            rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        live.serve(stream, f"{root}/state").awaitTermination()
    return live


@query(f"""WITH RECURSIVE {_LIVE}, {_STORED} SELECT idx, mode, CASE WHEN hit THEN 'cache_semantic' WHEN mode = 'expensive' THEN 'model_direct' ELSE 'miss' END AS kind,
  CASE WHEN hit THEN round(s, 6) END AS similarity, CASE WHEN hit THEN src END AS hit_source_idx, up AND NOT hit AS escalated, CASE WHEN hit THEN (SELECT who FROM r o WHERE o.idx = r.src) ELSE who END AS served_by,
  'label ' || CASE WHEN hit THEN (SELECT label FROM r o WHERE o.idx = r.src) ELSE label END AS answer_text,
  CASE WHEN hit THEN 0 WHEN who = 'cheap' THEN label + 10 WHEN up THEN 2 * label + 30 ELSE label + 20 END::BIGINT AS tokens_in,
  CASE WHEN hit THEN 0 WHEN who = 'cheap' THEN 10 WHEN up THEN 30 ELSE 20 END::BIGINT AS tokens_out FROM r WHERE hit OR error IS NULL""")
def stream_semantic_cache(spark, d):
    """Answers of the live gateway: as if all requests had come one after the other."""
    out = _served(spark, d).table("answers")
    return rounded(out.drop("norm_key", "hit", "stored"))


@query(f"""WITH RECURSIVE {_LIVE}, {_STORED} SELECT idx, 500::BIGINT AS status, 'upstream_unavailable' AS error_type, error AS error_message, 'BASE_URL' AS param FROM r WHERE NOT hit AND error IS NOT NULL
UNION ALL SELECT idx, 400, 'invalid_request_error', 'x-bench-mode must be one of router, cache, cheap, expensive', NULL FROM asked WHERE mode = 'turbo'""")
def stream_errors(spark, d):
    return _served(spark, d).table("errors").withColumn("status", F.col("status").cast("long"))


@query(f"WITH RECURSIVE {_LIVE}, {_STORED} SELECT true AS ok, count(*)::BIGINT AS cache_size FROM f")
def stream_health(spark, d):
    """The cache's size as the next request would find it."""
    return _served(spark, d).health()


def _documents(spark, d):
    """The documents as a stream of requests, each answered by its text's last words."""
    docs = spark.readStream.schema(load(spark, d, "documents").schema).parquet(f"{d}/documents*.parquet")
    return docs.where(~is_blank(F.col("text")))


def _exact(spark, d) -> Live:
    side = F.struct(F.col("source").alias("text"), F.col("n_chars").alias("tokens_in"), F.lit(1).cast("long").alias("tokens_out"))
    asked = _documents(spark, d).select(
        F.col("doc_id").alias("idx"), F.col("text").alias("request"), F.lit("cache").alias("mode"), F.lit(None).cast("array<float>").alias("vec"),
        side.alias("cheap"), side.alias("dear"), F.lit(None).cast("string").alias("error"),
    )
    root = f"{tables.shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    live = Live(spark, f"{root}/tables", 2.0)
    live.serve(asked, f"{root}/state").awaitTermination()
    return live


_EXACT = rf"k AS (SELECT doc_id AS idx, source, n_chars, {NORM} AS norm_key, trim(coalesce(source, '')) <> '' AS keep FROM documents WHERE text IS NOT NULL), f AS (SELECT norm_key, min(idx) FILTER (WHERE keep) AS first_idx, arg_min(source, idx) FILTER (WHERE keep) AS answer FROM k WHERE norm_key <> '' GROUP BY 1), x AS (SELECT k.*, coalesce(idx > first_idx, false) AS hit, first_idx, answer FROM k JOIN f USING (norm_key))"


@query(f"WITH {_EXACT} SELECT idx, hit, CASE WHEN hit THEN 'cache_exact' ELSE 'miss' END AS kind, CASE WHEN hit THEN first_idx END AS hit_source_idx, CASE WHEN hit THEN answer ELSE source END AS answer_text, CASE WHEN hit THEN 0 ELSE n_chars END::BIGINT AS tokens_in FROM x")
def stream_exact_cache(spark, d):
    """A gateway without vectors: only requests of one key share an answer."""
    return _exact(spark, d).table("answers").select("idx", "hit", "kind", "hit_source_idx", "answer_text", "tokens_in")


@query(f"WITH {_EXACT} SELECT idx, hit, CASE WHEN hit THEN 'cache_exact' ELSE 'miss' END AS kind, CASE WHEN hit THEN 1e0 END AS similarity, 'expensive' AS served_by, CASE WHEN hit THEN 0 ELSE n_chars END::BIGINT AS prompt_tokens, CASE WHEN hit THEN 0 ELSE 1 END::BIGINT AS completion_tokens, CASE WHEN hit THEN 0 ELSE n_chars + 1 END::BIGINT AS total_tokens FROM x")
def gateway_envelope(spark, d):
    out = gateway.envelope(_exact(spark, d).table("answers"))
    return out.select(
        "idx", "x_gateway.hit", "x_gateway.kind", "x_gateway.similarity", "x_gateway.served_by", "usage.prompt_tokens", "usage.completion_tokens", "usage.total_tokens"
    )


@query(f"WITH {_EXACT} SELECT true AS ok, count(DISTINCT norm_key) FILTER (WHERE first_idx IS NOT NULL)::BIGINT AS cache_size FROM x")
def gateway_health(spark, d):
    """Read from the checkpoint of a stopped stream."""
    asked = _documents(spark, d).select(
        F.col("doc_id").alias("idx"), F.col("text").alias("request"), F.lit("cache").alias("mode"), F.col("source").alias("answer_text"),
        F.lit("cheap").alias("served_by"), F.lit(None).cast("string").alias("error"),
    )
    checkpoint = f"{tables.shared_folder(spark)}/state-{uuid.uuid4().hex}"
    gateway.first_answers(asked).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    return gateway.health_of_state(spark, checkpoint)


_CHEAP = "s AS (SELECT idx, coalesce(mode, 'router') AS md, substr(request, 1, 200) AS text, request FROM b WHERE NOT blank AND coalesce(mode, 'router') <> 'turbo')"


@query(f"WITH {reports._ASKED}, {_CHEAP}, m AS (SELECT *, {catalog._ESC} AS up FROM s), t AS (SELECT *, md = 'router' AND up AS escalated, md = 'cheap' OR (md = 'router' AND NOT up) AS cheap FROM m) SELECT idx, md AS mode, escalated, CASE WHEN cheap THEN 'cheap' ELSE 'expensive' END AS served_by, CASE WHEN cheap THEN text ELSE request END AS answer_text, CASE WHEN cheap THEN length(text) WHEN escalated THEN length(text) + length(request) ELSE length(request) END::BIGINT AS tokens_in, CASE WHEN cheap THEN 1 WHEN escalated THEN 3 ELSE 2 END::BIGINT AS tokens_out FROM t")
def gateway_dispatch(spark, d):
    """The cheap model says a text's beginning, the dear one all of it; a beginning that voices doubt is escalated."""
    side = lambda t, n: F.struct(t.alias("text"), F.length(t).cast("long").alias("tokens_in"), F.lit(n).cast("long").alias("tokens_out"))
    good = gateway.accepted(reports._asked(spark, d))
    rows = good.withColumns({"cheap": side(F.substring("request", 1, 200), 1), "dear": side(F.col("request"), 2)})
    return gateway.by_mode(rows).select("idx", "mode", "escalated", "served_by", "answer_text", "tokens_in", "tokens_out")
