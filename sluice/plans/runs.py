"""Queries of whole runs; importing this completes the other modules of queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cache, encoder, execution, workload
from ..operators.tuning import CONTROL_SEED
from ..sources import tables
from ..sources.surrogate import load
from . import streams  # noqa: F401
from .catalog import ORACLE, QUERIES, query, rounded

__all__ = ["ORACLE", "QUERIES"]

ALIKE, BUDGETS, PRICES = 0.45, {"cheap": 300, "expensive": 800}, {"cheap": (1.5, 6.0), "expensive": (3.0, 12.0)}


def provider():
    """A stand-in for a model: blocks some requests, is busy at times, and needs a larger budget for some."""
    busy: set[int] = set()

    def client(tier: str, request: str, budget: int) -> tuple[str, int, int, float]:
        label, i = int(request.split()[1]), int(request.split()[3])
        if i % 13 == 6:
            raise ValueError("content-blocked by policy")
        if i % 29 == 7:
            raise OSError("no route")
        if i % 17 == 3 and i not in busy:
            busy.add(i)
            raise OSError("busy")
        if i % 11 == 5 and budget <= 800:
            return " \n", 10 + label, 0, 1.0
        return f"{tier} answer to label {label}", 10 + label, 5, 2.0

    return client


def _workload(spark, d):
    n = F.col("vec_id")
    return load(spark, d, "embeddings").select(
        n.alias("idx"), F.concat(F.lit("Label "), "label", F.lit(" of "), n).alias("request"), F.expr("CASE vec_id % 4 WHEN 2 THEN 'paraphrase' WHEN 3 THEN 'trap' ELSE 'novel' END").alias("dup_type"),
        F.concat(F.lit("g"), F.floor(n / 4)).alias("group_id"), F.col("embedding").alias("vec"),
    )


_NEAR = "len(list_filter(n.near, lambda y: list_contains(g.stored, y))) > 0"
_RUN = f"""q AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS x, label, CASE vec_id % 4 WHEN 2 THEN 'paraphrase' WHEN 3 THEN 'trap' ELSE 'novel' END AS dup_type, 'g' || (vec_id // 4) AS group_id,
  CASE WHEN vec_id % 4 >= 2 THEN 1 ELSE 0 END AS wave, CASE WHEN vec_id % 13 = 6 THEN 'ValueError: content-blocked by policy' WHEN vec_id % 29 = 7 THEN 'OSError: no route' END AS error FROM embeddings),
e AS (SELECT a.idx AS a, b.idx AS b, b.wave AS w, list_dot_product(a.x, b.x) AS s FROM q a JOIN q b ON b.idx < a.idx AND b.wave <= a.wave WHERE list_dot_product(a.x, b.x) >= 45e-2),
n AS (SELECT q.idx, wave, row_number() OVER (ORDER BY wave, q.idx) AS rn, error IS NULL AS keep, coalesce(list(e.b) FILTER (WHERE e.b IS NOT NULL), []) AS near FROM q LEFT JOIN e ON e.a = q.idx GROUP BY q.idx, wave, error),
g AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS stored UNION ALL SELECT n.rn, CASE WHEN NOT n.keep OR {_NEAR} THEN g.stored ELSE list_append(g.stored, n.idx) END FROM g JOIN n ON n.rn = g.rn + 1),
f AS (SELECT unnest(stored) AS idx FROM (SELECT stored FROM g ORDER BY rn DESC LIMIT 1)),
h AS (SELECT e.a AS idx, max(s) AS s, arg_max(e.b, s) AS src FROM e JOIN f ON f.idx = e.b GROUP BY 1),
r AS (SELECT q.*, h.idx IS NOT NULL AS hit, h.s, h.src, CASE WHEN q.idx % 11 = 5 THEN 2 ELSE 1 END AS calls FROM q LEFT JOIN h USING (idx))"""


@query(f"""WITH RECURSIVE {_RUN} SELECT idx, dup_type, group_id, CASE WHEN hit THEN 'cache_semantic' ELSE 'miss' END AS kind, 'expensive' AS served_by, round(s, 6) AS similarity, src AS hit_source_idx,
  CASE WHEN hit OR error IS NOT NULL THEN 0 ELSE calls * (10 + label) END::BIGINT AS tokens_in, CASE WHEN hit OR error IS NOT NULL THEN 0 ELSE 5 END::BIGINT AS tokens_out,
  CASE WHEN hit OR error IS NOT NULL THEN 0 ELSE round(calls * (10 + label) / 1e6 * 3e0 + 5 / 1e6 * 12e0, 9) END AS cost_usd,
  CASE WHEN hit THEN 'expensive answer to label ' || (SELECT label FROM q o WHERE o.idx = src) WHEN error IS NULL THEN 'expensive answer to label ' || label ELSE '' END AS answer_text, CASE WHEN NOT hit THEN error END AS error FROM r""")
def run_resumed(spark, d):
    """A run that was stopped after its first wave and started again: followers wait for their anchors, misses are called."""
    root = f"{tables.shared_folder(spark)}/run-{uuid.uuid4().hex}"
    rows = _workload(spark, d)
    for stop in (1, None):
        out = execution.run_config(rows, "cache", "low", root, provider, ALIKE, PRICES, BUDGETS, stop_after=stop)
    return rounded(out.select("idx", "dup_type", "group_id", "kind", "served_by", "similarity", "hit_source_idx", "tokens_in", "tokens_out", "cost_usd", "answer_text", "error"), 9).withColumn(
        "similarity", F.round("similarity", 6)
    )


@query("""WITH q AS (SELECT vec_id AS idx, label, CASE WHEN vec_id % 13 = 6 THEN 'ValueError: content-blocked by policy' WHEN vec_id % 29 = 7 THEN 'OSError: no route' END AS error FROM embeddings)
SELECT idx, coalesce(error, '') AS error, CASE WHEN error LIKE 'V%' THEN 1 WHEN error LIKE 'O%' THEN 3 WHEN idx % 17 = 3 THEN 2 ELSE 1 END::BIGINT AS attempts,
  CASE WHEN error IS NOT NULL THEN 0 WHEN idx % 11 = 5 THEN 2 * (10 + label) ELSE 10 + label END::BIGINT AS tokens_in, CASE WHEN error IS NOT NULL THEN 0 ELSE 5 END::BIGINT AS tokens_out FROM q""")
def provider_calls(spark, d):
    """Every request asked for once: retries, blank answers that are billed twice, blocked content that is not tried again."""
    rows = _workload(spark, d).withColumn("tier", F.lit("expensive"))
    out = execution.call(rows, provider, BUDGETS, 2)
    return out.select("idx", F.coalesce("error", F.lit("")).alias("error"), F.col("attempts").cast("long").alias("attempts"), "tokens_in", "tokens_out")


#: Shares of paraphrases, traps and repeats by fraction.
FRACTIONS = {"low": (0.1, 0.1, 0.1), "high": (0.25, 0.1, 0.2)}
_PAIR = """pairs AS (SELECT doc_id::VARCHAR AS id, trim(split_part(text, chr(10), 1)) AS s1, trim(string_split(text, chr(10))[-1]) AS s2, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
pr AS (SELECT * FROM pairs WHERE s1 <> '' AND s2 <> ''), size AS (SELECT count(*) // 4 AS n FROM pr)"""


def _built(f: str) -> str:
    """CTEs of a fraction's workload."""
    p, t, e = FRACTIONS[f]
    seed = CONTROL_SEED + sum(map(ord, f))
    many = lambda x: f"(SELECT round_even({x!r}e0 * n, 0)::BIGINT FROM size)"
    once = lambda w: f"SELECT s1, min(id) AS id, arg_min(s2, id) AS s2 FROM pr {w} GROUP BY s1"
    wait = f"-ln((('0x' || substr(sha256('{seed + 4}|' || k), 1, 13))::BIGINT + 5e-1) / 4503599627370496e0)"
    return f"""
same_{f} AS (SELECT *, 'paraphrase' AS d FROM ({once('WHERE label = 1')}) ORDER BY sha256('{seed}|' || id), id LIMIT {many(p)}),
other_{f} AS (SELECT *, 'trap' AS d FROM ({once('WHERE label = 0')}) WHERE s1 NOT IN (SELECT s1 FROM same_{f}) ORDER BY sha256('{seed + 1}|' || id), id LIMIT {many(t)}),
taken_{f} AS (SELECT * FROM same_{f} UNION ALL SELECT * FROM other_{f}),
rest_{f} AS (SELECT *, NULL AS d FROM ({once('')}) WHERE s1 NOT IN (SELECT s1 FROM taken_{f}) ORDER BY sha256('{seed + 2}|' || id), id LIMIT (SELECT n FROM size) - {many(e)} - 2 * {many(p)} - 2 * {many(t)}),
base_{f} AS (SELECT *, printf('g%05d', row_number() OVER (ORDER BY id) - 1) AS g FROM (SELECT * FROM taken_{f} UNION ALL SELECT * FROM rest_{f})),
again_{f} AS (SELECT i AS draw, ('0x' || substr(sha256('{seed + 3}|' || i), 1, 8))::BIGINT % (SELECT count(*) FROM base_{f}) AS pos FROM range({many(e)}) r(i)),
rows_{f} AS (SELECT s1 AS s, 'novel' AS dup_type, g, g || '|novel' AS k FROM base_{f} UNION ALL SELECT s2, d, g, g || '|' || d FROM base_{f} WHERE d IS NOT NULL
  UNION ALL SELECT s1, 'exact', g, g || '|exact|' || draw FROM again_{f} JOIN (SELECT *, row_number() OVER (ORDER BY g) - 1 AS pos FROM base_{f}) USING (pos)),
wait_{f} AS (SELECT *, {wait} AS w FROM rows_{f}),
built_{f} AS (SELECT '{f}' AS frac, row_number() OVER (ORDER BY r.w + CASE WHEN r.dup_type = 'novel' THEN 0 ELSE a.w END) - 1 AS idx, r.s, r.dup_type, r.g FROM wait_{f} r JOIN wait_{f} a ON a.g = r.g AND a.dup_type = 'novel')"""


_WORKLOADS = f"WITH {_PAIR}, {', '.join(map(_built, FRACTIONS))}, w AS ({' UNION ALL '.join(f'SELECT * FROM built_{f}' for f in FRACTIONS)})"


def _pairs(spark, d):
    """Labelled pairs, written as CSV and read again: the first and the last line of each document of known quality."""
    docs = load(spark, d, "documents").join(load(spark, d, "labels").where("quality IS NOT NULL"), "doc_id")
    lines = F.split("text", "\n")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.trim(F.get(lines, F.lit(0))).alias("sentence1"), F.trim(F.element_at(lines, -1)).alias("sentence2"), F.col("quality").alias("label")
    ).where("sentence1 <> '' AND sentence2 <> ''")
    path = f"{tables.shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    return tables.read_pairs(spark, path)


def _workloads(spark, d):
    """The workload of each fraction, written by fraction with its counts, and read again."""
    pairs = tables.cut_lineage(_pairs(spark, d))
    path, n = f"{tables.shared_folder(spark)}/workload-{uuid.uuid4().hex}", pairs.count() // 4
    parts = {}
    for f, shares in FRACTIONS.items():
        seed = CONTROL_SEED + sum(map(ord, f))
        parts[f] = workload.build(pairs, n, *shares, seed, f)
    workload.write_fractions(parts, path, {"n_per_fraction": n, "fractions": {f: list(x) for f, x in FRACTIONS.items()}, "seed": CONTROL_SEED})
    told = tables.read_json(spark, f"{path}/meta.json")
    if told is None or told["n_per_fraction"] != n:
        raise ValueError("the workload's counts were not written")
    return tables.read_table(spark, f"{path}/workload", tables.WORKLOAD)


@query(f"""{_WORKLOADS} SELECT frac, idx::BIGINT AS idx, 'Explain this statement: "' || s || '"' AS request, dup_type, g AS group_id FROM w""")
def workload_build(spark, d):
    return _workloads(spark, d)


@query(f"""{_WORKLOADS}, a AS (SELECT frac, g, idx AS placed FROM w WHERE dup_type = 'novel') SELECT w.frac, dup_type, count(*)::BIGINT AS n, count(DISTINCT w.g)::BIGINT AS n_groups, count(*) FILTER (WHERE idx <= placed)::BIGINT AS out_of_order,
  count(*) FILTER (WHERE idx = placed + 1)::BIGINT AS adjacent, round(avg(idx - placed), 6) AS distance FROM w JOIN a ON a.frac = w.frac AND a.g = w.g WHERE dup_type <> 'novel' GROUP BY ALL""")
def follower_distances(spark, d):
    """How far followers stand behind their anchors; none stands before."""
    gap = F.col("idx") - F.col("anchor_idx")
    out = workload.anchors(_workloads(spark, d)).groupBy("frac", "dup_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("n_groups"), F.count_if(gap <= 0).alias("out_of_order"),
        F.count_if(gap == 1).alias("adjacent"), F.avg(gap).alias("distance"),
    )
    return rounded(out)


@query(f"""{_WORKLOADS}, k AS (SELECT frac, s, max(g) AS g FROM w GROUP BY ALL) SELECT w.frac, idx::BIGINT AS idx, k.g AS group_id FROM w JOIN k USING (frac, s) WHERE dup_type <> 'novel' AND frac = 'low'""")
def follower_groups(spark, d):
    """Each follower's group by its text alone; a text that no pair holds would fail the query."""
    rows = tables.cut_lineage(_workloads(spark, d).where("frac = 'low'"))
    known = rows.select("request", "group_id")
    return workload.resolve(rows.where("dup_type <> 'novel'"), known).select("frac", "idx", "group_id")


@query()
def encode_documents(spark, d):
    """The vector of each document, by an encoder that was learned from all of them."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    out = encoder.encode(docs, encoder.learn(docs)).select("doc_id", "vec")
    return out.select("doc_id", F.transform("vec", lambda x: F.round(x.cast("double"), 4)).alias("vec"))


@query()
def similar_documents(spark, d):
    """Each document with the most similar earlier one, by learned vectors; exact and near copies are found."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    model = encoder.learn(docs)
    rows = tables.cut_lineage(encoder.encode(docs, model).select("doc_id", "vec"))  # read several times
    told = cache.prefix_best(rows, order="doc_id", least=0.9).where("best >= 0.9")
    return told.select(F.col("idx").alias("doc_id"), F.round("best", 4).alias("similarity"), F.col("best_src").alias("earlier"))


_FIELDS = ("cheap_calls", "config", "cost_usd", "expensive_calls", "first_latency_ms", "frac", "hit_rate", "mean_ms", "n_errors", "n_exact", "n_miss", "n_ok", "n_rows",
           "n_semantic", "p50_ms", "p95_ms", "p99_ms", "tokens_in", "tokens_out")


@query(f"SELECT to_json({{{', '.join(f'{chr(39)}{c}{chr(39)}: {c}' for c in _FIELDS)}}})::VARCHAR AS document FROM ({ORACLE['run_metrics']})")
def json_results(spark, d):
    """The metrics of each run as a document with sorted keys."""
    return tables.json_rows(QUERIES["run_metrics"](spark, d))
