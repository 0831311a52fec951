"""Queries of judgements, comparisons, results, the store, the gateway and the audit; importing this completes ``catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import stats, text, vectors
from ..operators import agreement, audit, cache, gates, judging, metrics, results, routing, tuning, workload
from ..sources import surrogate, tables
from ..sources.surrogate import SQL, load
from ..streaming import gateway
from . import catalog
from .catalog import FULL_GRID, ORACLE, QUERIES, THRESHOLD, query, rounded

__all__ = ["ORACLE", "QUERIES"]

RUBRIC, SECOND, SAMPLE_SEED = "Score 0, 1 or 2.", 40, 5
_PROMPT = r"'Score 0, 1 or 2.' || chr(10) || chr(10) || 'REQUEST: ' || request || chr(10) || chr(10) || 'ANSWER_A (reference): ' || baseline_text || chr(10) || chr(10) || 'ANSWER_B (candidate): ' || answer_text || chr(10) || chr(10) || 'SCORE:'"


@query(f"""WITH {SQL}, s AS (SELECT config, frac, idx, row_number() OVER (PARTITION BY config, frac ORDER BY sha256('{SAMPLE_SEED}|' || config || '|' || frac || '|' || idx), idx) <= {SECOND} AS second FROM ok WHERE config <> 'baseline'),
r AS (SELECT o.config, o.frac, o.idx, o.request, o.dup_type, o.answer_text, b.answer_text AS baseline_text, second FROM ok o JOIN ok b ON b.config = 'baseline' AND b.frac = o.frac AND b.idx = o.idx JOIN s ON s.config = o.config AND s.frac = o.frac AND s.idx = o.idx),
p AS (SELECT *, answer_text = baseline_text AS identical, length({_PROMPT}) + idx AS len FROM r)
SELECT config, frac, idx, request, dup_type, answer_text, baseline_text, identical, CASE WHEN identical THEN 2 ELSE len % 3 END::BIGINT AS judge1_score,
  CASE WHEN NOT identical AND second AND len % 4 < 3 THEN len % 4 END::BIGINT AS judge2_score, CASE WHEN NOT identical THEN 'Score: ' || (len % 3) || '.' END AS judge1_raw,
  CASE WHEN NOT identical AND second THEN 'I say ' || (len % 4) END AS judge2_raw, second AS sampled_for_judge2, '' AS human_label, CASE WHEN identical THEN 'identical to baseline, no judge call' ELSE '' END AS note FROM p""")
def judge_run(spark, d):
    ok = metrics.succeeded(surrogate.outcomes(spark, d))
    length = lambda p: F.length(p) + F.col("idx")
    one = lambda p: F.concat(F.lit("Score: "), length(p) % 3, F.lit("."))
    two = lambda p: F.concat(F.lit("I say "), length(p) % 4)
    out = judging.judge_run(
        ok.where("config <> 'baseline'"), ok.where("config = 'baseline'"), one, two, RUBRIC, SECOND, SAMPLE_SEED
    )
    return catalog._long(out)


_REASON = "CASE p WHEN 1 THEN 'semantic hit judged incorrect (false hit)' WHEN 2 THEN 'judge passes disagree' WHEN 3 THEN 'cascade escalation' ELSE 'other judged row' END"
_TIERED = catalog._TIER.replace("AS priority", "AS p")


@query(f"""WITH {SQL}, q AS (SELECT {_TIERED}, j.*, o.similarity, o.hit_source_idx, o.request FROM j JOIN o USING (seq) ORDER BY 1, config, frac, idx LIMIT 60)
SELECT p AS priority, {_REASON} AS priority_reason, config, frac, idx, coalesce(kind, '') AS kind, coalesce(served_by, '') AS served_by, coalesce(similarity::VARCHAR, '') AS similarity, coalesce(hit_source_idx::VARCHAR, '') AS hit_source_idx,
  coalesce(dup_type, '') AS dup_type, coalesce(request, '') AS request, coalesce(answer_text, '') AS answer_text, coalesce(baseline_text, '') AS baseline_text, coalesce(judge1_score::VARCHAR, '') AS judge1_score, coalesce(judge2_score::VARCHAR, '') AS judge2_score, '' AS human_label FROM q""".replace("j.*, o", "j.config, j.frac, j.idx, j.dup_type, j.kind, j.served_by, j.answer_text, j.baseline_text, j.judge1_score, j.judge2_score, o").replace("CASE WHEN kind", "CASE WHEN j.kind").replace("WHEN config = 'router_cascade' AND served_by", "WHEN j.config = 'router_cascade' AND j.served_by").replace("ORDER BY 1, config, frac, idx", "ORDER BY 1, 2, 3, 4"))
def human_queue(spark, d):
    return catalog._long(agreement.human_queue(surrogate.judgements(spark, d), surrogate.outcomes(spark, d)))


def _derived(*parts: str) -> str:
    joined = " || '|' || ".join(parts)
    return f"('0x' || substr(sha256('{stats.MASTER_SEED}|' || {joined}), 1, 8))::BIGINT"


@query(
    "SELECT frac, config, quantity, " + _derived(
        "frac", "config", "quantity"
    ) + " AS seed FROM unnest(['low', 'high']) a(frac), unnest(['baseline', 'cache', 'router_cascade', 'router_heuristic', 'exact_only']) b(config), unnest(['cost', 'latency', 'quality']) c(quantity)"
)
def derive_seed(spark, d):
    rows = spark.createDataFrame(
        [
            (f, c, q) for f in gates.FRACS for c in (
                *tables.CONFIGS, "exact_only"
            ) for q in ("cost", "latency", "quality")
        ],
        "frac string, config string, quantity string",
    )
    return rows.select("*", stats.derive_seed(F.col("frac"), F.col("config"), F.col("quantity")).alias("seed"))


_SPECS = ", ".join(f"('{i}', '{a}', '{b}', '{q}')" for i, a, b, q in metrics.COMPARISONS)
_FHR = next(c for c in metrics.COMPARISONS if c[3] == "fhr")
_A, _B = catalog._wilson("k_a", "n_a"), catalog._wilson("k_b", "n_b")
_P, _Q = "(k_a::DOUBLE / n_a)", "(k_b::DOUBLE / n_b)"
POINTS = f"""WITH {SQL}, spec AS (SELECT * FROM (VALUES {_SPECS}) v(id, a, b, quantity)), mi AS (SELECT config, frac, min(idx) AS first_idx FROM ok GROUP BY ALL),
sr AS (SELECT 'cost' AS quantity, config, frac, idx, cost_usd::DOUBLE AS value FROM ok UNION ALL SELECT 'quality', config, frac, idx, CASE WHEN identical THEN 2 ELSE judge1_score END / 2e0 FROM j UNION ALL SELECT 'p99', config, frac, idx, latency_ms::DOUBLE FROM ok JOIN mi USING (config, frac) WHERE idx <> first_idx),
sv AS (SELECT * FROM sr WHERE value IS NOT NULL), pr AS (SELECT spec.id, a, b, x.frac, spec.quantity, {_derived('x.frac', 'a', 'spec.quantity').replace(" || a || ", " || a || '-vs-' || b || ")} AS seed, x.value AS x, y.value AS y FROM spec JOIN sv x ON x.quantity = spec.quantity AND x.config = a JOIN sv y ON y.quantity = spec.quantity AND y.config = b AND y.frac = x.frac AND y.idx = x.idx),
pp AS (SELECT id || '-' || frac AS id, a, b, frac, quantity, 'paired' AS method, seed, count(*)::BIGINT AS n_shared, CASE WHEN quantity = 'p99' THEN quantile_cont(x, 99e-2) - quantile_cont(y, 99e-2) ELSE avg(x) - avg(y) END AS diff FROM pr GROUP BY id, a, b, frac, quantity, seed),
{catalog._SEM}, bd AS (SELECT config, frac, count(*) AS k FROM j WHERE NOT identical AND judge1_score = 0 AND dup_type IN ('paraphrase', 'trap') GROUP BY ALL),
rt AS (SELECT n.config, n.frac, least(coalesce(bd.k, 0), n.n)::BIGINT AS k, n.n FROM n LEFT JOIN bd ON bd.config = n.config AND bd.frac = n.frac),
nc AS (SELECT x.frac, x.k AS k_a, x.n AS n_a, y.k AS k_b, y.n AS n_b FROM rt x JOIN rt y ON x.frac = y.frac AND x.config = '{_FHR[1]}' AND y.config = '{_FHR[2]}'),
ni AS (SELECT *, {_Q} - {_P} AS diff, {_Q} - {_P} - sqrt(pow({_Q} - {_B[0]}, 2) + pow({_A[1]} - {_P}, 2)) AS lo, {_Q} - {_P} + sqrt(pow({_B[1]} - {_Q}, 2) + pow({_P} - {_A[0]}, 2)) AS hi FROM nc)
SELECT id, a, b, frac, quantity, method, seed, n_shared, round(diff, 6) AS diff, NULL::BIGINT AS k_a, NULL::BIGINT AS n_a, NULL::BIGINT AS k_b, NULL::BIGINT AS n_b, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::BOOLEAN AS separated FROM pp
UNION ALL SELECT '{_FHR[0]}-' || frac, '{_FHR[1]}', '{_FHR[2]}', frac, 'fhr', 'newcombe', NULL, NULL, round(diff, 6), k_a, n_a, k_b, n_b, round(lo, 6), round(hi, 6), lo > 0 OR hi < 0 FROM ni"""


@query(POINTS)
def comparison_points(spark, d, of=catalog.TABLES):
    return rounded(metrics.comparison_points(of.outcomes(spark, d), of.judgements(spark, d)))


_WEIGHT = " + ".join(f"(h >= {t})::INT" for t in stats._UP_TO)


@query(f"""WITH {SQL}, r AS (SELECT config, frac, latency_ms::DOUBLE AS x, seq FROM ok), e AS (SELECT config, frac, rep, x, ('0x' || substr(md5('{stats.MASTER_SEED}|' || rep || '|' || seq), 1, 8))::BIGINT AS h FROM r, range(200) t(rep)),
m AS (SELECT config, frac, rep, sum(x * ({_WEIGHT})) / nullif(sum({_WEIGHT}), 0) AS m FROM e GROUP BY ALL), q AS (SELECT config, frac, quantile_cont(m, 25e-3) AS lo, quantile_cont(m, 975e-3) AS hi FROM m GROUP BY ALL)
SELECT config, frac, round(avg(x), 6) AS mean, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, count(*)::BIGINT AS n FROM r JOIN q USING (config, frac) GROUP BY ALL""")
def hash_bootstrap(spark, d):
    return rounded(
        stats.hash_bootstrap(metrics.succeeded(surrogate.outcomes(spark, d)), ["config", "frac"], "latency_ms", "seq")
    )


_RUN = "concat(frac, '_', config)"
PARTS = (
    ("gates", "gate_table_full", "name", (), ("passed", "observed")),
    (
        "metrics",
        "run_metrics",
        _RUN,
        (
            "n_rows",
            "n_errors",
            "tokens_in",
            "tokens_out",
            "cost_usd",
            "cheap_calls",
            "expensive_calls",
            "n_exact",
            "n_semantic",
            "n_miss",
            "hit_rate",
            "first_latency_ms",
            "p50_ms",
            "p95_ms",
            "p99_ms",
            "mean_ms",
        ),
        (),
    ),
    ("hit_rate_ci", "hit_rate_wilson", _RUN, ("lo", "hi"), ()),
    ("quality", "quality_by_config", _RUN, ("n_scored", "mean_score", "quality"), ()),
    ("quality_by_dup", "quality_by_dup", "concat(frac, '_', config, '_', dup_type)", ("quality",), ()),
    ("false_hits", "false_hit_wilson", _RUN, ("k", "n", "false_hit_rate", "lo", "hi"), ()),
    ("exact_proxy", "exact_proxy", _RUN, ("judged", "score_0", "score_1", "score_2", "unjudged"), ()),
    (
        "exact_only",
        "exact_replay_summary",
        "frac",
        ("n_rows", "n_hits", "hit_rate", "cost_usd", "tokens_in", "tokens_out", "mean_ms"),
        (),
    ),
    ("tuning", "best_f1_threshold_full", "'best'", ("threshold", "tp", "fp", "fn", "tn", "f1"), ()),
    ("control", "control_thresholds_full", "'random'", ("mean_f1", "max_f1", "n"), ()),
    (
        "cost_weighted",
        "cost_weighted_threshold_full",
        "concat('r', CAST(r AS STRING))",
        ("threshold", "fp", "fn", "loss"),
        (),
    ),
    ("kappa", "kappa_judges", "'judges'", ("n", "observed", "expected", "kappa"), ()),
    (
        "comparisons",
        "comparison_points",
        "id",
        ("seed", "n_shared", "diff", "k_a", "n_a", "k_b", "n_b", "lo", "hi"),
        ("method", "separated"),
    ),
)


@query(" UNION ALL ".join(results.long_sql(s, ORACLE[q], name.replace("STRING", "VARCHAR"), numbers, texts) for s, q, name, numbers, texts in PARTS))
def results_document(spark, d):
    of = catalog.Written()  # all parts read the same tables, and the search for similar vectors runs once
    parts = [results.long_form(s, QUERIES[q](spark, d, of), name, numbers, texts) for s, q, name, numbers, texts in PARTS]
    return gates.gate_table(*parts)


@query(f"WITH n AS (SELECT doc_id AS idx, {catalog.NORM} AS norm_key, source FROM documents WHERE text IS NOT NULL), k AS (SELECT norm_key, max(idx) AS idx, arg_max(coalesce(source, chr(0)), idx) AS model FROM n WHERE norm_key <> '' GROUP BY 1) SELECT idx, nullif(model, chr(0)) AS model, sha256(norm_key) AS key_sha FROM k")
def store_upsert(spark, d):
    rows = surrogate.requests(spark, d).where("norm_key IS NOT NULL AND norm_key <> ''").select(
        "norm_key", "idx", F.col("source").alias("model")
    )
    keyed = rows.select("idx", "model", F.sha2("norm_key", 256).alias("key_sha"))  # keys are whole texts, which need no shuffle or sort
    return cache.latest_by_key(keyed, "key_sha").select("idx", "model", "key_sha")


@query(
    catalog.GREEDY + " SELECT v.idx, CASE WHEN h.idx IS NULL THEN 'miss' ELSE 'cache_semantic' END AS kind, h.src AS hit_source_idx, 'answer ' || h.src AS stored_answer, CASE WHEN h.src IS NOT NULL THEN CASE WHEN h.src % 3 = 0 THEN 'cheap' ELSE 'expensive' END END AS stored_by FROM v LEFT JOIN h USING (idx)"
)
def served_answers(spark, d):
    v = surrogate.vectors(spark, d)
    store = v.select(
        "idx",
        F.concat(F.lit("answer "), "idx").alias("answer_text"),
        F.when(F.col("idx") % 3 == 0, "cheap").otherwise("expensive").alias("served_by"),
    )
    return cache.served(cache.greedy_cache(v, THRESHOLD), store).select(
        "idx", "kind", "hit_source_idx", "stored_answer", "stored_by"
    )


_ASKED = f"a AS (SELECT doc_id AS idx, text AS request, CASE doc_id % 6 WHEN 0 THEN 'router' WHEN 1 THEN 'cache' WHEN 2 THEN 'cheap' WHEN 3 THEN 'expensive' WHEN 4 THEN NULL ELSE 'turbo' END AS mode FROM documents), b AS (SELECT *, {catalog._BLANK.replace('text', 'request')} AS blank FROM a)"


def _asked(spark, d):
    mode = F.expr("CASE doc_id % 6 WHEN 0 THEN 'router' WHEN 1 THEN 'cache' WHEN 2 THEN 'cheap' WHEN 3 THEN 'expensive' WHEN 5 THEN 'turbo' END")
    return load(spark, d, "documents").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("request"), mode.alias("mode")
    )


@query(f"WITH {_ASKED} SELECT idx, CASE WHEN blank THEN 'no user message with text content' ELSE 'x-bench-mode must be one of router, cache, cheap, expensive' END AS error_message, 'invalid_request_error' AS error_type, 400::BIGINT AS status FROM b WHERE blank OR mode = 'turbo'")
def gateway_rejections(spark, d):
    return gateway.rejected(_asked(spark, d)).select(
        "idx", "error_message", "error_type", F.col("status").cast("long").alias("status")
    )


@query(f"WITH {SQL}, w AS (SELECT config, frac FROM unnest(['baseline', 'cache', 'router_cascade', 'router_heuristic', 'exact_only']) u(config), unnest(['low', 'high']) v(frac)) SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.config = w.config AND o.frac = w.frac)")
def audit_completeness(spark, d):
    return audit.missing_runs(gates.expected_runs(spark, (*tables.CONFIGS, "exact_only")), surrogate.outcomes(spark, d))


@query(f"SELECT config, frac, n_rows, n_ok, n_errors FROM ({ORACLE['run_metrics']}) WHERE n_rows <> coalesce(n_ok, 0) + n_errors")
def audit_attempted(spark, d):
    return audit.attempted_mismatches(
        metrics.run_metrics(surrogate.outcomes(spark, d))
    ).select("config", "frac", "n_rows", "n_ok", "n_errors")


_PAIRS = f"SELECT DISTINCT k::BIGINT AS k, n::BIGINT AS n FROM (SELECT unnest([n_exact + n_semantic, n_exact, n_exact, n_ok]) AS k, unnest([n_ok, greatest(n_exact + n_semantic, 1), n_ok + n_errors, n_ok + n_errors]) AS n FROM ({ORACLE['run_metrics']})) WHERE k IS NOT NULL AND n IS NOT NULL"


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, line::BIGINT AS line, len(string_split(regexp_replace(trim(l), '^\||\|$', '', 'g'), '|'))::BIGINT AS n_cells, trim(string_split(regexp_replace(trim(l), '^\||\|$', '', 'g'), '|')[1]) AS first_cell FROM l WHERE regexp_matches(trim(l), '^\|.*\|$') AND NOT regexp_matches(trim(l), '^[|\s:-]+$')")
def audit_table_rows(spark, d):
    return audit.table_rows(load(spark, d, "documents")).select(
        "doc_id", "line", F.size("cells").cast("long").alias("n_cells"), F.get("cells", F.lit(0)).alias("first_cell")
    )


@query(f"WITH g AS ({ORACLE['gate_table']}), r AS (SELECT name FROM g WHERE name <> 'judge_independence' UNION ALL SELECT 'retired_gate') SELECT name, 'not registered' AS problem FROM g WHERE name NOT IN (SELECT name FROM r) UNION ALL SELECT name, 'absent' FROM r WHERE name NOT IN (SELECT name FROM g) UNION ALL SELECT name, 'should fail' FROM g WHERE name IN ('human_label_coverage', 'judge_independence') AND passed")
def audit_gate_registry(spark, d):
    names = [f"{p}{f}_{c}" for p in (gates.COST, gates.FALSE_HIT) for f in gates.FRACS for c in gates.OTHERS]
    registered = spark.createDataFrame(
        [(n,) for n in (*names, gates.TUNED, gates.COVERAGE, "retired_gate")], "name string"
    )
    return audit.gate_registry(tables.cut_lineage(catalog.gate_table(spark, d)), registered)


@query(f"WITH m AS ({ORACLE['run_metrics']}) SELECT x.config, x.frac, x.cost_usd, b.cost_usd AS baseline_cost FROM m x JOIN m b ON b.config = 'baseline' AND b.frac = x.frac WHERE x.config <> 'baseline' AND x.cost_usd >= b.cost_usd")
def audit_cost_order(spark, d):
    return audit.cost_order(rounded(metrics.run_metrics(surrogate.outcomes(spark, d))))


@query("WITH p AS (SELECT doc_id, unnest(['the', 'zz' || doc_id]) AS phrase FROM documents) SELECT p.doc_id, phrase FROM p LEFT JOIN documents USING (doc_id) WHERE NOT coalesce(contains(text, phrase), false)")
def audit_missing_phrases(spark, d):
    docs = load(spark, d, "documents")
    phrases = docs.select("doc_id", F.explode(F.array(F.lit("the"), F.concat(F.lit("zz"), "doc_id"))).alias("phrase"))
    return audit.missing_phrases(docs, phrases)


@query(f"WITH {SQL} SELECT frac, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE para AND first)::BIGINT AS n_should_hit, count(*) FILTER (WHERE first)::BIGINT AS n_eligible FROM (SELECT frac, dup_type = 'paraphrase' AS para, row_number() OVER (PARTITION BY frac, request ORDER BY idx) = 1 AS first FROM o WHERE config = 'cache') GROUP BY 1")
def label_counts(spark, d):
    rows = surrogate.outcomes(spark, d).where("config = 'cache'").withColumn(
        "norm_key", text.normalize_exact(F.col("request"))
    )
    return tuning.label_counts(tuning.replay_labels(rows, by=("frac",)))


_HALVES = catalog.BEST.replace(
    "best AS (SELECT v.idx, coalesce(best, 0) AS best, should_hit FROM",
    "best AS (SELECT v.idx, v.idx % 2 AS half, coalesce(best, 0) AS best, should_hit FROM",
)


@query(f"WITH {_HALVES}, t AS (SELECT round(20e-2 + 5e-3 * i, 4) AS threshold FROM range(160) r(i)), c AS (SELECT threshold, count(*) FILTER (WHERE best >= threshold AND should_hit)::BIGINT AS tp, count(*) FILTER (WHERE best >= threshold AND NOT should_hit)::BIGINT AS fp, count(*) FILTER (WHERE best < threshold AND should_hit)::BIGINT AS fn, count(*) FILTER (WHERE best < threshold AND NOT should_hit)::BIGINT AS tn FROM best, t GROUP BY 1) SELECT *, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def pooled_sweep(spark, d):
    best = catalog._best(spark, d).withColumn("half", F.col("idx") % 2)
    return rounded(
        tuning.pooled(tuning.sweep(best, FULL_GRID, ("half",))).select("threshold", "tp", "fp", "fn", "tn", "f1")
    )


@query("SELECT frac, (20260908 + list_sum(list_transform(string_split(frac, ''), lambda c: unicode(c))))::BIGINT AS seed FROM unnest(['low', 'high', 'mid']) u(frac)")
def fraction_seed(spark, d):
    rows = spark.createDataFrame([("low",), ("high",), ("mid",)], "frac string")
    return rows.select("frac", workload.fraction_seed(F.col("frac"), tuning.CONTROL_SEED).alias("seed"))


@query(f"WITH {SQL} SELECT config, frac, idx FROM j WHERE NOT identical AND judge1_score = 0 AND dup_type IN ('paraphrase', 'trap')")
def false_hit_rows(spark, d):
    return metrics.false_hit_rows(surrogate.judgements(spark, d))


@query(ORACLE["run_metrics"])
def runs_by_folder(spark, d):
    """Written by run into folders, with a second append, and found again by them."""
    path = f"{tables.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = tables.cut_lineage(rounded(metrics.run_metrics(surrogate.outcomes(spark, d))))
    for frac in gates.FRACS:
        tables.append_rows(rows.where(F.col("frac") == frac), path)
    return tables.read_runs(spark, path, ", ".join(f"{c} {t}" for c, t in rows.dtypes)).select(*rows.columns)


@query(f"SELECT nullif(priority::VARCHAR, '') AS priority, priority_reason, config, frac, idx::VARCHAR AS idx, {', '.join(f'nullif({c}, {chr(39) * 2}) AS {c}' for c in agreement.QUEUE[5:])} FROM ({ORACLE['human_queue']})")
def queue_file(spark, d):
    """The file for people, written as CSV and read again; empty cells are null there."""
    path = f"{tables.shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    tables.write_queue(
        agreement.human_queue(surrogate.judgements(spark, d), surrogate.outcomes(spark, d)),
        path,
        ["priority", "config", "frac", "idx"],
        60,
    )
    return tables.read_csv_text(spark, path)


@query(f"WITH {SQL} SELECT config, frac, idx FROM o WHERE seq % 3 <> 0")
def resume_pending(spark, d):
    o = surrogate.outcomes(spark, d)
    return tables.pending(o, o.where("seq % 3 = 0")).select("config", "frac", "idx")


@query("SELECT conv_id, turn::BIGINT AS turn, CASE WHEN turn % 3 = 0 THEN 'second' ELSE text END AS text, CASE WHEN turn % 3 = 0 THEN 30 ELSE 10 END::BIGINT AS tokens_in, CASE WHEN turn % 3 = 0 THEN 45 ELSE 5 END::BIGINT AS tokens_out FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def blank_retry(spark, d):
    c = load(spark, d, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    side = lambda t, i, o: F.struct(
        t.alias("text"),
        F.lit(i).cast("long").alias("tokens_in"),
        F.lit(o).cast("long").alias("tokens_out"),
        F.lit(1.0).alias("ms"),
    )
    first = side(F.when(F.col("turn") % 3 == 0, " \n").otherwise(F.col("text")), 10, 5)
    return c.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        routing.retry_blank(first, side(F.lit("second"), 20, 40)).alias("r"),
    ).select("conv_id", "turn", "r.text", "r.tokens_in", "r.tokens_out")


@query("SELECT conv_id, turn::BIGINT AS turn, text, CASE WHEN turn % 2 = 0 THEN conv_id ELSE 0 END::BIGINT AS tokens_in, CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END::BIGINT AS tokens_out FROM conversations")
def completion_replies(spark, d):
    usage = F.when(
        F.col("turn") % 2 == 0,
        F.struct(F.col("conv_id").alias("prompt_tokens"), F.col("turn").alias("completion_tokens")),
    )
    reply = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"),
            usage.alias("usage"),
        )
    )
    return load(spark, d, "conversations").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), text.completion_fields(reply).alias("r")
    ).select("conv_id", "turn", "r.*")


@query(f"WITH {SQL} SELECT seq, idx, request, kind, latency_ms FROM o WHERE config = 'baseline' AND frac = 'low' ORDER BY idx LIMIT 20")
def pilot_rows(spark, d):
    rows = surrogate.outcomes(spark, d).where("config = 'baseline' AND frac = 'low'")
    return workload.pilot(rows, 20).select("seq", "idx", "request", "kind", "latency_ms")


@query(f"WITH {SQL} SELECT seq, 'UpstreamError' AS error_message, 'upstream_unavailable' AS error_type, 'BASE_URL' AS param, 500::BIGINT AS status FROM o WHERE error IS NOT NULL")
def gateway_failures(spark, d):
    out = gateway.failed(surrogate.outcomes(spark, d), "BASE_URL")
    return out.select("seq", "error_message", "error_type", "param", F.col("status").cast("long").alias("status"))


_PADDED = "' ' || lower(coalesce(t, '')) || ' '"
_MARKS = f"list_transform(range(1, length({_PADDED}) - 1), lambda i: ('0x' || substr(md5(substr({_PADDED}, i, 3)), 1, 8))::BIGINT)"


def _encoded(rows: str) -> str:
    """SQL of unit vectors (16 places) of the texts ``t`` of ``rows``."""
    place = (
        "list_transform(range(16), lambda d: coalesce(list_sum(list_transform(list_filter(m, lambda h: h % 16 = d), "
        "lambda h: CASE WHEN (h // 1048576) % 2 = 0 THEN 1e0 ELSE -1e0 END)), 0e0))"
    )
    return f"SELECT * EXCLUDE (m), {place} AS v FROM (SELECT *, {_MARKS} AS m FROM ({rows}))"




@query(
    "WITH e AS ("
    + _encoded("SELECT conv_id, turn, text AS t FROM conversations WHERE role = 'user'")
    + "), q AS ("
    + _encoded("SELECT 'how does it work' AS t")
    + ") SELECT e.conv_id, e.turn::BIGINT AS turn, round(coalesce(list_dot_product(e.v, q.v) / nullif(sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v)), 0), 0), 6) AS similarity FROM e, q"
)
def encode_similarity(spark, d):
    """Each user turn's encoding against that of a fixed question."""
    rows = load(spark, d, "conversations").where("role = 'user'")
    pair = vectors.dot(vectors.hashed_ngrams(F.col("text"), 16), vectors.hashed_ngrams(F.lit("how does it work"), 16))
    return rounded(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), pair.alias("similarity")))
