"""Every query of the engine by name, over whole tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import agreement, audit, cache, gates, metrics, routing, tuning, workload
from ..sources import surrogate, tables
from ..sources.surrogate import SQL, load

THRESHOLD = 0.35
#: The published grid; the queries named ``_full`` begin lower.
GRID = tuning.grid()
FULL_GRID = [round(0.20 + 0.005 * i, 4) for i in range(160)]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables that queries of runs read, made for each reader."""

    def outcomes(self, spark, d) -> DataFrame:
        return surrogate.outcomes(spark, d)

    def judgements(self, spark, d) -> DataFrame:
        return surrogate.judgements(spark, d, self.outcomes(spark, d))

    def replay(self, spark, d) -> DataFrame:
        base = self.outcomes(spark, d).where("config = 'baseline'").withColumn("norm_key", text.normalize_exact(F.col("request")))
        return cache.exact_replay(base)

    def best(self, spark, d) -> DataFrame:
        v = surrogate.vectors(spark, d)
        return cache.prefix_best(v).join(
            v.select("idx", (F.col("dup_type") == "paraphrase").alias("should_hit"), F.lit(True).alias("eligible")), "idx"
        )


class Written(Tables):
    """The same for queries that are asked together: each table is written once, without what none of its readers asks for."""

    _LEFT_OUT = {
        "outcomes": ("group_id", "similarity", "hit_source_idx"),
        "judgements": ("seq", "request", "answer_text", "baseline_text"),
        "replay": ("seq", "config", "request", "norm_key", "dup_type", "kind", "served_by", "answer_text", "error", "hit_source_idx"),
        "best": ("best_src",),
    }

    def __init__(self) -> None:
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, spark, d) -> DataFrame:
        if name not in self._kept:
            path = f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
            tables.write_table(getattr(Tables, name)(self, spark, d).drop(*self._LEFT_OUT[name]), path)
            self._kept[name] = spark.read.parquet(path)
        return self._kept[name]

    def outcomes(self, spark, d) -> DataFrame:
        return self._once("outcomes", spark, d)

    def judgements(self, spark, d) -> DataFrame:
        return self._once("judgements", spark, d)

    def replay(self, spark, d) -> DataFrame:
        return self._once("replay", spark, d)

    def best(self, spark, d) -> DataFrame:
        return self._once("best", spark, d)


TABLES = Tables()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at ``digits`` places: their sums depend on the order of adding."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _long(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


WARM = "f AS (SELECT config, frac, min(seq) AS first_seq, count(*) AS c FROM ok GROUP BY ALL), warm AS (SELECT ok.* FROM ok JOIN f USING (config, frac) WHERE seq <> first_seq OR c = 1)"
PCT = "round(quantile_cont(latency_ms, 5e-1), 6) AS p50_ms, round(quantile_cont(latency_ms, 95e-2), 6) AS p95_ms, round(quantile_cont(latency_ms, 99e-2), 6) AS p99_ms, round(avg(latency_ms), 6) AS mean_ms"
SUMS = """count(*)::BIGINT AS n_ok, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 6) AS cost_usd,
  count(*) FILTER (WHERE served_by = 'cheap' AND tokens_out > 0)::BIGINT AS cheap_calls, count(*) FILTER (WHERE served_by = 'expensive' AND tokens_out > 0)::BIGINT AS expensive_calls,
  count(*) FILTER (WHERE kind = 'cache_exact')::BIGINT AS n_exact, count(*) FILTER (WHERE kind = 'cache_semantic')::BIGINT AS n_semantic,
  count(*) FILTER (WHERE kind IN ('miss', 'model_direct'))::BIGINT AS n_miss, round(arg_min(latency_ms, seq), 6) AS first_latency_ms,
  round(count(*) FILTER (WHERE kind IN ('cache_exact', 'cache_semantic'))::DOUBLE / count(*), 6) AS hit_rate"""


def _wilson(k: str, n: str) -> tuple[str, str]:
    k, n = f"({k})::DOUBLE", f"nullif({n}, 0)::DOUBLE"
    d, mid = f"(1 + 3.8416e0 / {n})", f"({k} / {n} + 3.8416e0 / (2 * {n}))"
    half = f"196e-2 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416e0 / (4 * {n} * {n}))"
    return f"greatest(0e0, ({mid} - {half}) / {d})", f"least(1e0, ({mid} + {half}) / {d})"


LO, HI = _wilson("k", "n")


@query(f"WITH {SQL}, {WARM}, a AS (SELECT config, frac, count(*)::BIGINT AS n_rows, count(error)::BIGINT AS n_errors FROM o GROUP BY ALL), s AS (SELECT config, frac, {SUMS} FROM ok GROUP BY ALL), p AS (SELECT config, frac, {PCT} FROM warm GROUP BY ALL) SELECT * FROM a LEFT JOIN s USING (config, frac) LEFT JOIN p USING (config, frac)")
def run_metrics(spark, d, of=TABLES):
    return rounded(metrics.run_metrics(of.outcomes(spark, d)))


@query(f"WITH {SQL}, r AS (SELECT config, frac, count(*) FILTER (WHERE kind IN ('cache_exact', 'cache_semantic'))::BIGINT AS k, count(*)::BIGINT AS n FROM ok GROUP BY ALL) SELECT config, frac, k, n, round(k::DOUBLE / n, 6) AS hit_rate, round({LO}, 6) AS lo, round({HI}, 6) AS hi FROM r")
def hit_rate_wilson(spark, d, of=TABLES):
    return rounded(metrics.hit_rates(of.outcomes(spark, d)))


_FALSE = f"SELECT n.config, n.frac, coalesce(b.k, 0)::BIGINT AS k, n.n, round(coalesce(b.k, 0)::DOUBLE / n.n, 6) AS false_hit_rate, round({_wilson('least(coalesce(b.k, 0), n.n)', 'n.n')[0]}, 6) AS lo, round({_wilson('least(coalesce(b.k, 0), n.n)', 'n.n')[1]}, 6) AS hi FROM n LEFT JOIN b ON b.config = n.config AND b.frac = n.frac"
_SEM = "n AS (SELECT config, frac, count(*) FILTER (WHERE kind = 'cache_semantic')::BIGINT AS n FROM ok GROUP BY ALL)"
FALSE_SQL = f"WITH {SQL}, {_SEM}, b AS (SELECT config, frac, count(*) AS k FROM j WHERE NOT identical AND judge1_score = 0 AND dup_type IN ('paraphrase', 'trap') GROUP BY ALL) {_FALSE}"


@query(FALSE_SQL)
def false_hit_wilson(spark, d, of=TABLES):
    return rounded(metrics.false_hits(of.judgements(spark, d), of.outcomes(spark, d)))


@query(f"WITH {SQL}, {_SEM}, b AS (SELECT config, frac, count(*) AS k FROM j WHERE NOT identical AND judge1_score = 0 AND kind = 'cache_semantic' GROUP BY ALL) {_FALSE}")
def false_hit_wilson_strict(spark, d):
    return rounded(metrics.false_hits(surrogate.judgements(spark, d), surrogate.outcomes(spark, d), strict=True))


@query(f"WITH {SQL} SELECT seq, config, frac, tokens_in, tokens_out, round(cost_usd, 9) AS cost_usd FROM o")
def cost_ledger(spark, d):
    rows = surrogate.outcomes(spark, d).select(
        "seq", "config", "frac", "tokens_in", "tokens_out", F.lit("flash").alias("model")
    )
    return rounded(routing.priced(rows, surrogate.PRICES).drop("model"), 9)


@query(f"WITH {SQL} SELECT config, served_by, count(*)::BIGINT AS n, round(sum(cost_usd), 6) AS cost_usd FROM ok GROUP BY ALL")
def cost_by_tier(spark, d):
    return rounded(
        metrics.succeeded(surrogate.outcomes(spark, d)).groupBy("config", "served_by").agg(
            F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost_usd")
        )
    )


@query(f"WITH {SQL}, {WARM} SELECT config, frac, {PCT} FROM warm GROUP BY ALL")
def latency_percentiles_warm(spark, d):
    return rounded(metrics.latency_percentiles(metrics.warm(metrics.succeeded(surrogate.outcomes(spark, d)))))


@query(f"WITH {SQL}, {WARM} SELECT config, frac, least(greatest(trunc((log10(greatest(latency_ms, 1e-9)) - (-0.3010299956639812e0)) / 5.3010299956639812e0 * 28), 0), 27)::BIGINT AS bin, count(*)::BIGINT AS n FROM warm GROUP BY ALL")
def latency_log_histogram(spark, d):
    return _long(metrics.latency_histogram(metrics.warm(metrics.succeeded(surrogate.outcomes(spark, d)))))


@query(f"WITH {SQL} SELECT config, frac, arg_min(latency_ms, seq) AS first_latency_ms FROM ok GROUP BY ALL")
def first_latency(spark, d):
    return metrics.succeeded(surrogate.outcomes(spark, d)).groupBy("config", "frac").agg(
        F.min_by("latency_ms", "seq").alias("first_latency_ms")
    )


@query(f"WITH {SQL} SELECT config, frac, error IS NOT NULL AS failed, kind, count(*)::BIGINT AS n FROM o GROUP BY ALL")
def kind_mix(spark, d):
    return surrogate.outcomes(spark, d).groupBy(
        "config", "frac", text.has_error(F.col("error")).alias("failed"), "kind"
    ).agg(F.count(F.lit(1)).alias("n"))


NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id AS idx, sha256({NORM}) AS key_sha, length(text)::BIGINT AS n_chars FROM documents")
def exact_key_normalize(spark, d):
    return surrogate.requests(spark, d).select(
        "idx", F.sha2("norm_key", 256).alias("key_sha"), F.length("request").cast("long").alias("n_chars")
    )


@query(f"WITH k AS (SELECT doc_id AS idx, {NORM} AS norm_key FROM documents), f AS (SELECT norm_key, min(idx) AS first_idx FROM k GROUP BY 1) SELECT idx, coalesce(idx > first_idx, false) AS is_hit, CASE WHEN idx > first_idx THEN first_idx END AS hit_source_idx FROM k LEFT JOIN f USING (norm_key) WHERE norm_key <> ''")
def exact_only_replay(spark, d):
    rows = surrogate.requests(spark, d).where(~text.is_blank(F.col("request")))
    return cache.seen_earlier(rows, "norm_key", "idx").select(
        "idx", F.col("seen").alias("is_hit"), F.when(F.col("seen"), F.col("first_idx")).alias("hit_source_idx")
    )


def _replay(spark, d) -> DataFrame:
    return TABLES.replay(spark, d)


REPLAY = "b AS (SELECT * FROM ok WHERE config = 'baseline'), g AS (SELECT frac, request, min(idx) AS first_idx FROM b GROUP BY ALL), rp AS (SELECT b.*, idx > first_idx AS is_hit FROM b JOIN g USING (frac, request))"


@query(f"""WITH {SQL}, {REPLAY}, m AS (SELECT frac, median(latency_ms) AS hit_ms FROM ok WHERE kind = 'cache_exact' GROUP BY 1)
SELECT frac, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE is_hit)::BIGINT AS n_hits, round(count(*) FILTER (WHERE is_hit)::DOUBLE / count(*), 6) AS hit_rate,
  round(sum(CASE WHEN is_hit THEN 0e0 ELSE cost_usd END), 6) AS cost_usd, sum(CASE WHEN is_hit THEN 0 ELSE tokens_in END)::BIGINT AS tokens_in, sum(CASE WHEN is_hit THEN 0 ELSE tokens_out END)::BIGINT AS tokens_out,
  round(any_value(hit_ms), 6) AS hit_ms, round(sum(CASE WHEN is_hit THEN hit_ms ELSE latency_ms END) / count(*), 6) AS mean_ms
FROM rp LEFT JOIN m USING (frac) GROUP BY frac""")
def exact_replay_summary(spark, d, of=TABLES):
    return rounded(cache.replay_summary(of.replay(spark, d), of.outcomes(spark, d)))


@query(f"""WITH {SQL}, {REPLAY}, c AS (SELECT frac, idx, kind FROM ok WHERE config = 'cache')
SELECT frac, count(*)::BIGINT AS available, count(*) FILTER (WHERE c.kind = 'cache_exact')::BIGINT AS observed, count(*) FILTER (WHERE coalesce(c.kind, '') <> 'cache_exact')::BIGINT AS absorbed FROM rp LEFT JOIN c USING (frac, idx) WHERE is_hit GROUP BY frac""")
def exact_hit_reconciliation(spark, d):
    return metrics.reconcile_exact(
        _replay(spark, d), metrics.succeeded(surrogate.outcomes(spark, d)).where("config = 'cache'")
    )


def _has(col: str, phrases) -> str:
    return "(" + " OR ".join(
        "contains(replace(lower({}), 'ß', 'ss'), '{}')".format(col, p.replace("'", "''")) for p in phrases
    ) + ")"


_CUE = f"coalesce({_has('text', text.CUES)}, false)"
ROUTE = f"SELECT doc_id AS idx, coalesce(length(text) > 240, false) OR {_CUE} AS hard, CASE WHEN coalesce(length(text) > 240, false) OR {_CUE} THEN 'long=' || CASE WHEN coalesce(length(text) > 240, false) THEN 'True' ELSE 'False' END || ' cue=' || CASE WHEN {_CUE} THEN 'True' ELSE 'False' END ELSE 'short and no reasoning cue' END AS reason, lang FROM documents"


@query(f"SELECT idx, hard, reason FROM ({ROUTE})")
def heuristic_route(spark, d):
    return surrogate.requests(spark, d).select(
        "idx", routing.heuristic(F.col("request")).alias("r")
    ).select("idx", "r.hard", "r.reason")


@query(f"SELECT lang, hard, count(*)::BIGINT AS n FROM ({ROUTE}) GROUP BY ALL")
def route_mix(spark, d):
    return surrogate.requests(spark, d).select(
        "lang", routing.heuristic(F.col("request"))["hard"].alias("hard")
    ).groupBy("lang", "hard").agg(F.count(F.lit(1)).alias("n"))


_BLANK = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = ''"


_ESC = f"({_BLANK}) OR coalesce({_has('text', text.DOUBTS)}, false)"


@query(f"SELECT conv_id, turn::BIGINT AS turn, {_ESC} AS escalate, CASE WHEN {_ESC} THEN 'cheap answer uncertain or empty' ELSE 'cheap answer confident' END AS reason FROM conversations WHERE role = 'assistant'")
def cascade_route(spark, d):
    turns = load(spark, d, "conversations").where("role = 'assistant'")
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), routing.cascade_reason(F.col("text")).alias("r")
    ).select("conv_id", "turn", "r.*")


DISPATCH = f"""d AS (SELECT config, frac, CASE WHEN config = 'baseline' THEN 'model_direct' WHEN kind IN ('cache_exact', 'cache_semantic') THEN kind ELSE 'miss' END AS k, served_by, user_hard AS hard, user_esc AS escalate, tokens_in, tokens_out FROM (SELECT *, seq % 3 = 0 AS user_hard, seq % 5 = 0 AS user_esc FROM ok))"""


@query(f"""WITH {SQL}, {DISPATCH}, e AS (SELECT config, frac, k AS kind,
  CASE WHEN k IN ('cache_exact', 'cache_semantic') THEN served_by WHEN (config = 'router_cascade' AND NOT escalate) OR (config = 'router_heuristic' AND NOT hard) THEN 'cheap' ELSE 'expensive' END AS served_by,
  CASE WHEN k IN ('cache_exact', 'cache_semantic') THEN 0 WHEN config = 'router_cascade' AND escalate THEN 2 * tokens_in ELSE tokens_in END AS ti,
  CASE WHEN k IN ('cache_exact', 'cache_semantic') THEN 0 WHEN config = 'router_cascade' AND escalate THEN tokens_out + tokens_out // 2 WHEN (config = 'router_cascade' AND NOT escalate) OR (config = 'router_heuristic' AND NOT hard) THEN tokens_out // 2 ELSE tokens_out END AS tk FROM d)
SELECT config, frac, kind, served_by, count(*)::BIGINT AS n, sum(ti)::BIGINT AS tokens_in, sum(tk)::BIGINT AS tokens_out, round(sum(ti / 1e6 * 1.5e0 + tk / 1e6 * 6e0), 6) AS cost_usd FROM e GROUP BY ALL""")
def router_cost_comparison(spark, d):
    o = metrics.succeeded(surrogate.outcomes(spark, d))
    ready = o.select(
        "config",
        "frac",
        F.col("kind").alias("hit_kind"),
        F.col("served_by").alias("stored_by"),
        (F.col("seq") % 3 == 0).alias("hard"),
        (F.col("seq") % 5 == 0).alias("escalate"),
        F.col("tokens_in").alias("cheap_in"),
        F.expr("tokens_out div 2").alias("cheap_out"),
        F.col("latency_ms").alias("cheap_ms"),
        F.col("tokens_in").alias("dear_in"),
        F.col("tokens_out").alias("dear_out"),
        F.col("latency_ms").alias("dear_ms"),
    )
    out = routing.dispatch(ready).withColumn(
        "cost_usd", routing.cost_usd(F.col("tokens_in"), F.col("tokens_out"), 1.5, 6.0)
    )
    return rounded(
        out.groupBy("config", "frac", "kind", "served_by").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("tokens_in").cast("long").alias("tokens_in"),
            F.sum("tokens_out").cast("long").alias("tokens_out"),
            F.sum("cost_usd").alias("cost_usd"),
        )
    )


VEC = "v AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS x, vec_id % 4 = 2 AS should_hit FROM embeddings)"
BEST = f"{VEC}, p AS (SELECT a.idx, max(list_dot_product(a.x, b.x)) AS best FROM v a JOIN v b ON b.idx < a.idx GROUP BY 1), best AS (SELECT v.idx, coalesce(best, 0) AS best, should_hit FROM v LEFT JOIN p USING (idx))"


def _best(spark, d) -> DataFrame:
    return TABLES.best(spark, d)


@query(f"WITH {BEST} SELECT idx, round(best, 6) AS best FROM best")
def prefix_best_similarity(spark, d):
    return rounded(cache.prefix_best(surrogate.vectors(spark, d)).select("idx", "best"))


@query(f"WITH {VEC} SELECT a.idx, arg_max(b.idx, list_dot_product(a.x, b.x)) AS best_src FROM v a JOIN v b ON b.idx < a.idx GROUP BY 1")
def nearest_prior(spark, d):
    return cache.prefix_best(surrogate.vectors(spark, d)).where("best_src IS NOT NULL").select("idx", "best_src")


_SW = f"{BEST}, t AS (SELECT round(30e-2 + 5e-3 * i, 4) AS threshold FROM range(140) r(i)), c AS (SELECT threshold, count(*) FILTER (WHERE best >= threshold AND should_hit)::BIGINT AS tp, count(*) FILTER (WHERE best >= threshold AND NOT should_hit)::BIGINT AS fp, count(*) FILTER (WHERE best < threshold AND should_hit)::BIGINT AS fn, count(*) FILTER (WHERE best < threshold AND NOT should_hit)::BIGINT AS tn FROM best, t GROUP BY 1), sw AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp::DOUBLE / nullif(tp + fp, 0), 0) AS false_hit_rate FROM c)"


@query(f"WITH {_SW} SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(false_hit_rate, 6) AS false_hit_rate FROM sw")
def threshold_sweep(spark, d):
    return rounded(tuning.sweep(_best(spark, d), GRID))


@query(f"WITH {_SW} SELECT threshold, tp, fp, fn, tn, round(f1, 6) AS f1 FROM sw ORDER BY round(f1, 12) DESC, threshold DESC LIMIT 1")
def best_f1_threshold(spark, d):
    swept = tuning.sweep(_best(spark, d), GRID).withColumn("f1", F.round("f1", 12))
    return rounded(tuning.best_f1(swept).select("threshold", "tp", "fp", "fn", "tn", "f1"))


@query(f"WITH {_SW}, l AS (SELECT r, r * fp + fn AS loss, threshold, fp, fn, row_number() OVER (PARTITION BY r ORDER BY r * fp + fn, threshold) AS k FROM sw, unnest([1, 3, 10, 30, 100]) u(r)) SELECT r::BIGINT AS r, loss::BIGINT AS loss, threshold, fp, fn FROM l WHERE k = 1")
def cost_weighted_threshold(spark, d):
    return _long(tuning.cost_weighted(tuning.sweep(_best(spark, d), GRID)))


_DRAWS = tuning.control_draws()


@query(f"WITH {_SW.replace('round(30e-2 + 5e-3 * i, 4) AS threshold FROM range(140) r(i)', 'x AS threshold FROM unnest([' + ', '.join(f'{x!r}e0' for x in _DRAWS) + ']) u(x)')} SELECT round(avg(f1), 6) AS mean_f1, round(max(f1), 6) AS max_f1, count(*)::BIGINT AS n FROM sw")
def control_thresholds(spark, d):
    return rounded(tuning.control(_best(spark, d), _DRAWS))


_FULL = _SW.replace("round(30e-2 + 5e-3 * i, 4) AS threshold FROM range(140)", "round(20e-2 + 5e-3 * i, 4) AS threshold FROM range(160)")
_FULL_DRAWS = tuning.control_draws(0.2)


def _list(draws: list[float]) -> str:
    return ", ".join(f"{x!r}e0" for x in draws)


@query(f"WITH {_FULL} SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(false_hit_rate, 6) AS false_hit_rate FROM sw")
def threshold_sweep_full(spark, d):
    return rounded(tuning.sweep(_best(spark, d), FULL_GRID))


@query(ORACLE["best_f1_threshold"].replace(_SW, _FULL))
def best_f1_threshold_full(spark, d, of=TABLES):
    swept = tuning.sweep(of.best(spark, d), FULL_GRID).withColumn("f1", F.round("f1", 12))
    return rounded(tuning.best_f1(swept).select("threshold", "tp", "fp", "fn", "tn", "f1"))


@query(ORACLE["cost_weighted_threshold"].replace(_SW, _FULL))
def cost_weighted_threshold_full(spark, d, of=TABLES):
    return _long(tuning.cost_weighted(tuning.sweep(of.best(spark, d), FULL_GRID)))


@query(ORACLE["control_thresholds"].replace(_list(_DRAWS), _list(_FULL_DRAWS)))
def control_thresholds_full(spark, d, of=TABLES):
    return rounded(tuning.control(of.best(spark, d), _FULL_DRAWS))


GREEDY = f"""WITH RECURSIVE {VEC}, q AS (SELECT idx, x, row_number() OVER (ORDER BY idx) AS rn FROM v),
e AS (SELECT a.idx AS a, b.idx AS b, list_dot_product(a.x, b.x) AS s FROM v a JOIN v b ON b.idx < a.idx WHERE list_dot_product(a.x, b.x) >= 35e-2),
n AS (SELECT q.rn, q.idx, coalesce(list(e.b) FILTER (WHERE e.b IS NOT NULL), []) AS near FROM q LEFT JOIN e ON e.a = q.idx GROUP BY ALL),
g AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS stored UNION ALL SELECT n.rn, CASE WHEN list_has_any(n.near, g.stored) THEN g.stored ELSE list_append(g.stored, n.idx) END FROM g JOIN n ON n.rn = g.rn + 1),
f AS (SELECT unnest(stored) AS idx FROM (SELECT stored FROM g ORDER BY rn DESC LIMIT 1)),
h AS (SELECT e.a AS idx, max(s) AS s, arg_max(e.b, s) AS src FROM e JOIN f ON f.idx = e.b WHERE e.a NOT IN (SELECT idx FROM f) GROUP BY 1)"""


@query(
    GREEDY + " SELECT v.idx, CASE WHEN h.idx IS NULL THEN 'miss' ELSE 'cache_semantic' END AS kind, round(h.s, 6) AS similarity, h.src AS hit_source_idx FROM v LEFT JOIN h USING (idx)"
)
def greedy_cache_decisions(spark, d):
    return rounded(cache.greedy_cache(surrogate.vectors(spark, d), THRESHOLD))


@query(
    GREEDY + f", p AS (SELECT count(DISTINCT a) AS n FROM e) SELECT (SELECT n FROM p)::BIGINT AS prefix_hits, (SELECT count(*) FROM h)::BIGINT AS live_hits"
)
def prefix_vs_live_gap(spark, d):
    v = surrogate.vectors(spark, d)
    live = cache.greedy_cache(v, THRESHOLD).agg(F.count_if(F.col("kind") != "miss").alias("live_hits"))
    return cache.prefix_best(v).agg(F.count_if(F.col("best") >= THRESHOLD).alias("prefix_hits")).crossJoin(live)  # one row each


@query(f"WITH k AS (SELECT doc_id AS idx, {NORM} AS norm_key, doc_id % 4 = 2 AS para FROM documents), f AS (SELECT norm_key, min(idx) AS first_idx FROM k GROUP BY 1) SELECT idx, NOT coalesce(idx > first_idx, false) AS eligible, para AND NOT coalesce(idx > first_idx, false) AS should_hit FROM k LEFT JOIN f USING (norm_key)")
def replay_labels(spark, d):
    rows = surrogate.requests(spark, d).withColumn(
        "dup_type", F.when(F.col("idx") % 4 == 2, "paraphrase").otherwise("novel")
    )
    # texts are folded once; the keys' first rows and the rows they are joined to are both read from what is written here
    digest = F.unhex(cache.key_digest(rows, "norm_key"))
    keyed = tables.cut_lineage(rows.select("idx", "dup_type", digest.alias("norm_key")))
    return tuning.replay_labels(keyed).select("idx", "eligible", "should_hit")


_Q = "count(s)::BIGINT AS n_scored, round(avg(s), 6) AS mean_score, round(avg(s) / 2, 6) AS quality FROM (SELECT *, CASE WHEN identical THEN 2 ELSE judge1_score END AS s FROM j) GROUP BY ALL"


@query(f"WITH {SQL} SELECT config, frac, {_Q}")
def quality_by_config(spark, d, of=TABLES):
    return rounded(metrics.quality(of.judgements(spark, d)))


@query(f"WITH {SQL} SELECT config, frac, dup_type, {_Q}")
def quality_by_dup(spark, d, of=TABLES):
    return rounded(metrics.quality(of.judgements(spark, d), ["config", "frac", "dup_type"]))


@query(f"""WITH {SQL}, {REPLAY}, s AS (SELECT j.*, CASE WHEN identical THEN 2 ELSE judge1_score END AS s FROM j SEMI JOIN (SELECT frac, idx FROM rp WHERE is_hit) h ON h.frac = j.frac AND h.idx = j.idx)
SELECT config, frac, count(s)::BIGINT AS judged, count(*) FILTER (WHERE s = 0)::BIGINT AS score_0, count(*) FILTER (WHERE s = 1)::BIGINT AS score_1, count(*) FILTER (WHERE s = 2)::BIGINT AS score_2, count(*) FILTER (WHERE s IS NULL)::BIGINT AS unjudged FROM s GROUP BY ALL""")
def exact_proxy(spark, d, of=TABLES):
    return metrics.exact_proxy(of.judgements(spark, d), of.replay(spark, d).where("is_hit"))


def _kappa(rows: str) -> str:
    return f"x AS ({rows}), c AS (SELECT a, b, count(*) AS n FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), m AS (SELECT sum(p.n::DOUBLE * q.n) AS e FROM (SELECT a AS c, sum(n) AS n FROM c GROUP BY 1) p JOIN (SELECT b AS c, sum(n) AS n FROM c GROUP BY 1) q USING (c)), k AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (WHERE a = b)::DOUBLE / sum(n) AS observed FROM c) SELECT n, round(observed, 6) AS observed, round(e / (n::DOUBLE * n), 6) AS expected, round((observed - e / (n::DOUBLE * n)) / (1 - e / (n::DOUBLE * n)), 6) AS kappa FROM k, m"


@query("WITH " + _kappa("SELECT quality AS a, 1 - toxic AS b FROM labels"))
def kappa_labels(spark, d):
    return rounded(
        agreement.kappa(
            load(spark, d, "labels").select("quality", (1 - F.col("toxic")).alias("good")), "quality", "good"
        )
    )


@query(f"WITH {SQL}, " + _kappa("SELECT judge1_score AS a, judge2_score AS b FROM j"))
def kappa_judges(spark, d, of=TABLES):
    return rounded(agreement.kappa(of.judgements(spark, d), "judge1_score", "judge2_score"))


@query(f"WITH {SQL} SELECT judge1_score AS a, judge2_score AS b, count(*)::BIGINT AS n FROM j WHERE judge1_score IS NOT NULL AND judge2_score IS NOT NULL GROUP BY ALL")
def contingency(spark, d):
    return _long(agreement.contingency(surrogate.judgements(spark, d), "judge1_score", "judge2_score"))


@query("SELECT count(quality)::BIGINT AS filled, count(*)::BIGINT AS total, round(count(quality)::DOUBLE / count(*), 6) AS coverage, count(quality)::DOUBLE / count(*) >= 5e-1 AS enough FROM documents LEFT JOIN labels USING (doc_id)")
def label_coverage(spark, d):
    return rounded(
        agreement.coverage(
            load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left"), "quality"
        )
    )


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'partial' WHEN 0 THEN 'incorrect' END AS label FROM labels")
def label_normalize(spark, d):
    return load(spark, d, "labels").select(
        "doc_id", text.normalize_label(F.col("quality").cast("double").cast("string")).alias("label")
    )


_TIER = "CASE WHEN kind = 'cache_semantic' AND judge1_score = 0 THEN 1 WHEN judge1_score <> judge2_score THEN 2 WHEN config = 'router_cascade' AND served_by = 'expensive' THEN 3 ELSE 4 END::BIGINT AS priority"


@query(f"WITH {SQL} SELECT {_TIER}, config, frac, idx, kind, served_by, judge1_score::BIGINT AS judge1_score, judge2_score::BIGINT AS judge2_score FROM j ORDER BY 1, 2, 3, 4 LIMIT 60")
def triage_queue(spark, d):
    return _long(agreement.triage(surrogate.judgements(spark, d), surrogate.outcomes(spark, d)))


@query(f"WITH {SQL}, t AS (SELECT {_TIER} FROM j) SELECT p::BIGINT AS priority, count(t.priority)::BIGINT AS n FROM unnest([1, 2, 3, 4]) u(p) LEFT JOIN t ON t.priority = p GROUP BY ALL")
def tier_counts(spark, d):
    return _long(
        agreement.tier_counts(
            agreement.triage(surrogate.judgements(spark, d), surrogate.outcomes(spark, d), limit=None)
        )
    )


_A, _B = _wilson("k_a", "n_a"), _wilson("k_b", "n_b")
_P, _Q2 = "(k_a::DOUBLE / n_a)", "(k_b::DOUBLE / n_b)"


@query(f"""WITH {SQL}, r AS (SELECT config, frac, count(*) FILTER (WHERE kind IN ('cache_exact', 'cache_semantic'))::BIGINT AS k, count(*)::BIGINT AS n FROM ok GROUP BY ALL),
w AS (SELECT a.frac, a.k AS k_a, a.n AS n_a, b.k AS k_b, b.n AS n_b FROM r a JOIN r b ON a.frac = b.frac AND a.config = 'router_cascade' AND b.config = 'router_heuristic'),
i AS (SELECT *, {_Q2} - {_P} AS diff, {_Q2} - {_P} - sqrt(pow({_Q2} - {_B[0]}, 2) + pow({_A[1]} - {_P}, 2)) AS lo, {_Q2} - {_P} + sqrt(pow({_B[1]} - {_Q2}, 2) + pow({_P} - {_A[0]}, 2)) AS hi FROM w)
SELECT frac, k_a, n_a, k_b, n_b, round(diff, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS separated FROM i""")
def newcombe_diff(spark, d):
    return rounded(
        metrics.newcombe_rates(metrics.hit_rates(surrogate.outcomes(spark, d)), "router_cascade", "router_heuristic")
    )


@query(f"WITH {SQL} SELECT a.frac, count(*)::BIGINT AS n_shared, round(avg(a.cost_usd), 9) AS mean_a, round(avg(b.cost_usd), 9) AS mean_b, round(avg(a.cost_usd - b.cost_usd), 9) AS diff FROM ok a JOIN ok b ON a.config = 'cache' AND b.config = 'baseline' AND a.frac = b.frac AND a.idx = b.idx GROUP BY 1")
def paired_difference(spark, d):
    return rounded(
        metrics.paired_difference(metrics.succeeded(surrogate.outcomes(spark, d)), "cache", "baseline", "cost_usd"), 9
    )


def _gates(spark, d, grid=GRID, draws=_DRAWS, of=TABLES) -> DataFrame:
    o, j = of.outcomes(spark, d), of.judgements(spark, d)
    m = metrics.succeeded(o).groupBy("config", "frac").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    best = tables.cut_lineage(of.best(spark, d))  # the similarity join runs once
    swept = tuning.sweep(best, grid)
    cover = agreement.coverage(
        load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left"), "quality"
    )
    return gates.gate_table(
        gates.cost_gates(m),
        gates.false_hit_gates(metrics.false_hits(j, o)),
        gates.tuned_gate(tuning.best_f1(swept), tuning.control(best, draws)),
        gates.coverage_gate(cover),
        gates.independence_gate(agreement.kappa(j, "judge1_score", "judge2_score"), "judge-one", "judge-one"),
    )


GATES = f"""WITH {SQL}, {_SEM}, b AS (SELECT config, frac, count(*) AS k FROM j WHERE NOT identical AND judge1_score = 0 AND dup_type IN ('paraphrase', 'trap') GROUP BY ALL), fr AS ({_FALSE}),
m AS (SELECT config, frac, round(sum(cost_usd), 6) AS c FROM ok GROUP BY ALL), want AS (SELECT config, frac FROM unnest(['cache', 'router_cascade', 'router_heuristic']) u(config), unnest(['low', 'high']) w(frac)), {_SW},
ct AS (SELECT max(x.f1) AS f, avg(x.f1) AS m FROM (SELECT coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (SELECT u.t, count(*) FILTER (WHERE best >= u.t AND should_hit) AS tp, count(*) FILTER (WHERE best >= u.t AND NOT should_hit) AS fp, count(*) FILTER (WHERE best < u.t AND should_hit) AS fn FROM best, unnest([{', '.join(f'{x!r}e0' for x in _DRAWS)}]) u(t) GROUP BY 1)) x),
cov AS (SELECT count(quality) AS f, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)), kp AS (SELECT * FROM (WITH {_kappa("SELECT judge1_score AS a, judge2_score AS b FROM j")})),
gt AS (
SELECT 'baseline_costs_more_' || w.frac || '_' || w.config AS name, coalesce(m.c < z.c, false) AS passed, CASE WHEN m.c IS NULL OR z.c IS NULL THEN 'run not present (resume incomplete)' ELSE printf('baseline %.4f vs %s %.4f', z.c, w.config, m.c) END AS observed FROM want w LEFT JOIN m ON m.config = w.config AND m.frac = w.frac LEFT JOIN m z ON z.config = 'baseline' AND z.frac = w.frac
UNION ALL SELECT 'false_hit_rate_within_bound_' || w.frac || '_' || w.config, coalesce(fr.false_hit_rate <= 5e-2, false), CASE WHEN fr.false_hit_rate IS NULL THEN 'run not present or unjudged' ELSE printf('%.4f (%d of %d semantic hits) vs bar 0.0500', fr.false_hit_rate, fr.k, fr.n) END FROM want w LEFT JOIN fr ON fr.config = w.config AND fr.frac = w.frac
UNION ALL SELECT 'tuned_threshold_beats_random_control', s.f > ct.f, printf('tuned %s f1 %.4f vs control max %.4f (mean %.4f)', s.t::VARCHAR, s.f, ct.f, ct.m) FROM (SELECT f1 AS f, threshold AS t FROM sw ORDER BY f1 DESC, threshold DESC LIMIT 1) s, ct
UNION ALL SELECT 'human_label_coverage', n > 0 AND f >= 5e-1 * n, CASE WHEN n > 0 THEN printf('%d/%d = %.3f', f, n, f / n::DOUBLE) ELSE 'csv empty' END FROM cov
UNION ALL SELECT 'judge_independence', false, 'primary judge-one == secondary judge-one; kappa ' || printf('%.4f', kappa) || ' (n=' || n || ') is self-consistency' FROM kp)"""


@query(GATES + " SELECT * FROM gt")
def gate_table(spark, d):
    return _gates(spark, d)


@query(
    GATES + " SELECT bool_and(passed) AS all_gates_passed, count(*)::BIGINT AS n_gates, count(*) FILTER (WHERE passed)::BIGINT AS n_passed FROM gt"
)
def all_gates(spark, d):
    return gates.summary(_gates(spark, d))


FULL_GATES = GATES.replace(_SW, _FULL).replace(_list(_DRAWS), _list(_FULL_DRAWS))


@query(FULL_GATES + " SELECT * FROM gt")
def gate_table_full(spark, d, of=TABLES):
    return _gates(spark, d, FULL_GRID, _FULL_DRAWS, of)


@query(
    FULL_GATES + " SELECT bool_and(passed) AS all_gates_passed, count(*)::BIGINT AS n_gates, count(*) FILTER (WHERE passed)::BIGINT AS n_passed FROM gt"
)
def all_gates_full(spark, d):
    return gates.summary(_gates(spark, d, FULL_GRID, _FULL_DRAWS))


_SPLIT = "g AS (SELECT DISTINCT substr(md5(text), 1, 2) AS grp FROM documents WHERE text IS NOT NULL), k AS (SELECT grp, row_number() OVER (ORDER BY sha256('7|' || grp)) AS r, count(*) OVER () AS n FROM g), h AS (SELECT grp, CASE WHEN r <= floor(n * 5e-1) THEN 'tune' ELSE 'report' END AS half FROM k)"


def _split(spark, d):
    return workload.split_groups(
        load(spark, d, "documents").where("text IS NOT NULL").select(
            "doc_id", F.substring(F.md5(F.col("text").cast("binary")), 1, 2).alias("grp")
        ),
        "grp",
    )


@query(f"WITH {_SPLIT} SELECT doc_id, grp, half FROM documents JOIN h ON grp = substr(md5(text), 1, 2)")
def group_split(spark, d):
    return _split(spark, d).select("doc_id", "grp", "half")


@query(f"WITH {_SPLIT} SELECT half, count(*)::BIGINT AS n_rows, count(DISTINCT grp)::BIGINT AS n_groups FROM documents JOIN h ON grp = substr(md5(text), 1, 2) GROUP BY 1")
def split_balance(spark, d):
    return workload.split_balance(_split(spark, d), "grp")


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents), d AS (SELECT i AS draw, ('0x' || substr(sha256('11|' || i), 1, 8))::BIGINT AS h FROM range(1000) r(i)) SELECT draw, doc_id FROM d JOIN n ON pos = h % n")
def exact_repeat_draw(spark, d):
    return workload.exact_repeats(
        load(spark, d, "documents").select("doc_id"), spark.range(1000).select(F.col("id").alias("draw")), 11, "doc_id"
    )


@query("SELECT conv_id, turn::BIGINT AS turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY sha256('3|' || conv_id || '|' || turn), conv_id, turn) AS r FROM conversations WHERE role = 'user') WHERE r <= 100")
def pair_sampling(spark, d):
    return workload.sample(
        load(spark, d, "conversations").where("role = 'user'").select(
            "conv_id", F.col("turn").cast("long").alias("turn")
        ),
        100,
        3,
        "conv_id",
        "turn",
    )


@query(f"WITH {SQL}, a AS (SELECT frac, request, max(idx) AS anchor_idx FROM o WHERE config = 'cache' AND dup_type = 'novel' GROUP BY ALL) SELECT o.frac, o.idx, a.anchor_idx FROM o LEFT JOIN a ON a.frac = o.frac AND a.request = 'q' || (substr(o.request, 2)::BIGINT - substr(o.request, 2)::BIGINT % 4) WHERE config = 'cache' AND dup_type <> 'novel'")
def dependency_order(spark, d):
    rows = surrogate.outcomes(spark, d).where("config = 'cache'")
    user = F.substring("group_id", 2, 18).cast("long")
    return workload.anchors(
        rows.withColumn("group_id", text.group_name(user - user % 4))
    ).select("frac", "idx", "anchor_idx")


@query("WITH u AS (SELECT conv_id, count(*)::BIGINT AS n_turns, trim(string_agg(text, chr(10) ORDER BY turn), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1) SELECT * FROM u WHERE text <> ''")
def chat_user_text(spark, d):
    return workload.user_text(load(spark, d, "conversations"))


@query("SELECT conv_id, max(turn)::BIGINT AS turn, arg_max(coalesce(text, chr(0)), turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def chat_last_answer(spark, d):
    return _long(
        workload.last_answer(load(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("\0"))))
    )


_REPLY = "(CASE conv_id % 4 WHEN 0 THEN 'Score: 2.' WHEN 1 THEN 'I give it 10 of 10, so 1!' WHEN 2 THEN '(0) wrong' ELSE 'x' || conv_id || 'y2z' END)"
_TOKENS = r"list_filter(list_transform(regexp_split_to_array(reply, '\s+'), lambda w: trim(w, '.,:;!?()[]{}""''`')), lambda w: w IN ('0', '1', '2'))"


@query(
    rf"WITH r AS (SELECT conv_id, turn::BIGINT AS turn, {_REPLY} AS reply FROM conversations) SELECT conv_id, turn, coalesce({_TOKENS}[1], nullif(regexp_extract(reply, '(^|[^0-9])([012])($|[^0-9])', 2), ''))::BIGINT AS score FROM r".replace('""', '"')
)
def score_parse(spark, d):
    c = load(spark, d, "conversations")
    reply = F.when(F.col("conv_id") % 4 == 0, "Score: 2.").when(
        F.col("conv_id") % 4 == 1, "I give it 10 of 10, so 1!"
    ).when(F.col("conv_id") % 4 == 2, "(0) wrong").otherwise(F.concat(F.lit("x"), F.col("conv_id"), F.lit("y2z")))
    return c.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), text.parse_score(reply).cast("long").alias("score")
    )


@query(r"SELECT doc_id, 'percent' AS kind, unnest(regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)%', 0)) AS claim FROM documents UNION ALL SELECT doc_id, 'pair', unnest(regexp_extract_all(text, '([0-9]+) of ([0-9]+)', 0)) FROM documents")
def audit_numbers(spark, d):
    return audit.claims(load(spark, d, "documents"))


@query()
def bootstrap_ci(spark, d):
    means = stats.poisson_bootstrap(
        metrics.succeeded(surrogate.outcomes(spark, d)), ["config", "frac"], "cost_usd", "seq", stats.REPLICATES
    )
    return means.select(
        "config",
        "frac",
        F.lit("sum").alias("quantity"),
        (F.col("lo") * F.col("n")).alias("lo"),
        (F.col("hi") * F.col("n")).alias("hi"),
        "n",
    )


@query()
def bootstrap_percentiles(spark, d):
    rows = metrics.warm(metrics.succeeded(surrogate.outcomes(spark, d))).withColumn(
        "seed", stats.derive_seed(F.col("frac"), F.col("config"), F.lit("latency"))
    )
    return stats.percentile_bootstrap(rows, ["config", "frac"], "latency_ms", "seed")


@query()
def paired_bootstrap(spark, d):
    return metrics.comparisons(surrogate.outcomes(spark, d), surrogate.judgements(spark, d))


@query()
def poisson_bootstrap(spark, d):
    return stats.poisson_bootstrap(
        metrics.succeeded(surrogate.outcomes(spark, d)), ["config", "frac"], "latency_ms", "seq"
    )
