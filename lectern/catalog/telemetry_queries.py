"""Telemetry, logs and paging over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import inputs as I
from lectern.catalog import sqltext as S
from lectern.catalog.registry import query
from lectern.catalog.retrieval_queries import STATUS, statuses
from lectern.operators import retrieval as R
from lectern.operators import telemetry as N
from lectern.sources.tables import read_table

# An event is one request: its value is the latency, its type decides which stages ran.
METRICS = """mt AS (SELECT event_id AS request_id, user_id, event_type, value AS total_latency_ms, value / 10 AS query_latency_ms, value / 20 AS routing_latency_ms,
  value / 2 AS retrieval_latency_ms, value / 4 AS reranking_latency_ms, value / 8 AS cag_latency_ms, value / 16 AS mag_latency_ms, value / 32 AS fusion_latency_ms,
  value / 64 AS prompt_latency_ms, CASE WHEN event_type <> 'error' THEN value / 3 END AS llm_latency_ms, CASE WHEN event_type = 'purchase' THEN value / 6 END AS llm_ttft_ms,
  user_id % 2 = 0 AS routing_enabled, event_type IN ('view', 'click') AS rag_selected, event_type IN ('view', 'purchase') AS cag_selected, event_type = 'signup' AS mag_selected,
  event_type = 'view' AS cag_cache_hit, event_type IN ('view', 'click') AS cag_cache_miss, (props->>'k')::INT AS k, event_type = 'error' AS has_error,
  CASE user_id % 3 WHEN 0 THEN 'Timeout' WHEN 1 THEN '' END AS error_type FROM events)"""


def metrics(spark, sf):
    e, v, t = I.events(spark, sf), F.col("value"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("request_id"), "user_id", "event_type", "ts", v.alias("total_latency_ms"),
        (v / 10).alias("query_latency_ms"), (v / 20).alias("routing_latency_ms"), (v / 2).alias("retrieval_latency_ms"),
        (v / 4).alias("reranking_latency_ms"), (v / 8).alias("cag_latency_ms"), (v / 16).alias("mag_latency_ms"),
        (v / 32).alias("fusion_latency_ms"), (v / 64).alias("prompt_latency_ms"), F.when(t != "error", v / 3).alias("llm_latency_ms"),
        F.when(t == "purchase", v / 6).alias("llm_ttft_ms"), (F.col("user_id") % 2 == 0).alias("routing_enabled"),
        t.isin("view", "click").alias("rag_selected"), t.isin("view", "purchase").alias("cag_selected"),
        (t == "signup").alias("mag_selected"), (t == "view").alias("cag_cache_hit"), t.isin("view", "click").alias("cag_cache_miss"),
        k.alias("k"), (k % 4).alias("memories_retrieved"), (k % 3 + k % 5).alias("contexts_dropped"),
        F.create_map(F.lit("duplicate"), k % 3, F.lit("token_budget"), k % 5).alias("dropped_reasons"),
        (t == "error").alias("has_error"),
        F.when(F.col("user_id") % 3 == 0, "Timeout").when(F.col("user_id") % 3 == 1, "").alias("error_type"),
    )


@query("documents_by_status", f"WITH {STATUS} SELECT status, count(*) AS documents FROM st GROUP BY ROLLUP (status)")
def documents_by_status(spark, sf):
    return N.docs_by_status(statuses(spark, sf))


@query("overview", f"""WITH {S.CHUNKS}, {S.MESSAGES}, n AS (SELECT user_id, 'd' AS w, count(*) AS n FROM docs GROUP BY ALL UNION ALL SELECT user_id, 'c', count(*) FROM chunks GROUP BY ALL
  UNION ALL SELECT user_id, 's', count(DISTINCT session_id) FROM msgs GROUP BY ALL UNION ALL SELECT user_id, 'm', count(*) FROM msgs GROUP BY ALL
  UNION ALL SELECT 'src' || (user_id % 20), 'q', count(*) FROM events GROUP BY ALL)
SELECT user_id, coalesce(sum(n) FILTER (w = 'd'), 0)::BIGINT AS documents, coalesce(sum(n) FILTER (w = 'c'), 0)::BIGINT AS chunks, coalesce(sum(n) FILTER (w = 's'), 0)::BIGINT AS sessions,
  coalesce(sum(n) FILTER (w = 'm'), 0)::BIGINT AS messages, coalesce(sum(n) FILTER (w = 'q'), 0)::BIGINT AS queries FROM n GROUP BY user_id""")
def overview(spark, sf):
    logs = I.events(spark, sf).select(I.owner("user_id").alias("user_id"))
    return N.overview(I.docs(spark, sf), I.chunks(spark, sf), I.sessions(spark, sf), I.messages(spark, sf), logs)


def _stage_sql() -> str:
    parts = []
    for name, column, cond in N.STAGE_COLUMNS:
        v = column if cond is None else f"CASE WHEN {cond} THEN {column} END"
        parts.append(f"SELECT '{name}' AS stage, {v} AS ms FROM mt")
    return " UNION ALL ".join(parts)


# Both sides round at eight digits before they round at two.
@query("stage_latencies", f"""WITH {METRICS}, s AS ({_stage_sql()}) SELECT stage, count(ms) AS count, round(min(ms)::DECIMAL(18, 8), 2)::DOUBLE AS min_ms, round(max(ms)::DECIMAL(18, 8), 2)::DOUBLE AS max_ms,
  round((sum(ms) / count(ms))::DECIMAL(18, 8), 2)::DOUBLE AS avg_ms FROM s GROUP BY stage""")
def stage_latencies(spark, sf):
    return N.pipeline_latencies(metrics(spark, sf))


@query("latency_by_type", f"WITH {METRICS} SELECT event_type, 'total_latency_ms' AS stage, count(*) AS count, round(min(total_latency_ms)::DECIMAL(18, 8), 2)::DOUBLE AS min_ms, round(max(total_latency_ms)::DECIMAL(18, 8), 2)::DOUBLE AS max_ms, round(avg(total_latency_ms)::DECIMAL(18, 8), 2)::DOUBLE AS avg_ms FROM mt GROUP BY event_type")
def latency_by_type(spark, sf):
    return N.latency_stats(metrics(spark, sf), ["total_latency_ms"], ["event_type"])


@query("cache_hit_rates", f"""WITH {METRICS} SELECT user_id, count_if(cag_cache_hit) AS hits, count_if(NOT cag_cache_hit AND cag_cache_miss) AS misses,
  round(coalesce(count_if(cag_cache_hit) / nullif(count_if(cag_cache_hit OR cag_cache_miss), 0)::DOUBLE, 0.0), 4) AS cache_hit_rate FROM mt GROUP BY user_id""")
def cache_hit_rates(spark, sf):
    return N.hit_rate(metrics(spark, sf), ["user_id"])


@query("request_counters", f"WITH {METRICS} SELECT sum(k % 4)::BIGINT AS memories_retrieved_total, sum(k % 3 + k % 5)::BIGINT AS contexts_dropped_total, count_if(has_error) AS requests_failed FROM mt")
def request_counters(spark, sf):
    return N.counters(metrics(spark, sf))


@query("drops_by_reason", f"WITH {METRICS} SELECT 'duplicate' AS reason, sum(k % 3)::BIGINT AS dropped FROM mt UNION ALL SELECT 'token_budget', sum(k % 5)::BIGINT FROM mt")
def drops_by_reason(spark, sf):
    return N.drops_by_reason(metrics(spark, sf))


@query("errors_by_type", f"WITH {METRICS} SELECT coalesce(nullif(error_type, ''), 'UnknownError') AS error_type, count(*) AS errors FROM mt WHERE has_error GROUP BY ALL")
def errors_by_type(spark, sf):
    return N.errors_by_type(metrics(spark, sf))


LIFECYCLE = "lc AS (SELECT *, CASE event_type WHEN 'view' THEN 'request_started' WHEN 'error' THEN 'stage_failed' WHEN 'purchase' THEN 'request_completed' WHEN 'click' THEN 'llm_first_token' ELSE 'query_processed' END AS event FROM events)"


def lifecycle(events):
    t = F.col("event_type")
    name = (
        F.when(t == "view", "request_started").when(t == "error", "stage_failed").when(t == "purchase", "request_completed")
        .when(t == "click", "llm_first_token").otherwise("query_processed")
    )
    return events.withColumn("event", name)


@query("event_counters", f"WITH {LIFECYCLE} SELECT count_if(event = 'request_started') AS requests_total, count_if(event = 'stage_failed') AS requests_failed FROM lc")
def event_counters(spark, sf):
    return N.event_counters(lifecycle(I.events(spark, sf)))


@query("event_errors", f"WITH {LIFECYCLE} SELECT coalesce(CASE WHEN user_id % 2 = 0 THEN 'Timeout' END, 'UnknownError') AS error_type, count(*) AS errors FROM lc WHERE event = 'stage_failed' GROUP BY ALL")
def event_errors(spark, sf):
    return N.event_errors(lifecycle(I.events(spark, sf)), F.when(F.col("user_id") % 2 == 0, "Timeout"))


@query("recent_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(spark, sf):
    return N.recent(I.events(spark, sf), [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type")


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    p = N.percentiles(I.events(spark, sf), "value", ["event_type"])
    return p.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("safe_summaries", f"WITH {METRICS} SELECT request_id, total_latency_ms AS total, round(retrieval_latency_ms, 6) AS retrieval, rag_selected AS rag, k % 3 + k % 5 AS dropped, has_error FROM mt")
def safe_summaries(spark, sf):
    s = N.safe_summary(metrics(spark, sf))
    return s.select(
        "request_id", F.col("total_latency_ms").alias("total"), F.round("latencies.retrieval", 6).alias("retrieval"),
        F.col("sources.rag").alias("rag"), F.col("fusion.dropped").alias("dropped"), "has_error",
    )


@query("retrieval_logs", f"""WITH {S.CHUNKS}, {S.QUERIES}, oc AS (SELECT *, user_id AS scope FROM chunks), oq AS (SELECT *, user_id AS scope FROM qs), {S.bm25('oc', 'oq', 5)}
SELECT q.query_id, q.user_id, coalesce(string_agg(b.chunk_id, ',' ORDER BY b.rank), '') AS chunk_ids, CASE WHEN count(b.chunk_id) > 0 THEN 'hybrid_rerank' ELSE 'none' END AS retrieval_method,
  count(b.chunk_id) AS top_k, count(b.chunk_id) > 0 AS reranking_enabled FROM qs q LEFT JOIN bm25 b USING (query_id) GROUP BY ALL""")
def retrieval_logs(spark, sf):
    q = I.queries(spark, sf)
    m = q.select("*", F.lit(20).alias("candidate_count"), F.lit(1.0).alias("total_latency_ms"), I.now().alias("created_at"))
    log = N.to_log(R.bm25_search(q, I.chunks(spark, sf)), m)
    return log.select(
        "query_id", "user_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), "retrieval_method",
        F.col("top_k").cast("bigint").alias("top_k"), "reranking_enabled",
    )


@query("retrieval_log_columns", """SELECT item_id AS query_id, 's' || item_id AS session_id, 'r' || (item_id * 2) AS request_id, item_id / 4.0::DOUBLE AS retrieval_latency_ms,
  0.0::DOUBLE AS reranking_latency_ms, CASE WHEN item_id % 2 = 0 THEN item_id / 2.0::DOUBLE ELSE 0.0 END AS llm_latency_ms, '{}' AS metadata FROM benchmark""")
def retrieval_log_columns(spark, sf):
    """What a log row carries of its request, and the defaults of what the request did not measure."""
    i = F.col("query_id")
    q = I.queries(spark, sf).select(
        "*", F.lit(20).alias("candidate_count"), F.lit(1.0).alias("total_latency_ms"), I.now().alias("created_at"), F.concat(F.lit("s"), i.cast("string")).alias("session_id"),
        F.concat(F.lit("r"), (i * 2).cast("string")).alias("request_id"), (i / 4.0).alias("retrieval_latency_ms"), F.when(i % 2 == 0, i / 2.0).alias("llm_latency_ms"),
    )
    none = q.select("query_id", F.lit("").alias("chunk_id"), F.lit(1).alias("rank")).where("false")
    return N.to_log(none, q).select("query_id", "session_id", "request_id", "retrieval_latency_ms", "reranking_latency_ms", "llm_latency_ms", "metadata")


# --- paging --------------------------------------------------------------------------------------
def logs(spark, sf):
    method = N.method_label(F.col("event_type") != "error", F.col("event_type") == "view")
    return I.events(spark, sf).select(
        F.col("event_id").alias("log_id"), "user_id", F.col("ts").alias("created_at"), method.alias("retrieval_method")
    )


LOGS = "lg AS (SELECT event_id AS log_id, user_id, ts, CASE event_type WHEN 'error' THEN 'none' WHEN 'view' THEN 'hybrid_rerank' ELSE 'hybrid' END AS retrieval_method FROM events)"


@query("method_labels", f"WITH {LOGS} SELECT retrieval_method, count(*) AS n FROM lg GROUP BY ALL")
def method_labels(spark, sf):
    return logs(spark, sf).groupBy("retrieval_method").agg(F.count(F.lit(1)).alias("n"))


@query("document_page", "SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id OFFSET 20 LIMIT 50")
def document_page(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return N.page(d, [F.desc("n_chars"), F.col("doc_id")], 20, 50).select("doc_id", "source")


@query("audit_log_page", f"WITH {LOGS}, f AS (SELECT * FROM lg WHERE retrieval_method = 'hybrid') SELECT log_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC, log_id OFFSET 10 LIMIT 50")
def audit_log_page(spark, sf):
    rows, total = N.audit_log(logs(spark, sf), method="hybrid", skip=10)
    one = F.lit(1).alias("_one")
    return rows.select("log_id", one).join(total.select("total", one), "_one").drop("_one")


@query("logs_of_user", f"WITH {LOGS} SELECT log_id FROM lg WHERE user_id = 8 ORDER BY ts DESC, log_id LIMIT 50")
def logs_of_user(spark, sf):
    return N.logs_of(logs(spark, sf), "user_id", 8).select("log_id")


@query("top_messages_per_role", """SELECT role, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY length(text) DESC, conv_id, turn) <= 5""")
def top_messages_per_role(spark, sf):
    c = read_table(spark, sf, "conversations")
    return R.top_k(c, ["role"], [F.desc(F.length("text")), F.col("conv_id"), F.col("turn")], 5).select("role", "conv_id", "turn")


# Stage events of one request become one row; here a user's day is the request.
@query("request_lifecycles", f"""WITH {LIFECYCLE} SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS request_id, count(*) AS events, count_if(event = 'stage_failed') AS failures,
  round(min(value) FILTER (event = 'llm_first_token'), 6) AS first_token, bool_or(event = 'request_completed') AS completed FROM lc GROUP BY ALL""")
def request_lifecycles(spark, sf):
    from lectern.streaming.lifecycle import lifecycle_columns

    e = lifecycle(I.events(spark, sf))
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    out = e.withColumn("request_id", key).groupBy("request_id").agg(*lifecycle_columns())
    return out.select("request_id", "events", "failures", F.round("first_token", 6).alias("first_token"), "completed")
