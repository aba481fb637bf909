"""Counters, latency statistics, logs and paging over event and log tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import fixed_values as V
from lectern.functions import text as tx

# stage name, latency column, condition column (None: always)
STAGE_COLUMNS = [
    ("request", "total_latency_ms", None), ("query", "query_latency_ms", None),
    ("routing", "routing_latency_ms", "routing_enabled"), ("rag", "retrieval_latency_ms", "rag_selected"),
    ("rerank", "reranking_latency_ms", "rag_selected"), ("cag", "cag_latency_ms", "cag_selected"),
    ("mag", "mag_latency_ms", "mag_selected"), ("fusion", "fusion_latency_ms", None),
    ("prompt", "prompt_latency_ms", None), ("llm", "llm_latency_ms", None), ("llm_ttft", "llm_ttft_ms", None),
]


def docs_by_status(docs: DataFrame, user: str | None = None) -> DataFrame:
    """Documents per status with a total row (``status`` null); all owners for an administrator."""
    rows = docs if user is None else docs.where(F.col("user_id") == user)
    return rows.rollup("status").agg(F.count(F.lit(1)).alias("documents"))


def overview(docs: DataFrame, chunks: DataFrame, sessions: DataFrame, messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Documents, chunks, sessions, messages and queries per user.

    Every table is counted per user before the narrow counts are brought together by one aggregation.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.lit(name).alias("what"), "n")

    names = ["documents", "chunks", "sessions", "messages", "queries"]
    parts = [counted(d, n) for d, n in zip([docs, chunks, sessions, messages, logs], names, strict=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("user_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    )


def _cents(x: Column) -> Column:
    """Two decimals, rounded at eight first so that binary noise never decides a half."""
    return F.round(F.round(x, 8), 2)


def _stats(value: Column) -> list[Column]:
    mean = F.sum(value) / F.nullif(F.count(value), F.lit(0))
    return [
        F.count(value).alias("count"), _cents(F.min(value)).alias("min_ms"), _cents(F.max(value)).alias("max_ms"),
        F.coalesce(_cents(mean), F.lit(0.0)).alias("avg_ms"),
    ]


def latency_stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, min, max and mean of each latency column, nulls left out."""
    return df.unpivot(by or [], columns, "stage", "ms").groupBy(*(by or []), "stage").agg(*_stats(F.col("ms")))


def pipeline_latencies(metrics: DataFrame) -> DataFrame:
    """Statistics per stage; a stage counts only in requests that used it."""
    stages = []
    for name, column, condition in STAGE_COLUMNS:
        value = F.col(column) if condition is None else F.when(F.col(condition), F.col(column))
        stages.append(value.cast("double").alias(name))
    return latency_stats(metrics.select(*stages), [s[0] for s in STAGE_COLUMNS])


def hit_rate(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cache hits, misses and their rate; a row that is a hit is never counted as a miss."""
    hit = F.col("cag_cache_hit")
    hits, misses = F.count_if(hit), F.count_if(~hit & F.col("cag_cache_miss"))
    rate = F.round(F.coalesce(hits / F.nullif(hits + misses, F.lit(0)), F.lit(0.0)), 4)
    return metrics.groupBy(*(by or [])).agg(hits.alias("hits"), misses.alias("misses"), rate.alias("cache_hit_rate"))


def counters(metrics: DataFrame) -> DataFrame:
    """Sums over all requests."""
    return metrics.agg(
        F.sum(F.greatest("memories_retrieved", F.lit(0))).alias("memories_retrieved_total"),
        F.sum(F.greatest("contexts_dropped", F.lit(0))).alias("contexts_dropped_total"),
        F.count_if("has_error").alias("requests_failed"),
    )


def drops_by_reason(metrics: DataFrame) -> DataFrame:
    rows = metrics.where(F.col("contexts_dropped") > 0).select(F.explode("dropped_reasons").alias("reason", "n"))
    return rows.groupBy("reason").agg(F.sum("n").alias("dropped"))


def errors_by_type(metrics: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("error_type"), F.lit("")), F.lit(V.UNKNOWN_ERROR)).alias("error_type")
    return metrics.where("has_error").groupBy(kind).agg(F.count(F.lit(1)).alias("errors"))


def event_counters(events: DataFrame) -> DataFrame:
    failed = F.col("event").isin("request_failed", "stage_failed")
    return events.agg(
        F.count_if(F.col("event") == "request_started").alias("requests_total"), F.count_if(failed).alias("requests_failed")
    )


def event_errors(events: DataFrame, error_type: Column) -> DataFrame:
    kind = F.coalesce(error_type, F.lit(V.UNKNOWN_ERROR)).alias("error_type")
    return events.where(F.col("event").isin("request_failed", "stage_failed")).groupBy(kind).agg(
        F.count(F.lit(1)).alias("errors")
    )


def recent(df: DataFrame, order: list[Column], n: int = 100) -> DataFrame:
    return df.orderBy(*order).limit(n)


def percentiles(df: DataFrame, value: str, by: list[str], exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """P50 and P95 per group.

    The exact form first counts equal values, so its state holds distinct values only; ``exact=False`` uses a
    sketch of fixed size where even those are too many for one group.
    """
    if not exact:
        return df.groupBy(*by).agg(
            F.percentile_approx(value, 0.5, accuracy).alias("p50"), F.percentile_approx(value, 0.95, accuracy).alias("p95")
        )
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*by).agg(
        F.percentile(value, 0.5, F.col("_n")).alias("p50"), F.percentile(value, 0.95, F.col("_n")).alias("p95")
    )


def safe_summary(metrics: DataFrame) -> DataFrame:
    """Nested summary of a request without any content."""

    def part(names: dict[str, str]) -> Column:
        return F.struct(*[F.col(c).alias(n) for n, c in names.items() if c in metrics.columns])

    groups = {
        "latencies": {
            "query": "query_latency_ms", "routing": "routing_latency_ms", "retrieval": "retrieval_latency_ms",
            "reranking": "reranking_latency_ms", "cag": "cag_latency_ms", "mag": "mag_latency_ms",
            "fusion": "fusion_latency_ms", "prompt": "prompt_latency_ms", "llm_ttft": "llm_ttft_ms",
            "llm_generation": "llm_latency_ms",
        },
        "sources": {"rag": "rag_selected", "cag": "cag_selected", "mag": "mag_selected", "selected": "selected_sources"},
        "rag_quality": {
            "candidates": "candidate_count", "reranked": "reranked_count", "top_score": "top_score",
            "avg_score": "avg_score", "citations": "citations",
        },
        "fusion": {
            "received": "contexts_received", "selected": "contexts_selected", "deduped": "contexts_deduplicated",
            "dropped": "contexts_dropped", "dropped_reasons": "dropped_reasons", "estimated_tokens": "estimated_tokens",
        },
        "llm": {
            "provider": "llm_provider", "model": "llm_model", "actual_input_tokens": "actual_input_tokens",
            "actual_output_tokens": "actual_output_tokens", "actual_total_tokens": "actual_total_tokens",
        },
    }
    flat = ["request_id", "session_id", "user_id", "total_latency_ms"]
    cols = [F.col(c) for c in flat if c in metrics.columns]
    cols += [part(g).alias(n) for n, g in groups.items() if any(c in metrics.columns for c in g.values())]
    cols += [F.col(c) for c in ("has_error", "error_type") if c in metrics.columns]
    return metrics.select(*cols)


def method_label(found: Column, reranked: Column) -> Column:
    return F.when(found & reranked, "hybrid_rerank").when(found, "hybrid").otherwise("none")


def to_log(results: DataFrame, metrics: DataFrame, reranking: bool = True) -> DataFrame:
    """Retrieval log row per request from its results and metrics; both keyed by ``query_id``.

    What ``metrics`` does not carry has its default: no session and request, latencies of 0, empty metadata.
    """
    def carried(name: str, default: Column) -> Column:
        return (F.coalesce(F.col(name), default) if name in metrics.columns else default).alias(name)

    ids = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("_r")
    )
    out = metrics.join(ids, "query_id", "left")
    found = F.coalesce(F.size("_r"), F.lit(0)) > 0
    return out.select(
        "query_id", "user_id", "text", F.coalesce(F.col("_r.chunk_id"), F.array().cast("array<string>")).alias("chunk_ids"),
        method_label(found, F.lit(reranking)).alias("retrieval_method"), "candidate_count",
        F.coalesce(F.size("_r"), F.lit(0)).alias("top_k"), (found & F.lit(reranking)).alias("reranking_enabled"),
        "total_latency_ms", "created_at", carried("session_id", F.lit(None).cast("string")), carried("request_id", F.lit(None).cast("string")),
        *[carried(f"{stage}_latency_ms", F.lit(0.0)) for stage in ("retrieval", "reranking", "llm")], carried("metadata", F.lit("{}")),
    )


# --- redaction of payloads -----------------------------------------------------------------------
def _sensitive(key: Column) -> Column:
    return F.lower(key).rlike(tx.SENSITIVE_PATTERN)


def redact_struct(df: DataFrame, column: str) -> DataFrame:
    """Replace the values of sensitive keys inside a nested column, from its schema alone.

    A map whose values are no text becomes a map of texts: the mark where the key is sensitive, otherwise the value's JSON.
    """

    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            fields = [
                (F.lit(V.REDACTED) if tx.is_sensitive(f.name) else walk(c[f.name], f.dataType)).alias(f.name)
                for f in t.fields
            ]
            return F.when(c.isNotNull(), F.struct(*fields))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType))
        if isinstance(t, T.MapType):
            inner = t.valueType
            if isinstance(inner, T.StringType):
                return F.transform_values(c, lambda k, v: F.when(_sensitive(k), F.lit(V.REDACTED)).otherwise(v))
            nested = isinstance(inner, (T.StructType, T.ArrayType, T.MapType))
            text = (lambda v: F.to_json(walk(v, inner))) if nested else (lambda v: v.cast("string"))
            return F.transform_values(c, lambda k, v: F.when(_sensitive(k), F.lit(V.REDACTED)).otherwise(text(v)))
        return c

    return df.withColumn(column, walk(F.col(column), df.schema[column].dataType))


def _sanitized(value):
    """A parsed payload without the values of sensitive keys, at any depth; a stack of its own, no recursion."""
    top = [value]
    todo = [top]
    while todo:
        held = todo.pop()
        for key, item in list(held.items() if isinstance(held, dict) else enumerate(held)):
            if isinstance(held, dict) and any(word in key.lower() for word in V.SENSITIVE_KEYS):
                held[key] = V.REDACTED
            elif isinstance(item, (dict, list)):
                todo.append(item)
    return top[0]


@F.pandas_udf(T.StringType())
def _redact_text(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(_sanitized(json.loads(text)), ensure_ascii=False)
        except (ValueError, RecursionError):
            # What cannot be read cannot be told to be harmless.
            return V.REDACTED

    return texts.map(one)


def redact_text(text: str | Column) -> Column:
    """Redacted copy of JSON text of any depth. Texts that hold no sensitive word and no escaped one never reach Python
    and stay as they are; one that does and is no JSON is replaced by the mark."""
    c = tx.as_col(text)
    risky = _sensitive(c) | F.contains(c, F.lit("\\u"))
    return F.when(risky, _redact_text(F.when(risky, c))).otherwise(c)


def redact_json(text: str | Column) -> Column:
    """Redacted copy of a JSON object given as text: a map of the raw values, keys sorted. Nested values are redacted, too."""
    c = tx.as_col(text)
    nested = c.rlike(r"(?s)^.+[\[{]")
    m = F.from_json(F.when(nested, redact_text(F.when(nested, c))).otherwise(c), "map<string,string>")
    return F.transform_values(m, lambda k, v: F.when(_sensitive(k), F.lit(V.REDACTED)).otherwise(v))


# --- paging --------------------------------------------------------------------------------------
def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def audit_log(
    logs: DataFrame, user: str | None = None, method: str | None = None, skip: int = 0, limit: int = 50
) -> tuple[DataFrame, DataFrame]:
    """A page of the log, newest first, and the total number of rows under the same filter."""
    rows = logs if user is None else logs.where(F.col("user_id") == user)
    if method:
        rows = rows.where(F.col("retrieval_method") == method)
    return page(rows, [F.desc("created_at"), F.col("log_id")], skip, limit), rows.agg(F.count(F.lit(1)).alias("total"))


def logs_of(logs: DataFrame, by: str, value, n: int = 50) -> DataFrame:
    return recent(logs.where(F.col(by) == value), [F.desc("created_at"), F.col("log_id")], n)
