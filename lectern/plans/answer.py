"""From questions to prompts: guard, rewrite, route, retrieve, fuse, check, assemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Settings
from lectern.operators import cache as C
from lectern.operators import filters as FL
from lectern.operators import fusion as K
from lectern.operators import guard as G
from lectern.operators import memory as M
from lectern.operators import prompts as L
from lectern.operators import retrieval as R
from lectern.operators import routing as RT
from lectern.operators.sizing import cut_lineage


def pack(queries: DataFrame, history: DataFrame, cached: DataFrame, memories: DataFrame) -> DataFrame:
    """Queries with their history, cached texts and memories as arrays for the prompt.

    All three are short: messages are limited per session, memories per query, and cached texts to the
    keys a query resolves.
    """
    c = cached.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "cache_id", "version", "content"))).alias("cached")
    )
    m = memories.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "memory_type", "content"))).alias("memories")
    )
    h = history.select("query_id", "history")
    return queries.join(h, "query_id", "left").join(c, "query_id", "left").join(m, "query_id", "left")


def answer_contexts(
    queries: DataFrame, chunks: DataFrame, memories: DataFrame, domains: DataFrame, entries: DataFrame,
    messages: DataFrame, now: Column, cfg: Settings = DEFAULTS, scorer=R.overlap_scorer, shared: bool = False,
    documents: DataFrame | None = None,
) -> DataFrame:
    """One row per question ``(query_id, user_id, session_id, text[, embedding][, document_ids])`` with its decision,
    plan, prompt, cited chunks and citations.

    With ``documents`` (``doc_id, status``) only chunks of completed ones are searched; a question with ``document_ids``
    searches these alone. ``chunks`` is read for the search and for the few hits: give a stored table, not a plan that cuts texts.

    Blocked questions stop before retrieval, and a source is read only for the questions routed to it. The
    retrieval check sees chunks, cached texts and memories; what it does not allow goes no further: contexts of
    questions it allowed alone are fused, cited and put into prompts. The document text of the prompt comes from the
    retrieved chunks; the budgeted bundle decides on cached texts, memories and turns. Cache and memory
    see the question as asked, retrieval sees it rewritten. Without embeddings retrieval is BM25 alone.
    """
    guarded = G.guard_input(queries)
    hist = RT.history(messages, cfg.history_messages)
    asked = guarded.where(F.col("decision") != "BLOCK").join(hist, "session_id", "left")
    asked = asked.withColumn("text", G.safe_text())
    signals = RT.query_signals(asked, has_history=F.coalesce(F.size("history"), F.lit(0)) > 0)
    # Each stage below is read by several later ones; its rows are few per question, so it is written once.
    plan = cut_lineage(RT.plan(signals))

    to_rag = plan.where("use_rag").withColumn("text", RT.rewrite("text", F.col("history.content")))
    if documents is not None:
        chunks = chunks.join(FL.completed(documents).select("doc_id"), "doc_id", "left_semi")
    asked_, seen = (FL.subset_scopes if "document_ids" in queries.columns else FL.scope)(to_rag, chunks, shared)
    if "embedding" in queries.columns and "embedding" in chunks.columns:
        hits = R.hybrid_search(asked_, seen, cfg.top_k, cfg.alpha, cfg.candidates, cfg.threshold, scoped=True)
    else:
        hits = R.bm25_search(asked_, seen, cfg.top_k, scoped=True)
    # The few hits meet the chunk table once; reranking, fusion, checks and citations read them from there.
    hits = cut_lineage(hits.select("query_id", "chunk_id", "rank", "score"))
    details = chunks.select("chunk_id", "doc_id", "filename", "page_number", "chunk_index", "content", F.col("user_id").alias("owner_id"))
    texts = hits.join(details, "chunk_id").join(to_rag.select("query_id", "text"), "query_id")
    ranked = R.rerank(texts, scorer, cfg.top_k)
    found = cut_lineage(ranked.select(
        "query_id", "chunk_id", "score", F.col("final_rank").alias("rank"), "doc_id", "filename", "page_number", "chunk_index", "content", "owner_id",
    ))
    plain = plan.select("query_id", "user_id", "text", "use_cag", "use_mag")
    cached = cut_lineage(C.cache_search(plain.where("use_cag"), domains, entries, now, cfg.cache_chars))
    remembered = cut_lineage(M.memory_search(plain.where("use_mag"), memories, now, cfg.memory_top_k))

    callers = plan.select("query_id", F.col("user_id").alias("caller_id"))

    def shown(df: DataFrame, source: int, place: str, owner: str) -> DataFrame:
        return df.select("query_id", F.lit(source).alias("_source"), F.col(place).cast("long").alias("_place"), "content", F.col(owner).alias("user_id"))

    every = shown(found, 0, "rank", "owner_id").unionByName(shown(cached, 1, "seq", "owner_id")).unionByName(shown(remembered, 2, "rank", "user_id"))
    every = every.withColumn("idx", F.row_number().over(Window.partitionBy("query_id").orderBy("_source", "_place")) - 1)
    checked = cut_lineage(
        G.guard_retrieval(every.join(callers, "query_id")).select("query_id", F.col("decision").alias("retrieval_decision"))
    )
    allowed, stopped = (checked.where(c).select("query_id") for c in ("retrieval_decision = 'ALLOW'", "retrieval_decision <> 'ALLOW'"))
    found, cached, remembered = (df.join(allowed, "query_id", "left_semi") for df in (found, cached, remembered))
    going = plan.join(stopped, "query_id", "left_anti")

    contexts = K.normalize_contexts(
        going.select("query_id", F.col("user_id").alias("caller_id")), found, cached, remembered.withColumn("owner_id", F.col("user_id")),
        going.where("history IS NOT NULL"),
    )
    decisions = cut_lineage(K.fuse(contexts, cfg.budget))
    kept = decisions.where("accepted").select("query_id", "source", "source_id")

    def surviving(df: DataFrame, source: str, key: str) -> DataFrame:
        ids = kept.where(F.col("source") == source).select("query_id", F.col("source_id").alias(key))
        return df.join(ids, ["query_id", key], "left_semi")

    context = L.build_context(going, found, cfg.context_chars)
    turns = kept.where(F.col("source") == "conversation").groupBy("query_id").agg(F.collect_list("source_id").alias("_turns"))
    talk = going.select("query_id", "history").join(turns, "query_id").select(
        "query_id",
        F.filter(
            F.transform("history", lambda h, i: F.struct(F.concat_ws("_", F.lit("conv"), i.cast("string"), h["role"]).alias("id"), h["role"].alias("role"), h["content"].alias("content"))),
            lambda h: F.array_contains("_turns", h["id"]),
        ).alias("history"),
    )
    packed = pack(
        going.select("query_id", "text").join(context, "query_id"), talk, surviving(cached, "cag", "cache_id"),
        surviving(remembered, "mag", "memory_id"),
    )
    prompts = L.build_prompts(packed, cfg.prompt_turns).select("query_id", "prompt", "chunk_ids")
    summary = plan.select("query_id", "selected_sources", "confidence", F.col("reason").alias("plan_reason"))
    out = guarded.select("query_id", "user_id", F.col("decision").alias("input_decision"))
    out = out.join(summary, "query_id", "left").join(checked, "query_id", "left").join(prompts, "query_id", "left")
    cited = L.citations(found).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "filename", "page_number", "chunk_index", "preview", "relevance_score"))).alias("citations")
    )
    out = out.join(cited, "query_id", "left")
    return out.select(
        "query_id", "user_id", "input_decision", "selected_sources", "confidence", "plan_reason",
        F.coalesce("retrieval_decision", F.when(F.col("input_decision") != "BLOCK", "ALLOW")).alias("retrieval_decision"),
        "chunk_ids", "prompt", "citations",
    )
