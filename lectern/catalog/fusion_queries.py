"""Context fusion, context building, prompts and the whole answer plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import inputs as I
from lectern.catalog import memory_queries as MQ
from lectern.catalog import sqltext as S
from lectern.catalog.registry import query
from lectern.config import Budget
from lectern.functions import fixed_values as V
from lectern.operators import fusion as K
from lectern.operators import memory as M
from lectern.operators import prompts as L
from lectern.operators import retrieval as R
from lectern.operators import routing as RT
from lectern.operators.sizing import run_dir
from lectern.plans import answer as A
from lectern.sources.tables import read_table

# All documents of a tenant compete for one context; the kind of source alternates.
SOURCES = ["rag", "cag", "mag", "conversation"]
BUDGET = Budget(total=9000, rag=4000, cag=None, mag=1000, conversation=1000, min_score=0.1)
CTX = """cx AS (SELECT source AS query_id, source AS caller_id, ['rag', 'cag', 'mag', 'conversation'][doc_id % 4 + 1] AS source, doc_id::VARCHAR AS source_id,
    (3 + doc_id % 4)::INT AS priority, CASE doc_id % 4 WHEN 1 THEN NULL WHEN 3 THEN doc_id::DOUBLE ELSE (doc_id * 37 % 100) / 100.0::DOUBLE END AS score, text AS content,
    CASE WHEN doc_id % 17 = 0 THEN 'other' WHEN doc_id % 4 = 2 THEN source END AS owner_id, CASE WHEN doc_id % 4 = 3 THEN doc_id END AS turn_index FROM documents)"""


def limits(b: Budget) -> str:
    return " ".join(f"WHEN '{s}' THEN {b.of(s) if b.of(s) is not None else 1000000000}" for s in SOURCES)


def fused(b: Budget, src: str = "cx") -> str:
    """CTEs up to ``dec``: the greedy budget is a recursion along the order of each query."""
    return f"""t0 AS (SELECT *, {S.est_tokens('content')} AS tokens, coalesce(score, -1.0) AS sc, CASE source {limits(b)} END AS lim,
  trim(regexp_replace(lower(content), '{S.WS_RUN}', ' ', 'g')) AS dk FROM {src}),
t1 AS (SELECT *, CASE WHEN owner_id IS NOT NULL AND owner_id <> caller_id::VARCHAR THEN 'security_user_mismatch' END AS r1 FROM t0),
t2 AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN row_number() OVER (PARTITION BY query_id, r1 IS NULL, dk ORDER BY priority, sc DESC, source_id) > 1 THEN 'duplicate'
  END AS r2 FROM t1),
t3 AS (SELECT * EXCLUDE (dk), CASE WHEN r2 IS NOT NULL THEN r2 WHEN {b.min_score} > 0 AND source <> 'conversation' AND score < {b.min_score} THEN 'below_relevance_threshold' END AS r3 FROM t2),
ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, sc DESC, source_id) AS rn FROM t3 WHERE r3 IS NULL),
walk AS (SELECT query_id, 0::BIGINT AS rn, 0 AS g, 0 AS rag, 0 AS cag, 0 AS mag, 0 AS conv, NULL::VARCHAR AS reason FROM (SELECT DISTINCT query_id FROM ord)
  UNION ALL SELECT query_id, rn, CASE WHEN reason IS NULL THEN g + tokens ELSE g END, CASE WHEN reason IS NULL AND source = 'rag' THEN rag + tokens ELSE rag END,
    CASE WHEN reason IS NULL AND source = 'cag' THEN cag + tokens ELSE cag END, CASE WHEN reason IS NULL AND source = 'mag' THEN mag + tokens ELSE mag END,
    CASE WHEN reason IS NULL AND source = 'conversation' THEN conv + tokens ELSE conv END, reason
  FROM (SELECT w.query_id, o.rn, w.g, w.rag, w.cag, w.mag, w.conv, o.tokens, o.source,
      CASE WHEN CASE o.source WHEN 'rag' THEN w.rag WHEN 'cag' THEN w.cag WHEN 'mag' THEN w.mag ELSE w.conv END + o.tokens > o.lim THEN 'source_token_budget'
        WHEN w.g + o.tokens > {b.total} THEN 'token_budget' END AS reason
    FROM walk w JOIN ord o ON o.query_id = w.query_id AND o.rn = w.rn + 1)),
dec AS (SELECT t.query_id, t.source, t.source_id, t.content, t.score, t.turn_index, t.tokens, t.priority, coalesce(t.r3, w.reason) AS reason,
    coalesce(t.r3, w.reason) IS NULL AS accepted, o.rn
  FROM t3 t LEFT JOIN ord o USING (query_id, source, source_id) LEFT JOIN walk w ON w.query_id = o.query_id AND w.rn = o.rn)"""


def contexts(spark, sf):
    d = read_table(spark, sf, "documents")
    m = F.col("doc_id") % 4
    kind = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (m + 1).cast("int"))
    score = F.when(m == 1, None).when(m == 3, F.col("doc_id").cast("double")).otherwise((F.col("doc_id") * 37 % 100) / 100.0)
    owner = F.when(F.col("doc_id") % 17 == 0, "other").when(m == 2, F.col("source"))
    return d.select(
        F.col("source").alias("query_id"), F.col("source").alias("caller_id"), kind.alias("source"),
        F.col("doc_id").cast("string").alias("source_id"), (3 + m).cast("int").alias("priority"), score.alias("score"),
        F.col("text").alias("content"), owner.alias("owner_id"), F.when(m == 3, F.col("doc_id").cast("int")).alias("turn_index"),
    )


@query("fused_contexts", f"WITH RECURSIVE {CTX}, {fused(BUDGET)} SELECT query_id, source, source_id, tokens::BIGINT AS tokens, accepted, reason FROM dec")
def fused_contexts(spark, sf):
    return K.fuse(contexts(spark, sf), BUDGET).select(
        "query_id", "source", "source_id", F.col("estimated_tokens").cast("bigint").alias("tokens"), "accepted", "reason"
    )


@query("fusion_metrics", f"""WITH RECURSIVE {CTX}, {fused(BUDGET)} SELECT query_id, count(*) AS total_items, count_if(reason = 'duplicate') AS deduplicated_items,
  count_if(NOT accepted) AS dropped_items, coalesce(sum(CASE WHEN accepted THEN tokens END), 0)::BIGINT AS estimated_tokens,
  count_if(accepted AND source <> 'conversation') AS context_count, coalesce(sum(CASE WHEN accepted AND source <> 'conversation' THEN length(content) END), 0)::BIGINT AS context_chars,
  concat_ws(',', CASE WHEN bool_or(accepted AND source = 'rag') THEN 'rag' END, CASE WHEN bool_or(accepted AND source = 'cag') THEN 'cag' END,
    CASE WHEN bool_or(accepted AND source = 'mag') THEN 'mag' END, CASE WHEN bool_or(accepted AND source = 'conversation') THEN 'conversation' END) AS sources
FROM dec GROUP BY query_id""")
def fusion_metrics(spark, sf):
    m = K.fusion_metrics(K.fuse(contexts(spark, sf), BUDGET), BUDGET)
    return m.select(
        "query_id", "total_items", "deduplicated_items", "dropped_items", "estimated_tokens", "context_count", "context_chars",
        F.array_join("selected_sources", ",").alias("sources"),
    )


@query("dropped_reasons", f"WITH RECURSIVE {CTX}, {fused(BUDGET)} SELECT query_id, reason, count(*) AS n FROM dec WHERE NOT accepted GROUP BY ALL")
def dropped_reasons(spark, sf):
    return K.dropped_reasons(K.fuse(contexts(spark, sf), BUDGET))


@query("fused_bundles", f"""WITH RECURSIVE {CTX}, {fused(BUDGET)} SELECT query_id, string_agg(CASE WHEN source = 'rag' THEN source_id END, ',' ORDER BY rn) AS rag,
  string_agg(CASE WHEN source = 'cag' THEN source_id END, ',' ORDER BY rn) AS cag, string_agg(CASE WHEN source = 'mag' THEN source_id END, ',' ORDER BY rn) AS mag,
  string_agg(CASE WHEN source = 'conversation' THEN source_id END, ',' ORDER BY turn_index) AS conversation FROM dec WHERE accepted GROUP BY query_id""")
def fused_bundles(spark, sf):
    b = K.bundle(K.fuse(contexts(spark, sf), BUDGET))
    ids = [F.when(F.size(s) > 0, F.array_join(F.col(s)["source_id"], ",")).alias(s) for s in SOURCES]
    return b.select("query_id", *ids)


# --- the four real sources -----------------------------------------------------------------------
OWN = "oc AS (SELECT *, user_id AS scope FROM chunks), oq AS (SELECT *, user_id AS scope FROM qs)"
NORMALIZED = f"""{S.CHUNKS}, {MQ.FOUND}, {MQ.RANKED.replace(S.QUERIES + ',', '')}, {OWN}, {S.bm25('oc', 'oq', 5)},
hist AS (SELECT conv_id AS query_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations WHERE turn < 10),
nx AS (
  SELECT b.query_id, q.user_id AS caller_id, 'rag' AS source, b.chunk_id AS source_id, 3 AS priority, b.score, c.content, c.user_id AS owner_id, NULL::INT AS turn_index
    FROM bm25 b JOIN chunks c USING (chunk_id) JOIN qs q USING (query_id)
  UNION ALL SELECT query_id, caller_id, 'cag', 'cag_' || replace(key, ':', '_'), 4, NULL, cut, owner_id, NULL FROM found
  UNION ALL SELECT m.query_id, q.user_id, 'mag', memory_id, 5, score, content, m.user_id, NULL FROM mrank m JOIN qs q USING (query_id)
  UNION ALL SELECT h.query_id, q.user_id, 'conversation', 'conv_' || i || '_' || role, 6, i::DOUBLE, h.text, NULL, i::INT FROM hist h JOIN qs q USING (query_id))"""


def normalized(spark, sf):
    q = I.queries(spark, sf)
    c = I.chunks(spark, sf)
    rag = R.bm25_search(q, c).join(c.select("chunk_id", "content", F.col("user_id").alias("owner_id")), "chunk_id")
    cag = MQ.C.cache_search(q, MQ.domains(spark, sf), MQ.entries(spark, sf), I.now())
    mag = M.memory_search(q, MQ.memories(spark, sf), I.now()).withColumn("owner_id", F.col("user_id"))
    hist = RT.history(I.messages(spark, sf).drop("text").withColumnRenamed("plain", "text"))
    talk = hist.select(F.col("session_id").alias("query_id"), "history")
    return K.normalize_contexts(q.select("query_id", F.col("user_id").alias("caller_id")), rag, cag, mag, talk)


@query("normalized_contexts", f"WITH {NORMALIZED} SELECT query_id, source, source_id, priority, round(score, 6) AS score, owner_id, turn_index, md5(content) AS digest FROM nx WHERE {S.trim('content')} <> ''")
def normalized_contexts(spark, sf):
    return normalized(spark, sf).select(
        "query_id", "source", "source_id", "priority", F.round("score", 6).alias("score"), "owner_id", "turn_index",
        F.md5("content").alias("digest"),
    )


# --- context text and prompts --------------------------------------------------------------------
# The chunks of each document in their order are one result list; long documents exceed the context.
BLOCKS = f"""{S.CHUNKS}, res AS (SELECT doc_id AS query_id, chunk_id, doc_id, chunk_index, page_number, content, CASE WHEN doc_id % 3 > 0 THEN filename END AS filename,
  chunk_index + 1 AS rank, 1.0 / (1 + chunk_index) AS score FROM chunks),
blk AS (SELECT *, '[Source ' || rank || ']' || chr(10) || 'Document: ' || coalesce(filename, '{V.UNKNOWN_FILE}') || chr(10) || 'Page: ' || page_number || chr(10) || 'Content:' || chr(10) || content || chr(10) AS block FROM res),
cum AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM blk),
kept AS (SELECT * FROM cum WHERE rank = 1 OR used <= 12000)"""


def document_results(spark, sf):
    return I.chunks(spark, sf).select(
        F.col("doc_id").alias("query_id"), "chunk_id", "doc_id", "chunk_index", "page_number", "content",
        F.when(F.col("doc_id") % 3 > 0, F.col("filename")).alias("filename"), (F.col("chunk_index") + 1).alias("rank"),
        (1.0 / (1 + F.col("chunk_index"))).alias("score"),
    )


@query("context_blocks", f"WITH {BLOCKS} SELECT query_id, count(*) AS blocks, md5(string_agg(block, chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM kept GROUP BY ALL")
def context_blocks(spark, sf):
    r = document_results(spark, sf)
    out = L.build_context(r.select("query_id").distinct(), r)
    return out.select("query_id", F.size("chunk_ids").cast("bigint").alias("blocks"), F.md5("context").alias("digest"))


@query("citations", f"""WITH {BLOCKS} SELECT query_id, rank, doc_id, coalesce(filename, '{V.UNKNOWN_FILE}') AS filename, page_number::BIGINT AS page_number, chunk_index::BIGINT AS chunk_index,
  CASE WHEN length(content) > 250 THEN substring(content, 1, 250) || '...' ELSE content END AS preview, round(score, 4) AS relevance_score FROM kept""")
def citations(spark, sf):
    return L.citations(document_results(spark, sf)).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "filename", F.col("page_number").cast("bigint").alias("page_number"),
        F.col("chunk_index").cast("bigint").alias("chunk_index"), "preview", "relevance_score",
    )


SYSTEM = "Answer from the excerpts."
_sec = lambda h, b: f"'{h}' || chr(10) || '{V.RULER}' || chr(10) || {b} || chr(10) || '{V.RULER}' || chr(10) || chr(10)"
PROMPTS = f"""{MQ.FOUND}, {MQ.RANKED.replace(S.QUERIES + ',', '')},
h AS (SELECT conv_id AS query_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE turn < 10) WHERE r <= 6 GROUP BY conv_id),
c AS (SELECT query_id, string_agg('[Cached Knowledge ' || n || '] (ID: cag_' || replace(key, ':', '_') || ', Version: 1)' || chr(10) || cut, chr(10) || chr(10) ORDER BY n) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS n FROM found) GROUP BY query_id),
m AS (SELECT query_id, string_agg('[User Memory ' || rank || '] (Type: ' || memory_type || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS x FROM mrank GROUP BY query_id),
pr AS (SELECT q.query_id, coalesce('{V.HISTORY_HEADER}' || chr(10) || h.x || chr(10) || chr(10), '') || {_sec(V.DOCUMENT_HEADER, f"'{V.NO_CONTEXT}'")}
  || coalesce({_sec(V.CACHED_HEADER, 'c.x')}, '') || coalesce({_sec(V.MEMORY_HEADER, 'm.x')}, '') || '{V.QUESTION_LABEL}' || q.text || chr(10) || chr(10) || '{V.ANSWER_LABEL}' AS prompt
  FROM qs q LEFT JOIN h USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN m USING (query_id))"""


@query("prompts", f"WITH {PROMPTS} SELECT query_id, md5(prompt) AS digest, greatest(1, ceil((length(prompt) + {len(SYSTEM)}) / 4.0))::BIGINT AS tokens FROM pr")
def prompts(spark, sf):
    q = I.queries(spark, sf)
    cag = MQ.C.cache_search(q, MQ.domains(spark, sf), MQ.entries(spark, sf), I.now())
    mag = M.memory_search(q, MQ.memories(spark, sf), I.now())
    hist = RT.history(I.messages(spark, sf).drop("text").withColumnRenamed("plain", "text"))
    packed = A.pack(q, hist.withColumnRenamed("session_id", "query_id"), cag, mag)
    p = L.build_prompts(packed.withColumn("context", F.lit(V.NO_CONTEXT)))
    tokens = L.prompt_tokens(L.system_prompt(SYSTEM), "prompt").cast("bigint")
    return p.select("query_id", F.md5("prompt").alias("digest"), tokens.alias("tokens"))


# --- the whole plan ------------------------------------------------------------------------------
def stored_chunks(spark, sf):
    """Chunks with the vector of their document, cut once and stored as a service keeps them."""
    e = I.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    path = run_dir(spark, "chunk-table")
    I.chunks(spark, sf).drop("metadata").join(e, "doc_id", "left").write.parquet(path)
    return spark.read.parquet(path)


def questions(spark, sf):
    e = I.vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding")
    return I.queries(spark, sf).withColumn("session_id", F.col("query_id")).join(e, "query_id", "left")


def told(spark, sf):
    return I.messages(spark, sf).drop("text").withColumnRenamed("plain", "text")


@query("answer_contexts")
def answer_contexts(spark, sf):
    """Every question over all four sources: hybrid retrieval among the owner's chunks, fusion, prompt and citations."""
    return A.answer_contexts(
        questions(spark, sf), stored_chunks(spark, sf), MQ.memories(spark, sf), MQ.domains(spark, sf), MQ.entries(spark, sf),
        told(spark, sf), I.now(),
    )


@query("answer_citations", f"""WITH {S.QUERIES}
SELECT query_id, true AS only_completed, true AS only_named FROM qs""")
def answer_citations(spark, sf):
    """Citations of the whole plan where questions name documents: none but completed and named ones are cited."""
    done = I.docs(spark, sf).select("doc_id").join(
        spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left"
    ).select("doc_id", F.when(F.coalesce("quality", F.lit(1)) == 1, "COMPLETED").otherwise("FAILED").alias("status"))
    q, i = questions(spark, sf), F.col("query_id")
    ids = F.when(F.col("user_id") == "src0", F.array().cast("array<bigint>")).otherwise(F.array(i, i + 7, i * 5 + 100))
    q = q.withColumn("document_ids", ids)
    a = A.answer_contexts(
        q, stored_chunks(spark, sf), MQ.memories(spark, sf), MQ.domains(spark, sf), MQ.entries(spark, sf), told(spark, sf), I.now(),
        shared=True, documents=done,
    )
    cited = a.select("query_id", F.explode("citations.doc_id").alias("doc_id")).join(done, "doc_id").join(q.select("query_id", "document_ids"), "query_id")
    wrong = cited.groupBy("query_id").agg(
        F.count_if(F.col("status") != "COMPLETED").alias("unfinished"),
        F.count_if((F.size("document_ids") > 0) & ~F.array_contains("document_ids", F.col("doc_id"))).alias("foreign"),
    )
    return a.select("query_id").join(wrong, "query_id", "left").select(
        "query_id", (F.coalesce("unfinished", F.lit(0)) == 0).alias("only_completed"), (F.coalesce("foreign", F.lit(0)) == 0).alias("only_named")
    )
