"""Filters, joins, retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import inputs as I
from lectern.catalog import sqltext as S
from lectern.catalog.registry import query
from lectern.operators import filters as FL
from lectern.operators import postings as P
from lectern.operators import retrieval as R
from lectern.operators import vector_search as V
from lectern.operators.sizing import run_dir
from lectern.sources.tables import read_table

OWN = f"""{S.CHUNKS}, {S.QUERIES},
oc AS (SELECT *, user_id AS scope FROM chunks), oq AS (SELECT *, user_id AS scope FROM qs)"""
ALL = f"""{S.CHUNKS}, {S.QUERIES},
oc AS (SELECT *, '*' AS scope FROM chunks), oq AS (SELECT *, '*' AS scope FROM qs)"""
UNITS_OWN = f"{S.UNITS}, oc AS (SELECT *, user_id AS scope FROM units), oq AS (SELECT *, user_id AS scope FROM uq)"
UNITS_ALL = f"{S.UNITS}, oc AS (SELECT *, '*' AS scope FROM units), oq AS (SELECT *, '*' AS scope FROM uq)"
HYBRID = f"""{S.vector('oc', 'oq', 20, 0.0)}, {S.bm25('oc', 'oq', 20)},
mixed AS (SELECT query_id, chunk_id, coalesce(v.score, 0.0) AS vs, coalesce(b.score, 0.0) AS bs,
    round(0.7 * coalesce(v.score, 0.0) + (1.0 - 0.7) * coalesce(b.score, 0.0), 9) AS score
  FROM vec v FULL JOIN bm25 b USING (query_id, chunk_id)),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM mixed
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5)"""
OVERLAP = f"""CASE WHEN len(list_distinct({S.tokens('q.text')})) > 0 THEN
  len(list_intersect(list_distinct({S.tokens('q.text')}), list_distinct({S.tokens('c.content')})))
  / len(list_distinct({S.tokens('q.text')}))::DOUBLE ELSE 0.0 END"""


def ranked(df):
    return df.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


RANKED = "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM "


@query("bm25_index_terms", f"""WITH {OWN}, {S.bm25('oc', 'oq', 5)}
SELECT d.scope, count(*) AS terms, sum(d.df)::BIGINT AS postings, max(s.n) AS n_chunks, round(max(s.avgdl), 6) AS avgdl,
  round(sum(greatest(0.0, ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1.0))), 4) AS idf_sum
FROM bm25_df d JOIN bm25_stat s USING (scope) GROUP BY d.scope""")
def bm25_index_terms(spark, sf):
    _, c = FL.scope(I.queries(spark, sf), I.chunks(spark, sf))
    _, terms, stats = R.bm25_index(c)
    return terms.join(stats, "scope").groupBy("scope").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.max("n_chunks").alias("n_chunks"),
        F.round(F.max("avgdl"), 6).alias("avgdl"), F.round(F.sum(R.idf("n_chunks", "df")), 4).alias("idf_sum"),
    )


@query("bm25_scores", f"""WITH {OWN}, {S.bm25('oc', 'oq', 5)}
SELECT query_id, count(*) AS matched, round(sum(raw), 4) AS total, round(max(raw), 6) AS best FROM bm25_raw GROUP BY ALL""")
def bm25_scores(spark, sf):
    q, c = FL.scope(I.queries(spark, sf), I.chunks(spark, sf))
    return R.bm25_scores(q, c).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("matched"), F.round(F.sum("raw_score"), 4).alias("total"),
        F.round(F.max("raw_score"), 6).alias("best"),
    )


@query("bm25_topk", f"WITH {OWN}, {S.bm25('oc', 'oq', 5)} {RANKED} bm25")
def bm25_topk(spark, sf):
    return ranked(R.bm25_search(I.queries(spark, sf), I.chunks(spark, sf)))


@query("bm25_topk_shared", f"WITH {ALL}, {S.bm25('oc', 'oq', 20)} {RANKED} bm25")
def bm25_topk_shared(spark, sf):
    return ranked(R.bm25_search(I.queries(spark, sf), I.chunks(spark, sf), 20, shared=True))


@query("bm25_topk_stored_index", f"WITH {OWN}, {S.bm25('oc', 'oq', 5)} {RANKED} bm25")
def bm25_topk_stored_index(spark, sf):
    """The same from index tables written first, as a service would keep them."""
    from lectern.sources.tables import read_index, write_index

    q, c = FL.scope(I.queries(spark, sf), I.chunks(spark, sf))
    path = run_dir(spark, "index")
    write_index(R.bm25_index(c), path)
    return ranked(R.bm25_search(q, None, index=read_index(spark, path)))


@query("bm25_topk_pruned", f"WITH {ALL}, {S.bm25('oc', 'oq', 5)} {RANKED} bm25")
def bm25_topk_pruned(spark, sf):
    """Through stored postings with upper bounds: the blocks that can matter are read, the result is exact."""
    q, c = FL.scope(I.queries(spark, sf), I.chunks(spark, sf), True)
    path = run_dir(spark, "postings")
    P.build(c, path)
    return ranked(P.search(spark, q, path))


@query("bm25_topk_pruned_owners", f"WITH {OWN}, {S.bm25('oc', 'oq', 5)} {RANKED} bm25")
def bm25_topk_pruned_owners(spark, sf):
    q, c = FL.scope(I.queries(spark, sf), I.chunks(spark, sf))
    path = run_dir(spark, "postings")
    P.build(c, path)
    return ranked(P.search(spark, q, path))


@query("bm25_blocks_read", f"""WITH {ALL}, {S.bm25('oc', 'oq', 5)}
SELECT count(*) AS queries, true AS fewer_read FROM (SELECT DISTINCT query_id FROM bm25_raw)""")
def bm25_blocks_read(spark, sf):
    """Over all queries, fewer blocks are read than their terms have."""
    q, c = FL.scope(I.queries(spark, sf), I.chunks(spark, sf), True)
    path = run_dir(spark, "postings")
    P.build(c, path)
    return P.blocks_read(spark, q, path).agg(F.count(F.lit(1)).alias("queries"), (F.sum("opened") < F.sum("blocks")).alias("fewer_read"))


# Every query names three documents, or none, which searches all of them.
@query("bm25_topk_subset", f"""WITH {S.CHUNKS}, {S.QUERIES},
sub AS (SELECT query_id, text, CASE WHEN user_id = 'src0' THEN []::BIGINT[] ELSE [query_id, query_id + 7, query_id * 5 + 100] END AS ids FROM qs),
oq AS (SELECT query_id, text, array_to_string(ids, ',') AS scope, ids FROM sub),
oc AS (SELECT s.scope, c.chunk_id, c.content FROM (SELECT DISTINCT scope, ids FROM oq) s JOIN chunks c
  ON len(s.ids) = 0 OR list_contains(s.ids, c.doc_id)), {S.bm25('oc', 'oq', 5)} {RANKED} bm25""")
def bm25_topk_subset(spark, sf):
    q, one = I.queries(spark, sf), F.col("query_id")
    ids = F.when(F.col("user_id") == "src0", F.array().cast("array<bigint>")).otherwise(F.array(one, one + 7, one * 5 + 100))
    q, c = FL.subset_scopes(q.withColumn("document_ids", ids), I.chunks(spark, sf), shared=True)
    return ranked(R.bm25_search(q, c, scoped=True))


@query("vector_topk", f"WITH {UNITS_OWN}, {S.vector('oc', 'oq', 5, 0.0)} {RANKED} vec")
def vector_topk(spark, sf):
    return ranked(R.vector_search(I.vector_queries(spark, sf), I.units(spark, sf), threshold=0.0))


@query("vector_topk_shared", f"WITH {UNITS_ALL}, {S.vector('oc', 'oq', 20, 0.1)} {RANKED} vec")
def vector_topk_shared(spark, sf):
    return ranked(R.vector_search(I.vector_queries(spark, sf), I.units(spark, sf), 20, 0.1, shared=True))


@query("vector_neighbours_lsh")
def vector_neighbours_lsh(spark, sf):
    q, c = FL.scope(I.vector_queries(spark, sf).where("embedding IS NOT NULL"), I.units(spark, sf).where("embedding IS NOT NULL"), True)
    return ranked(R.lsh_search(q, c, threshold=0.1))


@query("vector_index_topk", f"WITH {UNITS_ALL}, {S.vector('oc', 'oq', 20, 0.1)} {RANKED} vec")
def vector_index_topk(spark, sf):
    """Through the stored index, with every cell probed: the exact result."""
    q, c = FL.scope(I.vector_queries(spark, sf), I.units(spark, sf), True)
    path = run_dir(spark, "vector-index")
    V.build_index(c, path)
    return ranked(V.index_search(spark, q, path, 20, 0.1, probes=V.MOST_CELLS))


@query("vector_index_recall", f"""WITH {UNITS_ALL}, {S.vector('oc', 'oq', 20, 0.0)}
SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS recall_reached, true AS fewer_scanned FROM vec""")
def vector_index_recall(spark, sf):
    """Of the true 20 nearest, at least 0.9 are found with the calibrated probes, and not all vectors are compared."""
    q, c = FL.scope(I.vector_queries(spark, sf), I.units(spark, sf), True)
    path = run_dir(spark, "vector-index")
    V.build_index(c, path)
    exact = V.vector_search(q, c, 20, 0.0, scoped=True).select("query_id", "chunk_id")
    found = V.index_search(spark, q, path, 20, 0.0).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return hits.join(V.scanned_share(spark, q, path), "query_id").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("n").alias("neighbours"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("recall_reached"),
        (F.sum("scanned") < F.sum("stored")).alias("fewer_scanned"),
    )


@query("vector_index_owners", f"WITH {UNITS_OWN}, {S.vector('oc', 'oq', 5, 0.0)} {RANKED} vec")
def vector_index_owners(spark, sf):
    """One index for all owners; a query sees its own rows only."""
    q, c = FL.scope(I.vector_queries(spark, sf), I.units(spark, sf))
    path = run_dir(spark, "vector-index")
    V.build_index(c, path)
    return ranked(V.index_search(spark, q, path, 5, 0.0, probes=V.MOST_CELLS))


@query("label_cosines", f"""SELECT a.vec_id, round({S.cosine('a.embedding', 'b.embedding')}, 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.label""")
def label_cosines(spark, sf):
    from lectern.functions.vectors import cosine

    v = I.vectors(spark, sf)
    b = v.select(F.col("vec_id").alias("label"), F.col("embedding").alias("other"))
    return v.join(b, "label").select("vec_id", F.round(cosine("embedding", "other"), 6).alias("score"))


@query("hybrid_topk", f"WITH {UNITS_OWN}, {HYBRID} SELECT query_id, chunk_id, rank, round(score, 6) AS score, round(vs, 4) AS vector_score, round(bs, 4) AS bm25_score FROM hybrid")
def hybrid_topk(spark, sf):
    h = R.hybrid_search(I.vector_queries(spark, sf), I.units(spark, sf), threshold=0.0)
    return h.select(
        "query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"),
        "vector_score", "bm25_score",
    )


@query("merged_scores", f"""WITH {UNITS_ALL}, {HYBRID} SELECT query_id, count(*) AS candidates, count_if(vs > 0 AND bs > 0) AS "both",
  round(sum(vs), 4) AS vector_sum, round(sum(bs), 4) AS bm25_sum FROM mixed GROUP BY ALL""")
def merged_scores(spark, sf):
    q, c = I.vector_queries(spark, sf), I.units(spark, sf)
    m = R.merge_scores(R.vector_search(q, c, 20, 0.0, shared=True), R.bm25_search(q, c, 20, shared=True))
    return m.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if((F.col("vector_score") > 0) & (F.col("bm25_score") > 0)).alias("both"),
        F.round(F.sum("vector_score"), 4).alias("vector_sum"), F.round(F.sum("bm25_score"), 4).alias("bm25_sum"),
    )


@query("rrf_fusion", f"""WITH {UNITS_ALL}, {HYBRID}, parts AS (
  SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS s FROM vec UNION ALL SELECT query_id, chunk_id, 0.5::DOUBLE / (60 + rank) FROM bm25)
SELECT query_id, chunk_id, round(sum(s), 8) AS score FROM parts GROUP BY ALL""")
def rrf_fusion(spark, sf):
    q, c = I.vector_queries(spark, sf), I.units(spark, sf)
    lists = [R.vector_search(q, c, 20, 0.0, shared=True), R.bm25_search(q, c, 20, shared=True)]
    return R.rrf(lists, weights=[1.0, 0.5]).withColumn("score", F.round("score", 8))


RERANKED = f"""cand AS (SELECT h.query_id, h.chunk_id, h.rank, h.score AS initial, {OVERLAP} AS s FROM hybrid h JOIN qs q USING (query_id) JOIN units c USING (chunk_id)),
counted AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM cand),
final AS (SELECT query_id, chunk_id, CASE WHEN n > 1 THEN s ELSE initial END AS score, CASE WHEN n > 1 THEN initial END AS initial_score,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 1 THEN round(s, 9) END DESC NULLS LAST, rank) AS final_rank FROM counted)"""


@query("retrieve_reranked", f"""WITH {UNITS_OWN}, {HYBRID}, {RERANKED}
SELECT query_id, chunk_id, final_rank, round(score, 6) AS score, round(initial_score, 6) AS initial_score FROM final""")
def retrieve_reranked(spark, sf):
    r = R.retrieve(I.vector_queries(spark, sf), I.units(spark, sf), threshold=0.0)
    return r.select(
        "query_id", "chunk_id", F.col("final_rank").cast("bigint").alias("final_rank"), F.round("score", 6).alias("score"),
        F.round("initial_score", 6).alias("initial_score"),
    )


@query("rerank_disabled", f"WITH {UNITS_OWN}, {HYBRID} SELECT query_id, chunk_id, rank AS final_rank FROM hybrid WHERE rank <= 3")
def rerank_disabled(spark, sf):
    r = R.retrieve(I.vector_queries(spark, sf), I.units(spark, sf), k=3, scorer=None, threshold=0.0)
    return r.select("query_id", "chunk_id", F.col("final_rank").cast("bigint").alias("final_rank"))


@query("retrieval_quality", f"""WITH {OWN}, {S.bm25('oc', 'oq', 5)}
SELECT query_id, round(max(score), 6) AS top_score, round(min(score), 6) AS min_score, round(avg(score), 4) AS avg_score,
  count(DISTINCT doc_id) AS unique_documents, count(DISTINCT (doc_id, page_number)) AS unique_pages, count(DISTINCT chunk_id) AS citations
FROM bm25 JOIN chunks USING (chunk_id) GROUP BY ALL""")
def retrieval_quality(spark, sf):
    c = I.chunks(spark, sf)
    found = R.bm25_search(I.queries(spark, sf), c).join(c.select("chunk_id", "doc_id", "page_number"), "chunk_id")
    out = R.quality(found)
    return out.withColumn("top_score", F.round("top_score", 6)).withColumn("min_score", F.round("min_score", 6))


TRUTH = "truth AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query("passage_truth", f"WITH {TRUTH} SELECT * FROM truth")
def passage_truth(spark, sf):
    return R.passage_truth(I.queries(spark, sf), I.docs(spark, sf).select("doc_id", "text"))


@query("recall_at_5", f"""WITH {UNITS_ALL}, {HYBRID}, {TRUTH},
res AS (SELECT 'bm25' AS strategy, query_id, chunk_id FROM bm25 WHERE rank <= 5
  UNION ALL SELECT 'vector', query_id, chunk_id FROM vec WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, chunk_id FROM hybrid),
hit AS (SELECT DISTINCT strategy, r.query_id FROM res r JOIN truth t ON r.query_id = t.query_id AND r.chunk_id = t.doc_id),
asked AS (SELECT DISTINCT s.strategy, t.query_id FROM truth t, (SELECT unnest(['bm25', 'vector', 'hybrid']) AS strategy) s)
SELECT a.strategy, count(*) AS queries, count(h.query_id) AS answered, round(count(h.query_id) / count(*)::DOUBLE, 6) AS recall
FROM asked a LEFT JOIN hit h ON a.strategy = h.strategy AND a.query_id = h.query_id GROUP BY a.strategy""")
def recall_at_5(spark, sf):
    q, c = I.vector_queries(spark, sf), I.units(spark, sf)
    truth = R.passage_truth(q.select("query_id", "text"), I.docs(spark, sf).select("doc_id", "text"))
    found = {
        "bm25": R.bm25_search(q, c, shared=True), "vector": R.vector_search(q, c, 5, 0.0, shared=True),
        "hybrid": R.hybrid_search(q, c, threshold=0.0, shared=True),
    }
    out = None
    for name, hits in found.items():
        one = R.recall_at_k(hits.withColumnRenamed("chunk_id", "doc_id"), truth).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# --- filters and joins ---------------------------------------------------------------------------
STATUS = """st AS (SELECT d.doc_id, d.source AS user_id, d.lang, CASE WHEN l.toxic = 1 THEN 'FAILED' WHEN l.quality = 0 THEN 'PROCESSING'
  WHEN l.doc_id IS NULL THEN 'PENDING' ELSE 'COMPLETED' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))"""


def statuses(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("user_id"), "lang")
    lab = read_table(spark, sf, "labels")
    status = (
        F.when(F.col("toxic") == 1, "FAILED").when(F.col("quality") == 0, "PROCESSING")
        .when(F.col("quality").isNull(), "PENDING").otherwise("COMPLETED")
    )
    return d.join(lab, "doc_id", "left").select("doc_id", "user_id", "lang", status.alias("status"))


@query("completed_documents", f"WITH {STATUS} SELECT doc_id, user_id FROM st WHERE status = 'COMPLETED'")
def completed_documents(spark, sf):
    return FL.completed(statuses(spark, sf)).select("doc_id", "user_id")


@query("authorized_events", """WITH u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 7 = 0 THEN 'ADMIN' ELSE 'USER' END AS role FROM events),
r AS (SELECT event_id, user_id, CASE WHEN event_type IN ('view', 'error') THEN user_id ELSE user_id + 1 END AS caller_id FROM events)
SELECT event_id, caller_id FROM r JOIN u ON u.user_id = r.caller_id WHERE r.user_id = r.caller_id OR role = 'ADMIN'""")
def authorized_events(spark, sf):
    e = I.events(spark, sf)
    users = e.select("user_id", F.when(F.col("user_id") % 7 == 0, "ADMIN").otherwise("USER").alias("role")).distinct()
    caller = F.when(F.col("event_type").isin("view", "error"), F.col("user_id")).otherwise(F.col("user_id") + 1)
    return FL.authorize(e.select("event_id", "user_id", caller.alias("caller_id")), users).select("event_id", "caller_id")


@query("live_events", f"""SELECT event_id, value > 0 AND (event_type = 'view' OR epoch(ts) + value * 86400 > {S.EPOCH + 30 * 86400}) AS table_form,
  NOT (event_type <> 'view' AND {S.EPOCH + 30 * 86400} > epoch(ts) + value * 86400) AS object_form FROM events""")
def live_events(spark, sf):
    e = I.events(spark, sf)
    now = F.lit(float(S.EPOCH + 30 * 86400))
    sec = F.unix_micros(F.expr("cast(ts as timestamp)")) / 1e6 + F.col("value") * 86400
    e = e.withColumn("expires", F.when(F.col("event_type") != "view", sec))
    return e.select(
        "event_id", ((F.col("value") > 0) & FL.not_expired("expires", now)).alias("table_form"),
        (~FL.is_expired("expires", now)).alias("object_form"),
    )


@query("validated_queries", """SELECT event_id, CASE WHEN length(props) < 1 OR length(props) > 2000 THEN 'query_length'
  WHEN (user_id % 25) NOT BETWEEN 1 AND 20 THEN 'top_k' WHEN value / 10 NOT BETWEEN 0.0 AND 1.0 THEN 'threshold' END AS reason FROM events""")
def validated_queries(spark, sf):
    e = I.events(spark, sf).select(
        "event_id", F.col("props").alias("text"), (F.col("user_id") % 25).alias("top_k"), (F.col("value") / 10).alias("threshold")
    )
    ok, bad = FL.validate_queries(e)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("event_id", "reason")


@query("validated_options", """SELECT event_id, CASE WHEN length(props) < 1 OR length(props) > 2000 THEN 'query_length' WHEN value / 40 NOT BETWEEN 0.0 AND 1.0 THEN 'threshold'
  WHEN user_id % 3 > 0 AND value / 20 > 1.0 THEN 'alpha' END AS reason, CASE WHEN value / 10 > 1.0 THEN 'importance' END AS memory_reason FROM events""")
def validated_options(spark, sf):
    """Weights of requests, where they are given, and importances of memories."""
    e = I.events(spark, sf).select(
        "event_id", F.col("props").alias("text"), F.lit(5).alias("top_k"), (F.col("value") / 40).alias("threshold"),
        F.when(F.col("user_id") % 3 > 0, F.col("value") / 20).alias("alpha"), F.col("props").alias("content"), (F.col("value") / 10).alias("importance"),
    )
    ok, bad = FL.validate_queries(e)
    out = ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return out.select("event_id", "reason", FL.memory_problem().alias("memory_reason"))


@query("search_messages", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND role = 'assistant'")
def search_messages(spark, sf):
    c = read_table(spark, sf, "conversations")
    return FL.search_rows(c, "The", ["text"], role="assistant").select("conv_id", "turn")


@query("collection_documents", """WITH ids AS (SELECT DISTINCT unnest([item_id, item_id * 3, item_id + 500]) AS doc_id FROM benchmark)
SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM ids)""")
def collection_documents(spark, sf):
    b, i = read_table(spark, sf, "benchmark"), F.col("item_id")
    coll = b.select(F.array(i, i * 3, i + 500).alias("document_ids"))
    return FL.in_collection(read_table(spark, sf, "documents"), coll).select("doc_id", "n_chars")


@query("chunks_with_documents", f"WITH {S.CHUNKS} SELECT c.user_id, d.lang, count(*) AS chunks FROM chunks c JOIN documents d USING (doc_id) GROUP BY ALL")
def chunks_with_documents(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    return FL.with_docs(I.chunks(spark, sf), d).groupBy("user_id", "lang").agg(F.count(F.lit(1)).alias("chunks"))


@query("messages_of_sessions", f"WITH {S.MESSAGES} SELECT user_id, role, count(*) AS n FROM msgs GROUP BY ALL")
def messages_of_sessions(spark, sf):
    m = I.messages(spark, sf).drop("user_id")
    return FL.messages_of(m, I.sessions(spark, sf)).groupBy("user_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("nested_messages", """SELECT conv_id AS session_id, count(*) AS n, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns FROM conversations GROUP BY ALL""")
def nested_messages(spark, sf):
    n = FL.nest_children(I.sessions(spark, sf), I.messages(spark, sf).drop("user_id"), "session_id", "turn", ["role"])
    turns = F.transform("children", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"]))
    return n.select("session_id", F.size("children").cast("bigint").alias("n"), F.array_join(turns, ",").alias("turns"))
