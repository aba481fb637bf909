"""Memory and knowledge cache over conversations, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import inputs as I
from lectern.catalog import sqltext as S
from lectern.catalog.registry import query
from lectern.catalog.routing_queries import SECRET
from lectern.functions import fixed_values as V
from lectern.operators import cache as C
from lectern.operators import memory as M
from lectern.sources.tables import read_table


# --- memory --------------------------------------------------------------------------------------
def _x(pattern: str, n: int = 1) -> str:
    return f"regexp_extract(t, {S.lit(pattern)}, {n}, 'i')"


def _m(pattern: str) -> str:
    return f"regexp_matches(t, {S.lit(pattern)}, 'i')"


def _end(pattern: str) -> str:
    return f"rtrim({S.trim(_x(pattern))}, '.!?')"


_SIMPLE = [
    (2, V.PREFERENCE_RULE, "preference", "User prefers ", 0.85, 0),
    (3, V.BUILDING_RULE, "project_context", "User is building ", 0.85, 0),
    (4, V.STACK_RULE, "project_context", "User project tech stack: ", 0.85, 0),
    (5, V.TEMPORARY_RULE, "temporary_context", "User is currently focused on ", 0.6, 7),
]
_rem = S.trim(_x(V.REMEMBER_RULE))
_ins = V.INSTRUCTION_RULE
MEMORIES = f"""{S.MESSAGES}, gated AS (SELECT *, {S.trim('text')} AS t FROM msgs WHERE length({S.trim('text')}) >= 6
  AND lower({S.trim('text')}) NOT IN {S.in_list(V.TRIVIAL_PHRASES)} AND NOT {SECRET} AND role = 'user'),
mem0 AS (
  SELECT message_id, user_id, ts, 0 AS rule_no, CASE WHEN regexp_matches(lower({_rem}), '{'|'.join(V.REMEMBER_INSTRUCTION_WORDS)}') THEN 'instruction' ELSE 'project_context' END AS memory_type,
    'Remembered: ' || {_rem} AS content, 0.95::DOUBLE AS importance, NULL::BIGINT AS expires FROM gated WHERE {_m(V.REMEMBER_RULE)}
  UNION ALL SELECT message_id, user_id, ts, 1, 'instruction', 'User instruction: ' || upper({_x(_ins, 1)}[1]) || lower({_x(_ins, 1)}[2:]) || ' ' || {_x(_ins, 2)} || ' ' || {S.trim(_x(_ins, 3))}, 0.9, NULL
    FROM gated WHERE {_m(_ins)} AND NOT {_m(V.REMEMBER_RULE)}
  {' '.join(f"UNION ALL SELECT message_id, user_id, ts, {n}, '{k}', '{o}' || {_end(p)}, {i}, {'ts + 604800' if d else 'NULL'} FROM gated WHERE {_m(p)}" for n, p, k, o, i, d in _SIMPLE)}),
mem AS (SELECT message_id || '-' || rule_no AS memory_id, user_id, memory_type, {S.trim('content')} AS content, importance, expires, ts FROM mem0)"""


def memories(spark, sf):
    m = I.messages(spark, sf).where(F.col("role") == "user")
    found = M.extract_memories(m, F.col("created_at"), keep=["message_id", "user_id", "created_at"])
    return found.select(
        F.concat_ws("-", "message_id", F.col("rule_no").cast("string")).alias("memory_id"), "user_id", "memory_type", "content",
        "importance", F.create_map(F.lit("source"), F.col("source")).alias("metadata"), "expires_at", "created_at",
        F.col("created_at").alias("updated_at"),
    )


def seconds(c: str):
    return F.unix_timestamp(c).alias(c)


@query("extracted_memories", f"WITH {MEMORIES} SELECT memory_id, user_id, memory_type, content, importance, expires AS expires_at, ts AS created_at FROM mem")
def extracted_memories(spark, sf):
    return memories(spark, sf).select(
        "memory_id", "user_id", "memory_type", "content", "importance", seconds("expires_at"), seconds("created_at")
    )


RESOLVED = f"""{MEMORIES}, cls AS (SELECT *, CASE WHEN starts_with(lower(content), 'user prefers') THEN 'p'
  WHEN starts_with(lower(content), 'user instruction') THEN 'i' END AS k FROM mem),
res AS (SELECT memory_id, user_id, memory_type, content, importance, expires, ts AS created, ts AS updated FROM cls WHERE k IS NULL
  UNION ALL SELECT arg_min(memory_id, (ts, memory_id)), user_id, memory_type, arg_max(content, (ts, memory_id)), arg_max(importance, (ts, memory_id)),
    NULL, min(ts), max(ts) FROM cls WHERE k IS NOT NULL GROUP BY user_id, memory_type, k)"""


# The twin holds while fewer than twenty other rows share a user and type, as on the checked scale.
@query("resolved_memories", f"WITH {RESOLVED} SELECT memory_id, user_id, memory_type, content, importance, created AS created_at, updated AS updated_at FROM res")
def resolved_memories(spark, sf):
    new = memories(spark, sf)
    r = M.apply_memories(new.limit(0), new)
    return r.select(
        "memory_id", "user_id", "memory_type", "content", "importance", seconds("created_at"), seconds("updated_at")
    )


_qt = f"list_filter({S.words('q.text')}, lambda w: length(w) > 1 AND NOT list_contains({S.array(V.MEMORY_STOPWORDS)}, w))"
_mt = _qt.replace("q.text", "content")
RANKED = f"""{MEMORIES}, {S.QUERIES}, live AS (SELECT *, {_mt} AS mt FROM mem WHERE expires IS NULL OR expires > {S.NOW}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, memory_id) <= 100),
pairs AS (SELECT q.query_id, {_qt} AS qt, l.* FROM qs q JOIN live l USING (user_id)),
rel AS (SELECT *, CASE WHEN len(mt) = 0 THEN 0.0 WHEN len(list_intersect(qt, mt)) > 0 THEN least(1.0, len(list_intersect(qt, mt)) / greatest(len(qt), 1)::DOUBLE)
  WHEN memory_type = 'instruction' THEN 0.4 ELSE 0.0 END::DOUBLE AS relevance,
  greatest(0.1, least(1.0, 1.0 - greatest(0, {S.NOW} - ts) / (30 * 86400.0::DOUBLE) * 0.9))::DOUBLE AS recency FROM pairs),
sco AS (SELECT *, round((relevance * 0.6::DOUBLE + importance * 0.25::DOUBLE + recency * 0.15::DOUBLE)::DECIMAL(20, 12), 4)::DOUBLE AS score FROM rel WHERE relevance > 0),
mrank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, memory_id) AS rank FROM sco
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, memory_id) <= 5)"""


@query("memory_topk", f"WITH {RANKED} SELECT query_id, memory_id, rank, score, round(relevance, 6) AS relevance, round(recency, 6) AS recency FROM mrank")
def memory_topk(spark, sf):
    r = M.memory_search(I.queries(spark, sf), memories(spark, sf), I.now())
    return r.select(
        "query_id", "memory_id", F.col("rank").cast("bigint").alias("rank"), "score", F.round("relevance", 6).alias("relevance"),
        F.round("recency", 6).alias("recency"),
    )


@query("memory_contexts", f"WITH {RANKED} SELECT query_id, 'mag' AS source, memory_id AS source_id, 5 AS priority, score, user_id AS owner_id FROM mrank")
def memory_contexts(spark, sf):
    r = M.memory_search(I.queries(spark, sf), memories(spark, sf), I.now())
    return M.to_contexts(r).select("query_id", "source", "source_id", "priority", "score", "owner_id")


@query("memory_list", f"WITH {MEMORIES} SELECT memory_id, ts AS created_at FROM mem WHERE user_id = 'src3' AND (expires IS NULL OR expires > {S.NOW}) ORDER BY ts DESC, memory_id LIMIT 50")
def memory_list(spark, sf):
    return M.list_memories(memories(spark, sf), "src3", I.now()).select("memory_id", seconds("created_at"))


@query("memory_deleted", f"""WITH {MEMORIES}, req AS (SELECT memory_id, CASE WHEN memory_type = 'preference' THEN 'src1' ELSE user_id END AS user_id FROM mem WHERE importance < 0.9)
SELECT m.memory_id FROM mem m ANTI JOIN req r ON m.memory_id = r.memory_id AND m.user_id = r.user_id""")
def memory_deleted(spark, sf):
    m = memories(spark, sf)
    req = m.where("importance < 0.9").select(
        "memory_id", F.when(F.col("memory_type") == "preference", "src1").otherwise(F.col("user_id")).alias("user_id")
    )
    return M.delete_memory(m, req).select("memory_id")


@query("memory_owned", f"""WITH {MEMORIES}, req AS (SELECT memory_id, CASE WHEN memory_type = 'preference' THEN 'src1' ELSE user_id END AS user_id FROM mem)
SELECT m.memory_id FROM mem m SEMI JOIN req r ON m.memory_id = r.memory_id AND m.user_id = r.user_id""")
def memory_owned(spark, sf):
    m = memories(spark, sf)
    req = m.select("memory_id", F.when(F.col("memory_type") == "preference", "src1").otherwise(F.col("user_id")).alias("user_id"))
    return M.get_memory(m, req).select("memory_id")


@query("memory_purged", f"WITH {MEMORIES} SELECT memory_id FROM mem WHERE user_id NOT IN (SELECT 'src' || (item_id % 20) FROM benchmark WHERE length(text) > 300)")
def memory_purged(spark, sf):
    users = I.queries(spark, sf).where(F.length("text") > 300)
    return M.purge_users(memories(spark, sf), users).select("memory_id")


@query("memory_stats", f"""WITH {MEMORIES}, t AS (SELECT user_id, memory_type, count(*) AS n, max(ts) AS last FROM mem GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS total_memories, string_agg(memory_type || '=' || n, ',' ORDER BY memory_type) AS by_type, max(last) AS last_updated FROM t GROUP BY ALL""")
def memory_stats(spark, sf):
    s = M.memory_stats(memories(spark, sf))
    pairs = F.transform(F.array_sort(F.map_entries("memories_by_type")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return s.select("user_id", "total_memories", F.array_join(pairs, ",").alias("by_type"), seconds("last_updated"))


# --- cache ---------------------------------------------------------------------------------------
# Every document is a cached text; English ones are global, German ones expire by their length.
ENTRIES = f"""ent AS (SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE source END AS user_id, lang AS namespace,
    lower(lang) || ':' || CASE WHEN lang = 'en' THEN '' ELSE source || ':' END || 'doc ' || doc_id AS key, text AS content, 1 AS version,
    CASE WHEN lang = 'de' THEN {S.EPOCH} + n_chars * 100 END AS expires, 'de=' || lang AS meta FROM documents)"""
DOMAINS = """dom AS (SELECT doc_id AS seq, regexp_extract(lower(content), '[a-z]{5,}') AS keyword, key AS cache_key, user_id FROM ent
  WHERE regexp_extract(lower(content), '[a-z]{5,}') <> '')"""


def entries(spark, sf):
    d = read_table(spark, sf, "documents")
    items = d.select(
        F.col("lang").alias("namespace"), F.concat(F.lit(" Doc "), F.col("doc_id").cast("string")).alias("identifier"),
        F.col("text").alias("content"), F.when(F.col("lang") != "en", F.col("source")).alias("user_id"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), F.lit(1).alias("version"),
        F.when(F.col("lang") == "de", F.col("n_chars") * 100).alias("ttl_seconds"),
    )
    return C.make_entries(items, F.timestamp_seconds(F.lit(S.EPOCH)))


def domains(spark, sf):
    d = read_table(spark, sf, "documents")
    owner = F.when(F.col("lang") != "en", F.col("source"))
    key = C.cache_key("lang", F.concat(F.lit("doc "), F.col("doc_id").cast("string")), owner)
    return d.select(
        F.col("doc_id").alias("seq"), F.regexp_extract(F.lower("text"), "[a-z]{5,}", 0).alias("keyword"), key.alias("cache_key"),
        owner.alias("user_id"),
    ).where("keyword <> ''")


@query("cache_entries", f"WITH {ENTRIES} SELECT key, 'cag_' || replace(key, ':', '_') AS cache_id, namespace, user_id, expires AS expires_at, md5(content) AS digest FROM ent")
def cache_entries(spark, sf):
    return entries(spark, sf).select("key", "cache_id", "namespace", "user_id", seconds("expires_at"), F.md5("content").alias("digest"))


@query("cache_put", f"""WITH {ENTRIES}, w AS (SELECT key, version, content, -1 AS seq FROM ent UNION ALL
  SELECT e.key, 2 + l.quality, 'new ' || e.content, l.doc_id * 2 + l.quality FROM ent e JOIN labels l USING (doc_id))
SELECT key, arg_max(version, seq)::BIGINT AS version, md5(arg_max(content, seq)) AS digest FROM w GROUP BY key""")
def cache_put(spark, sf):
    e = entries(spark, sf)
    lab = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    owner = F.when(F.col("lang") != "en", F.col("source"))
    key = C.cache_key("lang", F.concat(F.lit("doc "), F.col("doc_id").cast("string")), owner)
    new = e.join(lab.select(key.alias("key"), "quality", "doc_id"), "key").select(
        *[c for c in e.columns if c not in ("version", "content")], (F.col("quality") + 2).alias("version"),
        F.concat(F.lit("new "), "content").alias("content"), (F.col("doc_id") * 2 + F.col("quality")).alias("seq"),
    )
    out = C.cache_put(e, new)
    return out.select("key", F.col("version").cast("bigint").alias("version"), F.md5("content").alias("digest"))


_LABELLED = f"""{ENTRIES}, upd AS (SELECT e.*, l.quality, l.toxic, CASE WHEN l.quality = 1 THEN d.source ELSE 'src0' END AS caller_id
  FROM ent e JOIN labels l USING (doc_id) JOIN documents d USING (doc_id))"""


def labelled_keys(spark, sf):
    lab = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    owner = F.when(F.col("lang") != "en", F.col("source"))
    key = C.cache_key("lang", F.concat(F.lit("doc "), F.col("doc_id").cast("string")), owner)
    caller = F.when(F.col("quality") == 1, F.col("source")).otherwise("src0")
    return lab.select(key.alias("key"), caller.alias("caller_id"), "quality", "toxic")


@query("cache_refresh", f"""WITH {_LABELLED}, ok AS (SELECT key FROM upd WHERE (user_id IS NULL OR user_id = caller_id) AND NOT (expires IS NOT NULL AND {S.NOW} > expires))
SELECT e.key, CASE WHEN o.key IS NULL THEN 1 ELSE 2 END::BIGINT AS version, CASE WHEN o.key IS NULL THEN md5(e.content) ELSE md5('fresh') END AS digest,
  CASE WHEN o.key IS NULL THEN 'lang=' || namespace ELSE 'by=refresh,lang=' || namespace END AS metadata FROM ent e LEFT JOIN ok o USING (key)""")
def cache_refresh(spark, sf):
    u = labelled_keys(spark, sf).select(
        "key", F.lit("fresh").alias("new_content"), "caller_id", F.create_map(F.lit("by"), F.lit("refresh")).alias("new_metadata")
    )
    out = C.cache_refresh(entries(spark, sf), u, I.now())
    meta = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select(
        "key", F.col("version").cast("bigint").alias("version"), F.md5("content").alias("digest"), F.array_join(meta, ",").alias("metadata")
    )


@query("cache_invalidate", f"""WITH {_LABELLED}, gone AS (SELECT key FROM upd WHERE user_id IS NULL OR toxic = 1 OR user_id = caller_id)
SELECT key FROM ent WHERE key NOT IN (SELECT key FROM gone)""")
def cache_invalidate(spark, sf):
    r = labelled_keys(spark, sf).select("key", F.when(F.col("toxic") == 0, F.col("caller_id")).alias("caller_id"))
    return C.cache_invalidate(entries(spark, sf), r).select("key")


@query("cache_cleared", f"WITH {ENTRIES} SELECT key FROM ent WHERE user_id IS NULL OR user_id <> 'src5'")
def cache_cleared(spark, sf):
    return C.cache_clear(entries(spark, sf), "src5").select("key")


@query("cache_domains", f"""WITH {ENTRIES}, {DOMAINS} SELECT min(seq) AS seq, keyword, cache_key, user_id FROM (
  SELECT * FROM dom UNION ALL SELECT seq + 1000000, keyword, cache_key, user_id FROM dom) WHERE keyword NOT IN (SELECT lower(role) FROM conversations) GROUP BY ALL""")
def cache_domains(spark, sf):
    d = domains(spark, sf)
    again = d.select(F.col("seq") + 1000000, F.concat(F.lit(" "), F.upper("keyword")).alias("keyword"), "cache_key", "user_id")
    both = C.register_domains(d, again.toDF(*d.columns))
    return C.unregister_domains(both, read_table(spark, sf, "conversations").select(F.col("role").alias("keyword")))


@query("cache_eligible", f"""WITH {ENTRIES}, {DOMAINS}, {S.QUERIES} SELECT q.query_id, list_has_any({S.words('q.text')}, {S.array(V.CACHE_KEYWORDS)})
  OR EXISTS (SELECT 1 FROM dom WHERE contains(lower(q.text), dom.keyword)) AS eligible FROM qs q""")
def cache_eligible(spark, sf):
    return C.is_eligible(I.queries(spark, sf), domains(spark, sf)).select("query_id", "eligible")


RESOLVED_KEYS = f"""{ENTRIES}, {DOMAINS}, {S.QUERIES}, keys AS (SELECT q.query_id, q.user_id, d.cache_key, min(d.seq) AS seq FROM qs q JOIN dom d
  ON contains(lower(q.text), d.keyword) AND (d.user_id IS NULL OR d.user_id = q.user_id) GROUP BY ALL)"""


@query("cache_keys_resolved", f"WITH {RESOLVED_KEYS} SELECT query_id, cache_key, seq FROM keys")
def cache_keys_resolved(spark, sf):
    return C.resolve_keys(I.queries(spark, sf), domains(spark, sf)).select("query_id", "cache_key", "seq")


FOUND = f"""{RESOLVED_KEYS}, found AS (SELECT k.query_id, k.user_id AS caller_id, k.seq, e.* EXCLUDE (user_id), e.user_id AS owner_id,
  CASE WHEN length(e.content) > 4000 THEN substring(e.content, 1, 4000) || '{V.CACHE_TRUNCATED}' ELSE e.content END AS cut
  FROM keys k JOIN ent e ON e.key = k.cache_key WHERE (e.user_id IS NULL OR e.user_id = k.user_id) AND NOT (e.expires IS NOT NULL AND {S.NOW} > e.expires))"""


@query("cache_lookup", f"WITH {FOUND} SELECT query_id, seq, 'cag_' || replace(key, ':', '_') AS cache_id, '1' AS version, md5(cut) AS digest FROM found")
def cache_lookup(spark, sf):
    f = C.cache_search(I.queries(spark, sf), domains(spark, sf), entries(spark, sf), I.now())
    return f.select("query_id", "seq", "cache_id", "version", F.md5("content").alias("digest"))


# Every query asks for the keys of three documents and for one that does not exist.
ACCESS = f"""{ENTRIES}, {S.QUERIES}, lk AS (SELECT q.query_id, q.user_id, e.key AS cache_key FROM qs q JOIN ent e ON e.doc_id IN (q.query_id, q.query_id + 60, q.query_id * 5 + 100)
  UNION ALL SELECT query_id, user_id, 'none' FROM qs),
acc AS (SELECT l.*, e.key IS NOT NULL AND NOT (e.expires IS NOT NULL AND {S.NOW} > e.expires) AND (e.user_id IS NULL OR e.user_id = l.user_id) AS hit
  FROM lk l LEFT JOIN ent e ON e.key = l.cache_key)"""


def lookups(spark, sf):
    i = F.col("query_id")
    q = I.queries(spark, sf).select("query_id", "user_id")
    wanted = q.select("*", F.explode(F.array_distinct(F.array(i, i + 60, i * 5 + 100))).alias("doc_id"))
    owner = F.when(F.col("lang") != "en", F.col("source"))
    key = C.cache_key("lang", F.concat(F.lit("doc "), F.col("doc_id").cast("string")), owner)
    keys = read_table(spark, sf, "documents").select("doc_id", key.alias("cache_key"))
    return wanted.join(keys, "doc_id").select("query_id", "user_id", "cache_key").unionByName(
        q.select("query_id", "user_id", F.lit("none").alias("cache_key"))
    )


@query("cache_access", f"WITH {ACCESS} SELECT query_id, count_if(hit) AS hits, count_if(NOT hit) AS misses FROM acc GROUP BY ALL")
def cache_access(spark, sf):
    a = C.cache_access(lookups(spark, sf), entries(spark, sf), I.now())
    return a.groupBy("query_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("cache_stats", f"""WITH {ACCESS} SELECT (SELECT count(*) FROM ent) AS entries, (SELECT sum(strlen(content))::BIGINT FROM ent) AS total_size_bytes,
  {S.EPOCH} AS last_refresh, count_if(hit) AS hits, count_if(NOT hit) AS misses FROM acc""")
def cache_stats(spark, sf):
    e = entries(spark, sf)
    s = C.cache_stats(e, C.cache_access(lookups(spark, sf), e, I.now()))
    return s.withColumn("last_refresh", F.unix_timestamp("last_refresh"))


@query("cache_versions", f"WITH {ENTRIES} SELECT 'cag_' || replace(key, ':', '_') AS cache_id, version::BIGINT AS version FROM ent")
def cache_versions(spark, sf):
    return C.cache_versions(entries(spark, sf)).select("cache_id", F.col("version").cast("bigint").alias("version"))


@query("cache_list", f"WITH {ENTRIES} SELECT key FROM ent WHERE namespace = 'fr' AND (user_id IS NULL OR user_id = 'src4')")
def cache_list(spark, sf):
    return C.cache_list(entries(spark, sf), I.now(), "src4", " FR").select("key")
