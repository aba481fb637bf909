"""Text functions, pages, chunks and uploads over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import inputs as I
from lectern.catalog import sqltext as S
from lectern.catalog.registry import query
from lectern.functions import fixed_values as V
from lectern.functions import text as tx
from lectern.functions import vectors as vec
from lectern.operators import documents as D
from lectern.operators import filters as FL
from lectern.operators.telemetry import redact_json
from lectern.plans.ingest import cleaned_pages, ingest_chunks
from lectern.sources import tables as TB


@query("clean_documents", f"""WITH c AS (SELECT doc_id, {S.clean_marked(S.marks('text'))} AS t FROM documents)
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM c""")
def clean_documents(spark, sf):
    d = I.docs(spark, sf).select("doc_id", tx.clean("text").alias("t"))
    return d.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query("strip_control_characters", f"""SELECT doc_id, md5(regexp_replace(text, '{S.CONTROL}', '', 'g')) AS digest FROM documents""")
def strip_control_characters(spark, sf):
    return I.docs(spark, sf).select("doc_id", F.md5(tx.strip_control("text")).alias("digest"))


@query("tokenize_documents", f"""WITH t AS (SELECT doc_id, {S.tokens('text')} AS w FROM documents)
SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM t""")
def tokenize_documents(spark, sf):
    d = I.docs(spark, sf).select("doc_id", tx.tokenize("text").alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("memory_token_sets", f"""WITH t AS (SELECT conv_id, turn,
  list_sort(list_filter({S.words('text')}, lambda w: length(w) > 1 AND NOT list_contains({S.array(V.MEMORY_STOPWORDS)}, w))) AS w
  FROM conversations) SELECT conv_id, turn, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM t""")
def memory_token_sets(spark, sf):
    d = TB.read_table(spark, sf, "conversations").select("conv_id", "turn", F.array_sort(tx.memory_tokens("text")).alias("w"))
    return d.select("conv_id", "turn", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("query_keywords", rf"""WITH t AS (SELECT item_id, list_filter(regexp_extract_all(
    regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F\P{{L}}]', 'Z', 'g'), '[^\x00-\x7F\P{{N}}]', 'Z', 'g'),
    '\b[a-z0-9_\-\.]+\b'), lambda w: length(w) > 2 AND NOT list_contains({S.array(V.KEYWORD_STOPWORDS)}, w)) AS w FROM benchmark)
SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS keywords FROM t""")
def query_keywords(spark, sf):
    d = TB.read_table(spark, sf, "benchmark").select("item_id", tx.extract_keywords("text").alias("w"))
    return d.select("item_id", F.size("w").cast("bigint").alias("n"), F.array_join("w", " ").alias("keywords"))


@query("normalized_queries", rf"""SELECT item_id, {S.trim(f"regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '{S.WS_RUN}', ' ', 'g')")} AS text
FROM benchmark""")
def normalized_queries(spark, sf):
    return TB.read_table(spark, sf, "benchmark").select("item_id", tx.normalize_query("text").alias("text"))


@query("dedup_keys", f"""SELECT md5(trim(regexp_replace(lower(text), '{S.WS_RUN}', ' ', 'g'))) AS dedup_key, count(*) AS copies
FROM documents GROUP BY ALL""")
def dedup_keys(spark, sf):
    d = I.docs(spark, sf).select(F.md5(tx.dedup_key("text")).alias("dedup_key"))
    return d.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("copies"))


@query("text_measures", f"""SELECT doc_id, ({S.est_tokens('text')})::BIGINT AS est_tokens,
  greatest(1, length(text) // 4)::BIGINT AS chunk_tokens, greatest(1, len({S.pieces('text')}))::BIGINT AS words,
  strlen(text) AS bytes FROM documents""")
def text_measures(spark, sf):
    return I.docs(spark, sf).select(
        "doc_id", tx.est_tokens("text").cast("bigint").alias("est_tokens"),
        tx.chunk_tokens("text").cast("bigint").alias("chunk_tokens"),
        tx.word_count("text").cast("bigint").alias("words"), tx.byte_size("text").cast("bigint").alias("bytes"),
    )


@query("text_previews", f"""SELECT doc_id,
  CASE WHEN length(text) > 250 THEN substring(text, 1, 250) || '...' ELSE text END AS citation,
  substring(text, 1, 200) AS payload,
  array_to_string(({S.pieces('text')})[1:5], ' ') || CASE WHEN len({S.pieces('text')}) > 5 THEN '...' ELSE '' END AS title,
  md5(CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || {S.lit(V.CACHE_TRUNCATED)} ELSE text END) AS cached
FROM documents""")
def text_previews(spark, sf):
    return I.docs(spark, sf).select(
        "doc_id", tx.preview("text").alias("citation"), tx.preview("text", 200, False).alias("payload"),
        tx.session_title("text").alias("title"), F.md5(tx.truncate_cache("text")).alias("cached"),
    )


@query("masked_errors", r"""WITH e AS (SELECT event_id, event_type || ' failed: key=' || event_id || 'abc&k=1 Bearer ' ||
    md5(event_id::VARCHAR) || ' sk-' || md5(props) AS m FROM events)
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(m, '(key|api[_-]?key)=([^\s&]+)', '\1=[REDACTED]', 'gi'),
  '(bearer\s+|gsk_)[a-zA-Z0-9_\-\.]{10,}', '[REDACTED_TOKEN]', 'gi'), '(sk-[a-zA-Z0-9_\-]{10,})', '[REDACTED_KEY]', 'g') AS message FROM e""")
def masked_errors(spark, sf):
    e = I.events(spark, sf)
    m = F.concat(
        "event_type", F.lit(" failed: key="), F.col("event_id").cast("string"), F.lit("abc&k=1 Bearer "),
        F.md5(F.col("event_id").cast("string")), F.lit(" sk-"), F.md5("props"),
    )
    return e.select("event_id", tx.mask_error(m).alias("message"))


@query("redacted_payloads", """SELECT event_id, props->>'k' AS k, CASE WHEN event_type = 'error' THEN '[REDACTED]' END AS secret
FROM events""")
def redacted_payloads(spark, sf):
    # The payload of an error event also carries a credential, which must not survive.
    e = I.events(spark, sf)
    leak = F.concat(F.lit('{"user_Token": "'), F.md5("props"), F.lit('", '), F.expr("substring(props, 2)"))
    m = redact_json(F.when(F.col("event_type") == "error", leak).otherwise(F.col("props")))
    return e.select("event_id", m["k"].alias("k"), m["user_Token"].alias("secret"))


@query("redacted_nested", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '{"level1": [{"token": "[REDACTED]", "id": "' || user_id || '"}, {"nested_auth": {"Bearer": "[REDACTED]"}}], "k": '
    || (props->>'k') || ', "deep": {"a": [[{"my_Secret_list": "[REDACTED]"}]]}}'
  WHEN user_id % 3 = 1 THEN props ELSE '[REDACTED]' END AS payload, '{"password":"[REDACTED]","plain":"' || user_id || '"}' AS typed FROM events""")
def redacted_nested(spark, sf):
    """Secrets below objects and lists of any depth, in text that is no JSON, and in a map of numbers."""
    from lectern.operators.telemetry import redact_struct, redact_text

    e, leak = I.events(spark, sf), F.md5("props")
    nested = F.concat(
        F.lit('{"level1":[{"token":"'), leak, F.lit('","id":"'), F.col("user_id").cast("string"), F.lit('"},{"nested_auth":{"Bearer":{"x":"'), leak,
        F.lit('"}}}],"k":'), F.get_json_object("props", "$.k"), F.lit(',"deep":{"a":[[{"my_Secret_list":["'), leak, F.lit('"]}]]}}'),
    )
    broken = F.concat(F.lit('{"token": "'), leak)
    text = F.when(F.col("user_id") % 3 == 0, nested).when(F.col("user_id") % 3 == 1, F.col("props")).otherwise(broken)
    e = e.withColumn("payload", redact_text(text)).withColumn("typed", F.create_map(F.lit("password"), F.col("event_id"), F.lit("plain"), F.col("user_id")))
    return redact_struct(e, "typed").select("event_id", "payload", F.to_json("typed").alias("typed"))


@query("cited_sources", r"""WITH t AS (SELECT conv_id, turn, '[Source ' || turn || '] ' || role || ' [Source 12][Source ' || (conv_id % 7) || ']' AS s FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(s, '\[Source (\d+)\]', 1), lambda x: x::BIGINT))), ',') AS refs FROM t""")
def cited_sources(spark, sf):
    c = TB.read_table(spark, sf, "conversations")
    s = F.concat(
        F.lit("[Source "), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(" [Source 12][Source "),
        (F.col("conv_id") % 7).cast("string"), F.lit("]"),
    )
    refs = F.transform(tx.cited_sources(s), lambda x: x.cast("string"))
    return c.select("conv_id", "turn", F.array_join(refs, ",").alias("refs"))


# --- pages and chunks ----------------------------------------------------------------------------
@query("paginate_lines", f"""WITH {S.DOCS}, {S.PAGES.split('doc_pages AS')[0].rstrip().rstrip(',').replace(S.marks('text'), 'text')}
SELECT doc_id, (i // 60 + 1)::BIGINT AS page_number, i::BIGINT AS line_start, least(i + 60, len(ls))::BIGINT AS line_end,
  md5(array_to_string(ls[i + 1:i + 60], chr(10))) AS digest FROM pages_raw""")
def paginate_lines(spark, sf):
    p = D.paginate_lines(I.docs(spark, sf).select("doc_id", "text"))
    return p.select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), F.col("line_start").cast("bigint").alias("line_start"),
        F.col("line_end").cast("bigint").alias("line_end"), F.md5("text").alias("digest"),
    )


@query("paginate_paragraphs", f"""WITH RECURSIVE p AS (SELECT doc_id,
    list_filter(string_split(text, chr(10)), lambda x: {S.trim('x')} <> '') AS ps FROM documents),
f AS (SELECT doc_id, ps, 0 AS i, 0 AS open, 1 AS page, 0 AS this_page FROM p
  UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN open + length(ps[i + 1]) >= 3000 THEN 0 ELSE open + length(ps[i + 1]) END,
    CASE WHEN open + length(ps[i + 1]) >= 3000 THEN page + 1 ELSE page END, page
  FROM f WHERE i < len(ps))
SELECT doc_id, this_page::BIGINT AS page_number, count(*) AS paragraph_count,
  md5(string_agg(ps[i], chr(10) || chr(10) ORDER BY i)) AS digest FROM f WHERE i > 0 GROUP BY ALL
UNION ALL SELECT doc_id, 1, NULL, md5('') FROM p WHERE len(ps) = 0""")
def paginate_paragraphs(spark, sf):
    d = I.docs(spark, sf).select("doc_id", F.split("text", "\n").alias("paras"))
    return D.paginate_paragraphs(d).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"),
        F.col("paragraph_count").cast("bigint").alias("paragraph_count"), F.md5("text").alias("digest"),
    )


@query("chunk_fixed", f"""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 64) / 448.0))::BIGINT)) AS i
  FROM documents WHERE text <> ''),
c AS (SELECT doc_id, i, {S.trim('substring(text, i * 448 + 1, 512)')} AS content FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, md5(content) AS digest FROM c WHERE content <> ''""")
def chunk_fixed(spark, sf):
    c = D.chunk(I.docs(spark, sf).select("doc_id", "text"), strategy="fixed")
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("content").alias("digest"))


@query("sentences", rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\s\x0b]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents)
SELECT doc_id, len(list_filter(list_transform(p, lambda x: {S.trim('x')}), lambda x: x <> '')) AS n,
  md5(array_to_string(list_filter(list_transform(p, lambda x: {S.trim('x')}), lambda x: x <> ''), '|')) AS digest FROM s""")
def sentences(spark, sf):
    d = I.docs(spark, sf).select("doc_id", D.sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("chunk_sentences")
def chunk_sentences(spark, sf):
    return D.chunk(I.docs(spark, sf).select("doc_id", "text"), strategy="sentence_aware")


@query("chunk_paragraphs")
def chunk_paragraphs(spark, sf):
    return D.chunk(I.docs(spark, sf).select("doc_id", "text"), strategy="paragraph_aware")


@query("chunk_documents", f"""WITH {S.CHUNKS} SELECT doc_id, chunk_index, page_number::BIGINT AS page_number,
  length(content)::BIGINT AS char_count, greatest(1, length(content) // 4)::BIGINT AS token_estimate, md5(content) AS digest FROM chunks""")
def chunk_documents(spark, sf):
    return I.chunks(spark, sf).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("page_number").cast("bigint").alias("page_number"),
        F.col("metadata.char_count").cast("bigint").alias("char_count"),
        F.col("metadata.token_estimate").cast("bigint").alias("token_estimate"), F.md5("content").alias("digest"),
    )


@query("cleaned_pages", f"""WITH {S.DOCS}, {S.PAGES} SELECT doc_id, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM doc_pages GROUP BY ALL""")
def cleaned_pages_query(spark, sf):
    p = cleaned_pages(I.docs(spark, sf).select("doc_id", "text"))
    chars = F.aggregate("pages", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["text"]))
    return p.select("doc_id", F.size("pages").cast("bigint").alias("pages"), chars.alias("chars"))


@query("ingest_status", f"""WITH {S.CHUNKS} SELECT d.doc_id, CASE WHEN f.lang = 'es' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN f.lang = 'es' THEN 0 ELSE count(c.chunk_id) END AS chunk_count, CASE WHEN f.lang = 'es' THEN 'unsupported_extension' END AS error_message
FROM docs d JOIN documents f USING (doc_id) LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id, f.lang""")
def ingest_status(spark, sf):
    """Uploads of a kind that cannot be read have failed; all others are complete, whatever their length."""
    raw = TB.read_table(spark, sf, "documents").select("doc_id", "lang")
    name = F.when(F.col("lang") == "es", "program.exe").otherwise("note.txt")
    _, rejected = D.validate_files(raw.select("doc_id", name.alias("filename"), F.lit(1).alias("file_size")))
    out = D.ingest_status(raw.select("doc_id"), I.chunks(spark, sf), rejected.select("doc_id", F.col("reason").alias("error_message")))
    return out.select("doc_id", "status", "chunk_count", "error_message")


# --- uploads -------------------------------------------------------------------------------------
@query("validate_uploads", r"""WITH f AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'note.txt' WHEN 'fr' THEN 'Note.DOCX' WHEN 'de' THEN 'a.b.pdf' ELSE 'script.exe' END AS name,
  strlen(text) * CASE WHEN lang = 'de' THEN 10000 ELSE 1 END AS size FROM documents)
SELECT doc_id, CASE WHEN lower(regexp_extract(name, '\.[^.]+$')) NOT IN ('.pdf', '.txt', '.docx') THEN 'unsupported_extension'
  WHEN size = 0 THEN 'empty_file' WHEN size > 25 * 1024 * 1024 THEN 'file_too_large' END AS reason FROM f""")
def validate_uploads(spark, sf):
    d = TB.read_table(spark, sf, "documents")
    name = F.when(F.col("lang") == "en", "note.txt").when(F.col("lang") == "fr", "Note.DOCX").when(
        F.col("lang") == "de", "a.b.pdf"
    ).otherwise("script.exe")
    size = F.octet_length("text") * F.when(F.col("lang") == "de", 10000).otherwise(1).cast("bigint")
    f = d.select("doc_id", name.alias("filename"), size.alias("file_size"))
    valid, rejected = D.validate_files(f)
    return valid.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).select("doc_id", "reason")


@query("route_by_type", r"""SELECT page_id, CASE WHEN e IN ('.pdf', '.txt', '.docx') THEN substring(e, 2) END AS extractor,
  CASE WHEN e IN ('.pdf', '.txt', '.docx') THEN 'PROCESSING' ELSE 'FAILED' END AS status
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' ELSE '.html' END AS e FROM pages)""")
def route_by_type(spark, sf):
    p = TB.read_table(spark, sf, "pages")
    ext = F.when(F.col("page_id") % 4 == 0, ".TXT").when(F.col("page_id") % 4 == 1, ".docx").when(
        F.col("page_id") % 4 == 2, ".Pdf"
    ).otherwise(".html")
    files = p.select("page_id", F.concat(F.lit("/in/v1.2/file_"), F.col("page_id").cast("string"), ext).alias("path"))
    return D.route_by_type(files).select("page_id", "extractor", "status")


@query("sanitize_filenames", r"""WITH b AS (SELECT page_id, string_split(replace(url || '\..\' || page_id || ' a..b...c é.txt', '\', '/'), '/') AS p FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(trim(p[len(p)]), '\s+', '_', 'g'), '[^a-zA-Z0-9_.-]', '', 'g') AS n FROM b),
d AS (SELECT page_id, regexp_replace(n, '(?:\.\.)+', '', 'g') AS n FROM c)
SELECT page_id, CASE WHEN n = '' OR starts_with(n, '.') THEN 'doc_' || n ELSE n END AS name FROM d""")
def sanitize_filenames(spark, sf):
    p = TB.read_table(spark, sf, "pages")
    raw = F.concat("url", F.lit("\\..\\"), F.col("page_id").cast("string"), F.lit(" a..b...c é.txt"))
    return p.select("page_id", tx.sanitize_filename(raw).alias("name"))


@query("replace_chunks", f"""WITH {S.CHUNKS}
SELECT c.doc_id, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS version, count(*) AS n
FROM chunks c LEFT JOIN labels l ON c.doc_id = l.doc_id GROUP BY ALL""")
def replace_chunks(spark, sf):
    """Write all chunks, then replace those of the labelled documents."""
    from lectern.operators.sizing import run_dir

    path = run_dir(spark, "chunks")
    docs, labelled = I.docs(spark, sf), TB.read_table(spark, sf, "labels").select("doc_id")
    # The labelled documents are chosen first: a join after the cutting would cut all texts again.
    for version, d in (("old", docs), ("new", docs.join(labelled, "doc_id", "left_semi"))):
        c = ingest_chunks(d, "fixed").select("doc_id", "chunk_index", "content")
        TB.write_chunks(c.withColumn("version", F.lit(version)), path)
    return TB.read_chunks(spark, path).groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n"))


@query("cascade_delete", f"""WITH {S.CHUNKS}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT doc_id, count(*) AS n FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY ALL""")
def cascade_delete(spark, sf):
    gone = TB.read_table(spark, sf, "labels").where("toxic = 1")
    return FL.cascade_delete(gone, I.chunks(spark, sf), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("cascade_set_null", """WITH gone AS (SELECT DISTINCT conv_id FROM conversations WHERE length(text) > 1500)
SELECT e.event_id, CASE WHEN g.conv_id IS NULL THEN e.user_id END AS session_id FROM events e LEFT JOIN gone g ON e.user_id = g.conv_id""")
def cascade_set_null(spark, sf):
    c = TB.read_table(spark, sf, "conversations").where(F.length("text") > 1500).select(F.col("conv_id").alias("session_id"))
    logs = I.events(spark, sf).select("event_id", F.col("user_id").alias("session_id"))
    return FL.cascade_delete(c, logs, "session_id", set_null=True)


# --- vectors -------------------------------------------------------------------------------------
@query("l2_normalize", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) ** 2)), 6) AS norm,
  round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings""")
def l2_normalize(spark, sf):
    v = I.vectors(spark, sf).select("vec_id", vec.l2_normalize("embedding").alias("u"))
    return v.select("vec_id", F.round(vec.dot("u", "u"), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


@query("embedding_dimensions", """SELECT len(embedding)::BIGINT AS dim, len(embedding) = 64 AS valid, count(*) AS n FROM embeddings GROUP BY ALL""")
def embedding_dimensions(spark, sf):
    from lectern.operators.embedding import validate_dim

    ok = validate_dim(I.vectors(spark, sf), 64, mode="flag")
    return ok.groupBy(F.size("embedding").cast("bigint").alias("dim"), F.col("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("embed_chunks")
def embed_chunks(spark, sf):
    from lectern.operators.embedding import embed

    e = embed(I.chunks(spark, sf).select("chunk_id", "content"), text="content", dim=64)
    return e.select("chunk_id", F.size("embedding").alias("dim"), F.round(vec.l2_norm("embedding"), 6).alias("norm"))
