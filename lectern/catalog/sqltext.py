"""SQL expressions and table expressions shared by the SQL twins."""

from __future__ import annotations

from lectern.functions import fixed_values as V
from lectern.functions.text import PY_SPACE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = lit(PY_SPACE)
WS_RUN = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LINES = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
NL = "chr(10)"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def marks(x: str) -> str:
    one = {k: v for k, v in V.CHAR_REPLACEMENTS.items() if len(v) == 1}
    gone = "".join(k for k, v in V.CHAR_REPLACEMENTS.items() if v == "")
    return f"translate(replace({x}, {lit(chr(0x2026))}, '...'), {lit(''.join(one) + gone)}, {lit(''.join(one.values()))})"


def clean_marked(x: str) -> str:
    y = f"regexp_replace({x}, '{CONTROL}', '', 'g')"
    y = rf"regexp_replace(regexp_replace({y}, '[ \t]+', ' ', 'g'), '\n{{3,}}', {NL}||{NL}, 'g')"
    lines = f"list_transform(string_split_regex({y}, '{LINES}'), lambda l: trim(l, {WS}))"
    return trim(f"array_to_string({lines}, {NL})")


def tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9_]+'))"


def words(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


def pieces(x: str) -> str:
    return f"list_filter(string_split_regex({trim(x)}, '{WS_RUN}'), lambda p: p <> '')"


def in_list(words_: list[str]) -> str:
    return "(" + ", ".join(lit(w) for w in words_) + ")"


def array(words_: list[str]) -> str:
    return "[" + ", ".join(lit(w) for w in words_) + "]"


def est_tokens(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, ceil(length({x}) / 4.0)) END::INT"


DOCS = "docs AS (SELECT doc_id, source AS user_id, 'doc_' || doc_id || '.txt' AS filename, text FROM documents)"

PAGES = f"""doc_lines AS (
  SELECT doc_id, user_id, filename, string_split_regex({marks('text')}, '{LINES}') AS raw FROM docs),
doc_lines2 AS (
  SELECT doc_id, user_id, filename, CASE WHEN raw[len(raw)] = '' THEN raw[1:len(raw) - 1] ELSE raw END AS ls FROM doc_lines),
pages_raw AS (
  SELECT doc_id, user_id, filename, ls, unnest(range(0, greatest(len(ls), 1), 60)) AS i FROM doc_lines2),
doc_pages AS (
  SELECT doc_id, user_id, filename, (i // 60 + 1)::INT AS page_number,
    {clean_marked(f'array_to_string(ls[i + 1:i + 60], {NL})')} AS text FROM pages_raw)"""

CHUNKS = f"""{DOCS}, {PAGES},
cuts AS (
  SELECT doc_id, user_id, filename, page_number, text,
    unnest(range(0, greatest(1, ceil((length(text) - 64) / 448.0))::BIGINT)) AS w FROM doc_pages WHERE text <> ''),
cut_texts AS (
  SELECT doc_id, user_id, filename, page_number, w, {trim('substring(text, w * 448 + 1, 512)')} AS content FROM cuts),
chunks AS (
  SELECT doc_id, user_id, filename, page_number, content, chunk_index,
    doc_id || '-' || lpad(chunk_index::VARCHAR, 6, '0') AS chunk_id
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, w) - 1 AS chunk_index
        FROM cut_texts WHERE content <> ''))"""

QUERIES = "qs AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS user_id, text FROM benchmark)"


def bm25(chunks: str, queries: str, k: int, name: str = "bm25") -> str:
    """CTEs for the best k chunks; ``chunks`` has scope, chunk_id, content and ``queries`` query_id, scope, text."""
    return f"""{name}_tok AS (SELECT scope, chunk_id, {tokens('content')} AS toks FROM {chunks}),
{name}_post AS (
  SELECT scope, chunk_id, dl, term, count(*) AS tf
  FROM (SELECT scope, chunk_id, len(toks) AS dl, unnest(toks) AS term FROM {name}_tok) GROUP BY ALL),
{name}_stat AS (SELECT scope, count(*) AS n, avg(len(toks)) AS avgdl FROM {name}_tok GROUP BY scope),
{name}_df AS (SELECT scope, term, count(*) AS df FROM {name}_post GROUP BY ALL),
{name}_q AS (
  SELECT query_id, scope, term, count(*) AS qtf
  FROM (SELECT query_id, scope, unnest({tokens('text')}) AS term FROM {queries}) GROUP BY ALL),
{name}_raw AS (
  SELECT q.query_id, p.scope, p.chunk_id,
    sum(q.qtf * greatest(0.0, ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1.0)) * (p.tf * 2.5)
        / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))) AS raw
  FROM {name}_q q JOIN {name}_post p USING (scope, term) JOIN {name}_df d USING (scope, term)
  JOIN {name}_stat s USING (scope) GROUP BY ALL),
{name}_range AS (
  SELECT query_id, round(max(raw), 9) AS hi, CASE WHEN count(*) = max(n) THEN round(min(raw), 9) ELSE 0.0 END AS lo
  FROM {name}_raw JOIN {name}_stat USING (scope) GROUP BY query_id),
{name} AS (
  SELECT query_id, chunk_id, round(raw, 9) AS raw_score,
    CASE WHEN hi > lo THEN (round(raw, 9) - lo) / (hi - lo) ELSE 1.0 END AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS rank
  FROM {name}_raw JOIN {name}_range USING (query_id) WHERE raw > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) <= {k})"""


def cosine(a: str, b: str) -> str:
    dot = f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
    norm = lambda v: f"sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[]))"
    return f"greatest(0.0, least(1.0, {dot} / ({norm(a)} * {norm(b)})))"


def vector(chunks: str, queries: str, k: int, threshold: float, name: str = "vec") -> str:
    return f"""{name}_all AS (
  SELECT q.query_id, c.chunk_id, round({cosine('q.embedding', 'c.embedding')}, 9) AS score
  FROM {queries} q JOIN {chunks} c ON q.scope = c.scope
  WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL),
{name} AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM {name}_all WHERE score >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {k})"""


# Documents as retrieval units with their vectors; query vectors are found by the item id.
UNITS = f"""{DOCS}, {QUERIES},
units AS (SELECT d.doc_id AS chunk_id, d.doc_id, d.user_id, d.text AS content, e.embedding
  FROM docs d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
uq AS (SELECT q.*, e.embedding FROM qs q LEFT JOIN embeddings e ON q.query_id = e.vec_id)"""

# Messages with an opening phrase in turn, so that the memory rules have work on these texts.
PHRASES = [
    "Please remember that ", "I prefer using ", "Always use ", "We are building ", "Our stack uses ",
    "Right now debugging ", "Remember this: never ", "",
]
EPOCH = 1704067200  # 2024-01-01
NOW = EPOCH + 7 * 86400 + 43200
_case = " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(PHRASES))
MESSAGES = f"""msgs AS (
  SELECT conv_id AS session_id, turn, role, 'src' || (conv_id % 20) AS user_id, conv_id || '-' || turn AS message_id,
    (CASE (conv_id + turn) % 8 {_case} END) || text AS text, text AS plain, {EPOCH} + conv_id * 600 + turn * 60 AS ts
  FROM conversations)"""
