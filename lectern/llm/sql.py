"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from lectern.llm import quality as Q
from lectern.llm import secrets as S

_WORD = r"[^\x20\x09-\x0D]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secrets_sql() -> str:
    one = []
    for no, r in enumerate(S.RULES):
        p = _q(r.pattern)
        one.append(
            f"SELECT doc_id, {no} AS no, {_q(r.kind)} AS kind, {r.least} AS least, "
            f"unnest(string_split_regex(t, {p})[:len(regexp_extract_all(t, {p}))]) AS gap, "
            f"unnest(regexp_extract_all(t, {p}, 0)) AS hit, unnest(regexp_extract_all(t, {p}, {r.group})) AS val, "
            f"unnest(range(len(regexp_extract_all(t, {p})))) AS i FROM d"
        )
    base = ", ".join(_q(k) for k in S.BASE)
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(one)}),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, no ORDER BY i) AS e0 FROM m),
s AS (SELECT doc_id, no, kind, CAST(e0 - length(hit) AS BIGINT) AS s, CAST(e0 AS BIGINT) AS e FROM p WHERE length(val) >= least)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce({text} FILTER (WHERE kind IN ({base})), '')) AS base_sha256, coalesce({text}, '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


def quality_sql() -> str:
    b = r"[\x20\x09-\x0D]"
    few = lambda n: _q(rf"^{b}*(?:[^\x20\x09-\x0D]+(?:{b}+|\z)){{0,{n}}}\z")
    nav, boiler = "(?:" + "|".join(Q.NAVIGATION) + ")", "(?:" + "|".join(Q.BOILERPLATE) + ")"
    ends = _q(r"[.!?…:;。！？][\"'”’»)\]]*" + b + r"*\z")
    mark = r"(?:[#*$%&|<>]|!!)"
    marks = _q(rf"(?:[^\x20\x09-\x0D]*{mark}[.,!]*{b}+){{3}}[^\x20\x09-\x0D]*{mark}")
    nav_re = _q(rf"(?i)(?:^|[^A-Za-z]){nav}(?:[^A-Za-z]|\z)")
    fails = f"""(NOT regexp_matches(x, {ends}) AND regexp_matches(x, {few(2)})) OR regexp_matches(x, {marks})
      OR regexp_matches(x, {_q(rf'(?:[^|]{{1,40}}[|]{b}*){{3}}')})
      OR (regexp_matches(x, {few(4)}) AND regexp_matches(x, {nav_re}))
      OR regexp_matches(x, {_q('(?i)' + boiler)}) OR regexp_matches(x, '[{{}}]')
      OR len(list_filter(range(1, greatest(len(lw) - 2, 1)), lambda k: lw[k] = lw[k+1] AND lw[k] = lw[k+2] AND lw[k] = lw[k+3])) > 0"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
gg AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS gram FROM g),
r AS (SELECT doc_id, i FROM gg QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2),
n AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS rep FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
lw AS (SELECT doc_id, x, regexp_extract_all(x, '{_WORD}') AS lw FROM l),
lines AS (SELECT doc_id, x, len(lw) AS n, ({fails}) AND len(lw) > 0 AS bad FROM lw),
ls AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT x) FILTER (WHERE n > 0) AS dup, coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS left_ FROM lines GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, left_ FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ls USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND left_ >= 0.5 * n_words AS kept
FROM m"""


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
# The CRC of a text bit by bit; only its parity is asked for.
_CRC_ODD = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), repeat([0::BIGINT], 8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) & 1"
)

MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER () AS row_no,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM (
    SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
      CASE WHEN doc_id IS NOT NULL AND {_CRC_ODD} = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS tampered
    FROM documents
  )
), low AS (
  SELECT 0 AS height, tree, node, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT height + 1, tree, node // 3, sha256(string_agg(digest, '' ORDER BY node)), (any_value(n) + 2) // 3
  FROM low WHERE n > 1 GROUP BY height, tree, node // 3
), subroots AS (SELECT tree, digest, height FROM low WHERE n = 1
), high AS (
  SELECT 0 AS height, tree AS node, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT height + 1, node // 3, sha256(string_agg(digest, '' ORDER BY node)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY height, node // 3
), steps AS (
  SELECT row_no, low.height, low.node, low.digest, low.node < leaves.node // pow(3, low.height)::BIGINT AS is_left
  FROM leaves JOIN low ON low.tree = leaves.tree AND low.node // 3 = leaves.node // pow(3, low.height + 1)::BIGINT
    AND low.node <> leaves.node // pow(3, low.height)::BIGINT
  UNION ALL
  SELECT row_no, 1000 + high.height, high.node, high.digest, high.node < tree // pow(3, high.height)::BIGINT
  FROM leaves JOIN high ON high.node // 3 = tree // pow(3, high.height + 1)::BIGINT AND high.node <> tree // pow(3, high.height)::BIGINT
), levels AS (
  -- A run of one node is hashed, too, so every level below a root counts.
  SELECT row_no, height, row_number() OVER (PARTITION BY row_no ORDER BY height) AS step FROM (
    SELECT row_no, unnest(range(subroots.height)) AS height FROM leaves JOIN subroots USING (tree)
    UNION ALL SELECT row_no, 1000 + unnest(range((SELECT max(height) FROM high))) FROM leaves
  )
), sides AS (
  SELECT row_no, step, coalesce(string_agg(digest, '' ORDER BY node) FILTER (is_left), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY node) FILTER (NOT is_left), '') AS r
  FROM levels LEFT JOIN steps USING (row_no, height) GROUP BY row_no, step
), folds AS (
  SELECT row_no, 0::BIGINT AS step, tampered AS d FROM leaves
  UNION ALL
  SELECT folds.row_no, sides.step, sha256(l || d || r) FROM folds JOIN sides ON sides.row_no = folds.row_no AND sides.step = folds.step + 1
), proofs AS (SELECT row_no, string_agg(digest, '' ORDER BY height, node) AS proof FROM steps GROUP BY row_no)
SELECT doc_id, leaf, subroots.digest AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) LEFT JOIN proofs USING (row_no)
JOIN (SELECT row_no, arg_max(d, step) AS folded_root FROM folds GROUP BY row_no) USING (row_no)
CROSS JOIN (SELECT digest AS root FROM high WHERE n = 1)
"""
