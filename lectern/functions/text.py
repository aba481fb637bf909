"""Text expressions. All stay in the JVM except the compatibility normalisation of unusual characters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import fixed_values as V

# What str.strip() removes in Python.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
PY_SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Printable ASCII is passed over by the first test.
LINE_BREAK = r"(?![ -~])(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|[^\x00-\x7f](?<=[\x85\u2028\u2029]))"
# The same sets for scanning: single Latin-1 characters first, the rest only for characters past ASCII.
_WIDE_SPACE = r"[[^\x00-\x7f]&&[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_LINE_SPACE = rf"(?:[\t\x1f\x20]|(?![\u2028\u2029\x85]){_WIDE_SPACE})*"
_LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|[[^\x00-\x7f]&&[\x85\u2028\u2029]])"
# Runs of white space other than one plain blank, which need no change to become one blank.
_SPACE_RUN = rf"(?![!-~])(?: (?=[{PY_SPACE_CLASS}])[{PY_SPACE_CLASS}]+|[{PY_SPACE_CLASS}&&[^ ]][{PY_SPACE_CLASS}]*)"
WORD = r"[\p{L}\p{N}_]"

# Characters that compatibility normalisation leaves alone when no combining mark is present, plus
# the ones the replacement table maps to the same result. Anything else goes to unicodedata.
_STABLE = (
    r"\x00-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    r"\u0400-\u0482\u048a-\u052f\u2010\u2012-\u2016\u2018-\u201f\u2026\u200b-\u200d\ufeff\u20ac"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
)


# Of these, the characters that no step of the cleaning changes and no line ends at, with printable ASCII and the line feed.
_PLAIN = (
    r"[ -~[\n\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    r"\u0400-\u0482\u048a-\u052f\u2010\u2012\u2015\u2016\u201a\u201b\u201e\u201f\u20ac"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]]"
)


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once, although ``body`` uses it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def trim_py(c: str | Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.btrim(as_col(c), F.lit(PY_SPACE))


def trim_ends(c: Column) -> Column:
    """As :func:`trim_py`, for texts that mostly need none: only the two outer characters are looked at first."""
    blank = F.contains(F.lit(PY_SPACE), F.substring(c, 1, 1)) | F.contains(F.lit(PY_SPACE), F.substring(c, -1, 1))
    return F.when(blank, trim_py(c)).otherwise(c)


def is_plain(c: str | Column) -> Column:
    """Whether a text has usual characters alone: it is normalised as it is, its lines end at line feeds, and of its white
    space only runs and places may change. A single pass; null for a null text."""
    return as_col(c).rlike(rf"\A{_PLAIN}*+\z")


def normalize_unicode(c: str | Column, nfkc: bool = True, plain: Column | None = None) -> Column:
    """Compatibility-normalise, then replace typographic marks.

    Only rows that hold a character outside the stable ranges are sent to Python; every other row
    passes a null through the Arrow batch. Rows known to be ``plain`` are not searched.
    """
    c = as_col(c)
    if plain is not None:
        odd = F.when(F.coalesce(plain, F.lit(False)), None).otherwise(c)
        return F.coalesce(normalize_unicode(odd, nfkc), c)
    if nfkc:
        # The cheap first class skips ASCII; only other characters are looked up in the ranges.
        c = F.coalesce(_nfkc(F.when(c.rlike(f"[^\\x00-\\x7f](?<![{_STABLE}])"), c)), c)
    marks = r"[^\x00-\x7f](?<=[" + "".join(V.CHAR_REPLACEMENTS) + "])"

    def replace_marks(t: Column) -> Column:
        out = t
        for result in dict.fromkeys(V.CHAR_REPLACEMENTS.values()):
            group = "".join(k for k, v in V.CHAR_REPLACEMENTS.items() if v == result)
            out = F.regexp_replace(out, f"[{group}]", result)
        return F.when(t.rlike(marks), out).otherwise(t)

    return let(c, replace_marks)


def strip_control(c: str | Column) -> Column:
    return F.regexp_replace(as_col(c), "(?![ -~])" + V.CONTROL_CHARS, "")


def clean_whitespace(c: str | Column) -> Column:
    """One space for blanks, at most one empty line, no white space around line ends."""
    c = F.regexp_replace(as_col(c), r"[ \t]{2,}|\t", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return trim_py(F.regexp_replace(c, f"{_LINE_SPACE}{_LINE_END}{_LINE_SPACE}", "\n"))


# Control characters, tabs and white space other than the blank and the line feed. Printable ASCII is
# passed over by the first class.
_ODD = r"[^ -~\n](?<=[\x00-\x1f\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])"


def _may_change(t: Column, plain: Column | None = None) -> Column:
    """False only where the two cleaning steps change nothing but the ends of the text."""
    runs = [F.contains(t, F.lit(s)) for s in ("  ", " \n", "\n ", "\n\n\n")]
    odd = t.rlike(_ODD) if plain is None else ~F.coalesce(plain, F.lit(False)) & t.rlike(_ODD)
    return runs[0] | runs[1] | runs[2] | runs[3] | odd


def clean_marked(c: str | Column, plain: Column | None = None) -> Column:
    """Control characters and white space of a text whose characters are already normalised. Texts with
    nothing to change, the usual case, are only searched; ``plain`` ones (:func:`is_plain`) for blanks and line feeds alone."""

    def steps(t: Column) -> Column:
        return F.when(_may_change(t, plain), clean_whitespace(strip_control(t))).otherwise(trim_ends(t))

    return let(as_col(c), steps)


def clean(c: str | Column, nfkc: bool = True) -> Column:
    return clean_marked(normalize_unicode(c, nfkc))


def split_lines(c: str | Column, plain: Column | None = None) -> Column:
    """Lines without their ends; a final line end opens no extra line, the empty text has none. Those of a ``plain`` text
    (:func:`is_plain`) end at line feeds alone."""
    parts = F.split(as_col(c), LINE_BREAK, -1)
    return let(
        parts if plain is None else F.when(plain, F.split(as_col(c), "\n", -1)).otherwise(parts),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def tokenize(c: str | Column) -> Column:
    """Lower-case ASCII words that touch no other letter or digit."""
    c = as_col(c)
    # The first test passes over all places but those a word may begin at; in ASCII no other letter can touch one.
    pattern = f"(?=[a-z0-9_])(?<!{WORD})[a-z0-9_]++(?!{WORD})"
    found = [F.regexp_extract_all(F.lower(c), F.lit(p), F.lit(0)) for p in ("[a-z0-9_]++", pattern)]
    return F.when(F.octet_length(c) == F.length(c), found[0]).otherwise(found[1])


def word_set(c: str | Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(as_col(c)), F.lit(f"{WORD}+"), F.lit(0)))


def _listed(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def memory_tokens(c: str | Column) -> Column:
    kept = F.filter(word_set(c), lambda w: F.length(w) > 1)
    return F.array_except(kept, _listed(V.MEMORY_STOPWORDS))


def extract_keywords(c: str | Column) -> Column:
    """Words with inner dots and dashes, longer than two characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"(?U)\b[a-z0-9_\-.]+\b"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(V.KEYWORD_STOPWORDS))


def normalize_query(c: str | Column) -> Column:
    stripped = F.regexp_replace(as_col(c), V.QUERY_CONTROL_CHARS, "")
    return trim_py(F.regexp_replace(stripped, _SPACE_RUN, " "))


def dedup_key(c: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(as_col(c)), _SPACE_RUN, " "))


def est_tokens(c: str | Column) -> Column:
    n = F.length(as_col(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4.0))).cast("int")


def chunk_tokens(c: str | Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(as_col(c)) / 4)).cast("int")


def preview(c: str | Column, n: int = 250, dots: bool = True) -> Column:
    c = as_col(c)
    head = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(head, F.lit("..."))).otherwise(c) if dots else head


def words(c: str | Column) -> Column:
    """Pieces between runs of white space; none for a blank text."""
    t = trim_py(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{PY_SPACE_CLASS}]+"))


def session_title(c: str | Column, n: int = 5) -> Column:
    w = words(c)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, "...").otherwise(""))


def truncate_cache(c: str | Column, n: int = 4000) -> Column:
    c = as_col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(V.CACHE_TRUNCATED))).otherwise(c)


def mask_error(c: str | Column) -> Column:
    c = as_col(c)
    for pattern, mark in V.ERROR_MASKS:
        c = F.regexp_replace(c, pattern, mark)
    return c


def word_count(c: str | Column) -> Column:
    return F.greatest(F.lit(1), F.size(words(c)))


def byte_size(c: str | Column) -> Column:
    return F.octet_length(as_col(c))


def sanitize_filename(c: str | Column) -> Column:
    """Base name with safe characters only, never empty and never hidden."""
    c = F.element_at(F.split(F.replace(as_col(c), F.lit("\\"), F.lit("/")), "/"), -1)
    c = F.regexp_replace(trim_py(c), f"[{PY_SPACE_CLASS}]+", "_")
    c = F.regexp_replace(c, r"[^a-zA-Z0-9_.-]", "")
    # Removing pairs of dots until none is left keeps one dot of every odd run and none of an even one.
    c = F.regexp_replace(c, r"(?:\.\.)+", "")
    return F.when((c == "") | c.startswith("."), F.concat(F.lit("doc_"), c)).otherwise(c)


def file_extension(c: str | Column) -> Column:
    """Lower-case suffix of the base name with its dot, or the empty text."""
    return F.lower(F.regexp_extract(as_col(c), r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))


def any_pattern(c: str | Column, patterns: list[str], flags: str = "") -> Column:
    """True when one of the patterns is found; a single scan of the text."""
    return as_col(c).rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def capitalize(c: str | Column) -> Column:
    c = as_col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def cited_sources(c: str | Column) -> Column:
    """Distinct ``[Source n]`` numbers in rising order."""
    found = F.regexp_extract_all(as_col(c), F.lit(r"\[Source (\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: s.cast("bigint"))))


def is_sensitive(key: str) -> bool:
    return any(s in key.lower() for s in V.SENSITIVE_KEYS)


SENSITIVE_PATTERN = "|".join(re.escape(s) for s in V.SENSITIVE_KEYS)
