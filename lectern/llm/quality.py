"""Quality rules, line first: lines that fail a rule are removed, then documents that lost too much are rejected.

A line with a word fails when it
* breaks the punctuation rule: no sentence mark at its end and fewer than ``min_words`` words, marks such as ``###`` or
  ``!!`` on four words in a row, or one word four times in a row,
* is a navigation line: at most ``nav_words`` words of which one is a navigation word, or a row of entries between bars,
* is boilerplate: it holds one of the phrases below, or a brace.
Lines without a word are left as they are. The document is rejected when it fails the base rules or when fewer than
``keep_share`` of its words are left.

Results: a null text is an empty one and fails the base rules (fewer than ten words), as does a text of blanks only.
Every row gives one row, repeated rows give repeated rows, an empty table an empty one. Only JVM expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import split_words, text_of, word_count

NAVIGATION = ["home", "menu", "login", "logout", "register", "next", "previous", "contact", "sitemap", "search", "share", "subscribe"]
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript",
    "click here", "read more", "lorem ipsum", "powered by",
]
NGRAM = 5
# Positions take the low bits of a sorted number, a part of the hash the high ones.
_BITS = 28
_MASK = (1 << _BITS) - 1


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


_BLANK = r"[\x20\x09-\x0D]"


def _at_most(n: int) -> str:
    """Pattern of a line with at most ``n`` words."""
    return rf"^{_BLANK}*+(?:[^\x20\x09-\x0D]++(?:{_BLANK}++|\z)){{0,{n}}}\z"


def _gates(text: Column) -> Column:
    """Which of the slow rules some line of a text can fail at all, told by plain searches over the whole text."""
    low = F.lower(text)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(p))
    brace = F.contains(text, F.lit("{")) | F.contains(text, F.lit("}"))
    return F.struct(
        text.rlike(r"[#*$%&|<>]|!!").alias("marks"), F.contains(text, F.lit("|")).alias("bars"), (phrase | brace).alias("boiler")
    )


def line_fails(line: Column, gates: Column | None = None, min_words: int = 3, nav_words: int = 4) -> Column:
    """True for a line that holds a word and fails a rule. With the ``gates`` of its text, rules that no line of the text
    can fail are not tried; the answer is the same."""
    gate = lambda name: F.lit(True) if gates is None else gates[name]
    ends = line.rlike(rf"[.!?…:;。！？][\"'”’»)\]]*{_BLANK}*\z")
    fragment = line.rlike(_at_most(min_words - 1)) & ~ends
    # Four words in a row with a mark that prose does not hang on words, or one word four times over.
    marks = gate("marks") & line.rlike(rf"(?:[^\x20\x09-\x0D]*(?:[#*$%&|<>]|!!)[.,!]*{_BLANK}++){{3}}[^\x20\x09-\x0D]*(?:[#*$%&|<>]|!!)")
    bars = gate("bars") & line.rlike(rf"(?:[^|\n]{{1,40}}\|{_BLANK}*+){{3}}")
    again = line.rlike(rf"(?:^|{_BLANK})([^\x20\x09-\x0D]++)(?:{_BLANK}++\1(?={_BLANK}|\z)){{3}}")
    nav = line.rlike(_at_most(nav_words)) & line.rlike(rf"(?i)(?:^|[^A-Za-z]){_any(NAVIGATION)}(?:[^A-Za-z]|\z)")
    boiler = gate("boiler") & (line.rlike(rf"(?i){_any(BOILERPLATE)}") | line.rlike(r"[{}]"))
    return line.rlike(r"[^\x20\x09-\x0D]") & (fragment | marks | bars | again | nav | boiler)


def clean_lines(text: Column, gates: Column | None = None, **rules) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~line_fails(x, gates, **rules)), "\n")


def _windows(words: str) -> Column:
    """All windows of a text as sorted numbers: a part of the window's hash, then its position."""
    w = F.col(words)
    starts = F.when(F.size(w) >= NGRAM, F.sequence(F.lit(0), F.size(w) - NGRAM)).otherwise(F.array().cast("array<int>"))
    hashed = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(NGRAM)])
    return F.sort_array(
        F.transform(starts, lambda i: hashed(i).bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("bigint")))
    )


def _beside_equal(column: str, value) -> Column:
    """Elements of a sorted array that equal a neighbour in ``value``. Equal window hashes are candidates only; the second
    pass compares the words, so the answer is exact whatever the hash does."""
    a = F.col(column)
    return F.filter(
        a,
        lambda x, i: F.coalesce(value(F.get(a, i - 1)) == value(x), F.lit(False))
        | F.coalesce(value(F.get(a, i + 1)) == value(x), F.lit(False)),
    )


def measures(docs: DataFrame, text: str = "text", keep_share: float = 0.5, **rules) -> DataFrame:
    """All input columns and ``clean_text`` with the measures, ``base_failed``, ``kept_share`` and ``kept``."""
    own = docs.columns
    t, w, at = F.col("_llm_t"), F.col("_llm_w"), F.col("_llm_i")
    d = docs.withColumn("_llm_t", text_of(text))
    d = d.withColumn("_llm_w", split_words(t)).withColumn("_llm_s", _windows("_llm_w"))
    place = lambda x: x.bitwiseAND(F.lit(_MASK)).cast("int")
    d = d.withColumn(
        "_llm_c",
        F.sort_array(F.transform(
            _beside_equal("_llm_s", lambda x: F.shiftright(x, _BITS)),
            lambda x: F.struct(F.array_join(F.slice(w, place(x) + 1, NGRAM), " ").alias("g"), place(x).alias("i")),
        )),
    )
    d = d.withColumn("_llm_i", F.sort_array(F.transform(_beside_equal("_llm_c", lambda x: x["g"]), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(NGRAM), F.coalesce(F.get(at, i + 1) - x, F.lit(NGRAM))).cast("bigint")),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    )
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_llm_lines", lines).withColumn("_llm_gates", _gates(t))
    d = d.withColumn("_llm_clean", clean_lines(t, F.col("_llm_gates"), **rules))
    d = d.select(
        *own,
        F.size(w).cast("bigint").alias("_n"),
        F.length(F.array_join(w, "")).cast("bigint").alias("_wc"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("bigint").alias("_sym"),
        (F.size("_llm_lines") - F.size(F.array_distinct("_llm_lines"))).cast("bigint").alias("_dup"),
        covered.alias("_rep"), F.col("_llm_clean").alias("_clean"), word_count(F.col("_llm_clean")).alias("_left"),
    )
    failed = (F.col("_n") < 10) | (100 * F.col("_rep") > 20 * F.col("_n"))
    share = F.when(F.col("_n") == 0, 0.0).otherwise(F.col("_left") / F.col("_n"))
    named = {
        "n_words": F.col("_n"), "word_chars": F.col("_wc"), "n_symbols": F.col("_sym"), "n_dup_lines": F.col("_dup"),
        "n_repeat_words": F.col("_rep"), "base_failed": failed, "kept": ~failed & (share >= keep_share), "kept_share": share,
        "clean_text": F.col("_clean"),
    }
    return d.select(*[c for c in own if c not in named], *[v.alias(k) for k, v in named.items()])
