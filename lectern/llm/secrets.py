"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams (lower-cased): every text that matches must
hold, for each clause, all trigrams of one of its alternatives. The index holds postings (trigram, document) for the
trigrams the rules ask for; postings are intersected per alternative and clause by aggregation. Only the documents that
are left are verified with the expression itself; rules without a mandatory trigram (``hex``) scan every text. Verified
matches are leftmost and non-overlapping within a rule. Spans are code points, end exclusive.

Results: a null text is an empty one. Every row gives one row, repeated rows too; a null id is kept. An empty table
gives an empty one. Input columns called like an output are replaced. Only JVM expressions are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` without flags; ``group`` must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
RULES = [
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    # The longest runs of 32 and more are the runs of one and more that are long enough.
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_host", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN\x20(?:RSA\x20|EC\x20|OPENSSH\x20)?PRIVATE\x20KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
BASE = ("assign", "access", "hex")
_MOST = 32  # strings followed at once; beyond it the part before is closed as a clause


def _walk(items, seen: set[str], clauses: list[list[frozenset]]) -> set[str]:
    """Strings the expression can end with so far; closed parts go to ``clauses``."""
    for op, arg in items:
        name = str(op)
        step: set[str] | None = None
        if name == "LITERAL":
            step = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            step = {chr(a).lower() for _, a in arg}
        elif name == "SUBPATTERN":
            step = _strings(arg[-1])
            if step is None:
                _close(seen, clauses)
                seen = _walk(arg[-1], {""}, clauses)
                continue
        elif name == "BRANCH":
            parts = [_strings(b) for b in arg[1]]
            step = set().union(*parts) if all(p is not None for p in parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] == 0 and arg[1] == 1:
            inner = _strings(arg[2])
            step = None if inner is None else inner | {""}
        if step is None or len(seen) * len(step) > _MOST:
            _close(seen, clauses)
            seen = {""}
            continue
        seen = {a + b for a in seen for b in step}
    return seen


def _strings(items) -> set[str] | None:
    """All strings of an expression, or nothing when they are too many."""
    clauses: list[list[frozenset]] = [[]]
    found = _walk(items, {""}, clauses)
    return found if clauses == [[]] and all(str(o) not in ("ANY",) for o, _ in items) else None


def _close(seen: set[str], clauses: list) -> None:
    """A clause: one alternative per string, unless some string is too short to hold a trigram."""
    if clauses and clauses[0] == []:
        clauses.append([])  # marks that the expression is not a plain list of strings
    if all(len(s) >= 3 for s in seen):
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in seen}
        clauses.append(sorted((g for g in grams if not any(h < g for h in grams)), key=sorted))


def trigram_query(pattern: str) -> list[list[frozenset]]:
    """Clauses that all must hold; a clause is a list of alternatives, an alternative a set of trigrams that all must occur.
    No clause means that the rule has no mandatory trigram."""
    clauses: list[list[frozenset]] = []
    _close(_walk(re._parser.parse(pattern), {""}, clauses), clauses)
    return [c for c in clauses if c]


def candidates(docs: DataFrame, key: str, text: Column, rules: list[Rule]) -> DataFrame:
    """``(key, rules)``: rules whose trigram query the document meets, by intersecting postings."""
    spark = docs.sparkSession
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in asked.values() for c in q for a in c for g in a})
    if not grams:
        return spark.createDataFrame([], T.StructType([docs.schema[key], T.StructField("rules", T.ArrayType(T.StringType()))]))
    low = docs.select(F.col(key), F.lower(text).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    postings = low.select(key, F.explode(held).alias("gram"))
    at = {g: i for i, g in enumerate(grams)}
    wanted = [
        (at[g], kind, len(q), c, a, len(alt))
        for kind, q in asked.items() for c, clause in enumerate(q) for a, alt in enumerate(clause) for g in sorted(alt)
    ]
    # As many rows as the rules have trigrams.
    terms = F.broadcast(spark.createDataFrame(wanted, "gram int, kind string, n_clauses int, clause int, alternative int, n_grams int"))
    met = (
        postings.join(terms, "gram").groupBy(key, "kind", "n_clauses", "clause", "alternative", "n_grams")
        .agg(F.count_distinct("gram").alias("n")).where("n = n_grams")
    )
    return (
        met.groupBy(key, "kind", "n_clauses").agg(F.count_distinct("clause").alias("n")).where("n = n_clauses")
        .groupBy(key).agg(F.sort_array(F.collect_set("kind")).alias("rules"))
    )


def _spans(text: Column, rule: Rule) -> Column:
    """Verified matches of one rule: the pieces between matches give the positions."""
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
    )
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def step(acc, m):
        begin = acc["at"] + F.length(m["gap"])
        end = begin + F.length(m["all"])
        one = F.array(F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), end.alias("end")))
        kept = F.when(F.length(m["value"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.coalesce(kept, acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """All input columns and ``secrets``: the spans of all rules by start, then rule."""
    out = "secrets"
    own = [c for c in docs.columns if c != out]
    # Equal rows share a key and a result; a rare collision only adds candidates.
    keyed = docs.select(*own, text_of(text).alias("_llm_t")).withColumn(
        "_llm_key", F.xxhash64(F.col("_llm_t"), F.length("_llm_t"))
    )
    found = candidates(keyed.select("_llm_key", "_llm_t"), "_llm_key", F.col("_llm_t"), rules)
    d = keyed.join(found.withColumnRenamed("_llm_key", "_llm_k").withColumnRenamed("rules", "_llm_rules"), F.col("_llm_key") == F.col("_llm_k"), "left")
    t = F.col("_llm_t")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    parts = []
    for r in rules:
        on = F.lit(True) if not trigram_query(r.pattern) else F.coalesce(F.array_contains("_llm_rules", r.kind), F.lit(False))
        parts.append(F.when(on & t.rlike(r.pattern), _spans(t, r)).otherwise(none))
    number = {r.kind: i for i, r in enumerate(rules)}
    place = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in number.items() for v in kv]), x["kind"])
    ordered = F.transform(
        F.sort_array(F.transform(F.concat(*parts), lambda x: F.struct(x["start"].alias("start"), place(x).alias("no"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    return d.select(*own, ordered.alias(out))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
