"""Content rules as a table.

A row of the table is one pattern of a rule: ``rule_no`` (the order of rules; patterns of one number are one rule),
``rule_name, policy, reason, severity, pattern`` (matched against the lower-cased text where ``fold``), ``replacement`` (what a
MEDIUM rule puts for its matches) and ``literals``: lower-case texts of which every match holds at least one, or null.

All literals together are one search over a text. What it finds joins by equality with the patterns that have it; the
regex of a pattern runs on these texts alone, and on every text for patterns without literals. An optional scorer adds a
rule of its own; where it fails it gives an error for the row, which the guard's switches then decide on.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.operators import guard as G

SCHEMA = (
    "rule_no int, rule_name string, policy string, reason string, severity string, pattern string, fold boolean, "
    "replacement string, literals array<string>"
)
SHORTEST = 3
# Literals of a table that one search may look for; they are its settings, not data.
MOST_LITERALS = 20_000


def required_literals(pattern: str) -> list[str] | None:
    """Literals of which every match of a (lower-case) pattern holds at least one; null where none is sure."""
    from re import _constants as C
    from re import _parser as P

    def best(items) -> set[str] | None:
        options, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is C.LITERAL:
                run += chr(value)
                continue
            if len(run) >= SHORTEST:
                options.append({run.lower()})
            run = ""
            inner = None
            if op is C.SUBPATTERN:
                inner = best(value[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
                inner = best(value[2])
            elif op is C.BRANCH:
                parts = [best(branch) for branch in value[1]]
                inner = None if any(p is None for p in parts) else set().union(*parts)
            if inner:
                options.append(inner)
        return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)

    found = best(P.parse(pattern))
    return sorted(found) if found else None


def default_rules(spark: SparkSession, stage: str = "input", introduction: str | None = None) -> DataFrame:
    """The guard's own rules of a stage as a table."""
    pii = [(V.SSN_PATTERN, V.SSN_MARK), (V.CARD_PATTERN, V.CARD_MARK)]
    if stage == "input":
        groups = [(V.RULE_INJECTION, "CRITICAL", V.INJECTION_PATTERNS), (V.RULE_TOPIC_INPUT, "HIGH", V.TOPIC_PATTERNS)]
        last = V.RULE_PII_INPUT
    else:
        leaks = [re.escape(p.lower()) for p in ([introduction] if introduction else []) + V.LEAK_PHRASES]
        groups = [(V.RULE_LEAK, "CRITICAL", leaks), (V.RULE_TOPIC_OUTPUT, "CRITICAL", V.TOPIC_PATTERNS)]
        last = V.RULE_PII_OUTPUT
    rows = [
        (no, name, policy, reason, severity, "(?U)" + p, True, None, required_literals(p))
        for no, ((name, policy, reason), severity, patterns) in enumerate(groups) for p in patterns
    ]
    rows += [(len(groups), last[0], last[1], last[2], "MEDIUM", "(?U)" + p, False, mark, None) for p, mark in pii]
    return spark.createDataFrame(rows, SCHEMA)


def _anchors(rules: DataFrame) -> list[str]:
    """Literals that no other one is the beginning of: at a place where a longer one stands, its anchor stands, too."""
    rows = rules.select(F.explode("literals").alias("l")).distinct().limit(MOST_LITERALS + 1).collect()
    if len(rows) > MOST_LITERALS:
        raise ValueError(f"a table of rules holds at most {MOST_LITERALS} literals")
    out: list[str] = []
    for literal in sorted(r["l"] for r in rows):
        if not out or not literal.startswith(out[-1]):
            out.append(literal)
    return out


def _quoted(literal: str) -> str:
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def matches(rows: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """``key, rule_no`` and the rule's columns of every pattern that matches a row's text."""
    anchors = _anchors(rules)
    slim = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.lower(F.col(text)).alias("_lower")).where("_text IS NOT NULL")
    always = rules.where("literals IS NULL").withColumn("_anchor", F.lit(""))
    if anchors:
        # A zero-width search finds one anchor at every place, overlapping ones too.
        search = "(?=(" + "|".join(map(_quoted, anchors)) + "))"
        found = F.array_distinct(F.regexp_extract_all("_lower", F.lit(search), F.lit(1)))
        by = rules.select("*", F.explode("literals").alias("_literal"))
        table = rows.sparkSession.createDataFrame([(a,) for a in anchors], "_anchor string")
        # As literals are sorted, a literal's anchor is the one it begins with.
        prefixes = by.withColumn("_n", F.explode(F.sequence(F.lit(SHORTEST), F.length("_literal"))))
        prefixes = prefixes.withColumn("_anchor", F.substring("_literal", F.lit(1), F.col("_n")))
        some = prefixes.join(table, "_anchor", "left_semi").drop("_literal", "_n").dropDuplicates(["_anchor", "rule_no", "pattern"])
        always = some.unionByName(always)
        found = F.concat(found, F.array(F.lit("")))
    else:
        found = F.array(F.lit(""))
    near = slim.withColumn("_anchor", F.explode(found)).join(always, "_anchor")
    hit = F.when(F.col("fold"), F.rlike("_lower", F.col("pattern"))).otherwise(F.rlike("_text", F.col("pattern")))
    return near.where(hit).select(F.col("_key").alias(key), *[c for c in rules.columns if c != "literals"]).distinct()


def guard(
    rows: DataFrame, rules: DataFrame, key: str, text: str = "text", stage: str = "input", sanitized_reason: str = V.SANITIZED_INPUT,
    scorer: Callable[[Column], tuple[Column, Column]] | None = None, threshold: float = 0.5,
    scorer_rule: tuple[str, str, str, str] = ("classifier", "safety/classifier", "Text was rejected by the classifier", "HIGH"),
) -> DataFrame:
    """Rows with ``violations, decision, reason, policy, sanitized_text`` by a table of rules; ``key`` is unique.

    ``scorer`` maps the text to a score and an error, both columns; a score of ``threshold`` or more violates ``scorer_rule``
    after all rules of the table. With a scorer the rows have a column ``error``, for :func:`guard.with_policy`.
    """
    hits = matches(rows, rules, key, text)
    violation = F.struct("rule_name", F.lit(stage).alias("stage"), "reason", "policy", "severity")
    marks = F.filter(
        F.array_sort(F.collect_set(F.struct("rule_no", "pattern", "replacement", "severity"))), lambda m: (m["severity"] == "MEDIUM") & m["replacement"].isNotNull()
    )
    per = hits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("rule_no", violation.alias("v")))).alias("_v"), marks.alias("_marks"))
    out = rows.join(per.withColumnRenamed(key, "_rule_key"), F.col(key) == F.col("_rule_key"), "left").drop("_rule_key")
    none = F.array().cast(per.schema["_v"].dataType)
    violations = F.transform(F.coalesce("_v", none), lambda x: x["v"])
    if scorer is not None:
        score, error = scorer(F.col(text))
        out = out.withColumn("error", error).withColumn("_score", score)
        name, policy, reason, severity = scorer_rule
        own = F.struct(
            F.lit(name).alias("rule_name"), F.lit(stage).alias("stage"), F.lit(reason).alias("reason"), F.lit(policy).alias("policy"), F.lit(severity).alias("severity")
        )
        violations = F.concat(violations, F.array_compact(F.array(F.when(F.col("error").isNull() & (F.col("_score") >= threshold), own))))
    clean = F.aggregate(
        F.coalesce("_marks", F.array().cast(per.schema["_marks"].dataType)), F.col(text), lambda t, m: F.regexp_replace(t, m["pattern"], m["replacement"])
    )
    out = out.withColumn("violations", violations).withColumn("_clean", clean).drop("_v", "_marks", "_score")
    return G.conclude(out, text, sanitized_reason)
