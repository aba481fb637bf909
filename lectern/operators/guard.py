"""Content rules for inputs, retrieved contexts and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import text as tx
from lectern.functions.text import as_col

_U = "(?U)"


def scan_injection(text: str | Column) -> Column:
    return tx.any_pattern(F.lower(as_col(text)), V.INJECTION_PATTERNS, _U)


def scan_topics(text: str | Column) -> Column:
    return tx.any_pattern(F.lower(as_col(text)), V.TOPIC_PATTERNS, _U)


def has_pii(text: str | Column) -> Column:
    return tx.any_pattern(text, [V.SSN_PATTERN, V.CARD_PATTERN], _U)


def redact_pii(text: str | Column) -> Column:
    c = F.regexp_replace(as_col(text), _U + V.SSN_PATTERN, V.SSN_MARK)
    return F.regexp_replace(c, _U + V.CARD_PATTERN, V.CARD_MARK)


def _violation(rule: tuple[str, str, str], stage: str, severity: str) -> Column:
    name, policy, reason = rule
    return F.struct(
        F.lit(name).alias("rule_name"), F.lit(stage).alias("stage"), F.lit(reason).alias("reason"),
        F.lit(policy).alias("policy"), F.lit(severity).alias("severity"),
    )


def _decide(df: DataFrame, text: str, rules: list, sanitized_reason: str) -> DataFrame:
    """Decision from ordered rules ``(condition, violation)``; the last one is the redaction."""
    found = F.array_compact(F.array(*[F.when(cond, v) for cond, v in rules]))
    out = df.withColumn("violations", found).withColumn(
        "_clean", F.when(F.exists("violations", lambda v: v["severity"] == "MEDIUM"), redact_pii(text)).otherwise(F.col(text))
    )
    return conclude(out, text, sanitized_reason)


def conclude(out: DataFrame, text: str, sanitized_reason: str) -> DataFrame:
    """Decision, reason, policy and sanitized text of rows with ``violations`` and the redacted text ``_clean``."""
    block = F.exists("violations", lambda v: v["severity"].isin("CRITICAL", "HIGH"))
    first = F.try_element_at("violations", F.lit(1))
    changed = F.col("_clean") != F.col(text)
    return (
        out.withColumn("decision", F.when(block, "BLOCK").when(changed, "SANITIZE").otherwise("ALLOW"))
        .withColumn(
            "reason",
            F.when(F.col("decision") == "BLOCK", first["reason"]).when(F.col("decision") == "SANITIZE", sanitized_reason),
        )
        .withColumn(
            "policy",
            F.when(F.col("decision") == "BLOCK", first["policy"]).when(F.col("decision") == "SANITIZE", V.PII_POLICY),
        )
        .withColumn("sanitized_text", F.when(F.col("decision") == "SANITIZE", F.col("_clean")))
        .drop("_clean")
    )


def guard_input(df: DataFrame, text: str = "text") -> DataFrame:
    rules = [
        (scan_injection(text), _violation(V.RULE_INJECTION, "input", "CRITICAL")),
        (scan_topics(text), _violation(V.RULE_TOPIC_INPUT, "input", "HIGH")),
        (has_pii(text), _violation(V.RULE_PII_INPUT, "input", "MEDIUM")),
    ]
    return _decide(df, text, rules, V.SANITIZED_INPUT)


def guard_output(df: DataFrame, text: str = "text", introduction: str | None = None) -> DataFrame:
    """``introduction`` is the product's own opening phrase, which must not leak."""
    phrases = ([introduction] if introduction else []) + V.LEAK_PHRASES
    lower = F.lower(F.col(text))
    leak = F.lit(False)
    for p in phrases:
        leak = leak | F.contains(lower, F.lit(p.lower()))
    rules = [
        (leak, _violation(V.RULE_LEAK, "output", "CRITICAL")),
        (scan_topics(text), _violation(V.RULE_TOPIC_OUTPUT, "output", "CRITICAL")),
        (has_pii(text), _violation(V.RULE_PII_OUTPUT, "output", "MEDIUM")),
    ]
    return _decide(df, text, rules, V.SANITIZED_OUTPUT)


def context_violations(contexts: DataFrame, caller: str = "caller_id", owner: str = "user_id") -> DataFrame:
    """Violations of context rows ``(query_id, idx, content, owner, caller)``, one row each."""
    idx = F.col("idx").cast("string")
    lower = F.lower(F.col("content"))
    indirect = F.lit(False)
    for p in V.INDIRECT_PHRASES:
        indirect = indirect | F.contains(lower, F.lit(p))
    foreign = F.coalesce(F.col(owner).cast("string") != F.col(caller).cast("string"), F.lit(False))

    def row(order: int, rule: tuple[str, str], words: tuple[str, str], extra: bool) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(order).alias("rule_order"), F.lit(rule[0]).alias("rule_name"),
            F.concat(F.lit(words[0]), idx, F.lit(words[1])).alias("reason"), F.lit(rule[1]).alias("policy"),
            F.lit("CRITICAL").alias("severity"),
            (F.col(caller).cast("string") if extra else none).alias("expected_user"),
            (F.col(owner).cast("string") if extra else none).alias("found_user"),
        )

    found = F.array_compact(
        F.array(
            F.when(foreign, row(0, V.RULE_FOREIGN, V.FOREIGN_REASON, True)),
            F.when(indirect, row(1, V.RULE_INDIRECT, V.INDIRECT_REASON, False)),
        )
    )
    return contexts.select("query_id", "idx", F.inline(found))


def guard_retrieval(contexts: DataFrame, caller: str = "caller_id", owner: str = "user_id") -> DataFrame:
    """One decision per query: a single violation among its contexts blocks the query.

    The first violation and the counts are partial aggregates; single violations stay rows of
    :func:`context_violations`, so a query with very many contexts gathers nothing in one place.
    """
    bad = context_violations(contexts, caller, owner).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("violation_count"),
        F.min(F.struct("idx", "rule_order", "reason", "policy")).alias("_first"),
    )
    seen = contexts.groupBy("query_id").agg(F.count(F.lit(1)).alias("contexts_checked"))
    out = seen.join(bad, "query_id", "left")
    hit = F.col("violation_count").isNotNull()
    return out.select(
        "query_id", "contexts_checked", F.coalesce("violation_count", F.lit(0)).alias("violation_count"),
        F.when(hit, "BLOCK").otherwise("ALLOW").alias("decision"), F.col("_first.reason").alias("reason"),
        F.col("_first.policy").alias("policy"),
    )


def with_policy(
    df: DataFrame, error: str = "error", enabled: bool = True, fail_closed: bool = True, stage: str = "input"
) -> DataFrame:
    """Apply the switches of the guard: off allows all, a failed check blocks (or passes when open)."""
    if not enabled:
        off = F.lit(f"{stage.capitalize()} guardrail is disabled by configuration")
        return df.withColumn("decision", F.lit("ALLOW")).withColumn("reason", off).withColumn(
            "policy", F.lit(None).cast("string")
        )
    failed = F.col(error).isNotNull()
    rule, policy, reason = V.FAIL_CLOSED
    if fail_closed:
        values = {"decision": F.lit("BLOCK"), "reason": F.lit(reason), "policy": F.lit(policy)}
    else:
        values = {
            "decision": F.lit("ALLOW"), "reason": F.lit(V.FAIL_OPEN_REASON), "policy": F.lit(None).cast("string"),
        }
    for name, value in values.items():
        df = df.withColumn(name, F.when(failed, value).otherwise(F.col(name)))
    return df


def safe_text(text: str = "text") -> Column:
    return F.coalesce(F.col("sanitized_text"), F.col(text))


def guard_metrics(checks: DataFrame) -> DataFrame:
    """Counters per stage of decisions ``(stage, decision, violation_count)``."""

    def n(decision: str) -> Column:
        return F.count_if(F.col("decision") == decision)

    return checks.groupBy("stage").agg(
        F.count(F.lit(1)).alias("checks"), n("ALLOW").alias("allowed"), n("BLOCK").alias("blocked"),
        n("SANITIZE").alias("sanitized"), F.sum("violation_count").alias("violations"),
    )
