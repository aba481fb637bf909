"""Query preparation and the choice of context sources, as expressions over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions import fixed_values as V
from lectern.functions import text as tx
from lectern.functions.text import as_col
from lectern.operators.retrieval import top_k

SOURCES = ["rag", "cag", "mag", "conversation"]


def history(messages: DataFrame, n: int = DEFAULTS.history_messages, order: str = "oldest") -> DataFrame:
    """``n`` messages per session in time order, as one array. The oldest ones are the default."""
    first = F.col("turn") if order == "oldest" else F.col("turn").desc()
    kept = top_k(messages, ["session_id"], [first], n, "_rn")
    item = F.struct("turn", "role", F.col("text").alias("content"))
    return kept.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("history"))


def last_items(arr: Column, n: int) -> Column:
    """Last ``n`` elements, all of a shorter array."""
    return F.when(F.size(arr) > 0, F.slice(arr, F.greatest(-F.size(arr), F.lit(-n)), F.lit(n))).otherwise(arr)


def rewrite(text: str | Column, contents: str | Column) -> Column:
    """Append the latest non-empty message of the last four when a pronoun refers back.

    ``contents`` is the array of earlier message texts, oldest first.
    """
    contents = as_col(contents)
    filled = F.filter(last_items(contents, 4), lambda c: F.coalesce(c, F.lit("")) != "")

    def expand(q: Column) -> Column:
        refers = F.arrays_overlap(tx.word_set(q), F.array(*[F.lit(p) for p in V.PRONOUNS]))
        usable = contents.isNotNull() & (F.size(filled) > 0) & refers
        context = F.substring(F.try_element_at(filled, F.lit(-1)), 1, 150)
        return F.when(F.coalesce(usable, F.lit(False)), F.concat(q, F.lit(" (context: "), context, F.lit(")"))).otherwise(q)

    return tx.let(tx.normalize_query(text), expand)


def _bare(text: str | Column) -> Column:
    return F.rtrim(F.lower(tx.trim_py(text)), F.lit(".!?"))


def _starts(c: Column, prefixes: list[str]) -> Column:
    return c.rlike("^(?:" + "|".join(prefixes) + ")")


def is_chit_chat(text: str | Column) -> Column:
    bare = _bare(text)
    return bare.isin(V.CHIT_CHAT_EXACT) | ((F.size(tx.words(bare)) <= 3) & _starts(bare, V.CHIT_CHAT_PREFIXES))


def query_signals(q: DataFrame, text: str = "text", has_history: Column | None = None) -> DataFrame:
    """Boolean signals of every query and the labels of those that fired, in a fixed order."""
    has_history = F.lit(False) if has_history is None else has_history
    chat = is_chit_chat(text)
    t = tx.trim_py(text)

    def hit(patterns: list[str]) -> Column:
        return ~chat & tx.any_pattern(t, patterns, "(?i)")

    bare = _bare(text)
    follow = has_history & (F.size(tx.words(bare)) <= 5) & _starts(bare, V.FOLLOW_UP_PREFIXES)
    out = q.select(
        "*", chat.alias("is_chit_chat"), hit(V.MEMORY_SIGNAL).alias("memory_reference"),
        hit(V.PROJECT_SIGNAL).alias("project_reference"), hit(V.DOCUMENT_SIGNAL).alias("document_reference"),
        hit(V.POLICY_SIGNAL).alias("policy_reference"), hit(V.CONVERSATION_SIGNAL).alias("_said"),
        (~chat & follow).alias("_follow"), hit(V.PREFERENCE_SIGNAL).alias("explicit_user_reference"),
    )
    labels = [
        ("is_chit_chat", "chit_chat"), ("memory_reference", "memory_ref"), ("project_reference", "project_ref"),
        ("document_reference", "doc_ref"), ("policy_reference", "policy_ref"), ("_said", "conv_ref"),
        ("_follow_only", "conv_followup"), ("explicit_user_reference", "user_pref"),
    ]
    out = out.withColumn("_follow_only", F.col("_follow") & ~F.col("_said"))
    fired = F.array_compact(F.array(*[F.when(F.col(c), F.lit(name)) for c, name in labels]))
    return (
        out.withColumn("conversation_reference", F.col("_said") | F.col("_follow"))
        .withColumn("stable_knowledge_reference", F.col("policy_reference"))
        .withColumn("detected_keywords", fired)
        .drop("_said", "_follow", "_follow_only")
    )


def plan(signals: DataFrame) -> DataFrame:
    """Sources, confidence, reasons and one decision per source from the signals."""
    chat, doc, policy = F.col("is_chit_chat"), F.col("document_reference"), F.col("policy_reference")
    memory, project = F.col("memory_reference"), F.col("project_reference")
    preference = F.col("explicit_user_reference") & ~doc
    mag = memory | project | preference
    fallback = ~chat & ~(mag | doc | policy)

    def reasons(*pairs: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in pairs]))

    out = signals.select(
        "*", (~chat & (doc | fallback)).alias("use_rag"), (~chat & policy).alias("use_cag"),
        (~chat & mag).alias("use_mag"), F.lit(True).alias("use_conversation"), fallback.alias("is_fallback"),
        reasons((doc, V.REASON_DOCUMENT), (fallback, V.REASON_FALLBACK)).alias("_rag"),
        reasons((policy, V.REASON_POLICY)).alias("_cag"),
        reasons((memory, V.REASON_MEMORY), (project, V.REASON_PROJECT), (preference, V.REASON_PREFERENCE)).alias("_mag"),
    )
    active = F.concat("_rag", "_cag", "_mag")
    out = out.withColumn(
        "confidence",
        F.when(chat, 0.95).when(F.col("is_fallback"), 0.65).when(F.size(active) > 1, 0.90).otherwise(0.88),
    ).withColumn(
        "reason",
        F.when(chat, V.PLAN_CHIT_CHAT).when(F.col("is_fallback"), V.PLAN_FALLBACK).otherwise(
            tx.capitalize(F.array_join(active, "; "))
        ),
    )

    def decision(source: str) -> Column:
        on = F.col(f"use_{source}")
        if source == "conversation":
            sure, why = F.lit(0.95), F.lit(V.DECISION_CONVERSATION)
        else:
            sure = F.when(on, F.col("confidence")).otherwise(0.85)
            why = F.when(on, F.array_join(f"_{source}", "; ")).otherwise(V.DECISION_OFF[source])
        return F.struct(
            F.lit(source).alias("source"), on.alias("enabled"), F.when(chat, 0.95).otherwise(sure).alias("confidence"),
            F.when(chat, V.DECISION_CHIT_CHAT[source]).otherwise(why).alias("reason"),
        )

    chosen = F.array_compact(F.array(*[F.when(F.col(f"use_{s}"), F.lit(s)) for s in SOURCES]))
    return (
        out.withColumn("decisions", F.array(*[decision(s) for s in SOURCES]))
        .withColumn("selected_sources", chosen)
        .drop("_rag", "_cag", "_mag")
    )


def run_plan(planned: DataFrame, providers: dict) -> DataFrame:
    """Contexts of the selected sources only.

    A provider maps the queries routed to it to context rows. Queries of other sources never reach it, so
    unselected sources are not read for them. A provider reports a row's failure in an ``error`` column;
    such rows are kept apart from the contexts by the caller.
    """
    parts = [fn(planned.where(F.col(f"use_{source}"))) for source, fn in providers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


AUTHORIZATION = "authorization"


def dispatch(planned: DataFrame, providers: dict) -> tuple[DataFrame, DataFrame]:
    """Contexts of the selected sources, and the failures ``(query_id, source, error)``; one source's failure leaves the others.

    A provider fails as a whole by an exception while it is planned: every query routed to it then has a failure. It fails
    for single queries by rows with an ``error``; these rows are no contexts, nor are its other rows of that query. What it
    may not do is never set aside: a ``PermissionError`` is raised again, and a row whose ``error_kind`` is ``authorization``
    ends the job that reads the results.
    """
    kind = "query_id " + planned.schema["query_id"].dataType.simpleString() + ", source string, error string"
    spark = planned.sparkSession
    contexts, failures = None, spark.createDataFrame([], kind)
    for source, fn in providers.items():
        asked = planned.where(F.col(f"use_{source}"))
        try:
            rows = fn(asked)
        except PermissionError:
            raise
        except Exception as e:  # noqa: BLE001 - the other sources go on
            failures = failures.unionByName(asked.select("query_id", F.lit(source).alias("source"), F.lit(f"{source}: {e}").alias("error")))
            continue
        if "error" in rows.columns:
            error = F.col("error")
            if "error_kind" in rows.columns:
                error = F.when(F.col("error_kind") == AUTHORIZATION, F.raise_error(F.concat(F.lit(f"{source}: "), error)).cast("string")).otherwise(error)
            rows = rows.withColumn("error", error).drop("error_kind")
            bad = rows.where("error IS NOT NULL").groupBy("query_id").agg(F.min("error").alias("error"))
            failures = failures.unionByName(bad.select("query_id", F.lit(source).alias("source"), F.concat(F.lit(f"{source}: "), "error").alias("error")))
            rows = rows.where("error IS NULL").drop("error").join(bad.select("query_id"), "query_id", "left_anti")
        contexts = rows if contexts is None else contexts.unionByName(rows, allowMissingColumns=True)
    if contexts is None:
        contexts = planned.where("false").select("query_id")
    return contexts, failures


def provider_failures(planned: DataFrame, failures: DataFrame) -> DataFrame:
    """``query_id, provider_failures`` of every planned query, its failures in the order of their text."""
    found = failures.groupBy("query_id").agg(F.array_sort(F.collect_set("error")).alias("provider_failures"))
    none = F.array().cast("array<string>")
    return planned.select("query_id").join(found, "query_id", "left").withColumn("provider_failures", F.coalesce("provider_failures", none))
