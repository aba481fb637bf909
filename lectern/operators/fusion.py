"""Context fusion: isolation, cross-source de-duplication, threshold, order and token budgets.

A context row is ``(query_id, caller_id, source, source_id, priority, score, content, owner_id, turn_index)``;
``source_id`` identifies an item within its query and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import Budget
from lectern.functions import fixed_values as V
from lectern.functions import text as tx
from lectern.operators.sizing import cut_lineage, small_side

CONTEXT_COLUMNS = [
    "query_id", "caller_id", "source", "source_id", "priority", "score", "content", "owner_id", "turn_index",
]
SOURCES = ["rag", "cag", "mag", "conversation"]


def normalize_contexts(
    callers: DataFrame, rag: DataFrame | None = None, cag: DataFrame | None = None, mag: DataFrame | None = None,
    conversation: DataFrame | None = None,
) -> DataFrame:
    """One table from the four sources; blank contents are left out.

    ``callers`` is ``(query_id, caller_id)``. Sources: ``rag (query_id, chunk_id, score, content, owner_id)``,
    ``cag (query_id, cache_id, content, owner_id)``, ``mag (query_id, memory_id, score, content, owner_id)``,
    ``conversation (query_id, history)`` with the history array of :func:`lectern.operators.routing.history`.
    """
    none = F.lit(None)

    def rows(df: DataFrame, source: str, key: Column, score: Column, owner: Column, turn: Column) -> DataFrame:
        return df.select(
            "query_id", F.lit(source).alias("source"), key.cast("string").alias("source_id"),
            F.lit(V.PRIORITY[source]).alias("priority"), score.cast("double").alias("score"), "content",
            owner.cast("string").alias("owner_id"), turn.cast("int").alias("turn_index"),
        )

    parts = []
    if rag is not None:
        parts.append(rows(rag, "rag", F.col("chunk_id"), F.col("score"), F.col("owner_id"), none))
    if cag is not None:
        parts.append(rows(cag, "cag", F.col("cache_id"), none, F.col("owner_id"), none))
    if mag is not None:
        parts.append(rows(mag, "mag", F.col("memory_id"), F.col("score"), F.col("owner_id"), none))
    if conversation is not None:
        # Turns are numbered before blank ones are left out.
        turns = conversation.select("query_id", F.posexplode("history").alias("i", "h")).select(
            "query_id", "i", F.col("h.role").alias("role"), F.col("h.content").alias("content")
        )
        key = F.concat_ws("_", F.lit("conv"), F.col("i").cast("string"), F.col("role"))
        parts.append(rows(turns, "conversation", key, F.col("i"), none, F.col("i")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where(tx.trim_py("content") != "")
    return every.join(small_side(callers.select("query_id", "caller_id")), "query_id").select(*CONTEXT_COLUMNS)


def _rank_score() -> Column:
    return F.coalesce(F.col("score"), F.lit(-1.0))


def _limit(budget: Budget) -> Column:
    """Limit of the row's source; the total where a source has none of its own."""
    out = F.lit(budget.total)
    for s in SOURCES:
        own = budget.of(s)
        if own is not None:
            out = F.when(F.col("source") == s, F.lit(own)).otherwise(out)
    return out


def _accepted(survivors: DataFrame, budget: Budget) -> DataFrame:
    """Accepted items per query, in order, as one bounded array.

    Use only grows along the order. So among the items of one query, source and token count, once one is
    refused all later ones are: the accepted ones are a prefix of at most ``limit / tokens`` items. Only
    these prefixes enter the fold, which bounds its input by the budgets, not by the data.
    """
    room = F.least(_limit(budget), F.lit(budget.total))
    w = W.partitionBy("query_id", "source", "tokens").orderBy("priority", "neg", "source_id")
    widest = max([budget.total, *[budget.of(s) or 0 for s in SOURCES]])
    cands = (
        survivors.where(F.col("tokens") <= room)
        .withColumn("_rn", F.row_number().over(w))
        # An empty content costs nothing and always fits; as copies are gone, a query has one at most.
        .where((F.col("tokens") == 0) | (F.col("_rn") <= F.least(F.lit(widest), F.floor(room / F.greatest("tokens", F.lit(1))))))
    )
    item = F.struct("priority", "neg", "source_id", "source", "tokens")
    per_query = cands.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    empty = F.array().cast(f"array<{cands.select(item.alias('i')).schema['i'].dataType.simpleString()}>")
    start = F.struct(F.lit(0).alias("total"), *[F.lit(0).alias(s) for s in SOURCES], empty.alias("kept"))

    def step(state: Column, x: Column) -> Column:
        fits = state["total"] + x["tokens"] <= budget.total
        for s in SOURCES:
            own = budget.of(s)
            if own is not None:
                fits = fits & ((x["source"] != s) | (state[s] + x["tokens"] <= own))
        return F.when(
            fits,
            F.struct(
                (state["total"] + x["tokens"]).alias("total"),
                *[(state[s] + F.when(x["source"] == s, x["tokens"]).otherwise(0)).alias(s) for s in SOURCES],
                F.array_append(state["kept"], x).alias("kept"),
            ),
        ).otherwise(state)

    return per_query.select("query_id", F.aggregate("_items", start, step, lambda s: s["kept"]).alias("_kept"))


def fuse(contexts: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Decision for every context row: ``accepted`` with its ``position`` in the order, or a drop ``reason``.

    The texts are read once, for their length and a digest of their normal form. All decisions are made on
    these narrow rows, written once to the shared folder, and joined to the contexts at the end.
    """
    key = ["query_id", "source", "source_id"]
    foreign = F.coalesce(F.col("owner_id") != F.col("caller_id").cast("string"), F.lit(False))
    low = F.lit(False)
    if budget.min_score and budget.min_score > 0:
        low = (F.col("source") != "conversation") & F.coalesce(F.col("score") < budget.min_score, F.lit(False))
    rows = cut_lineage(
        contexts.select(
            *key, "priority", (-_rank_score()).alias("neg"), tx.est_tokens("content").alias("tokens"),
            F.sha2(tx.dedup_key("content"), 256).alias("_key"), foreign.alias("_foreign"), low.alias("_low"),
        )
    )
    order = F.struct("priority", "neg", "source_id")
    # The best of each set of copies is a partial aggregate, so one text copied everywhere stays cheap.
    best = rows.where(~F.col("_foreign")).groupBy("query_id", "_key").agg(F.min(order).alias("_best"))
    rows = rows.join(best, ["query_id", "_key"], "left").withColumn(
        "_early",
        F.when(F.col("_foreign"), "security_user_mismatch").when(order != F.col("_best"), "duplicate")
        .when(F.col("_low"), "below_relevance_threshold"),
    ).drop("_best", "_key", "_foreign", "_low")
    kept = _accepted(rows.where(F.col("_early").isNull()).drop("_early"), budget)
    out = rows.join(kept, "query_id", "left")
    position = F.array_position(
        F.transform("_kept", lambda a: F.struct(a["source"].alias("s"), a["source_id"].alias("i"))),
        F.struct(F.col("source").alias("s"), F.col("source_id").alias("i")),
    )
    used = F.aggregate(
        F.filter(
            "_kept",
            lambda a: (a["source"] == F.col("source"))
            & (F.struct(a["priority"].alias("priority"), a["neg"].alias("neg"), a["source_id"].alias("source_id")) < order),
        ),
        F.lit(0),
        lambda t, a: t + a["tokens"],
    )
    out = out.withColumn("position", F.when(F.col("_early").isNull() & (position > 0), position.cast("int")))
    over_source = F.coalesce(used, F.lit(0)) + F.col("tokens") > _limit(budget)
    limited = F.lit(False)
    for s in SOURCES:
        if budget.of(s) is not None:
            limited = limited | (F.col("source") == s)
    reason = F.coalesce(
        F.col("_early"),
        F.when(F.col("position").isNull(), F.when(limited & over_source, "source_token_budget").otherwise("token_budget")),
    )
    decided = out.select(
        *key, F.col("tokens").alias("estimated_tokens"), reason.isNull().alias("accepted"), "position", reason.alias("reason")
    )
    return contexts.join(decided, key)


def bundle(decisions: DataFrame) -> DataFrame:
    """Accepted items per query and source; turns return to their time order. Sizes are bounded by the budget."""
    ok = decisions.where("accepted")
    item = F.struct("position", "source_id", "content", "score")
    turn = F.struct("turn_index", "source_id", "content")

    def of(source: str, what: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("source") == source, what)))

    return ok.groupBy("query_id").agg(
        of("rag", item).alias("rag"), of("cag", item).alias("cag"), of("mag", item).alias("mag"),
        of("conversation", turn).alias("conversation"),
    )


def fusion_metrics(decisions: DataFrame, budget: Budget = Budget()) -> DataFrame:
    ok, talk = F.col("accepted"), F.col("source") == "conversation"
    sources = F.array_compact(
        F.array(*[F.when(F.max((F.col("source") == s) & ok), F.lit(s)) for s in SOURCES])
    )
    return decisions.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(F.col("reason") == "duplicate").alias("deduplicated_items"),
        F.count_if(~ok).alias("dropped_items"),
        F.coalesce(F.sum(F.when(ok, F.col("estimated_tokens"))), F.lit(0)).alias("estimated_tokens"),
        F.lit(budget.total).alias("token_budget"), F.count_if(ok & ~talk).alias("context_count"),
        F.coalesce(F.sum(F.when(ok & ~talk, F.length("content"))), F.lit(0)).alias("context_chars"),
        sources.alias("selected_sources"),
    )


def dropped_reasons(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("accepted")).groupBy("query_id", "reason").agg(F.count(F.lit(1)).alias("n"))
