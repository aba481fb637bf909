"""Long-term user memory: extraction from messages, conflict resolution, ranking and upkeep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions import fixed_values as V
from lectern.functions import text as tx
from lectern.functions.text import as_col
from lectern.operators.filters import not_expired
from lectern.operators.retrieval import top_k
from lectern.operators.sizing import cut_lineage

MEMORY_SCHEMA = (
    "memory_id STRING, user_id STRING, memory_type STRING, content STRING, importance DOUBLE, "
    "metadata MAP<STRING,STRING>, expires_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
# Ignore case, Unicode classes, and a dot that stops at the line feed only.
_FLAGS = "(?iUd)"


# --- extraction ----------------------------------------------------------------------------------
def contains_secret(text: str | Column) -> Column:
    cased = [p for p, ignore in V.SECRET_PATTERNS if not ignore]
    loose = [p for p, ignore in V.SECRET_PATTERNS if ignore]
    return tx.any_pattern(text, loose, "(?i)") | tx.any_pattern(text, cased)


def memory_gate(text: str | Column) -> Column:
    t = tx.trim_py(text)
    return (F.length(t) >= 6) & ~F.lower(t).isin(V.TRIVIAL_PHRASES) & ~contains_secret(t)


def extract_memories(
    messages: DataFrame, now: Column, text: str = "text", min_importance: float = 0.5, keep: list[str] | None = None
) -> DataFrame:
    """Memories found in messages, one row each, in rule order (``rule_no``).

    Every rule writes its own opening words, so the contents of one message are distinct by construction.
    """
    keep = [c for c in messages.columns if c != text] if keep is None else keep
    t = tx.trim_py(text)

    def group(pattern: str, n: int = 1) -> Column:
        return F.regexp_extract(F.col("_t"), _FLAGS + pattern, n)

    def ended(c: Column) -> Column:
        return F.rtrim(tx.trim_py(c), F.lit(".!?"))

    def memory(no: int, kind: Column, content: Column, importance: float, source: str, days: int | None = None) -> Column:
        expires = F.lit(None).cast("timestamp") if days is None else now + F.expr(f"INTERVAL {days} DAYS")
        return F.struct(
            F.lit(no).alias("rule_no"), kind.alias("memory_type"), tx.trim_py(content).alias("content"),
            F.lit(importance).alias("importance"), F.lit(source).alias("source"), expires.alias("expires_at"),
        )

    rows = messages.where(memory_gate(text)).select(*keep, t.alias("_t"))
    rows = rows.withColumn("_remember", tx.trim_py(group(V.REMEMBER_RULE))).withColumn(
        "_said", F.col("_t").rlike(_FLAGS + V.REMEMBER_RULE)
    )
    kind = F.when(
        F.lower("_remember").rlike("|".join(V.REMEMBER_INSTRUCTION_WORDS)), "instruction"
    ).otherwise("project_context")
    simple = [
        (2, V.PREFERENCE_RULE, "preference", "User prefers ", 0.85, "preference", None),
        (3, V.BUILDING_RULE, "project_context", "User is building ", 0.85, "project_context", None),
        (4, V.STACK_RULE, "project_context", "User project tech stack: ", 0.85, "tech_stack", None),
        (5, V.TEMPORARY_RULE, "temporary_context", "User is currently focused on ", 0.6, "temporary_context", 7),
    ]
    instruction = F.concat(
        F.lit("User instruction: "), tx.capitalize(group(V.INSTRUCTION_RULE, 1)), F.lit(" "),
        group(V.INSTRUCTION_RULE, 2), F.lit(" "), tx.trim_py(group(V.INSTRUCTION_RULE, 3)),
    )
    found = [
        F.when(
            F.col("_said"),
            memory(0, kind, F.concat(F.lit("Remembered: "), F.col("_remember")), 0.95, "explicit_remember"),
        ),
        F.when(
            ~F.col("_said") & F.col("_t").rlike(_FLAGS + V.INSTRUCTION_RULE),
            memory(1, F.lit("instruction"), instruction, 0.9, "rule_instruction"),
        ),
    ]
    for no, pattern, kind_name, opening, importance, source, days in simple:
        content = F.concat(F.lit(opening), ended(group(pattern)))
        found.append(
            F.when(F.col("_t").rlike(_FLAGS + pattern), memory(no, F.lit(kind_name), content, importance, source, days))
        )
    out = rows.select(*keep, F.inline(F.array_compact(F.array(*found))))
    return out.where(F.col("importance") >= min_importance)


# --- conflict resolution -------------------------------------------------------------------------
def _conflict_class(content: str) -> Column:
    c = F.lower(F.col(content))
    return F.when(c.startswith("user prefers"), "prefers").when(c.rlike(r"^user instruction:\s"), "instruction")


# For a group in which nothing expires, the window is summed up by two numbers: how many rows came after the
# newest preference and after the newest instruction, counted up to the window. A slice of time maps every such
# pair at its start to the pair at its end, so slices are summed up in parallel and chained afterwards.
_FAR = DEFAULTS.conflict_window
_PAIRS = (_FAR + 1) ** 2


def _advance(since: list, last: list, kind: int | None, is_new: bool, row_id: str):
    """One arrival on arrays of states: ``since[k]`` rows after the newest of kind ``k``, ``last[k]`` its id."""
    if kind is None:
        grow = np.ones(len(since[0]), dtype=bool)
    else:
        grow = (since[kind] >= _FAR) if is_new else np.ones(len(since[0]), dtype=bool)
    for k in (0, 1):
        since[k] = np.where(grow, 0 if k == kind else np.minimum(since[k] + 1, _FAR), since[k])
    if kind is not None:
        last[kind] = np.where(grow, row_id, last[kind])
    return grow


def _kind(k) -> int | None:
    return None if k is None else (0 if k == "prefers" else 1)


def _summaries(batches):
    """End state and newest ids of a slice for every possible start state, per (user, type)."""
    held = {}
    for batch in batches:
        for user, kind_of, part, k, is_new, row_id in zip(
            batch["user_id"], batch["memory_type"], batch["slice"], batch["klass"], batch["is_new"], batch["memory_id"], strict=True
        ):
            key = (user, kind_of, int(part))
            if key not in held:
                grid = np.indices((_FAR + 1, _FAR + 1)).reshape(2, -1)
                held[key] = ([grid[0], grid[1]], [np.full(_PAIRS, None, dtype=object), np.full(_PAIRS, None, dtype=object)])
            _advance(*held[key], _kind(k), is_new, row_id)
    rows = [
        (*key, (since[0] * (_FAR + 1) + since[1]).tolist(), last[0].tolist(), last[1].tolist())
        for key, (since, last) in held.items()
    ]
    yield pd.DataFrame(rows, columns=["user_id", "memory_type", "slice", "ends", "last_p", "last_i"])


def _chain(slices: pd.DataFrame) -> pd.DataFrame:
    """Start state of every slice of one (user, type); at most one row per partition of the data."""
    state, ids, out = _PAIRS - 1, [None, None], []
    for r in slices.sort_values("slice").itertuples(index=False):
        out.append((r.user_id, r.memory_type, r.slice, state, ids[0], ids[1]))
        ids = [new[state] if new[state] is not None else old for new, old in zip((r.last_p, r.last_i), ids, strict=True)]
        state = int(r.ends[state])
    return pd.DataFrame(out, columns=["user_id", "memory_type", "slice", "start", "start_p", "start_i"])


def _replay(batches):
    """Row that takes every arrival in, from the known start of each slice."""
    group, since, last = None, None, None
    for batch in batches:
        out = []
        for user, kind_of, start, start_p, start_i, k, is_new, row_id in zip(
            batch["user_id"], batch["memory_type"], batch["start"], batch["start_p"], batch["start_i"], batch["klass"],
            batch["is_new"], batch["memory_id"], strict=True,
        ):
            if (user, kind_of) != group:
                group = (user, kind_of)
                begin = _PAIRS - 1 if pd.isna(start) else int(start)
                since = [begin // (_FAR + 1), begin % (_FAR + 1)]
                last = [start_p, start_i]
            kind = _kind(k)
            if kind is not None and is_new and since[kind] < _FAR:
                out.append(last[kind])
                continue
            since = [0 if j == kind else min(since[j] + 1, _FAR) for j in (0, 1)]
            if kind is not None:
                last[kind] = row_id
            out.append(row_id)
        yield pd.DataFrame({"memory_id": batch["memory_id"], "slot": out})


def _slots(arrivals: DataFrame) -> DataFrame:
    """``(memory_id, slot)`` for groups in which nothing expires, however large one of them is.

    The rows are range-partitioned by user, type and arrival, so a large group is spread over many slices. Only
    groups that cross a slice border, at most two per slice, need a start state.
    """
    order = ["user_id", "memory_type", "is_new", "at", "memory_id"]
    sliced = cut_lineage(
        arrivals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())
    )
    key = ["user_id", "memory_type"]
    spans = sliced.groupBy(*key).agg(F.min("slice").alias("_lo"), F.max("slice").alias("_hi")).where("_lo < _hi").select(*key)
    parts = sliced.join(F.broadcast(spans), key, "left_semi").mapInPandas(
        _summaries, "user_id string, memory_type string, slice int, ends array<int>, last_p array<string>, last_i array<string>"
    )
    starts = parts.groupBy(*key).applyInPandas(
        _chain, "user_id string, memory_type string, slice int, start int, start_p string, start_i string"
    )
    return sliced.join(F.broadcast(starts), [*key, "slice"], "left").mapInPandas(_replay, "memory_id string, slot string")


def _fold(batches):
    """Newest rows of one (user, type) at a time; input sorted by user, type and arrival.

    Only the rows that can still be among the newest live ones are held: nothing older than the
    twentieth row without expiry can come back.
    """
    limit = DEFAULTS.conflict_window
    group, held = None, []
    for batch in batches:
        out = []
        for key, kind, row_id, at, expires, is_new in zip(
            zip(batch["user_id"], batch["memory_type"], strict=True), batch["klass"], batch["memory_id"],
            batch["at"], batch["expires_at"], batch["is_new"], strict=True,
        ):
            if key != group:
                group, held = key, []
            held = [h for h in held if h[2] is None or h[2] > at]
            target = None
            if kind is not None and is_new:
                target = next((h for h in held[:limit] if h[1] == kind), None)
            expires = None if pd.isna(expires) else expires
            if target is not None:
                if expires is not None:
                    target[2] = expires
                out.append(target[0])
                continue
            out.append(row_id)
            held.insert(0, [row_id, kind, expires])
            lasting = [i for i, h in enumerate(held) if h[2] is None]
            if len(lasting) > limit:
                held = held[: lasting[limit - 1] + 1]
        yield pd.DataFrame({"memory_id": batch["memory_id"], "slot": out})


def apply_memories(existing: DataFrame, new: DataFrame, window: int = DEFAULTS.conflict_window) -> DataFrame:
    """Memory table after the arrivals in ``new`` (same columns; ``created_at`` is the arrival time).

    A preference or instruction overwrites the newest one of its kind among the newest ``window`` live rows
    of the user and type; anything else is added. An overwritten row keeps its id and creation time.

    Where a (user, type) holds too few other rows to push one out of the window, and nothing expires, all
    arrivals of a kind share one row: first and last arrival are partial aggregates, whatever the number
    of arrivals. The other groups are replayed in arrival order on narrow rows without their contents: in slices
    of time that run in parallel, or, where rows of the group expire, as one sorted pass that holds only the
    rows the window can still see.
    """
    if window != DEFAULTS.conflict_window:
        raise ValueError("the conflict window is fixed")
    cols = existing.columns
    every = existing.withColumn("is_new", F.lit(False)).unionByName(new.select(*cols).withColumn("is_new", F.lit(True)))
    every = every.withColumn("klass", _conflict_class("content")).withColumn(
        "arrival", F.struct("is_new", "created_at", "memory_id")
    )
    groups = every.groupBy("user_id", "memory_type").agg(
        F.count_if(F.col("klass").isNull()).alias("others"),
        F.count("klass").alias("kinds_rows"),
        F.count("expires_at").alias("expiring"),
        F.count_if(F.col("klass").isNotNull() & ~F.col("is_new")).alias("stored"),
        F.count_distinct("klass").alias("kinds"),
    )
    calm = (F.col("others") + F.col("kinds") <= window) & (F.col("expiring") == 0) & (F.col("stored") <= 1)
    groups = groups.where(F.col("kinds_rows") > 0).select(
        "user_id", "memory_type", calm.alias("calm"), (F.col("expiring") > 0).alias("expires")
    )
    marked = every.join(groups, ["user_id", "memory_type"], "left")

    plain = marked.where(F.col("klass").isNull() & F.coalesce("calm", F.lit(True))).select(*cols)
    short = marked.where(F.col("klass").isNotNull() & F.col("calm")).withColumn("slot", F.lit(None).cast("string"))
    busy = marked.where(~F.coalesce("calm", F.lit(True)))
    narrow = busy.select(
        "user_id", "memory_type", "klass", "memory_id", F.col("created_at").alias("at"), "expires_at", "is_new", "expires"
    )
    moving = (
        narrow.where("expires").drop("expires")
        .repartition("user_id", "memory_type")
        .sortWithinPartitions("user_id", "memory_type", "is_new", "at", "memory_id")
        .mapInPandas(_fold, "memory_id string, slot string")
    )
    slots = _slots(narrow.where(~F.col("expires")).drop("expires", "expires_at")).unionByName(moving)
    busy = busy.join(slots, "memory_id")
    both = short.unionByName(busy.select(*short.columns))
    body = F.struct("content", "importance", "metadata")
    merged = both.groupBy("user_id", "memory_type", "klass", "slot").agg(
        F.min_by("memory_id", "arrival").alias("memory_id"),
        F.min_by("created_at", "arrival").alias("created_at"),
        F.min_by("updated_at", "arrival").alias("_first_update"),
        F.max_by(body, "arrival").alias("_b"),
        F.max_by("expires_at", F.when(F.col("expires_at").isNotNull(), F.col("arrival"))).alias("expires_at"),
        F.max("created_at").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    merged = merged.select(
        "memory_id", "user_id", "memory_type", "_b.content", "_b.importance", "_b.metadata", "expires_at", "created_at",
        F.when(F.col("_n") > 1, F.col("_last")).otherwise(F.col("_first_update")).alias("updated_at"),
    )
    return plain.unionByName(merged.select(*cols))


# --- ranking -------------------------------------------------------------------------------------
def relevance(query_tokens: Column, memory_tokens: Column, memory_type: str | Column) -> Column:
    shared = F.size(F.array_intersect(query_tokens, memory_tokens))
    share = F.least(F.lit(1.0), shared / F.greatest(F.size(query_tokens), F.lit(1)))
    return (
        F.when(F.size(memory_tokens) == 0, 0.0).when(shared > 0, share)
        .when(as_col(memory_type) == "instruction", 0.4).otherwise(0.0)
    )


def recency(updated_at: str | Column, now: Column) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(as_col(updated_at))) / 1e6)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 - age / (30 * 86400.0) * 0.9))


def memory_search(
    queries: DataFrame, memories: DataFrame, now: Column, k: int = DEFAULTS.memory_top_k,
    window: int = DEFAULTS.memory_window,
) -> DataFrame:
    """Best ``k`` memories per query among the newest ``window`` live ones of the same user."""
    newest = top_k(
        memories.where(not_expired("expires_at", now)), ["user_id"],
        [F.desc("created_at"), F.col("memory_id")], window, "_age",
    ).withColumn("_m", tx.memory_tokens("content"))
    pairs = queries.select("query_id", "user_id", tx.memory_tokens("text").alias("_q")).join(newest, "user_id")
    scored = (
        pairs.withColumn("relevance", relevance(F.col("_q"), F.col("_m"), "memory_type"))
        .where(F.col("relevance") > 0)
        .withColumn("recency", recency("updated_at", now))
    )
    importance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance")))
    # Rounded at twelve digits first, so that the noise of the sum never decides the fourth one.
    score = F.round(F.round(F.col("relevance") * 0.6 + importance * 0.25 + F.col("recency") * 0.15, 12), 4)
    scored = scored.withColumn("score", score).drop("_q", "_m", "_age")
    return top_k(scored, ["query_id"], [F.desc("score"), F.desc("created_at"), F.col("memory_id")], k)


# --- upkeep --------------------------------------------------------------------------------------
def list_memories(
    memories: DataFrame, user: str, now: Column, memory_type: str | None = None, include_expired: bool = False,
    limit: int = 50,
) -> DataFrame:
    rows = memories.where(F.col("user_id") == user)
    if memory_type:
        rows = rows.where(F.col("memory_type") == memory_type)
    if not include_expired:
        rows = rows.where(not_expired("expires_at", now))
    return rows.orderBy(F.desc("created_at"), "memory_id").limit(limit)


def get_memory(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested rows ``(memory_id, user_id)`` that belong to the asking user."""
    return memories.join(requests.select("memory_id", "user_id"), ["memory_id", "user_id"], "left_semi")


def delete_memory(memories: DataFrame, requests: DataFrame) -> DataFrame:
    return memories.join(requests.select("memory_id", "user_id"), ["memory_id", "user_id"], "left_anti")


def purge_users(memories: DataFrame, users: DataFrame) -> DataFrame:
    return memories.join(users.select("user_id"), "user_id", "left_anti")


def memory_stats(memories: DataFrame) -> DataFrame:
    """Counts by type, total and last update per user, expired rows included.

    The types are a closed list, so the map stays small.
    """
    by_type = memories.groupBy("user_id", "memory_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last")
    )
    return by_type.groupBy("user_id").agg(
        F.sum("n").alias("total_memories"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("memory_type", "n")))).alias("memories_by_type"),
        F.max("last").alias("last_updated"),
    )


def to_contexts(scored: DataFrame) -> DataFrame:
    """Memory rows in the common context form."""
    return scored.select(
        "query_id", F.lit("mag").alias("source"), F.col("memory_id").alias("source_id"),
        F.lit(V.PRIORITY["mag"]).alias("priority"), F.round("score", 4).alias("score"), "content",
        F.col("user_id").cast("string").alias("owner_id"), F.lit(None).cast("int").alias("turn_index"),
        "memory_type", "created_at",
    )
