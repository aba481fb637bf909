"""Predicates, tenancy and the few join shapes of the data model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import as_col
from lectern.operators.sizing import small_side


def completed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("status") == "COMPLETED")


def scope(queries: DataFrame, chunks: DataFrame, shared: bool = False) -> DataFrame:
    """Add the ``scope`` key that ties a query to the chunks it may see: the owner, or one common
    scope. It is part of the join key of every retrieval operator, never a filter afterwards."""
    key = (lambda: F.lit("*")) if shared else (lambda: F.col("user_id").cast("string"))
    return queries.withColumn("scope", key()), chunks.withColumn("scope", key())


def subset_scopes(queries: DataFrame, chunks: DataFrame, shared: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scopes for queries that each name the documents they search; an empty list searches all.

    Queries with the same owner and the same list share a scope. Listed documents join by equality on
    the document id, so a chunk is repeated once for every scope that really contains it.
    """
    owner = F.lit("*") if shared else F.col("user_id").cast("string")
    ids = F.array_sort(F.array_distinct(F.coalesce(F.col("document_ids"), F.array().cast("array<bigint>"))))
    q = queries.withColumn("owner", owner).withColumn("_ids", ids)
    q = q.withColumn(
        "scope",
        F.when(F.size("_ids") == 0, F.col("owner")).otherwise(
            F.concat_ws("|", "owner", F.sha2(F.array_join(F.transform("_ids", lambda d: d.cast("string")), ","), 256))
        ),
    )
    c = chunks.withColumn("owner", owner)
    scopes = q.select("scope", "owner", "_ids").distinct()
    whole = scopes.where(F.size("_ids") == 0).select("scope", "owner")
    listed = scopes.where(F.size("_ids") > 0).select("scope", "owner", F.explode("_ids").alias("doc_id"))
    seen = c.join(small_side(whole), "owner").unionByName(
        c.join(small_side(listed), ["owner", "doc_id"]).select(*c.columns, "scope")
    )
    return q.drop("owner", "_ids"), seen.drop("owner")


def authorize(rows: DataFrame, users: DataFrame, caller: str = "caller_id") -> DataFrame:
    """Rows whose caller owns them or is an administrator."""
    roles = users.select(F.col("user_id").alias(caller), F.col("role").alias("_role"))
    ok = (F.col("user_id") == F.col(caller)) | (F.col("_role") == "ADMIN")
    return rows.join(roles, caller).where(ok).drop("_role")


def visible(owner: str | Column, user: str | Column) -> Column:
    """Own or global rows."""
    owner = as_col(owner)
    return owner.isNull() | F.coalesce(owner == as_col(user), F.lit(False))


def not_expired(expires: str | Column, now: Column) -> Column:
    """Table form: a row lives while its expiry lies after ``now``."""
    return as_col(expires).isNull() | (as_col(expires) > now)


def is_expired(expires: str | Column, now: Column) -> Column:
    """Object form: expired once ``now`` lies after the expiry (at equality it still lives)."""
    return F.coalesce(now > as_col(expires), F.lit(False))


def query_problem(text="text", top_k="top_k", threshold="threshold", alpha=None) -> Column:
    """First broken bound of a request, null when it is valid. A request without a weight ``alpha`` has the default."""
    n = F.length(as_col(text))
    weight = F.lit(False) if alpha is None else ~F.coalesce(as_col(alpha).between(0.0, 1.0) & ~F.isnan(as_col(alpha)), F.lit(True))
    return (
        F.when(n.isNull() | (n < 1) | (n > 2000), "query_length")
        .when(~as_col(top_k).between(1, 20), "top_k")
        .when(~as_col(threshold).between(0.0, 1.0), "threshold")
        .when(weight, "alpha")
    )


def memory_problem(content="content", importance="importance") -> Column:
    """First broken bound of a memory, null when it is valid; a memory without an importance has the default."""
    value = as_col(importance)
    return F.when(as_col(content).isNull(), "content").when(value.isNotNull() & (F.isnan(value) | ~value.between(0.0, 1.0)), "importance")


def validate_queries(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _checked(q, query_problem(alpha="alpha" if "alpha" in q.columns else None))


def validate_memories(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _checked(m, memory_problem())


def _checked(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    checked = rows.withColumn("reason", problem)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def search_rows(df: DataFrame, needle: str | Column, columns: list[str], **facets) -> DataFrame:
    """Case-insensitive substring in any of the columns, plus equality on facets."""
    needle = F.lower(F.lit(needle) if isinstance(needle, str) else needle)
    hit = reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c)), needle) for c in columns))
    for name, value in facets.items():
        if value is not None:
            hit = hit & (F.col(name) == value)
    return df.where(hit)


def in_collection(df: DataFrame, collections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose document is listed in one of the given collections."""
    return df.join(collections.select(F.explode("document_ids").alias(key)), key, "left_semi")


def with_docs(chunks: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.join(docs, key)


def messages_of(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.join(sessions.select("session_id", "user_id"), "session_id")


def nest_children(
    parent: DataFrame, child: DataFrame, key: str, order: str, fields: list[str], block: int | None = None
) -> DataFrame:
    """Children of every parent as ordered arrays: one row per parent, whatever the number of its children.

    Only where the caller names a ``block``, a row holds that many positions and ``block_no`` is part of the key.
    Parents without children keep one row with an empty array.
    """
    item = F.struct(F.col(order), *[F.col(f) for f in fields if f != order])
    no = F.lit(0).cast("bigint") if block is None else F.floor(F.col(order) / block).cast("bigint")
    packed = (
        child.withColumn("block_no", no)
        .groupBy(key, "block_no")
        .agg(F.array_sort(F.collect_list(item)).alias("children"))
    )
    empty = F.array().cast(packed.schema["children"].dataType)
    return parent.join(packed, key, "left").withColumn("block_no", F.coalesce("block_no", F.lit(0))).withColumn(
        "children", F.coalesce("children", empty)
    )


def cascade_delete(ids: DataFrame, table: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Table without the rows of deleted parents, or with their reference set to null."""
    if not set_null:
        return table.join(ids.select(key), key, "left_anti")
    gone = ids.select(F.col(key), F.lit(True).alias("_gone")).distinct()
    cols = [F.when(F.col("_gone").isNull(), F.col(key)).alias(key) if c == key else F.col(c) for c in table.columns]
    return table.join(gone, key, "left").select(*cols)
