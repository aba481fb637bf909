"""Knowledge cache: keys, entries with versions and expiry, keyword domains and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions import fixed_values as V
from lectern.functions import text as tx
from lectern.functions.text import as_col
from lectern.operators.filters import is_expired, visible
from lectern.operators.sizing import small_side

CACHE_SCHEMA = (
    "cache_id STRING, namespace STRING, key STRING, content STRING, version INT, user_id STRING, "
    "metadata MAP<STRING,STRING>, expires_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP, priority INT"
)


def cache_key(namespace: str | Column, identifier: str | Column, user: str | Column) -> Column:
    """``ns:user:id``, or ``ns:id`` without an owner."""
    ns, ident = F.lower(tx.trim_py(namespace)), F.lower(tx.trim_py(identifier))
    return F.concat_ws(":", ns, as_col(user), ident)


def cache_id(key: str | Column) -> Column:
    return F.concat(F.lit("cag_"), F.replace(as_col(key), F.lit(":"), F.lit("_")))


def make_entries(items: DataFrame, now: Column) -> DataFrame:
    """Entries from ``(namespace, identifier, content, user_id, metadata, version, ttl_seconds)``."""
    ttl = F.col("ttl_seconds")
    key = cache_key("namespace", "identifier", "user_id")
    return items.select(
        cache_id(key).alias("cache_id"), "namespace", key.alias("key"), "content",
        F.coalesce("version", F.lit(1)).alias("version"), "user_id",
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        F.when(ttl > 0, F.timestamp_seconds(F.unix_micros(now) / 1e6 + ttl)).alias("expires_at"),
        now.alias("created_at"), now.alias("updated_at"), F.lit(V.PRIORITY["cag"]).alias("priority"),
    )


def cache_put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Last write per key wins. ``new`` carries ``seq``, the order of the writes; stored entries come first."""
    every = entries.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(new.withColumn("seq", F.col("seq").cast("bigint")))
    row = F.struct(*[F.col(c) for c in entries.columns])
    # max_by merges partial results, so a key that is written very often is not gathered in one task.
    return every.groupBy("key").agg(F.max_by(row, "seq").alias("_e")).select("_e.*")


def cache_refresh(entries: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """New content for live entries the caller may see: version + 1, metadata merged, the rest kept.

    ``updates`` is ``(key, new_content, caller_id, new_metadata)`` with one row per key.
    """
    u = updates.select("key", "new_content", "caller_id", "new_metadata")
    out = entries.join(u, "key", "left")
    ok = F.coalesce(
        F.col("new_content").isNotNull() & ~is_expired("expires_at", now) & visible("user_id", "caller_id"), F.lit(False)
    )
    added = F.coalesce("new_metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter("metadata", lambda k, v: ~F.map_contains_key(added, k)), added)
    changes = {
        "content": F.col("new_content"), "version": F.col("version") + 1, "metadata": merged, "updated_at": now,
    }
    return out.select(
        *[(F.when(ok, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)) for c in entries.columns]
    )


def cache_invalidate(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Drop the requested keys ``(key, caller_id)``; an owned entry only by its owner or a null caller."""
    r = requests.select(F.col("key").alias("_k"), "caller_id")
    allowed = (
        F.col("user_id").isNull() | F.col("caller_id").isNull() | (F.col("user_id") == F.col("caller_id"))
    )
    return entries.join(r, (F.col("key") == F.col("_k")) & allowed, "left_anti")


def cache_clear(entries: DataFrame, caller: str | None = None, is_admin: bool = False) -> DataFrame:
    """Clear all entries for an administrator, else the caller's own."""
    if is_admin:
        return entries.limit(0)
    return entries.where(F.col("user_id").isNull() | (F.col("user_id") != caller))


def register_domains(domains: DataFrame, new: DataFrame) -> DataFrame:
    """Add ``(seq, keyword, cache_key, user_id)`` rows; a repeated mapping keeps its first place."""
    clean = F.lower(tx.trim_py("keyword"))
    every = domains.unionByName(new).withColumn("keyword", clean)
    return every.groupBy("keyword", "cache_key", "user_id").agg(F.min("seq").alias("seq")).select(
        "seq", "keyword", "cache_key", "user_id"
    )


def unregister_domains(domains: DataFrame, keywords: DataFrame) -> DataFrame:
    return domains.join(keywords.select(F.lower(tx.trim_py("keyword")).alias("keyword")), "keyword", "left_anti")


def match_domains(queries: DataFrame, domains: DataFrame) -> DataFrame:
    """Domains whose keyword is a substring of the query text.

    The first characters of every keyword, as many as the shortest one has, are joined by equality with
    the character grams of the queries; the full test follows. No query meets a keyword it shares no gram with.
    """
    m = domains.agg(F.coalesce(F.min(F.length("keyword")), F.lit(0))).first()[0]
    q = queries.withColumn("_q", F.lower("text"))
    if m == 0:
        # The empty keyword is part of every text; it is one row per mapping, so it is joined on a constant.
        some = domains.where(F.length("keyword") > 0)
        every = domains.where(F.length("keyword") == 0)
        hit_all = q.withColumn("_one", F.lit(1)).join(every.withColumn("_one", F.lit(1)), "_one").drop("_one", "_q")
        rest = match_domains(queries, some) if not some.isEmpty() else None
        return hit_all if rest is None else hit_all.unionByName(rest.select(*hit_all.columns))
    grams = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("_q") - (m - 1), F.lit(1))), lambda i: F.substring(F.col("_q"), i, F.lit(m))
        )
    )
    heads = domains.withColumn("_gram", F.substring("keyword", 1, m))
    return (
        q.withColumn("_gram", F.explode(grams))
        .join(small_side(heads), "_gram")
        .where(F.contains(F.col("_q"), F.col("keyword")))
        .drop("_gram", "_q")
    )


def is_eligible(queries: DataFrame, domains: DataFrame) -> DataFrame:
    """Add ``eligible``: a reference word in the query, or any registered keyword inside it."""
    word = F.arrays_overlap(tx.word_set("text"), F.array(*[F.lit(w) for w in V.CACHE_KEYWORDS]))
    keywords = domains.select("keyword").distinct()
    hits = match_domains(queries.select("query_id", "text"), keywords).select("query_id").distinct()
    return queries.join(hits.withColumn("_hit", F.lit(True)), "query_id", "left").withColumn(
        "eligible", word | F.col("_hit").isNotNull()
    ).drop("_hit")


def resolve_keys(queries: DataFrame, domains: DataFrame) -> DataFrame:
    """Cache keys per query in registration order, each once, as far as the caller may see the mapping."""
    d = domains.withColumnRenamed("user_id", "_owner")
    found = match_domains(queries.select("query_id", "user_id", "text"), d).where(visible("_owner", "user_id"))
    return found.groupBy("query_id", "user_id", "cache_key").agg(F.min("seq").alias("seq"))


def cache_access(lookups: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Outcome of every key lookup ``(query_id, user_id, cache_key)``: missing, expired and foreign entries miss."""
    e = entries.withColumnRenamed("user_id", "owner_id")
    out = lookups.join(e, lookups["cache_key"] == e["key"], "left")
    hit = F.col("key").isNotNull() & ~is_expired("expires_at", now) & visible("owner_id", "user_id")
    return out.withColumn("hit", F.coalesce(hit, F.lit(False)))


def cache_search(
    queries: DataFrame, domains: DataFrame, entries: DataFrame, now: Column, max_chars: int = DEFAULTS.cache_chars
) -> DataFrame:
    """Visible live entries per query, in key order, content cut to ``max_chars``.

    A query that resolves a key holds a registered keyword and is therefore eligible.
    """
    found = cache_access(resolve_keys(queries, domains), entries, now).where("hit")
    meta = F.map_concat(
        F.map_filter("metadata", lambda k, v: ~k.isin("namespace", "cache_key", "user_id")),
        F.create_map(F.lit("namespace"), F.col("namespace"), F.lit("cache_key"), F.col("key")),
        F.when(F.col("owner_id").isNotNull(), F.create_map(F.lit("user_id"), F.col("owner_id"))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    )
    return found.select(
        "query_id", "user_id", "seq", "cache_id", F.col("version").cast("string").alias("version"), "priority",
        tx.truncate_cache("content", max_chars).alias("content"), meta.alias("metadata"), "owner_id",
    )


def cache_stats(entries: DataFrame, accesses: DataFrame) -> DataFrame:
    size = entries.agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(tx.byte_size("content")), F.lit(0)).alias("total_size_bytes"),
        F.max("updated_at").alias("last_refresh"),
    )
    use = accesses.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return size.withColumn("_one", F.lit(1)).join(F.broadcast(use.withColumn("_one", F.lit(1))), "_one").drop("_one")


def cache_versions(entries: DataFrame) -> DataFrame:
    """Version per entry id. Rows, not one map, because the number of entries grows with the data."""
    return entries.select("cache_id", "version")


def cache_list(
    entries: DataFrame, now: Column, user: str | None = None, namespace: str | None = None, scope: str = "own"
) -> DataFrame:
    """Live entries the caller may see; ``scope='all'`` lists every owner's, which the plain administrator
    view (no user) does not."""
    out = entries.where(~is_expired("expires_at", now))
    if scope != "all":
        out = out.where(visible("user_id", F.lit(user).cast("string")))
    if namespace:
        out = out.where(F.lower("namespace") == namespace.strip().lower())
    return out
