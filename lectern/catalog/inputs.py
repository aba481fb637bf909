"""The data model over the given tables: owners, chunks, queries, sessions, messages, memories, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.catalog.sqltext import EPOCH, NOW, PHRASES
from lectern.plans.ingest import ingest_chunks
from lectern.sources.tables import read_table, spread

now = lambda: F.timestamp_seconds(F.lit(NOW))


def owner(key: str) -> Column:
    """The tenant of a row without one of its own."""
    return F.concat(F.lit("src"), (F.col(key) % 20).cast("string"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return spread(
        d.select(
            "doc_id", F.col("source").alias("user_id"),
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text",
        )
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_chunks(docs(spark, sf), "fixed")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), owner("item_id").alias("user_id"), "text"
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as retrieval units with their vectors."""
    e = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs(spark, sf).join(e, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), "doc_id", "user_id", F.col("text").alias("content"), "embedding"
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    e = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding")
    return queries(spark, sf).join(e, "query_id", "left")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return tag_messages(read_table(spark, sf, "conversations"))


def tag_messages(c: DataFrame) -> DataFrame:
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))
    phrase = F.lit("")
    for i, p in enumerate(PHRASES):
        phrase = F.when(which == i, p).otherwise(phrase)
    at = F.lit(EPOCH) + F.col("conv_id") * 600 + F.col("turn") * 60
    return c.select(
        F.col("conv_id").alias("session_id"), "turn", "role", owner("conv_id").alias("user_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        F.concat(phrase, "text").alias("text"), F.col("text").alias("plain"), at.alias("ts"),
        F.timestamp_seconds(at).alias("created_at"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), owner("conv_id").alias("user_id")).distinct()


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")
