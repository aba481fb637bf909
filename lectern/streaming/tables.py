"""Streams that keep tables up to date, one idempotent step per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import guard as G
from lectern.operators import memory as M
from lectern.operators.telemetry import recent
from lectern.plans.ingest import ingest_chunks
from lectern.sources import snapshots
from lectern.sources.tables import write_chunks
from lectern.streaming.runner import run_batches


def stream_ingest(docs: DataFrame, path: str, strategy: str = "fixed", buckets: int = 64) -> None:
    """Chunk arriving documents and replace their earlier chunks. Writing a batch twice changes nothing."""

    def step(batch: DataFrame, batch_id: int) -> None:
        write_chunks(ingest_chunks(batch, strategy).drop("metadata"), path, buckets=buckets)

    run_batches(docs, "ingest", step)


def stream_guard(messages: DataFrame, passed: str, blocked: str) -> None:
    """Route messages by the input rules: safe text to one table, blocked ones with their reason to another."""

    def step(batch: DataFrame, batch_id: int) -> None:
        checked = G.guard_input(batch).persist()
        ok = checked.where("decision <> 'BLOCK'").withColumn("text", G.safe_text())
        # The batch id is part of the path, so a repeated batch replaces itself.
        ok.select(*batch.columns, "decision").write.mode("overwrite").parquet(f"{passed}/batch={batch_id}")
        bad = checked.where("decision = 'BLOCK'").select(*batch.columns, "decision", "reason", "policy")
        bad.write.mode("overwrite").parquet(f"{blocked}/batch={batch_id}")
        checked.unpersist()

    run_batches(messages, "guard", step)


def found_memories(batch: DataFrame) -> DataFrame:
    """Memories of a batch of messages as rows of the memory table."""
    found = M.extract_memories(batch, F.col("created_at"), keep=["message_id", "user_id", "created_at"])
    return found.select(
        F.concat_ws("-", "message_id", F.col("rule_no").cast("string")).alias("memory_id"), "user_id", "memory_type",
        "content", "importance", F.create_map(F.lit("source"), F.col("source")).alias("metadata"), "expires_at",
        "created_at", F.col("created_at").alias("updated_at"),
    )


def stream_memories(messages: DataFrame, path: str) -> None:
    """Extract memories from arriving messages and resolve them against the table.

    Every batch writes the next version of the table, named by its batch id, from the version before it.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = found_memories(batch)
        old = (
            spark.read.schema(M.MEMORY_SCHEMA).parquet(f"{path}/version={batch_id - 1}")
            if batch_id > 0 else spark.createDataFrame([], M.MEMORY_SCHEMA)
        )
        M.apply_memories(old, new.select(*old.columns)).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    run_batches(messages, "memories", step)


def stream_recent(events: DataFrame, path: str, n: int = 100) -> None:
    """The newest ``n`` events; every batch writes the next version of the small table."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={batch_id - 1}"))
        newest = recent(rows, [F.desc("ts"), F.desc("event_id")], n)
        newest.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    run_batches(events, "recent", step)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a versioned table."""
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).drop("version")


# --- tables with versions ------------------------------------------------------------------------
def ingest_into(docs: DataFrame, path: str, strategy: str = "fixed", name: str = "ingest", **options) -> None:
    """Chunk arriving documents and replace their earlier chunks, one version per batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        chunks = ingest_chunks(batch, strategy).drop("metadata")
        snapshots.replace(batch.sparkSession, path, chunks, "doc_id", batch=(name, batch_id), **options)

    run_batches(docs, name, step)


def memories_into(messages: DataFrame, path: str, name: str = "memories", **options) -> None:
    """Extract memories from arriving messages and resolve them against the stored ones of the touched users' buckets."""

    def step(batch: DataFrame, batch_id: int) -> None:
        new = found_memories(batch)
        snapshots.change(
            batch.sparkSession, path, new, "user_id", lambda old, new: M.apply_memories(old, new.select(*old.columns)),
            schema=batch.sparkSession.createDataFrame([], M.MEMORY_SCHEMA).schema, batch=(name, batch_id), **options,
        )

    run_batches(messages, name, step)


def recent_into(events: DataFrame, path: str, n: int = 100, name: str = "recent") -> None:
    """The newest ``n`` events, one version per batch. The batch is cut to its own newest first, so a version is small."""

    def step(batch: DataFrame, batch_id: int) -> None:
        order = [F.desc("ts"), F.desc("event_id")]
        few = recent(batch, order, n).withColumn("list", F.lit(0))
        snapshots.change(
            batch.sparkSession, path, few, "list", lambda old, new: recent(old.unionByName(new), order, n), batch=(name, batch_id)
        )

    run_batches(events, name, step)
