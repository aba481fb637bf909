"""Streams over the given tables, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import inputs as I
from lectern.catalog import memory_queries as MQ
from lectern.catalog import routing_queries as RQ
from lectern.catalog import sqltext as S
from lectern.catalog.registry import query
from lectern.catalog.telemetry_queries import LIFECYCLE, lifecycle
from lectern.operators.sizing import run_dir
from lectern.plans.ingest import ingest_chunks
from lectern.sources import document_files, snapshots
from lectern.sources.tables import read_chunks
from lectern.streaming import lifecycle as LC
from lectern.streaming import stateful as ST
from lectern.streaming import tables as TB
from lectern.streaming.runner import read_stream, run_available


def event_stream(spark, sf):
    schema = I.events(spark, sf).schema
    return read_stream(spark, sf, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def started(c="window"):
    return F.date_format(f"{c}.start", "yyyy-MM-dd HH:mm:ss").alias("start")


# A window is final once it ends before the newest event less the allowed delay of ten minutes.
def final(width: str, trunc: str) -> str:
    return f"date_trunc('{trunc}', ts) + INTERVAL '{width}' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"


@query("stream_counters", f"SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events WHERE {final('1 minute', 'minute')} GROUP BY ALL")
def stream_counters(spark, sf):
    out = run_available(LC.stream_counters(event_stream(spark, sf)), "counters")
    return out.select(started(), "event_type", "n")


@query("stream_latency", f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(value) AS count, round(min(value), 2) AS min_ms, round(max(value), 2) AS max_ms, round(avg(value), 4) AS avg_ms
FROM events WHERE {final('1 hour', 'hour')} GROUP BY ALL""")
def stream_latency(spark, sf):
    out = run_available(LC.stream_latency(event_stream(spark, sf)), "latency")
    return out.select(
        started(), "event_type", "count", F.round("min_ms", 2).alias("min_ms"), F.round("max_ms", 2).alias("max_ms"),
        F.round("avg_ms", 4).alias("avg_ms"),
    )


@query("stream_rate_breach", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS calls FROM events WHERE {final('1 day', 'day')}
GROUP BY ALL HAVING count(*) > 4""")
def stream_rate_breach(spark, sf):
    out = run_available(LC.stream_rate_breach(event_stream(spark, sf), 4, "1 day"), "breach")
    return out.select(started(), "user_id", "calls")


@query("stream_dedup", "SELECT count(DISTINCT user_id) AS requests FROM events")
def stream_dedup(spark, sf):
    e = event_stream(spark, sf).select(F.col("user_id").alias("request_id"), "ts")
    out = run_available(LC.stream_dedup(e, delay="400 days"), "dedup")
    return out.agg(F.count(F.lit(1)).alias("requests"))


@query("stream_lifecycle", f"""WITH {LIFECYCLE}, g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '5 minutes' THEN 0 ELSE 1 END AS fresh FROM lc),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
a AS (SELECT user_id AS request_id, sid, max(ts) AS last, count(*) AS events, count_if(event = 'stage_failed') AS failures, bool_or(event = 'request_completed') AS completed FROM s GROUP BY ALL)
SELECT request_id, count(*) AS sessions, sum(events)::BIGINT AS events, sum(failures)::BIGINT AS failures, count_if(completed) AS completed FROM a
WHERE last + INTERVAL '5 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY request_id""")
def stream_lifecycle(spark, sf):
    e = lifecycle(event_stream(spark, sf)).withColumn("request_id", F.col("user_id"))
    out = run_available(LC.stream_lifecycle(e), "lifecycle")
    return out.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.sum("failures").alias("failures"),
        F.count_if("completed").alias("completed"),
    )


@query("stream_recent", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def stream_recent(spark, sf):
    path = run_dir(spark, "recent")
    TB.stream_recent(event_stream(spark, sf).select("event_id", "ts"), path)
    return TB.latest(spark, path).select("event_id")


@query("stream_ingest", f"WITH {S.CHUNKS} SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM chunks GROUP BY ALL")
def stream_ingest(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    d = read_stream(spark, sf, "documents", schema).select("doc_id", F.col("source").alias("user_id"), "text")
    path = run_dir(spark, "chunks")
    TB.stream_ingest(d, path, buckets=8)
    return read_chunks(spark, path).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars")
    )


BATCHES = 3


def in_batches(df, name, column):
    """The rows as a stream of ``BATCHES`` batches, in ranges of a column that follow each other."""
    spark = df.sparkSession
    folder = run_dir(spark, name)
    cuts = df.approxQuantile(column, [i / BATCHES for i in range(1, BATCHES)], 0.0)
    # As many files for every batch; the stream takes files by age. A table of few splits gets one each.
    files = -(-df.rdd.getNumPartitions() // BATCHES)
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = df if low is None else df.where(F.col(column) > low)
        part = part if high is None else part.where(F.col(column) <= high)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(f"{folder}/{i}")
        # A split without rows leaves no file: empty ones make up for it, so that no batch takes files of the next.
        for _ in range(files - file_count(spark, f"{folder}/{i}")):
            df.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def file_count(spark, folder):
    """Parquet files of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    return len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


@query("stream_ingest_batches", f"WITH {S.CHUNKS} SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM chunks GROUP BY ALL")
def stream_ingest_batches(spark, sf):
    """Three batches, of which the last brings some documents a second time, into a table with versions."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("source").alias("user_id"), "text")
    path = run_dir(spark, "chunk-table")
    TB.ingest_into(in_batches(d, "arriving", "doc_id"), path, bucket_rows=2000)
    again = d.where(F.col("doc_id") % 10 == 0)
    snapshots.replace(spark, path, ingest_chunks(again, "fixed").drop("metadata"), "doc_id", batch=("again", 0))
    # Noted before: changes nothing.
    snapshots.delete(spark, path, again, "doc_id", batch=("again", 0))
    return snapshots.read(spark, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("stream_recent_batches", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def stream_recent_batches(spark, sf):
    e = I.events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    path = run_dir(spark, "recent-table")
    TB.recent_into(in_batches(e, "events", "event_id"), path)
    return snapshots.read(spark, path).select("event_id")


@query("stream_memories_batches", f"WITH {MQ.RESOLVED} SELECT memory_id, content, created AS created_at, updated AS updated_at FROM res")
def stream_memories_batches(spark, sf):
    m = I.tag_messages(spark.read.parquet(f"{sf}/conversations.parquet")).where(F.col("role") == "user")
    m = m.select("message_id", "user_id", "created_at", "text", "ts")
    path = run_dir(spark, "memory-table")
    TB.memories_into(in_batches(m, "messages", "ts").drop("ts"), path, bucket_rows=200)
    return snapshots.read(spark, path).select("memory_id", "content", MQ.seconds("created_at"), MQ.seconds("updated_at"))


FILES = "SELECT doc_id, strlen(text) AS file_size, md5(text) AS digest FROM documents"


def written_files(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat("doc_id", F.lit(".txt")).alias("name"), "text")
    path = run_dir(spark, "files")
    return path, document_files.write_files(d, path)


def file_rows(df):
    return df.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), "file_size", F.md5("text").alias("digest"))


@query("document_files", FILES)
def files(spark, sf):
    """Documents written as text files and read by the data source."""
    return file_rows(document_files.read(spark, written_files(spark, sf)[0], share_bytes=1 << 20))


@query("stream_document_files", FILES)
def stream_files(spark, sf):
    """The same as a stream of several batches."""
    path, n = written_files(spark, sf)
    log, out, state = (run_dir(spark, f"file-{x}") for x in ("log", "read", "state"))
    # A trigger over what is available takes one batch of this source, so it is pulled until no file is left.
    for _ in range(BATCHES + 1):
        arriving = document_files.stream(spark, path, log, max_files=-(-n // BATCHES) or 1)
        to = arriving.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        to.trigger(availableNow=True).start().awaitTermination()
    return file_rows(spark.read.schema(arriving.schema).parquet(out))


def message_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/conversations.parquet").schema
    return read_stream(spark, sf, "conversations", schema)


@query("stream_guard", f"""WITH c AS (SELECT conv_id AS doc_id, turn, (CASE (conv_id + turn) % {len(RQ.ATTACKS)} {RQ._acase} END) || text AS text FROM conversations),
d AS (SELECT doc_id, turn, {RQ.INJ} OR {RQ.TOP} AS bad, {RQ.RED} AS red, text FROM c)
SELECT doc_id AS conv_id, turn, CASE WHEN bad THEN 'BLOCK' WHEN red <> text THEN 'SANITIZE' ELSE 'ALLOW' END AS decision, md5(CASE WHEN bad THEN text ELSE red END) AS digest FROM d""")
def stream_guard(spark, sf):
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(RQ.ATTACKS)))
    head = F.lit("")
    for i, p in enumerate(RQ.ATTACKS):
        head = F.when(which == i, p).otherwise(head)
    m = message_stream(spark, sf).select("conv_id", "turn", F.concat(head, "text").alias("text"))
    base = run_dir(spark, "guard")
    TB.stream_guard(m, f"{base}/passed", f"{base}/blocked")
    parts = [spark.read.parquet(f"{base}/{p}").select("conv_id", "turn", "decision", "text") for p in ("passed", "blocked")]
    return parts[0].unionByName(parts[1]).select("conv_id", "turn", "decision", F.md5("text").alias("digest"))


@query("stream_memories", f"WITH {MQ.RESOLVED} SELECT memory_id, content, created AS created_at, updated AS updated_at FROM res")
def stream_memories(spark, sf):
    raw = message_stream(spark, sf)
    path = run_dir(spark, "memories")
    m = I.tag_messages(raw).where(F.col("role") == "user")
    TB.stream_memories(m.select("message_id", "user_id", "created_at", "text"), path)
    return TB.latest(spark, path).select("memory_id", "content", MQ.seconds("created_at"), MQ.seconds("updated_at"))


@query("stream_history", "SELECT conv_id AS session_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 GROUP BY ALL")
def stream_history(spark, sf):
    ST.use_rocksdb(spark)
    m = message_stream(spark, sf).select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    base = run_dir(spark, "history")
    from lectern.streaming.runner import run_batches

    def step(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    run_batches(ST.stream_history(m, 3), "history-state", step)
    out = spark.read.parquet(base)
    last = out.groupBy("session_id").agg(F.max_by("turns", "batch").alias("turns"))
    return last.select("session_id", F.array_join(F.transform("turns", lambda t: t.cast("string")), ",").alias("turns"))


# Per user: views put a value that lives for two hours, clicks ask for it.
@query("stream_cache", """WITH o AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('click', 'error') THEN 'get' ELSE 'put' END AS op, event_type = 'error' AS foreign_caller FROM events),
p AS (SELECT *, max(CASE WHEN op = 'put' THEN epoch_ms(ts) END) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id ROWS UNBOUNDED PRECEDING) AS put_ms FROM o)
SELECT event_id AS seq, coalesce(put_ms IS NOT NULL AND epoch_ms(ts) <= put_ms + 7200000 AND NOT foreign_caller, false) AS hit FROM p WHERE op = 'get'""")
def stream_cache(spark, sf):
    ST.use_rocksdb(spark)
    get = F.col("event_type").isin("click", "error")
    ops = event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"),
        F.when(get, "get").otherwise("put").alias("op"), F.when(~get, F.col("props")).alias("content"),
        F.when(F.col("event_type") == "error", "stranger").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user_id"),
        F.lit(7200000).cast("bigint").alias("ttl_ms"),
    )
    return run_available(ST.stream_cache(ops), "cache").select("seq", "hit")
