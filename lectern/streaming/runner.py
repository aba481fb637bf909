"""Run a stream over everything that has arrived, into a parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.sizing import run_dir


def read_stream(spark: SparkSession, folder: str, name: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Stream over the parquet files of one table, be it a single file or a folder of part files."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    # A pattern, as the source takes a plain path for a folder.
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parque[t]")


def run_available(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process all available input and return the table the sink wrote."""
    spark = stream.sparkSession
    base = run_dir(spark, name)
    path = path or f"{base}/out"
    (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, name: str, step) -> None:
    """Process all available input with ``step(batch, batch_id)``; a repeated batch id must be harmless."""
    base = run_dir(stream.sparkSession, name)
    (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
