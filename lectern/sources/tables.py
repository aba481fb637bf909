"""Parquet tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input of few splits; an input with more splits than cores is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_chunks(chunks: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Replace the chunks of the given documents and keep those of all others.

    The table is laid out by a hash bucket of the document. Only buckets that hold a changed document
    are read, merged and written again, each as a whole. The new chunks are made once; one shuffle into
    the layout brings them and the stored ones of a document together.
    """
    from lectern.operators.sizing import written

    spark = chunks.sparkSession
    new = chunks.withColumn("bucket", _bucket(key, buckets))
    place = [F.col("bucket"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(8))]
    if _exists(spark, path):
        new = written(new, "changes")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most the buckets
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True))).withColumn("_part", place[1])
        replaced = F.max("_new").over(Window.partitionBy("bucket", "_part", key))
        merged = both.repartition("bucket", "_part").withColumn("_replaced", replaced)
        # A null key names no document, so it replaces none.
        placed = merged.where(F.col("_new") | ~F.col("_replaced") | F.col(key).isNull()).drop("_new", "_part", "_replaced")
    else:
        placed = new.repartition(*place)
    # Folders are exchanged when all tasks have ended, so stored buckets can be read until then.
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def delete_chunks(spark: SparkSession, path: str, ids: DataFrame, key: str = "doc_id", buckets: int = 64) -> None:
    """Remove the chunks of deleted documents, rewriting only the buckets that hold them."""
    from lectern.operators.sizing import cut_lineage

    gone = ids.select(key).distinct().withColumn("bucket", _bucket(key, buckets))
    old = spark.read.parquet(path)
    hit = old.join(F.broadcast(gone.select("bucket").distinct()), "bucket", "left_semi")
    # A bucket that becomes empty keeps no file, so it is replaced by a marker-free empty partition.
    kept = cut_lineage(hit.join(gone.select(key), key, "left_anti"))
    emptied = gone.select("bucket").distinct().join(kept.select("bucket").distinct(), "bucket", "left_anti")
    _drop_buckets(spark, path, emptied)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _drop_buckets(spark: SparkSession, path: str, buckets: DataFrame) -> None:
    jvm = spark.sparkContext._jvm
    for row in buckets.collect():  # at most the number of buckets
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={row['bucket']}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_index(index: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """Store the postings, terms and statistics of a corpus, postings sorted by term inside their files so
    that the row groups without an asked term are skipped."""
    for name, df in zip(("postings", "terms", "stats"), index, strict=True):
        keys = [c for c in ("scope", "term") if c in df.columns]
        df.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats"))


def write_events(events: DataFrame, path: str) -> None:
    """One JSON line per event."""
    events.write.mode("append").json(path)


def save_cache(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    from lectern.operators.cache import CACHE_SCHEMA

    return spark.read.schema(CACHE_SCHEMA).json(path)
