"""Tables that change by atomic commits: keyed rows in hash buckets, a manifest per version, readers pinned to one.

``<path>/data/<write>/bucket=<b>`` holds the rows one write gave a bucket, ``<path>/versions/<n>.json`` which folder each
bucket of version ``n`` is in. A change reads and writes the touched buckets alone, in new folders, and then publishes the
next manifest under a name that must not exist yet: a job that ends before that leaves the table as it was, a reader sees
one whole version, and of two writers that start from one version the second fails and may try again. A manifest names the
stream batches it holds, so a batch that is run again changes nothing.

The number of buckets follows the rows: a power of two, raised by a rewrite when buckets hold twice ``BUCKET_ROWS``. Only
manifests (a folder name per bucket) pass through the driver. Renames must be atomic, as on HDFS or a local file system.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 8192


class Conflict(RuntimeError):
    """Another writer published the version first."""


# --- small files of the driver -------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file as a whole, unless it exists: a rename never replaces."""
    fs, target = _fs(spark, path)
    _, held = _fs(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(held, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    done = not fs.exists(target) and fs.rename(held, target)
    if not done:
        fs.delete(held, False)
    return done


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/versions") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default the newest; null for a table without one."""
    known = versions(spark, path)
    if not known:
        return None
    version = known[-1] if version is None else version
    text = spark.read.text(f"{path}/versions/{version:012d}.json", wholetext=True).first()[0]
    return json.loads(text)


# --- reading -------------------------------------------------------------------------------------
def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, m: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(m["schema"])
    folders = [f"{path}/data/{m['folders'][b]}/bucket={b}" for b in map(str, m["folders"] if buckets is None else buckets) if m["folders"].get(b)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of one version. Later commits do not touch its files."""
    m = manifest(spark, path, version)
    if m is None:
        raise ValueError(f"no version of a table in {path}")
    return _read(spark, path, m)


# --- writing -------------------------------------------------------------------------------------
def change(
    spark: SparkSession, path: str, changes: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
    schema: T.StructType | None = None, batch: tuple[str, int] | None = None, bucket_rows: int = BUCKET_ROWS,
) -> int:
    """Publish the next version: ``merge(old, changes)`` of the touched buckets, all other buckets as they are.

    ``merge`` gets the stored rows of every bucket that ``changes`` has a key in and returns the new rows of these buckets.
    ``batch``, the name and number of a stream's batch, is noted; one noted before changes nothing. Gives the version.
    """
    m = manifest(spark, path)
    if m and batch and m["batches"].get(batch[0], -1) >= batch[1]:
        return m["version"]
    schema = T.StructType.fromJson(m["schema"]) if m else schema or changes.schema
    base = m or {"version": -1, "buckets": 0, "rows": 0, "folders": {}, "batches": {}}
    rows = changes.count()
    buckets = max(base["buckets"], 1)
    while buckets < MOST_BUCKETS and base["rows"] + rows > 2 * buckets * bucket_rows:
        buckets *= 2
    if buckets != base["buckets"]:
        # All rows are dealt anew.
        touched, old = list(range(buckets)), _read(spark, path, m) if m else spark.createDataFrame([], schema)
    else:
        touched = [r[0] for r in changes.select(_bucket(key, buckets).alias("b")).distinct().collect()]  # at most the buckets
        old = _read(spark, path, m, touched)
    write = uuid.uuid4().hex
    new = merge(old, changes).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    salts = max(1, -(-(base["rows"] + rows) // (buckets * bucket_rows)))
    placed = new.withColumn("bucket", _bucket(key, buckets))
    # A crowded key is dealt over as many tasks as its bucket has full shares.
    placed.repartition(F.col("bucket"), F.pmod(F.xxhash64(*[f.name for f in schema.fields if not isinstance(f.dataType, T.MapType)]), F.lit(salts))).write.partitionBy("bucket").parquet(f"{path}/data/{write}")
    made = {n.split("=")[1] for n in _names(spark, f"{path}/data/{write}") if n.startswith("bucket=")}
    folders = {b: f for b, f in base["folders"].items() if buckets == base["buckets"] and int(b) not in set(touched)}
    folders |= {b: write for b in made}
    after = {
        "version": base["version"] + 1, "buckets": buckets, "key": key, "folders": folders, "schema": schema.jsonValue(),
        "batches": base["batches"] | ({batch[0]: batch[1]} if batch else {}),
    }
    after["rows"] = _read(spark, path, after).count()
    if not _publish(spark, f"{path}/versions/{after['version']:012d}.json", json.dumps(after)):
        raise Conflict(f"version {after['version']} of {path} was published by another writer")
    return after["version"]


def replace(spark: SparkSession, path: str, rows: DataFrame, key: str, **options) -> int:
    """Rows of the given keys take the place of all earlier ones of these keys."""
    return change(spark, path, rows, key, lambda old, new: old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new), **options)


def delete(spark: SparkSession, path: str, keys: DataFrame, key: str, **options) -> int:
    """Without the rows of the given keys."""
    return change(spark, path, keys.select(key), key, lambda old, gone: old.join(gone.distinct(), key, "left_anti"), **options)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Drop all but the newest ``keep`` versions and the folders none of these names, also those of writers that failed.
    For times without writers; gives the number of folders removed."""
    known = versions(spark, path)
    fs, _ = _fs(spark, path)
    for v in known[:-keep]:
        fs.delete(_fs(spark, f"{path}/versions/{v:012d}.json")[1], False)
    used = {f for v in known[-keep:] for f in manifest(spark, path, v)["folders"].values()}
    gone = [n for n in _names(spark, f"{path}/data") if n not in used]
    for n in gone:
        fs.delete(_fs(spark, f"{path}/data/{n}")[1], True)
    return len(gone)
