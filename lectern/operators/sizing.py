"""Measured sizes: a side is broadcast only after its rows and bytes were counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def _width(df: DataFrame):
    """Bytes of one row, measured for text and arrays, nominal for the rest."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(
            f.dataType.elementType, (T.StringType, T.StructType, T.ArrayType, T.MapType, T.BinaryType)
        ):
            total = total + 8 * F.greatest(F.size(c), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return total


def measure(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """Rows (counted up to ``max_rows + 1``) and bytes of a side that may be small."""
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    rows, size = measure(df, max_rows)
    return rows <= max_rows and size <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint when it is measured to be small; otherwise unchanged,
    so that the join shuffles and skewed keys are split by adaptive execution."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder (``spark.checkpoint.dir``)."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a table in the shared folder, read again. Its size is then known: in loops of joins a checkpoint would
    keep the estimate of its plan, and products of estimates grow beyond all bounds."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: that of the session's ``spark.checkpoint.dir``. Where none is set, a folder of
    this application in the warehouse, which executors share as well; it is removed when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_runs/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return own


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared folder."""
    import uuid

    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
