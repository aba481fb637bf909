"""Helpers shared by the operators of this package."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.sizing import written

# Words are maximal runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
# Rows of one sorted block of a numbering.
BLOCK_ROWS = 50_000
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def small_batches(spark: SparkSession):
    """Whole texts go to Python in Arrow batches of about ``BATCH_BYTES`` while an action runs: a task and its worker both
    hold a batch, and that of 10,000 usual texts is many times as large."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def text_of(c: str | Column = "text") -> Column:
    """The whole text; a null text is the empty one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def id_text(c: str | Column = "doc_id") -> Column:
    """The id as text; a null id is the empty one."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def fold(c: str | Column, salt: int) -> Column:
    """Fold of a document: the CRC of its id, modulo ``salt``."""
    return F.crc32(id_text(c)) % salt


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else. ASCII texts take the fast way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def split_words(c: Column) -> Column:
    """Words of a text, in order. Only the ends of a split can be empty."""
    return F.filter(F.split(c, BLANKS, -1), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words of a text."""
    parts = F.size(F.split(c, BLANKS, -1))
    return (
        parts - F.when(c.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
        - F.when(c.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
        - F.when(c == "", 1).otherwise(0)
    ).cast("bigint")


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``node``: the place of every row in its tree, from 0, without a window over a whole tree.

    Rows are sorted by range over all partitions; a row's place is the number of its tree's rows in earlier partitions and
    its place in its own. The counts are one narrow row per tree and partition.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK_ROWS))
    spread = rows.repartitionByRange(n, F.col(tree).asc_nulls_first(), *order)
    # Written with its partition number: both uses see the same rows.
    spread = written(spread.withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.select(F.col(tree).alias("_t"), F.col("_part").alias("_p"), "_before")
    inner = F.row_number().over(Window.partitionBy("_part", tree).orderBy(*order)) - 1
    placed = spread.withColumn("_at", inner)
    met = placed.join(sizes, (placed["_part"] == sizes["_p"]) & placed[tree].eqNullSafe(sizes["_t"]))
    return met.withColumn("node", (F.col("_before") + F.col("_at")).cast("long")).drop("_t", "_p", "_before", "_at", "_part")


def components(links: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of a link table: the smallest node reachable.

    Labels go down along links and then along the labels themselves (``label[label]``), so chains
    shorten geometrically. One round is two aggregations and two joins on narrow rows, whose large
    sides adaptive execution splits; no neighbourhood is ever collected. Each round is written to the
    shared folder; the loop ends when a round changes nothing.
    """
    both = links.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    label = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    for _ in range(max_rounds):
        # Smallest label among the neighbours.
        near = (
            both.join(label.select(F.col("u").alias("v"), "l"), "v")
            .groupBy("u").agg(F.min("l").alias("n"))
        )
        step = label.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "n").alias("l"))
        # The node named by the old label learns the new one, and every node jumps to its label's label.
        told = step.groupBy(F.col("old").alias("u")).agg(F.min("l").alias("t"))
        step = written(
            step.join(told, "u", "left").select("u", "old", F.least(F.col("l"), F.coalesce("t", "l")).alias("l"))
        )
        jump = step.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        new = written(
            step.join(jump, "l", "left").select("u", "old", F.least(F.col("l"), F.coalesce("ll", "l")).alias("l"))
        )
        changed = new.where("l < old").limit(1).count()
        label = new.select("u", "l")
        if not changed:
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
    raise RuntimeError("components did not settle")


def bytes_words(text: str) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lowered. ``bytes`` knows ASCII alone, so both steps follow the word rule."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def whole_groups(batches, keys: list[str]):
    """Regroup sorted batches of a task into frames that hold whole groups; one group may span batches."""
    import pandas as pd

    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        first, last = held[0][keys].iloc[0], pdf[keys].iloc[-1]
        if (first == last).all():
            continue
        pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
        cut = int((pdf[keys] == last).all(axis=1).to_numpy().argmax())
        yield pdf.iloc[:cut]
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(pdf, keys: list[str]):
    """Start and end positions of the groups of a sorted frame."""
    import numpy as np

    new = np.ones(len(pdf), dtype=bool)
    if len(pdf) > 1:
        new[1:] = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return zip(starts, [*starts[1:], len(pdf)])


def forest(linked):
    """Edges ``(row, row)`` of a spanning forest of a symmetric Boolean matrix."""
    import numpy as np

    todo, edges = linked.any(axis=1), []
    while todo.any():
        root = int(todo.argmax())
        todo[root] = False
        stack = [root]
        while stack:
            a = stack.pop()
            near = np.flatnonzero(linked[a] & todo)
            todo[near] = False
            edges += [(a, int(b)) for b in near]
            stack += near.tolist()
    return edges
