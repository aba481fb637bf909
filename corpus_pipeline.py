"""Training-data pipeline over ``documents``: every stage is written as Parquet and read again by the next one.

1. ``toxicity``: documents that the classifier rejects go; it is fitted to the labels of the given folder.
2. ``near_duplicates``: of every group of near copies one row stays, that with the smallest id.
3. ``secrets``: all spans found are replaced by a mark, ``n_chars`` follows the text; no document goes.
4. ``mixing``: sources come near their target weights; a document may come up to three times, or not at all. Rows are
   written shard by shard, each in the order of its shuffle.
5. ``packing``: pieces of token sequences with their places.

The stages before the last keep the columns of their input. Nulls, empty tables, repeated rows and extra columns are
treated as the operators say. Groups are told by their texts, never by ids: rows of one id with texts that are no near
copies stay, each for its group. A null id is the last one; of rows that share the smallest id of their group, the one
with the smallest text hash stays, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, packing, secrets, simhash, toxicity
from lectern.llm.common import read, text_of
from lectern.operators.sizing import run_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_class(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A column called like the operator's output keeps its values under another name meanwhile.
    own = docs.columns
    docs = docs.withColumnRenamed("secrets", "_llm_own_secrets")
    found = secrets.scan(docs)
    text = F.when(F.col("text").isNull(), F.lit(None)).when(F.size("secrets") == 0, F.col("text")).otherwise(
        secrets.redact(text_of(), F.col("secrets"))
    )
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("secrets") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    out = out.drop("secrets") if "secrets" in own else out
    return out.withColumnRenamed("_llm_own_secrets", "secrets").select(*own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Every shard in its own shuffled order; the places go only after the rows stand there.
    # The number of partitions is named: otherwise small outputs become one file, and the next stage one task.
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mixed = mixing.mix(docs).repartition(n, "mix_shard").sortWithinPartitions("mix_shard", "mix_turn")
    return mixed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("packing", pack_sequences),
]
# A trained model and a tokenizer decide; tests compare the stages with plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the session's shared folder."""
    docs, folder = read(spark, sf_dir, "documents"), run_dir(spark, "pipeline")
    for no, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{no}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
