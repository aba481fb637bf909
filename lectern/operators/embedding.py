"""Embedding of texts with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import DEFAULTS
from lectern.functions import text as tx

Encoder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def prepared(text: str):
    """Text as the encoder sees it: one line, stripped."""
    return tx.trim_py(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))


def embed(
    df: DataFrame, encoder: Encoder | None = None, text: str = "content", dim: int = DEFAULTS.embedding_dim
) -> DataFrame:
    """Add ``embedding``, a unit vector of ``dim`` numbers.

    An encoder maps batches of texts to batches of vectors and loads its model once per worker, before its
    loop. Without one, hashed term counts are used; they need no model and stay in the JVM.
    """
    if encoder is not None:

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from encoder(batches)

        return df.withColumn("embedding", encode(prepared(text)))

    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tokens = df.withColumn("_tokens", tx.tokenize(prepared(text)))
    counted = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_tf").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")


def embed_queries(queries: DataFrame, encoder: Encoder | None = None, dim: int = DEFAULTS.embedding_dim) -> DataFrame:
    return embed(queries, encoder, "text", dim)


def validate_dim(df: DataFrame, dim: int, mode: str = "fail") -> DataFrame:
    """Check the vector length: ``fail`` stops the job, ``drop`` removes and ``flag`` marks wrong rows."""
    ok = F.coalesce(F.size("embedding") == dim, F.lit(False))
    if mode == "flag":
        return df.withColumn("valid", ok)
    if mode == "drop":
        return df.where(ok)
    message = F.concat(F.lit(f"expected {dim} dimensions, got "), F.size("embedding").cast("string"))
    return df.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(message)))
