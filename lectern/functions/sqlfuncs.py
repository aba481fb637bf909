"""Names for SQL: ``register(spark)`` makes the Python-backed functions callable from queries."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern.functions.text import _nfkc
from lectern.operators.documents import check_chunking, split_text


@udtf(returnType="chunk_index int, content string")
class ChunkText:
    """``SELECT d.id, c.* FROM docs d, LATERAL chunk_text(d.text, 'sentence_aware', 512, 64) c``"""

    def eval(self, text: str, strategy: str, size: int, overlap: int):
        check_chunking(size, overlap)
        yield from enumerate(split_text(text or "", strategy, size, overlap))


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udf.register("nfkc", _nfkc)
