"""Documents to chunks in one lazy plan without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions import text as tx
from lectern.operators import documents as D


def cleaned_pages(docs: DataFrame, text: str = "text", lines: int = DEFAULTS.lines_per_page) -> DataFrame:
    """Replace the text column by an array of cleaned pages.

    One pass over a text tells whether it has usual characters alone; the other searches are for the rest.
    """
    keep, plain = [c for c in docs.columns if c != text], F.col("_plain")
    marked = docs.withColumn("_plain", tx.is_plain(text)).withColumn(text, tx.normalize_unicode(text, plain=plain))
    paged = marked.select(*keep, "_plain", D.line_pages(text, lines, plain).alias("pages"))
    cleaned = F.transform(
        "pages",
        lambda p: F.struct(p["page_number"].alias("page_number"), tx.clean_marked(p["text"], plain).alias("text")),
    )
    return paged.select(*keep, cleaned.alias("pages"))


def ingest_chunks(
    docs: DataFrame, strategy: str = DEFAULTS.chunk_strategy, size: int = DEFAULTS.chunk_size,
    overlap: int = DEFAULTS.chunk_overlap, embed=None,
) -> DataFrame:
    """Paginate, clean and chunk every document; ``embed`` adds the vectors.

    Chunk ids are ``<doc_id>-<six-digit index>``, so they are stable and sort in document order.
    """
    chunks = D.chunk_document(cleaned_pages(docs), "pages", strategy, size, overlap)
    chunk_id = F.concat_ws("-", F.col("doc_id").cast("string"), F.lpad(F.col("chunk_index").cast("string"), 6, "0"))
    chunks = chunks.withColumn("chunk_id", chunk_id)
    return embed(chunks) if embed else chunks
