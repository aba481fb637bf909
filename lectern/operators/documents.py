"""Pages, chunks and upload checks. One document stays one row until its chunks are exploded, so
nothing here shuffles: page numbers and the running chunk index are positions inside the row."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import DEFAULTS
from lectern.functions import fixed_values as V
from lectern.functions import text as tx
from lectern.functions.text import as_col

ALLOWED_EXTENSIONS = [".pdf", ".txt", ".docx"]
# Windows cut from one block of the text, and from one part of a block, so that neither is scanned from its start for each.
_WINDOWS_PER_BLOCK, _WINDOWS_PER_PART = 64, 8
# Documents that a Python worker cuts before it passes their chunks on.
_DOCUMENTS_AT_ONCE = 128


# --- pages ---------------------------------------------------------------------------------------
def line_pages(text: str | Column, n: int = DEFAULTS.lines_per_page, plain: Column | None = None) -> Column:
    """Pages of ``n`` lines as an array of structs; at least one page. ``plain`` as in :func:`tx.split_lines`."""
    return tx.let(
        tx.split_lines(text, plain),
        lambda lines: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(lines), F.lit(1)) - 1, F.lit(n)),
            lambda i: F.struct(
                (i / n + 1).cast("int").alias("page_number"),
                F.array_join(F.slice(lines, i + 1, F.lit(n)), "\n").alias("text"),
                i.alias("line_start"),
                F.least(i + n, F.size(lines)).alias("line_end"),
            ),
        ),
    )


def paginate_lines(df: DataFrame, text: str = "text", n: int = DEFAULTS.lines_per_page) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.inline(line_pages(text, n)))


def paginate_paragraphs(df: DataFrame, paras: str = "paras", limit: int = DEFAULTS.page_chars) -> DataFrame:
    """Close a page once its paragraphs reach ``limit`` characters.

    The running length restarts with every page, so the page of each paragraph comes from a fold
    over the lengths of that row; the texts are gathered by slicing afterwards.
    """
    keep = [c for c in df.columns if c != paras]
    kept = F.filter(F.col(paras), lambda p: tx.trim_py(p) != "")
    # State: characters on the open page and the end positions of the closed pages.
    ends = F.aggregate(
        F.transform(F.col("_kept"), lambda p: F.length(p)),
        F.struct(F.lit(0).alias("open"), F.lit(0).alias("pos"), F.array().cast("array<int>").alias("ends")),
        lambda s, n: F.struct(
            F.when(s["open"] + n >= limit, 0).otherwise(s["open"] + n).alias("open"),
            (s["pos"] + 1).alias("pos"),
            F.when(s["open"] + n >= limit, F.array_append(s["ends"], s["pos"] + 1)).otherwise(s["ends"]).alias("ends"),
        ),
        lambda s: F.when(s["open"] > 0, F.array_append(s["ends"], s["pos"])).otherwise(s["ends"]),
    )
    pages = F.transform(
        F.col("_ends"),
        lambda e, i: F.struct(
            (i + 1).cast("int").alias("page_number"),
            F.array_join(F.slice(F.col("_kept"), _start(i) + 1, e - _start(i)), "\n\n").alias("text"),
            (e - _start(i)).alias("paragraph_count"),
        ),
    )
    empty = F.array(
        F.struct(F.lit(1).alias("page_number"), F.lit("").alias("text"), F.lit(None).cast("int").alias("paragraph_count"))
    )
    out = df.withColumn("_kept", kept).withColumn("_ends", ends)
    return out.select(*keep, F.inline(F.when(F.size("_ends") > 0, pages).otherwise(empty)))


def _start(i: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("_ends"), F.nullif(i, F.lit(0))), F.lit(0))


# --- chunk texts ---------------------------------------------------------------------------------
def check_chunking(size: int, overlap: int) -> None:
    if overlap >= size:
        raise ValueError(f"chunk overlap ({overlap}) must be smaller than the chunk size ({size})")


def fixed_chunks(text: str | Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of ``size`` characters, stripped, empty ones dropped."""
    check_chunking(size, overlap)
    text, step = as_col(text), size - overlap
    length = F.length(text)
    n = F.greatest(F.lit(1), F.ceil((length - overlap) / step)).cast("int")

    def parts(text: Column, n: Column, per: int, cut) -> Column:
        """The windows that ``cut(text, n)`` gives of every part with ``per`` of the ``n`` windows."""
        several = F.transform(
            F.sequence(F.lit(0), ((n - 1) / per).cast("int")),
            lambda b: F.struct(
                F.substring(text, b * (per * step) + 1, F.lit((per - 1) * step + size)).alias("text"),
                F.least(F.lit(per), n - b * per).alias("n"),
            ),
        )
        return F.flatten(F.transform(several, lambda k: cut(k["text"], k["n"])))

    def each(text: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))

    windows = parts(text, n, _WINDOWS_PER_BLOCK, lambda t, m: parts(t, m, _WINDOWS_PER_PART, each))
    windows = F.transform(windows, tx.trim_ends)
    return F.when(length == 0, F.array().cast("array<string>")).otherwise(F.filter(windows, lambda w: w != ""))


def sentences(text: str | Column) -> Column:
    parts = F.split(as_col(text), V.SENTENCE_BREAK, -1)
    return F.filter(F.transform(parts, tx.trim_py), lambda s: s != "")


def _windows(text: str, size: int, overlap: int) -> list[str]:
    last = max(0, -(-(len(text) - size) // (size - overlap)))
    cut = (text[i * (size - overlap) :][:size].strip() for i in range(last + 1))
    return [c for c in cut if c]


def _spans(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy spans over units that each take ``length + 1`` characters.

    With running totals the end of a span and the start of the carried tail are binary searches:
    a span ends before the unit that would overflow it, and the next one starts at the first unit
    whose tail up to that end fits the overlap. A carried tail always takes at least one new unit.
    """
    total = [0, *accumulate(n + 1 for n in lengths)]
    out, start, end = [], 0, 0
    while end < len(lengths):
        end = max(end + 1, bisect_right(total, total[start] + size) - 1)
        out.append((start, end))
        start = max(start, bisect_left(total, total[end] - overlap))
    return out


def _sentence_chunks(text: str, size: int, overlap: int) -> list[str]:
    units = [s.strip() for s in re.split(V.SENTENCE_BREAK, text)]
    units = [u for u in units if u]
    if not units:
        return _windows(text, size, overlap) if text else []
    out: list[str] = []
    first = 0
    long_ones = [i for i, u in enumerate(units) if len(u) > size]
    for cut in [*long_ones, len(units)]:
        run = units[first:cut]
        out += [" ".join(run[a:b]).strip() for a, b in _spans([len(u) for u in run], size, overlap)]
        if cut < len(units):
            out += _windows(units[cut], size, overlap)
        first = cut + 1
    return out


def _paragraph_chunks(text: str, size: int, overlap: int) -> list[str]:
    units = [p.strip() for p in text.split("\n\n")]
    units = [u for u in units if u]
    if not units:
        return _sentence_chunks(text, size, overlap)
    out: list[str] = []
    first = 0
    long_ones = [i for i, u in enumerate(units) if len(u) > size]
    for cut in [*long_ones, len(units)]:
        run = units[first:cut]
        # The separator takes two characters and nothing is carried over.
        out += ["\n\n".join(run[a:b]).strip() for a, b in _spans([len(u) + 1 for u in run], size, 0)]
        if cut < len(units):
            out += _sentence_chunks(units[cut], size, overlap)
        first = cut + 1
    return out


def split_text(text: str, strategy: str, size: int, overlap: int) -> list[str]:
    """Chunks of one text; the helper that runs inside Arrow batches and in the SQL table function."""
    if not text:
        return []
    rule = {"fixed": _windows, "paragraph_aware": _paragraph_chunks}.get(strategy, _sentence_chunks)
    return rule(text, size, overlap)


def _page_chunks(df: DataFrame, strategy: str, size: int, overlap: int, keep: list[str]) -> DataFrame:
    """``keep``, running chunk index, page number and content from the columns ``_n`` (page numbers)
    and ``_t`` (page texts)."""
    check_chunking(size, overlap)
    if strategy == "fixed":
        rows = F.flatten(
            F.zip_with(
                "_n", "_t",
                lambda n, t: F.transform(
                    fixed_chunks(t, size, overlap), lambda c: F.struct(n.alias("page_number"), c.alias("content"))
                ),
            )
        )
        out = df.select(*keep, F.posexplode(rows).alias("chunk_index", "_r"))
        return out.select(*keep, "chunk_index", "_r.page_number", "_r.content")

    def cut(batches):
        # Few documents at a time: a worker holds the chunks of those alone, not of an Arrow batch.
        for part in (b.iloc[i : i + _DOCUMENTS_AT_ONCE] for b in batches for i in range(0, len(b), _DOCUMENTS_AT_ONCE)):
            batch = part.reset_index(drop=True)
            pages = [
                [(n, c) for n, t in zip(ns, ts, strict=True) for c in split_text(t, strategy, size, overlap)]
                for ns, ts in zip(batch["_n"], batch["_t"], strict=True)
            ]
            flat = [(i, n, c) for rows in pages for i, (n, c) in enumerate(rows)]
            out = batch[keep].loc[batch.index.repeat([len(r) for r in pages])].reset_index(drop=True)
            extra = pd.DataFrame(flat, columns=["chunk_index", "page_number", "content"])
            yield pd.concat([out, extra], axis=1)

    fields = [df.schema[c] for c in keep]
    number = df.schema["_n"].dataType.elementType
    schema = T.StructType([
        *fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("page_number", number),
        T.StructField("content", T.StringType()),
    ])
    return df.select(*keep, "_n", "_t").mapInPandas(cut, schema)


def chunk(
    df: DataFrame, text: str = "text", strategy: str = DEFAULTS.chunk_strategy, size: int | None = None,
    overlap: int | None = None,
) -> DataFrame:
    """One row per chunk of a text column, with its position."""
    size = DEFAULTS.chunk_size if size is None else size
    overlap = DEFAULTS.chunk_overlap if overlap is None else overlap
    keep = [c for c in df.columns if c != text]
    one = df.select(*keep, F.array(F.lit(1)).alias("_n"), F.array(text).alias("_t"))
    return _page_chunks(one, strategy, size, overlap, keep).drop("page_number")


def chunk_document(
    df: DataFrame, pages: str = "pages", strategy: str = DEFAULTS.chunk_strategy, size: int | None = None,
    overlap: int | None = None,
) -> DataFrame:
    """Chunks of all pages of a document with one running index.

    ``pages`` is an array of structs with ``page_number`` and ``text``; blank pages are skipped.
    """
    size = DEFAULTS.chunk_size if size is None else size
    overlap = DEFAULTS.chunk_overlap if overlap is None else overlap
    keep = [c for c in df.columns if c != pages]
    filled = F.filter(
        F.transform(
            F.col(pages),
            lambda p: F.struct(p["page_number"].alias("page_number"), tx.trim_ends(p["text"]).alias("text")),
        ),
        lambda p: p["text"] != "",
    )
    cut = df.select(*keep, filled.alias("_p")).select(
        *keep, F.col("_p.page_number").alias("_n"), F.col("_p.text").alias("_t")
    )
    out = _page_chunks(cut, strategy, size, overlap, keep)
    return out.withColumn(
        "metadata",
        F.struct(
            F.length("content").alias("char_count"), tx.chunk_tokens("content").alias("token_estimate"),
            "page_number", F.lit(strategy).alias("strategy"),
        ),
    )


# --- upload checks -------------------------------------------------------------------------------
def upload_problem(name: str | Column, size: str | Column, max_mb: int = DEFAULTS.max_upload_mb) -> Column:
    """Reason for a rejection, null for a valid file."""
    size = as_col(size)
    return (
        F.when(~tx.file_extension(name).isin(ALLOWED_EXTENSIONS), "unsupported_extension")
        .when(size == 0, "empty_file")
        .when(size > max_mb * 1024 * 1024, "file_too_large")
    )


def validate_files(
    df: DataFrame, name: str = "filename", size: str = "file_size", max_mb: int = DEFAULTS.max_upload_mb
) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("reason", upload_problem(name, size, max_mb))
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def route_by_type(df: DataFrame, path: str = "path") -> DataFrame:
    """Extractor for each file by its extension; unknown types fail as a row, not as a job."""
    ext = tx.file_extension(path)
    known = ext.isin(ALLOWED_EXTENSIONS)
    return df.select(
        "*",
        F.when(known, F.substring(ext, 2, 10)).alias("extractor"),
        F.when(known, F.lit("PROCESSING")).otherwise("FAILED").alias("status"),
        F.when(~known, F.concat(F.lit("Unsupported file type: "), ext)).alias("error_message"),
    )


def ingest_status(docs: DataFrame, chunks: DataFrame, errors: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Status, chunk count and error of every document; no text still counts as completed."""
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"))
    out = docs.join(counts, key, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    if errors is None:
        return out.withColumn("status", F.lit("COMPLETED")).withColumn("error_message", F.lit(None).cast("string"))
    failed = errors.groupBy(key).agg(F.min("error_message").alias("error_message"))
    out = out.join(failed, key, "left")
    bad = F.col("error_message").isNotNull()
    return out.withColumn("status", F.when(bad, "FAILED").otherwise("COMPLETED")).withColumn(
        "chunk_count", F.when(bad, 0).otherwise(F.col("chunk_count"))
    )
