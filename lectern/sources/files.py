"""Text and word-processor files as tables of documents."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path and size of files; their content is not read unless a later step asks for it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def decode_text(content):
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def read_text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    files = list_files(spark, path, glob)
    return files.select("path", F.col("length").alias("file_size"), decode_text(F.col("content")).alias("text"))


def stream_text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """The same over arriving files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("file_size"), decode_text(F.col("content")).alias("text"))


def _paragraph(p: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((e.text or "") if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter())


def docx_paragraphs(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    return [_paragraph(p) for p in body.findall(f"{_W}p")]


def read_docx(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """Paragraphs of every file, or the error of a file that cannot be read."""

    def extract(batches):
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((p, docx_paragraphs(bytes(content)), None))
                except Exception as e:  # noqa: BLE001 - one broken file must not stop the job
                    rows.append((p, [], f"Failed to extract text from DOCX: {e}"))
            yield pd.DataFrame(rows, columns=["path", "paras", "error_message"])

    files = list_files(spark, path, glob).select("path", "content")
    return files.mapInPandas(extract, "path string, paras array<string>, error_message string")
