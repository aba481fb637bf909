"""Document files as a Spark data source, ``document_files``, in batch and as a stream.

Rows are ``path, file_size, kind, paras, text, error_message``: the text of ``.txt`` files (UTF-8, else Latin-1), the
paragraphs of ``.docx`` files; a file that cannot be read, or of another kind, is a row with its error. A read lists
names and sizes, and a task reads the files of one share of about ``share_bytes``; one file is never split.

As a stream, an offset is the number of files known and the newest names at it are kept in a log of batches below
``log``: a batch is the sorted names that no earlier batch has, at most ``max_files`` of them, written there once. A
restarted stream reads each batch with the files it had, and files that arrive late or under any name come in a later one.
A run with ``availableNow`` takes one batch; pull until a run brings nothing, or use a trigger with an interval.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lectern.sources.files import docx_paragraphs

SCHEMA = "path string, file_size long, kind string, paras array<string>, text string, error_message string"
SHARE_BYTES = 32 << 20


def _system(path: str):
    from pyarrow import fs

    if "://" not in path and ":/" in path:
        scheme, rest = path.split(":", 1)
        path = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files below a folder, sorted; hidden and unfinished ones are left out."""
    from pyarrow import fs

    system, folder = _system(path)
    found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


@dataclass
class Share(InputPartition):
    files: list[tuple[str, int]]


def shares(files: list[tuple[str, int]], share_bytes: int) -> list[Share]:
    out, held, size = [], [], 0
    for name, n in files:
        if held and size + n > share_bytes:
            out.append(Share(held))
            held, size = [], 0
        held.append((name, n))
        size += n
    return [*out, Share(held)] if held else out


def row(system, name: str, size: int) -> tuple:
    kind = posixpath.splitext(name)[1].lower()
    if kind not in (".txt", ".docx"):
        return name, size, kind, None, None, f"Unsupported file type: {kind}"
    try:
        with system.open_input_file(name) as f:
            content = f.read()
        if kind == ".docx":
            return name, size, kind, docx_paragraphs(content), None, None
        try:
            return name, size, kind, None, content.decode("utf-8"), None
        except UnicodeDecodeError:
            return name, size, kind, None, content.decode("latin-1"), None
    except Exception as e:  # noqa: BLE001 - one broken file must not stop the job
        return name, size, kind, None, None, f"Failed to extract text from {kind[1:].upper()}: {e}"


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.share = options["path"], int(options.get("share_bytes", SHARE_BYTES))

    def partitions(self):
        return shares(listed(self.path), self.share)

    def read(self, partition):
        if partition is not None:
            system, _ = _system(self.path)
            yield from (row(system, *f) for f in partition.files)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.share = options["path"], int(options.get("share_bytes", SHARE_BYTES))
        self.log, self.most = options["log"], int(options.get("max_files", 1000))

    def _batches(self) -> list[str]:
        return [n for n, _ in listed(self.log) if n.endswith(".json")]

    def _files(self, name: str) -> list[tuple[str, int]]:
        system, _ = _system(self.log)
        with system.open_input_stream(name) as f:
            return [tuple(x) for x in json.loads(f.read())]

    def initialOffset(self):
        return {"batches": 0}

    def latestOffset(self):
        done = self._batches()
        seen = {n for b in done for n, _ in self._files(b)}
        new = [f for f in listed(self.path) if f[0] not in seen][: self.most]
        if new:
            system, folder = _system(self.log)
            system.create_dir(folder, recursive=True)
            held = f"{folder}/_{uuid.uuid4().hex}"
            with system.open_output_stream(held) as out:
                out.write(json.dumps(new).encode())
            system.move(held, f"{folder}/{len(done):09d}.json")
        return {"batches": len(done) + bool(new)}

    def partitions(self, start, end):
        names = self._batches()[start["batches"] : end["batches"]]
        return shares([f for n in names for f in self._files(n)], self.share)

    def read(self, partition):
        system, _ = _system(self.path)
        yield from (row(system, *f) for f in partition.files)

    def commit(self, end):
        """Nothing: the log is what a restart reads."""


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def read(spark: SparkSession, path: str, **options):
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("document_files").options(path=path, **options).load()


def stream(spark: SparkSession, path: str, log: str, **options):
    """Arriving files. ``log`` is the folder of the stream's batches, for this stream alone."""
    spark.dataSource.register(DocumentFiles)
    return spark.readStream.format("document_files").options(path=path, log=log, **options).load()


def write_files(docs, path: str, name: str = "name", text: str = "text") -> int:
    """One UTF-8 file per row, written by the tasks under its name; gives the number of files."""
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        system, folder = _system(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Written aside and moved: a listing never shows half a file.
                held = f"{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(held) as out:
                    out.write((content or "").encode("utf-8"))
                system.move(held, f"{folder}/{file}")
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    return docs.select(F.col(name), F.col(text)).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
