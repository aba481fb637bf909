"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending order, ids as little-endian unsigned 32-bit integers:

1. data frames of at most ``FRAME_IDS`` ids each; a longer document continues in the next frame;
2. one skippable frame with the place of every document: ids, nulls among the ids, first token (compressed);
3. the seek table, a skippable frame of the public seekable format: compressed size, decompressed size and checksum (low
   half of XXH64 of the decompressed bytes) of every frame, then the number of frames.

Any zstandard reader unpacks such a file to its ids. A reader of single documents fetches the table, the places and the
frames that it needs, and compares their checksums.

Both sides are a Spark data source, ``token_frames``. The writer's tasks roll files of bounded size under names of their
own and give their names to the commit, which writes the manifest (a few numbers per file) last and by one rename: files
of lost tasks are in no manifest, and readers see a table whole or not at all. A read has a task per file; filters on
``doc_id`` prune files by the manifest and frames by the places.

Results: a null or empty text is one end id. Every row is written, repeated rows too; null ids come first, rows of one id
by the hash of their text. An empty table gives a manifest without files, and an empty table again. Extra columns are not
read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from lectern.llm import tokens
from lectern.llm.common import small_batches, text_of

FRAME_IDS = 1 << 16
FILE_IDS = 1 << 25
FILE_DOCS = 1 << 19
TASK_BYTES = 64 << 20
LEVEL = 3
MANIFEST = "_manifest.json"
# Fixed values of the public frame formats.
_SKIPPABLE = 0x184D2A50
_SEEK_FRAME = 0x184D2A5E
_SEEK_MAGIC = 0x8F92EAB1
_CHECKSUMS = 0x80
_PLACE = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("first", "<u8")])


def _checksum(data) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data) & 0xFFFFFFFF


def file_system(path: str):
    """File system and plain path of a URI, in a task or in the driver."""
    from pyarrow import fs

    if "://" not in path and ":/" in path:
        scheme, rest = path.split(":", 1)
        path = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# --- files ---------------------------------------------------------------------------------------
class FrameWriter:
    """One file: documents in, frames out. Holds at most a frame of ids and the documents' places."""

    def __init__(self, out, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.frame_ids, self.compressor = out, frame_ids, zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.parts: list[np.ndarray] = []
        self.held = self.ids = 0
        self.doc_ids: list[int | None] = []
        self.first: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.first.append(self.ids)
        self.ids += len(ids)
        while self.held + len(ids) >= self.frame_ids:
            room = self.frame_ids - self.held
            self.parts.append(ids[:room])
            self._frame()
            ids = ids[room:]
        if len(ids):
            self.parts.append(ids)
            self.held += len(ids)

    def _frame(self) -> None:
        data = np.concatenate(self.parts).astype("<u4", copy=False).tobytes()
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), _checksum(data)))
        self.parts, self.held = [], 0

    def finish(self) -> None:
        if self.parts:
            self._frame()
        places = np.zeros(len(self.doc_ids), _PLACE)
        places["doc_id"] = [0 if d is None else d for d in self.doc_ids]
        places["null"] = [d is None for d in self.doc_ids]
        places["first"] = self.first
        packed = self.compressor.compress(places.tobytes())
        self.out.write(struct.pack("<II", _SKIPPABLE, len(packed)) + packed)
        # A skippable frame unpacks to nothing; its checksum is that of its content.
        table = [*self.table, (len(packed) + 8, 0, _checksum(packed))]
        body = b"".join(struct.pack("<III", *e) for e in table) + struct.pack("<IBI", len(table), _CHECKSUMS, _SEEK_MAGIC)
        self.out.write(struct.pack("<II", _SEEK_FRAME, len(body)) + body)


class FrameReader:
    """Random access to one file: only what is asked for is fetched and unpacked."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker, self.frames_read = source, zstandard.ZstdDecompressor(), 0
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._fetch(end - 9, 9))
        if magic != _SEEK_MAGIC or flags != _CHECKSUMS:
            raise ValueError("not a file of token frames: its seek table is missing")
        table = np.frombuffer(self._fetch(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.cumsum(table[:, 0]) - table[:, 0]
        self.table, at = table[:-1], int(self.starts[-1])
        packed = self._fetch(at + 8, int(table[-1, 0]) - 8)
        if _checksum(packed) != table[-1, 2]:
            raise ValueError("damaged places of documents")
        self.places = np.frombuffer(self.unpacker.decompress(packed), _PLACE)
        self.frame_first = (np.cumsum(table[:-1, 1]) - table[:-1, 1]) // 4
        self.total = int(table[:, 1].sum()) // 4
        self.bounds = np.append(self.places["first"].astype(np.int64), self.total)
        self.last: tuple[int, np.ndarray] | None = None

    def _fetch(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, no: int) -> np.ndarray:
        if self.last is None or self.last[0] != no:
            packed_size, size, want = (int(x) for x in self.table[no])
            data = self.unpacker.decompress(self._fetch(int(self.starts[no]), packed_size), max_output_size=size)
            if len(data) != size or _checksum(data) != want:
                raise ValueError(f"frame {no} is damaged")
            self.frames_read += 1
            self.last = (no, np.frombuffer(data, "<u4"))
        return self.last[1]

    def parts(self, doc: int):
        """Ids of the document at place ``doc``, frame by frame."""
        at, end = int(self.bounds[doc]), int(self.bounds[doc + 1])
        no = int(np.searchsorted(self.frame_first, at, "right")) - 1
        while at < end:
            first, ids = int(self.frame_first[no]), self.frame(no)
            yield ids[at - first : end - first]
            at, no = min(end, first + len(ids)), no + 1

    def document(self, doc: int) -> np.ndarray:
        return np.concatenate(list(self.parts(doc)))

    def wanted(self, ids: list[int | None] | None) -> np.ndarray:
        """Places of the documents with these ids, or all."""
        if ids is None:
            return np.arange(len(self.places))
        null = self.places["null"] == 1
        return np.flatnonzero(np.isin(self.places["doc_id"], [i for i in ids if i is not None]) & ~null)


# --- data source ---------------------------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[dict]


@dataclass
class FilePart(InputPartition):
    name: str
    first: int


class Writer(DataSourceArrowWriter):
    """Writes rows ``(doc_id, ids)`` that come sorted by document, partition after partition."""

    def __init__(self, options):
        self.path, self.level = options["path"], int(options.get("level", LEVEL))
        self.frame_ids, self.file_ids = int(options.get("frame_ids", FRAME_IDS)), int(options.get("file_ids", FILE_IDS))

    def write(self, iterator) -> Written:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        partition, files, writer, out = TaskContext.get().partitionId(), [], None, None

        def close():
            writer.finish()
            out.close()
            known = [d for d in writer.doc_ids if d is not None]
            files.append({
                "name": name, "docs": len(writer.doc_ids), "ids": writer.ids, "nulls": len(writer.doc_ids) - len(known),
                "low": min(known, default=None), "high": max(known, default=None),
            })

        for batch in iterator:
            values = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                if writer is None:
                    # A name of its own for every attempt.
                    name = f"part-{partition:06d}-{len(files):04d}-{uuid.uuid4().hex}.tok.zst"
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    writer = FrameWriter(out, self.level, self.frame_ids)
                writer.add(doc_id, np.frombuffer(values[i].as_buffer(), "<u4"))
                if writer.ids >= self.file_ids or len(writer.doc_ids) >= FILE_DOCS:
                    close()
                    writer = None
        if writer is not None:
            close()
        return Written(partition, files)

    def commit(self, messages) -> None:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        files, first = [], 0
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for f in message.files:
                files.append({**f, "first": first})
                first += f["ids"]
        new = f"{folder}/{MANIFEST}-{uuid.uuid4().hex}"
        with system.open_output_stream(new) as out:
            out.write(json.dumps({"ids": first, "files": files}).encode())
        system.move(new, f"{folder}/{MANIFEST}")

    def abort(self, messages) -> None:
        """Files of an ended job stay out of every manifest; those that reported are removed."""
        system, folder = file_system(self.path)
        for message in messages:
            for f in message.files if message is not None else []:
                system.delete_file(f"{folder}/{f['name']}")


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.with_ids = options["path"], options.get("content", "ids") == "ids"
        self.ids: list[int | None] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("doc_id",):
                new = list(f.value) if isinstance(f, In) else [f.value]
                self.ids = new if self.ids is None else [i for i in self.ids if i in new]
            # Spark tests again: the filter here only saves work.
            yield f

    def partitions(self):
        system, folder = file_system(self.path)
        with system.open_input_stream(f"{folder}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        hit = lambda f: self.ids is None or any(i is not None and f["low"] is not None and f["low"] <= i <= f["high"] for i in self.ids)
        return [FilePart(f["name"], f["first"]) for f in files if hit(f)]

    def read(self, partition):
        if partition is None:
            return
        system, folder = file_system(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as source:
            file = FrameReader(source)
            rows, held = [], 0
            for doc in file.wanted(self.ids).tolist():
                crc, parts = 0, []
                for ids in file.parts(doc):
                    data = ids.tobytes()
                    crc = zlib.crc32(data, crc)
                    if self.with_ids:
                        parts.append(data)
                        held += len(data)
                at, end = int(file.bounds[doc]), int(file.bounds[doc + 1])
                doc_id = None if file.places["null"][doc] else int(file.places["doc_id"][doc])
                rows.append((doc_id, partition.first + at, end - at, crc, *([b"".join(parts)] if self.with_ids else [])))
                if held > 4 << 20 or len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows):
        kinds = [pa.int64()] * 4 + ([pa.binary()] if self.with_ids else [])
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if self.with_ids else [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class TokenFrames(DataSource):
    """``token_frames``: reads ``doc_id, start, n_tokens, ids_crc32`` and, unless ``content`` is ``digest``, ``ids``."""

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def schema(self) -> str:
        more = "" if self.options.get("content", "ids") == "digest" else ", ids binary"
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + more

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite) -> Writer:
        return Writer(self.options)


# --- operator ------------------------------------------------------------------------------------
def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row in the order of its partition."""

    def run(batches):
        encoder = tokens.Ids(tokens.path(vocabulary))
        for batch in batches:
            for lo, ids, bounds in encoder.blocks(batch.column("t")):
                n = len(bounds) - 1
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * bounds), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("id")[lo : lo + n], data.cast(pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).mapInArrow(run, "doc_id long, ids binary")


def write(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, **options) -> None:
    """Files of all rows in ascending order of ``key`` below ``path``."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFrames)
    t, d = text_of(text), docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = d.agg(F.sum(F.octet_length(text_of("text")))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-int(size) // TASK_BYTES))
    # Rows of one id are split by their texts; equal rows may change places without a trace.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_salt")]
    d = d.select("doc_id", t.alias("text"), F.xxhash64(t).alias("_h"), F.spark_partition_id().alias("_salt"))
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order[:2]).select("doc_id", "text")
    with small_batches(spark):
        encode(d, vocabulary=vocabulary).write.format("token_frames").options(path=path, **options).mode("append").save()


def read(spark: SparkSession, path: str, ids: list[int] | None = None, content: str = "ids") -> DataFrame:
    """Documents of the files below ``path``: all, or those with the given ids, whose frames alone are unpacked."""
    spark.dataSource.register(TokenFrames)
    # A reader that takes filters asks for this setting.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    out = spark.read.format("token_frames").option("path", path).option("content", content).load()
    return out if ids is None else out.where(F.col("doc_id").isin(ids))
