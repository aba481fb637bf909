"""Harmonic packing of token sequences.

A document becomes the ids of its text and an end id. Its full stretches of ``size`` ids are sequences of their own. The
rest goes by its length: class ``k`` holds lengths in ``(size / (k + 1), size / k]`` and each of its bins takes exactly
``k`` pieces. A piece that would leave more than ``slack`` of its slot empty is cut at ``size // (k + 1)`` ids, the whole
slot of the next class, and what is over is treated likewise. Pieces are dealt to workers by a hash; every worker fills
its bins alone. What is left of its classes (fewer than ``k`` pieces each) goes, longest first, to the first sequence with
room.

Results: a null or empty text is one end id. Every row is packed, repeated rows too; a null id is kept. An empty table
gives an empty one. Reruns over equal files give equal sequences. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.tokens import VOCABULARY  # noqa: F401
from lectern.llm.common import small_batches, text_of
from lectern.operators.sizing import cut_lineage

SIZE = 4096
SLACK = 1 / 32
WORKER_PIECES = 4096
PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"]
PIECE = ", ".join(f"{n} long" for n in PIECE_NAMES)


def cuts(n: int, size: int = SIZE, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document with ``n`` ids."""
    out = [size] * (n // size)
    rest = n % size
    while rest:
        k = size // rest
        slot, lower = size // k, size // (k + 1)
        if slot - rest <= slack * slot or lower == 0 or rest - lower == 0 or k >= 64:
            out.append(rest)
            break
        out.append(lower)
        rest -= lower
    return out


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, slack: float = SLACK, vocabulary: str | None = None) -> DataFrame:
    """One narrow row per piece. ``vocabulary`` is the file's path on every worker."""

    def run(batches):
        ids = tokens.Ids(tokens.path(vocabulary))
        for batch in batches:
            for lo, got, bounds in ids.blocks(batch.column("t")):
                raw, rows = memoryview(got).cast("B"), []
                for doc, first, last in zip(batch.column("id")[lo : lo + len(bounds) - 1].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    at = 0
                    for i, length in enumerate(cuts(last - first, size, slack)):
                        spot = 4 * (first + at)
                        rows.append((doc, at, length, zlib.crc32(raw[spot : spot + 4 * length]), last - first, i))
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=PIECE_NAMES)

    return docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).mapInArrow(run, PIECE)


def _fill(size: int):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sequences of one worker."""
        pdf = pdf.assign(k=size // pdf["length"]).sort_values(["k", "turn", "doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        k, length = pdf["k"].to_numpy(), pdf["length"].to_numpy()
        rank = pdf.groupby("k").cumcount().to_numpy()
        full = rank < (pdf.groupby("k")["k"].transform("size").to_numpy() // k) * k
        bin_no = np.full(len(pdf), -1, dtype=np.int64)
        opened = np.flatnonzero(full & (rank % k == 0))
        offset = np.zeros(len(pdf), dtype=np.int64)
        number = np.cumsum(full & (rank % k == 0)) - 1
        bin_no[full] = number[full]
        before = np.cumsum(length) - length
        if len(opened):
            offset[full] = (before - before[opened][np.maximum(number, 0)])[full]
        rest, n, used = np.flatnonzero(~full), count(len(opened)), []
        for i in rest[np.argsort(-length[rest], kind="stable")]:
            spot = next((s for s in used if s[1] + length[i] <= size), None)
            if spot is None:
                used.append(spot := [next(n), 0])
            bin_no[i], offset[i] = spot
            spot[1] += int(length[i])
        pdf["sequence_id"] = pdf["worker"] * (1 << 24) + bin_no
        pdf["offset"] = offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return fill


def pack(docs: DataFrame, size: int = SIZE, worker_pieces: int = WORKER_PIECES, **options) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    with small_batches(docs.sparkSession):
        cut = cut_lineage(pieces(docs, size=size, **options))
    workers = max(1, -(-cut.count() // worker_pieces))
    turn = F.xxhash64("doc_id", "start", "ids_crc32")
    # Equal rows share a hash; the place in the written checkpoint, the same on every retry, spreads them too.
    dealt = cut.withColumn("turn", turn).withColumn("worker", F.pmod(F.xxhash64("turn", F.spark_partition_id()), F.lit(workers)))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.drop("nth").groupBy("worker").applyInPandas(_fill(size), kind)
