"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into pieces, so that two which differ in at most four bits differ in few bits of some piece: at most
one of three pieces, or two of two. The anchors of a piece are the words of a covering code of radius 1: a perfect code on
its low bits, all words on the bits above. A fingerprint is *home* at its nearest anchor and is replicated to every anchor
within covering radius plus these few bits; there it meets all its partners. The full 64 bits are compared per anchor. The
anchors go by the number of distinct fingerprints: three pieces have three times 2^17, two pieces twice 2^27 at more replicas
each, so that an anchor's members stay few; both find the same links. A bit per anchor, 2^27 of them a piece at most, tells the
tasks where anybody is at home; replicas at all other anchors are dropped as soon as they are made. Anchors with many members are cut into tiles of bounded size, and a
tile gives the edges of a spanning forest, never all pairs.

Results: a null text is an empty one; texts without a word have fingerprint zero and link with each other. Equal
fingerprints are compared once. Repeated rows give repeated rows. A null id never names a group; a group of null ids has
a null component. An empty table gives an empty one. Input columns called like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from lectern.llm.common import bytes_words, components, forest, group_bounds, text_of, whole_groups
from lectern.operators.sizing import cut_lineage, written

SHINGLE = 4
NEAR_BITS = 4
SEED = 42
TILE = 1024
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Bits set in over half of the shingle hashes, as a signed 64-bit number."""
    words = bytes_words(text or "")
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(n, len(words))
    cuts = map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    count = len(words) - k + 1
    hashes = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, count)
    # Eight one-byte counters per number: blocks of 255 hashes cannot overflow them.
    pad = -count % 255
    blocks = np.concatenate((hashes, np.zeros(pad, np.uint64))).reshape(-1, 255)
    bits = np.empty(64, dtype=np.int64)
    for b in range(8):
        lanes = ((blocks >> np.uint64(b)) & _LANES).sum(axis=1, dtype=np.uint64)
        bits[b::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    word = np.packbits(bits * 2 > count, bitorder="little").view("<u8")[0]
    return int(word.astype(np.int64))


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


@dataclass(frozen=True)
class Layout:
    """Pieces (first bit, bits), the check bits of the perfect code on each one's low bits, and how many bits of a piece a
    replica may be away from its fingerprint: covering radius 1 and the bits in which partners may differ there."""

    pieces: tuple[tuple[int, int], ...]
    check: int
    reach: int

    @property
    def code(self) -> int:
        return (1 << self.check) - 1


FEW = Layout(((0, 21), (21, 21), (42, 22)), 4, 2)
MANY = Layout(((0, 32), (32, 32)), 5, 3)
# Distinct fingerprints from which the anchors of ``MANY`` are used. Both layouts find all links.
MANY_FROM = 1 << 14


def layout_for(n: int) -> Layout:
    return MANY if n >= MANY_FROM else FEW


def _syndrome(part: np.ndarray, layout: Layout) -> np.ndarray:
    """Exclusive or of the places of the ones among the low bits."""
    places = np.arange(1, layout.code + 1)
    out = np.zeros(len(part), dtype=np.int64)
    for k in range(layout.check):
        mask = sum(1 << int(i - 1) for i in places[places >> k & 1 == 1])
        out |= (np.bitwise_count(part & np.int64(mask)).astype(np.int64) & 1) << k
    return out


@lru_cache
def _moves(bits: int, layout: Layout) -> list[np.ndarray]:
    """For each syndrome: changes of at most ``reach`` bits that lead from such a word to an anchor."""
    high, out = bits - layout.code, [[] for _ in range(layout.code + 1)]
    for weight in range(layout.reach + 1):
        for spots in combinations(range(layout.code), weight):
            s, low = 0, 0
            for i in spots:
                s, low = s ^ (i + 1), low | 1 << i
            for more in range(layout.reach - weight + 1):
                out[s] += [low | sum(1 << (layout.code + i) for i in above) for above in combinations(range(high), more)]
    return [np.array(sorted(m), dtype=np.int64) for m in out]


def anchors(fp: np.ndarray, piece: int, layout: Layout = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, home)``: the anchors of each fingerprint in one piece."""
    first, bits = layout.pieces[piece]
    part = ((fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    syndrome, moves = _syndrome(part, layout), _moves(bits, layout)
    rows, at, home = [], [], []
    for s in range(layout.code + 1):
        mine = np.flatnonzero(syndrome == s)
        near = 0 if s == 0 else 1 << (s - 1)
        rows.append(np.repeat(mine, len(moves[s])))
        at.append((part[mine][:, None] ^ moves[s][None, :]).ravel())
        home.append(np.tile(moves[s] == near, len(mine)))
    return np.concatenate(rows), np.concatenate(at), np.concatenate(home)


def _number(anchor: np.ndarray, layout: Layout) -> np.ndarray:
    """Number of an anchor among those of its piece: its bits without the check bits, which stand at the powers of two."""
    out, at = np.zeros(len(anchor), np.int64), 0
    for k in range(1, layout.check):
        width = (1 << k) - 1
        out |= (anchor >> (1 << k) & ((1 << width) - 1)) << at
        at += width
    return out | anchor >> layout.code << at


def _home_bits(homes: DataFrame, layout: Layout) -> list[np.ndarray]:
    """For each piece a bit per anchor: whether any fingerprint is at home there. At most 2^27 bits a piece come to the driver,
    whatever the number of fingerprints."""
    # Spark numbers the bits of its bitmaps from one.
    one = F.col("number") + 1
    parts = homes.groupBy("piece", F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits")).collect()
    out = [np.zeros(1 << max(bits - layout.check - 3, 12), np.uint8) for _, bits in layout.pieces]
    for r in parts:
        # Buckets count from one and hold 2^15 bits.
        held, first = np.frombuffer(r["bits"], np.uint8), (r["bucket"] - 1) << 12
        out[r["piece"]][first : first + len(held)] = held[: len(out[r["piece"]]) - first]
    return out


def _homes(layout: Layout):
    """Rows ``(piece, number, anchor, fp)``: where fingerprints are at home."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for p in range(len(layout.pieces)):
                first, bits = layout.pieces[p]
                part = ((fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                s = _syndrome(part, layout)
                anchor = part ^ np.where(s == 0, 0, np.int64(1) << np.maximum(s - 1, 0))
                names = ["piece", "number", "anchor", "fp"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(fp), p), _number(anchor, layout), (p << 32) | anchor, fp)], names=names)

    return run


def _replicate(layout: Layout, bits):
    """Rows ``(anchor, fp, home)``: replicas at anchors where somebody is at home."""

    def run(batches):
        at_home = bits.value
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(every), 2000):
                fp = every[lo : lo + 2000]
                for p in range(len(layout.pieces)):
                    r, a, h = anchors(fp, p, layout)
                    n = _number(a, layout)
                    kept = np.flatnonzero(at_home[p][n >> 3] >> (n & 7).astype(np.uint8) & 1)
                    r, a, h = r[kept], a[kept], h[kept]
                    yield pa.RecordBatch.from_arrays([pa.array((p << 32) | a), pa.array(fp[r]), pa.array(h)], names=["anchor", "fp", "home"])

    return run


def _spots(fps: DataFrame, layout: Layout) -> DataFrame:
    """Replicas at anchors where another fingerprint is at home, and the homes there. All others meet nobody."""
    one = fps.select("fp")
    homes = written(one.mapInArrow(_homes(layout), "piece long, number long, anchor long, fp long"))
    bits = fps.sparkSession.sparkContext.broadcast(_home_bits(homes, layout))
    replicas = written(one.mapInArrow(_replicate(layout, bits), "anchor long, fp long, home boolean"))
    at = homes.select(F.col("anchor").alias("_anchor"), F.col("fp").alias("_fp"))
    met = written(replicas.join(at, (F.col("anchor") == F.col("_anchor")) & (F.col("fp") != F.col("_fp")), "left_semi"))
    visited = homes.select("anchor", "fp", F.lit(True).alias("home")).join(met.where("not home").select("anchor").distinct(), "anchor", "left_semi")
    return written(met.where("not home").unionByName(met.where("home").unionByName(visited).distinct()))


def _compare(batches):
    keys = ["anchor", "tile"]
    for pdf in whole_groups(batches, keys):
        fp, left, right = pdf["fp"].to_numpy(np.uint64), pdf["left"].to_numpy(), pdf["right"].to_numpy()
        a, b = [], []
        for s, e in group_bounds(pdf, keys):
            h, o = np.flatnonzero(left[s:e]) + s, np.flatnonzero(right[s:e]) + s
            if not len(h) or not len(o):
                continue
            linked = np.bitwise_count(fp[h][:, None] ^ fp[o][None, :]) <= NEAR_BITS
            linked &= fp[h][:, None] != fp[o][None, :]
            if not linked.any():
                continue
            rows = np.concatenate((h, o))
            both = np.zeros((len(rows), len(rows)), dtype=bool)
            both[: len(h), len(h) :] = linked
            both |= both.T
            for x, y in forest(both):
                a.append(rows[x])
                b.append(rows[y])
        got = pdf["fp"].to_numpy(np.int64)
        yield pd.DataFrame({"a": got[a] if a else np.array([], np.int64), "b": got[b] if b else np.array([], np.int64)})


def links(fps: DataFrame, tile: int = TILE, layout: Layout | None = None) -> DataFrame:
    """``(a, b)``: links that join the same fingerprints as all pairs within four bits do. ``fps`` has distinct ``fp``."""
    layout = layout or layout_for(fps.count())
    spots = _spots(fps, layout)
    sizes = written(
        spots.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("n_home"))
        .where("n > 1 and n_home > 0")
        .select("anchor", F.ceil(F.col("n") / tile).cast("int").alias("n_right"), F.ceil(F.col("n_home") / tile).cast("int").alias("n_left"))
    )
    # Nearly all anchors are one tile: every row once, on both sides where it is at home.
    one = spots.join(sizes.where("n_right = 1"), "anchor").select(
        "anchor", "fp", F.col("home").alias("left"), F.lit(True).alias("right"), F.lit(0).cast("bigint").alias("tile")
    )
    d = spots.join(sizes.where("n_right > 1"), "anchor")
    salt = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n))
    right = d.select(
        "anchor", "fp", F.lit(False).alias("left"), F.lit(True).alias("right"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("n_left") - 1), lambda i: i * F.col("n_right") + salt("n_right", 1))).alias("tile"),
    )
    left = d.where("home").select(
        "anchor", "fp", F.lit(True).alias("left"), F.lit(False).alias("right"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("n_right") - 1), lambda i: salt("n_left", 2) * F.col("n_right") + i)).alias("tile"),
    )
    tiles = one.unionByName(left).unionByName(right).repartition("anchor", "tile").sortWithinPartitions("anchor", "tile")
    return tiles.mapInPandas(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """All input columns, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id reachable."""
    own = [c for c in docs.columns if c not in ("fingerprint", "component_id")]
    # Ids, fingerprints and text hashes alone are kept; the texts stay in the source. Equal texts have equal results.
    h = F.xxhash64(text_of(text))
    marked = cut_lineage(docs.select(F.col(key).alias("id"), fingerprints(text_of(text)).alias("fp"), h.alias("h")))
    found = classes_of(marked, key, tile, "h")
    found = found.groupBy(F.col(key).alias("_llm_id"), F.col("h").alias("_llm_h")).agg(
        F.first("fingerprint").alias("fingerprint"), F.first("component_id").alias("component_id")
    )
    d = docs.select(*own).withColumn("_llm_k", h)
    met = d.join(found, d[key].eqNullSafe(found["_llm_id"]) & (d["_llm_k"] == found["_llm_h"]))
    return met.select(*own, "fingerprint", "component_id")


def fingerprint_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """``key, fingerprint, component_id`` of every row, without carrying the texts."""
    marked = cut_lineage(docs.select(F.col(key).alias("id"), fingerprints(text_of(text)).alias("fp")))
    return classes_of(marked, key, tile)


def _labels(marked: DataFrame, tile: int) -> DataFrame:
    """``fp, least, c``: fingerprints of the rows ``(id, fp, ...)`` with their smallest id and their class."""
    reps = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("least")))
    comp = components(links(reps, tile))
    return reps.join(comp, reps["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))


def classes_of(marked: DataFrame, key: str, tile: int = TILE, *more: str) -> DataFrame:
    """Classes of the rows ``(id, fp, ...)``."""
    grouped = _labels(marked, tile)
    least = grouped.groupBy("c").agg(F.min("least").alias("component_id"))
    table = marked.join(grouped.join(least, "c").select("fp", "component_id"), "fp")
    return table.select(F.col("id").alias(key), *more, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame, text: str = "text", key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """One whole row of every class of linked texts: that of the smallest id (nulls last), then text hash, then row hash.

    A class is told by its fingerprints, so ids may repeat or be null. Heads are chosen on narrow rows.
    """
    whole = F.xxhash64(*[f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    marked = docs.select(F.col(key).alias("id"), fingerprints(text_of(text)).alias("fp"), F.xxhash64(text_of(text)).alias("h"), whole.alias("r"))
    marked = cut_lineage(marked.groupBy("id", "fp", "h", "r").agg(F.count(F.lit(1)).alias("n")))
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "r", "n")).alias("head")
    heads = marked.join(_labels(marked, tile).select("fp", "c"), "fp").groupBy("c").agg(head)
    heads = heads.select(F.col("head.id").alias("_id"), F.col("head.h").alias("_h"), F.col("head.r").alias("_r"), F.col("head.n").alias("_n"))
    d = docs.withColumn("_row", whole).withColumn("_text", F.xxhash64(text_of(text)))
    met = d.join(heads, (d["_row"] == heads["_r"]) & (d["_text"] == heads["_h"]) & d[key].eqNullSafe(heads["_id"]))
    # Rows repeated as a whole are met together; partial aggregates leave one of them.
    once = met.where("_n > 1").dropDuplicates(["_row", "_text", "_id"])
    return met.where("_n = 1").unionByName(once).select(*docs.columns)
