"""Embedding near-duplicates: exact metric range join over pivots.

Vectors are scaled to length one; cosine ``c`` and distance ``r`` then go by ``r * r = 2 - 2 * c``. Pivots, a bounded
sample in the order of a hash, cut the space into cells of nearest pivots. If ``x`` is at home at pivot ``p``, a vector
``y`` with home ``q`` is within ``r`` of ``x`` only if ``d(y, p) - d(y, q) <= 2 * r`` (triangle inequality, twice), so
``y`` may link with homes of the cells for which that holds. No vector is replicated: the vectors of a cell are stored once, in
blocks of bounded size that name the cells their vectors may link with. Stored blocks meet in pairs that name each other, each
pair once and for both sides, and are read from the table again where they meet, so nothing but the table lies on disk. In
a pair the inequality is applied to every vector; a task gives counts and at most one class link per vector, never its pairs.
Equal vectors are one class with a weight. Rows find their class by the SHA-256 of their vector's text.

Results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
different lengths with each other. Repeated rows count as other vectors. A null id never names a component. An empty
table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import components, small_batches
from lectern.operators.sizing import written

COSINE = 0.9
# Vectors of a stored block, its bytes, and the bytes of vectors in a file of them.
TILE = 8192
_BLOCK_BYTES, _FILE_BYTES = 1 << 21, 4 << 20
# Rows and columns of a product; it stays in the processor's cache.
_ROWS, _COLUMNS = 512, 1024
CELL_ROWS = 4096
MOST_PIVOTS = 1024
# Room for rounding in the search; the test itself is on the cosine.
_ROOM = 1e-7
# Room for products in single precision.
_SINGLE_ROOM = 1e-3
# From this length on half of the components propose pairs.
_HALVED = 32
# Links that a task holds before it shortens them, and blocks whose forms it keeps.
_LINKS, _KEPT = 1 << 20, 16


def unit(vectors) -> np.ndarray:
    whole = isinstance(vectors, np.ndarray)
    x = np.array(vectors, dtype=np.float64) if whole else np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    # Scaled by the largest component first: squares of extreme values neither overflow nor vanish.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(vec: pa.Array):
    """``dim``, the places of the vectors of that length, and these scaled, at most 1,024 at once."""
    dims = vec.value_lengths().to_numpy()
    for dim in np.unique(dims):
        mine = np.flatnonzero(dims == dim)
        for lo in range(0, len(mine), 1024):
            part = mine[lo : lo + 1024]
            yield int(dim), part, unit(vec.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))


def _at_home(pivots: dict[int, np.ndarray]):
    """The rows with ``dim`` and ``cell``, the number of the nearest pivot."""

    def run(batches):
        for batch in batches:
            dims, cells = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for dim, part, x in _by_dim(batch.column("vec")):
                dims[part] = dim
                if dim in pivots:
                    cells[part] = _distances(x, pivots[dim]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cells)], names=[*batch.schema.names, "dim", "cell"])

    return run


def _pack(pivots: dict[int, np.ndarray], cosine: float, tile: int, width: int):
    """Blocks of the rows of a task, which come by ``dim`` and ``cell``: the cells that the vectors may link with (``near``), the
    largest distance from the own pivot, and the rows as arrays."""
    reach = 2 * np.sqrt(2 - 2 * cosine) + _ROOM

    def block(dim: int, cell: int, held: list) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda n: pa.concat_arrays(rows.column(n).chunks)
        near, radius = np.zeros(1, np.int32), 2.0
        if dim in pivots:
            close, radius = np.zeros(len(pivots[dim]), bool), 0.0
            for _, _, x in _by_dim(column("vec")):
                d = _distances(x, pivots[dim])
                close |= (d - d[:, [cell]] <= reach).any(axis=0)
                radius = max(radius, float(d[:, cell].max()))
            near = np.flatnonzero(close).astype(np.int32)
        whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        many = {n: column(n) for n in ("node", "weight", "least", "digest")}
        data = column("vec").flatten().to_numpy(zero_copy_only=False).tobytes()
        return pa.RecordBatch.from_arrays([
            pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), many["node"].slice(0, 1), pa.array([radius]), whole(pa.array(near)),
            *map(whole, many.values()), pa.array([data], pa.binary()),
        ], names=["dim", "cell", "block", "radius", "near", *many, "vecs"])

    def run(batches):
        now, held, room = None, [], 0
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("dim", "cell")], axis=1)
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                while lo < hi:
                    key = tuple(keys[lo].tolist())
                    if held and (key != now or not room):
                        yield block(*now, held)
                        held = []
                    if not held:
                        now, room = key, max(1, min(tile, _BLOCK_BYTES // (key[0] * width)))
                    n = min(room, hi - lo)
                    held.append(batch.slice(lo, n))
                    lo, room = lo + n, room - n
        if held:
            yield block(*now, held)

    return run


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(i, j)`` between numbers as at most one link per number, with the same classes."""
    names, flat = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    joined = np.flatnonzero(label != np.arange(len(names)))
    return names[joined], names[label[joined]]


class _Block:
    """Vectors of a block, scaled, and single-precision forms of them: the whole, and the first half with the length of the rest, whose
    product is at least the cosine."""

    def __init__(self, row: dict, side: str, kind: str, pivots: np.ndarray | None):
        self.cell, self.radius, self.pivots = row[f"{side}_cell"], row[f"{side}_radius"], pivots
        # Copied: views would keep the whole batch.
        self.node, self.weight = (np.array(row[f"{side}_{n}"].values) for n in ("node", "weight"))
        self.x = x = unit(np.frombuffer(row[f"{side}_vecs"], kind).reshape(len(self.node), -1))
        self.own = None if pivots is None else _distances(x, pivots[self.cell])
        half = x.shape[1] // 2 - 1
        self.single, self.half = x.astype(np.float32), None
        if x.shape[1] >= _HALVED:
            self.half = np.hstack((x[:, :half], np.sqrt((x[:, half:] ** 2).sum(axis=1, keepdims=True)))).astype(np.float32)

    def __len__(self) -> int:
        return len(self.node)

    def facing(self, other: _Block, cosine: float) -> np.ndarray:
        """Places of the vectors that may link with some of the other block."""
        if self.pivots is None or self.cell == other.cell:
            return np.arange(len(self))
        r = np.sqrt(2 - 2 * cosine)
        there = _distances(self.x, self.pivots[other.cell])
        return np.flatnonzero((there - self.own <= 2 * r + _ROOM) & (there <= other.radius + r + _ROOM))


def _linked(a: _Block, b: _Block, cosine: float):
    """Pairs of rows with cosine ``cosine`` or more, part by part: proposed in single precision with room, decided in double where
    that leaves a doubt."""
    low, high = np.float32(cosine - _SINGLE_ROOM), np.float32(cosine + _SINGLE_ROOM)
    product, met = np.empty(_ROWS * _COLUMNS, np.float32), np.empty(_ROWS * _COLUMNS, bool)

    def proposed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        size = len(x) * len(y)
        np.matmul(x, y.T, out=product[:size].reshape(len(x), len(y)))
        return np.flatnonzero(np.greater_equal(product[:size], low, out=met[:size]))

    rows, columns = a.facing(b, cosine), b.facing(a, cosine)
    halves = None if a.half is None else (a.half[rows], b.half[columns])
    for lo in range(0, len(rows), _ROWS):
        for at in range(0, len(columns), _COLUMNS):
            p, q = rows[lo : lo + _ROWS], columns[at : at + _COLUMNS]
            sure = None
            if halves:
                found = proposed(halves[0][lo : lo + _ROWS], halves[1][at : at + _COLUMNS])
            if not halves or len(found) * 64 > len(p) * len(q):
                found = proposed(a.single[p], b.single[q])
                sure = product[found] >= high
            if not len(found):
                continue
            i, j = p[found // len(q)], q[found % len(q)]
            good = np.zeros(len(found), bool) if sure is None else sure
            doubt = np.flatnonzero(~good)
            for k in range(0, len(doubt), 20_000):
                some = doubt[k : k + 20_000]
                good[some] = np.einsum("ij,ij->i", a.x[i[some]], b.x[j[some]]) >= cosine
            yield i[good], j[good]


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _compare(pivots: dict[int, np.ndarray], cosine: float, kind: str):
    """Counts and class links of the pairs of blocks of a task, added up over them."""

    def run(batches):
        kept, near, links, held = OrderedDict(), {}, [], 0

        def block(row: dict, side: str) -> _Block:
            number = row[f"{side}_block"]
            found = kept.pop(number, None) or _Block(row, side, kind, pivots.get(row["l_dim"]))
            kept[number] = found
            if len(kept) > _KEPT:
                kept.popitem(last=False)
            return found

        def add(block: _Block, n: np.ndarray) -> None:
            for k in np.flatnonzero(n).tolist():
                node = int(block.node[k])
                near[node] = near.get(node, 0) + int(n[k])

        for batch in batches:
            for row in range(batch.num_rows):
                row = {n: c[row].as_py() if n.endswith(("dim", "cell", "block", "radius")) else c[row].as_buffer() if n.endswith("vecs") else c[row] for n, c in zip(batch.schema.names, batch.columns)}
                x, y = block(row, "l"), block(row, "r")
                x_near, y_near = np.zeros(len(x)), np.zeros(len(y))
                for i, j in _linked(x, y, cosine):
                    if x is y:
                        i, j = i[i != j], j[i != j]
                    if not len(i):
                        continue
                    # Two vectors of one block meet twice in it; any other pair meets here alone.
                    x_near += np.bincount(i, weights=y.weight[j], minlength=len(x))
                    if x is not y:
                        y_near += np.bincount(j, weights=x.weight[i], minlength=len(y))
                    links.append(_forest(x.node[i], y.node[j]))
                    held += len(links[-1][0])
                    if held > _LINKS:
                        links, held = [_forest(*map(np.concatenate, zip(*links)))], 0
                add(x, x_near)
                add(y, y_near)
        if near:
            a, b = _forest(*map(np.concatenate, zip(*links)))
            nodes, n = (np.fromiter(v, np.int64, len(near)) for v in (near.keys(), near.values()))
            none = lambda k: pa.nulls(k, pa.int64())
            every = pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(nodes), pa.array(a)]), pa.concat_arrays([none(len(nodes)), pa.array(b)]), pa.concat_arrays([pa.array(n), none(len(a))]),
            ], schema=_FOUND)
            for lo in range(0, len(every), 100_000):
                yield every.slice(lo, 100_000)

    return run


def range_join(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, cell_rows: int = CELL_ROWS,
    most_pivots: int = MOST_PIVOTS, tile: int = TILE,
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row. Cells hold about ``cell_rows`` vectors, pivots are at most
    ``most_pivots``; both steer work only, the result is exact with any pivots."""
    v = F.col("vec")
    usable = F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec")).withColumn("usable", usable)
    # -0.0 and 0.0 are one value.
    plain = F.transform("vec", lambda x: x + F.lit(0.0).cast("float"))
    # The text of a vector gives back its components, so equal digests are equal vectors.
    digest = F.unhex(F.sha2(F.col("vec").cast("string"), 256))
    rows = rows.withColumn("vec", F.when(F.col("usable"), plain))
    good = rows.where("usable").select("id", "vec")
    classes = good.groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight")).withColumn("digest", digest)
    types = {f.name: f.dataType for f in classes.schema}
    width = 4 if isinstance(types["vec"].elementType, T.FloatType) else 8
    # About ``most_pivots`` vectors at most come to the driver, chosen by a hash.
    sizes = good.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum(F.col("dim") * F.col("n")).alias("all"), F.slice(F.sort_array(F.collect_list(F.struct("n", "dim")), False), 1, 8).alias("most")).first()
    pivots = {}
    for n, dim in total["most"]:
        want = min(most_pivots, -(-n // cell_rows))
        picked = good.where(F.size("vec") == dim).where(F.pmod(F.xxhash64("vec", F.lit(11)), F.lit(n)) < want)
        found = [r["vec"] for r in picked.select("vec").distinct().collect()]
        if found:
            pivots[int(dim)] = unit(found)
    spark = vectors.sparkSession
    long, text = T.LongType(), T.BinaryType()
    kinds = [("dim", T.IntegerType()), ("cell", T.IntegerType()), ("block", long), ("radius", T.DoubleType()), ("near", T.ArrayType(T.IntegerType()))]
    kinds += [("node", T.ArrayType(long)), ("weight", T.ArrayType(long)), ("least", T.ArrayType(types["least"])), ("digest", T.ArrayType(text)), ("vecs", text)]
    files = -(-(total["all"] or 1) * width // _FILE_BYTES)
    with small_batches(spark):
        homes = classes.mapInArrow(_at_home(pivots), T.StructType([*classes.schema, T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType())]))
        homes = homes.repartitionByRange(files, "dim", "cell", "digest").sortWithinPartitions("dim", "cell")
        # The number is fixed once it stands in the table.
        homes = homes.withColumn("node", F.monotonically_increasing_id())
        blocks = written(homes.mapInArrow(_pack(pivots, cosine, tile, width), T.StructType([T.StructField(*k) for k in kinds])), "blocks")
        side = lambda s: blocks.select(*[F.col(n).alias(f"{s}_{n}") for n in ("dim", "cell", "block", "radius", "near", "node", "weight", "vecs")])
        one, other = F.col("l_block"), F.col("r_block")
        # A pair meets once; whose side comes first is drawn, so that all tasks have as much to do.
        drawn = F.pmod(F.xxhash64(one).bitwiseXOR(F.xxhash64(other)), F.lit(2)) == 0
        meets = (F.col("l_dim") == F.col("r_dim")) & ((one == other) | ((one < other) == drawn))
        meets &= F.array_contains("l_near", F.col("r_cell")) & F.array_contains("r_near", F.col("l_cell"))
        # The blocks of one side are read again for each part of the other, never shuffled.
        pairs = side("l").join(side("r").hint("shuffle_replicate_nl"), meets).drop("l_near", "r_near", "r_dim")
        found = written(pairs.mapInArrow(_compare(pivots, cosine, f"<f{width}"), "a long, b long, n long"), "found")
    classes = blocks.select(F.inline(F.arrays_zip("node", "weight", "least", "digest")))
    near = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
    comp = components(found.where("b is not null").select("a", "b").distinct())
    least = comp.join(classes, "node").groupBy("component").agg(F.min("least").alias("first"))
    first = comp.join(least, "component").select("node", "first")
    d = classes.join(near, "node", "left").join(first, "node", "left").select(
        "digest", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id")
    )
    rows = rows.select("id", "usable", F.when(F.col("usable"), digest).alias("digest"))
    met = rows.join(d, "digest", "left")
    own = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id"))
    return met.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"),
    )
