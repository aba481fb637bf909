"""Vector search over blocks: exact, and by a stored inverted-file index.

*Exact.* Vectors of one scope and length are packed into block rows of at most ``BLOCK_ROWS`` next to the scan. Query
blocks and chunk blocks meet by an equi-join on scope, length and slice: a scope with many chunks has many slices, and its
query blocks go to each of them, so no scope is one task. A joined row is a tile; the task multiplies it and passes on
``k`` rows per query. Query blocks are written first, so that Spark knows their size and itself decides whether to
broadcast them (the chunks then stay where they are) or to shuffle both sides.

*Index.* Centroids are fitted on a bounded sample; every vector is written below ``cell=<nearest centroid>``. A search
joins the queries' nearest cells with the stored table: dynamic partition pruning reads only the probed folders, scope is
part of the join key. How many cells a query probes is calibrated on stored vectors against the exact search, so that the
wanted share of true neighbours is found; vectors of another length are kept in cells of their own and searched whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.operators.filters import scope
from lectern.operators.sizing import cut_lineage, run_dir

# Scores are compared at this precision, so equal texts tie and the smaller id wins.
RANK_DIGITS = 9
BLOCK_ROWS = 1024
SLICE_ROWS = 8192
# Hits that a task holds before it drops all but the best of every query.
_HELD = 200_000


# --- blocks --------------------------------------------------------------------------------------
def _lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of a list column; a null number is not a number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return values, offsets[:-1], np.diff(offsets)


def packed(vectors: DataFrame, item: str, keys: list[str], rows: int | None = None) -> DataFrame:
    """Block rows ``(keys, dim, ids, data, block)`` of ``(keys, item, embedding)``, in the partitions they come in."""
    rows = rows or BLOCK_ROWS
    item_type = vectors.schema[item].dataType.simpleString()
    kinds = {k: vectors.schema[k].dataType.simpleString() for k in keys}

    def pack(batches):
        for batch in batches:
            values, starts, dims = _lists(batch.column("embedding"))
            columns = [batch.column(k) for k in keys]
            coded = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in columns]
            order = np.lexsort((dims, *coded[::-1]))
            at = np.stack([dims, *coded], axis=1)[order]
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            out = {n: [] for n in (*keys, "dim", "ids", "data")}
            for part in np.split(order, cuts):
                for lo in range(0, len(part), rows):
                    own = part[lo : lo + rows]
                    dim = int(dims[own[0]])
                    for k, c in zip(keys, columns):
                        out[k].append(c[int(own[0])].as_py())
                    out["dim"].append(dim)
                    out["ids"].append(batch.column(item).take(pa.array(own)).to_pylist())
                    out["data"].append(values[starts[own][:, None] + np.arange(dim)].tobytes())
            if out["dim"]:
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    fields = [(k, _arrow(vectors.schema[k].dataType)) for k in keys]
    schema = pa.schema([*fields, ("dim", pa.int32()), ("ids", pa.list_(_arrow(vectors.schema[item].dataType))), ("data", pa.binary())])
    kind = ", ".join([*(f"{k} {t}" for k, t in kinds.items()), f"dim int, ids array<{item_type}>, data binary"])
    # Runs of equal keys make full blocks.
    ready = vectors.select(*keys, item, "embedding").sortWithinPartitions(*keys)
    return ready.mapInArrow(pack, kind).withColumn("block", F.xxhash64("ids"))


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull())


def _best(found: list[tuple], k: int) -> list[tuple]:
    """The first ``k`` hits of every query by score and id, of arrays ``(query, chunk, score)``."""
    q, c, s = (np.concatenate([f[i] for f in found]) for i in range(3))
    names, number = np.unique(q, return_inverse=True)
    _, ids = np.unique(c, return_inverse=True)
    order = np.lexsort((ids, -s, number))
    first = np.flatnonzero(np.diff(number[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    kept = order[rank < k]
    return [(q[kept], c[kept], s[kept])]


def _tiles(k: int, threshold: float, q_arrow, c_arrow, hashes: int = 0):
    """Best hits of the tiles ``(q_ids, q_data, c_ids, c_data, dim)`` of a task. The last ``hashes`` numbers of a vector are
    hash values: only pairs that have one of them in common, and whose unit vectors are near enough, are hits."""
    radius = np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-9

    def run(batches):
        found, held = [], 0
        for batch in batches:
            dims = batch.column("dim").to_pylist()
            for i, dim in enumerate(dims):
                q_ids, c_ids = (np.array(batch.column(n)[i].as_py(), dtype=object) for n in ("q_ids", "c_ids"))
                m, c = (np.frombuffer(batch.column(n)[i].as_buffer(), np.float64).reshape(-1, dim) for n in ("q_data", "c_data")) if dim else (
                    np.zeros((len(q_ids), 0)), np.zeros((len(c_ids), 0)))
                met = None
                if hashes:
                    met = np.logical_or.reduce([np.equal.outer(c[:, -h], m[:, -h]) for h in range(1, hashes + 1)])
                    m, c = m[:, :-hashes], c[:, :-hashes]
                norms = np.outer(np.sqrt((c * c).sum(axis=1)), np.sqrt((m * m).sum(axis=1)))
                cos = np.divide(c @ m.T, norms, out=np.zeros_like(norms), where=norms > 0)
                if hashes:
                    # |a - b|^2 = 2 - 2 cos for unit vectors.
                    cos = np.where(met & (np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos)) < radius), cos, np.nan)
                cos = np.round(np.clip(cos, 0.0, 1.0), RANK_DIGITS)
                good = cos >= threshold
                if len(c) > k:
                    # Nothing below a query's k-th best value of this tile can be among its best k.
                    good &= cos >= np.partition(np.where(np.isnan(cos), -1.0, cos), len(c) - k, axis=0)[len(c) - k]
                row, col = np.nonzero(good)
                found.append((q_ids[col], c_ids[row], cos[row, col]))
                held += len(row)
                if held > _HELD:
                    found = _best(found, k)
                    held = len(found[0][0])
        if held:
            q, c, s = _best(found, k)[0]
            for i in range(0, len(q), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(q[part], q_arrow), pa.array(c[part], c_arrow), pa.array(s[part])], names=["query_id", "chunk_id", "score"])

    return run


def tile_search(q: DataFrame, c: DataFrame, keys: list[str], k: int, threshold: float, hashes: int = 0) -> DataFrame:
    """Best ``k`` chunks ``(keys, chunk_id, embedding)`` of every query ``(keys, query_id, embedding)`` of equal keys; of the
    pairs that have a hash value in common where the vectors end in ``hashes`` of them."""
    spark = q.sparkSession
    path = run_dir(spark, "query-blocks")
    packed(q, "query_id", keys).write.parquet(path)
    blocks = spark.read.parquet(path).select(*keys, "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    on = [*keys, "dim"]
    sizes = c.groupBy(*keys, F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*on, F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices"))
    left = blocks.join(sizes, on).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    right = packed(c, "chunk_id", keys).join(sizes, on).select(
        *on, F.col("ids").alias("c_ids"), F.col("data").alias("c_data"), F.pmod(F.col("block"), F.col("slices")).cast("int").alias("slice")
    )
    tiles = right.join(left, [*on, "slice"]).select("dim", "q_ids", "q_data", "c_ids", "c_data")
    kinds = [d.schema[n].dataType for d, n in ((q, "query_id"), (c, "chunk_id"))]
    names = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"
    return tiles.mapInArrow(_tiles(k, threshold, *map(_arrow, kinds), hashes), names)


def best(found: DataFrame, k: int) -> DataFrame:
    """First ``k`` hits of every query with their rank."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("chunk_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_search(
    queries: DataFrame, chunks: DataFrame, k: int = DEFAULTS.top_k, threshold: float = DEFAULTS.threshold,
    shared: bool = False, scoped: bool = False,
) -> DataFrame:
    """Exact best ``k`` chunks per query by cosine similarity, at least ``threshold``."""
    if not scoped:
        queries, chunks = scope(queries, chunks, shared)
    q = usable(queries).where("scope IS NOT NULL").select("scope", "query_id", "embedding")
    c = usable(chunks).where("scope IS NOT NULL").select("scope", "chunk_id", "embedding")
    return best(tile_search(q, c, ["scope"], k, threshold), k)


# --- stored index --------------------------------------------------------------------------------
# Vectors the centroids are fitted on, cells at most, and stored vectors the probes are calibrated with.
FIT_ROWS = 200_000
MOST_CELLS = 4096
CALIBRATION_ROWS = 256
RECALL = 0.95


def _share(df: DataFrame, key: str, rows: int, total: int, seed: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of their key; all where there are fewer."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < F.lit(int(1_000_000 * rows / total)))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def fit_centroids(vectors: DataFrame, dim: int, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of the finite vectors of one length, by distributed k-means on the unit sphere."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from lectern.functions.vectors import l2_norm, l2_normalize

    v = F.col("embedding")
    fit = vectors.where((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(l2_norm(v) > 0)
    unit = fit.select(array_to_vector(l2_normalize(v)).alias("features"))
    if unit.isEmpty():
        return np.zeros((1, dim))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=12, tol=1e-4).fit(unit)
    return _unit(np.array(model.clusterCenters(), dtype=np.float64))


def _celled(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Rows with their ``probes`` nearest cells: ``cell`` and ``near`` (0 is the nearest). A vector of another length has
    the one cell of its length, a negative number."""
    dim = centroids.shape[1]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields), "cell int, near int"])

    def run(batches):
        for batch in batches:
            values, starts, dims = _lists(batch.column("embedding"))
            rows, cells, ranks = [], [], []
            own, other = np.flatnonzero(dims == dim), np.flatnonzero(dims != dim)
            if len(own):
                near = np.nan_to_num(_unit(values[starts[own][:, None] + np.arange(dim)])) @ centroids.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                rows.append(np.repeat(own, order.shape[1]))
                cells.append(order.ravel())
                ranks.append(np.tile(np.arange(order.shape[1]), len(own)))
            rows.append(other)
            cells.append(-1 - dims[other])
            ranks.append(np.zeros(len(other)))
            take = batch.take(pa.array(np.concatenate(rows).astype(np.int64)))
            more = [pa.array(np.concatenate(x).astype(np.int32)) for x in (cells, ranks)]
            yield pa.RecordBatch.from_arrays([*take.columns, *more], names=[*take.schema.names, "cell", "near"])

    return vectors.mapInArrow(run, kind)


def build_index(chunks: DataFrame, path: str, cells: int | None = None, recall: float = RECALL, k: int = DEFAULTS.candidates, seed: int = 7) -> None:
    """Store the vectors of scoped chunks ``(scope, chunk_id, embedding)`` by cell, with centroids and calibrated probes.

    ``cells`` defaults to the square root of the number of vectors. Only centroids (at most ``MOST_CELLS``), counts per length
    and one number of probes come to the driver.
    """
    spark = chunks.sparkSession
    v = usable(chunks).where("scope IS NOT NULL").select("scope", "chunk_id", "embedding")
    lengths = v.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, total = (int(lengths[0]["dim"]), int(lengths[0]["n"])) if lengths else (1, 0)
    cells = cells or int(min(MOST_CELLS, max(1, round(total**0.5))))
    centroids = fit_centroids(_share(v, "chunk_id", FIT_ROWS, total, seed), dim, cells, seed) if dim else np.zeros((1, 0))
    placed = _celled(v, centroids, 1).drop("near")
    # Ranges over (cell, id): a crowded cell is several files, a cell is in few of them.
    n = max(1, min(len(centroids), spark.sparkContext.defaultParallelism), total // 1_000_000)
    placed.repartitionByRange(n, "cell", "scope", "chunk_id").sortWithinPartitions("cell", "scope").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/vectors")
    stored.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/sizes")
    probes = _calibrated(stored, centroids, total, recall, k, seed)
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    kinds = [placed.schema[n].dataType.simpleString() for n in ("chunk_id", "embedding")]
    spark.createDataFrame([(dim, probes, *kinds)], "dim int, probes int, id_kind string, vector_kind string").coalesce(1).write.parquet(f"{path}/meta")


def _calibrated(stored: DataFrame, centroids: np.ndarray, total: int, recall: float, k: int, seed: int) -> int:
    """Least number of probes with which the share ``recall`` of the ``k`` nearest of a sample is in a probed cell."""
    dim = centroids.shape[1]
    some = _share(stored.where(F.size("embedding") == dim), "chunk_id", CALIBRATION_ROWS, total, seed + 1)
    q = some.select("scope", F.col("chunk_id").alias("query_id"), "embedding")
    exact = vector_search(q, stored, k + 1, 0.0, scoped=True).where("query_id <> chunk_id").select("query_id", "chunk_id")
    where = exact.join(stored.select("chunk_id", "cell"), "chunk_id")
    order = _celled(q, centroids, len(centroids)).select("query_id", "cell", "near")
    got = where.join(order, ["query_id", "cell"]).groupBy("near").agg(F.count(F.lit(1)).alias("n")).orderBy("near").collect()
    want, seen = recall * sum(r["n"] for r in got), 0
    for r in got:  # at most a row per cell
        seen += r["n"]
        if seen >= want:
            return int(r["near"]) + 1
    return 1


def index_probes(spark: SparkSession, queries: DataFrame, path: str, probes: int | None = None) -> DataFrame:
    """``scope, query_id, embedding, cell, near`` of scoped queries against a stored index."""
    meta = spark.read.parquet(f"{path}/meta").first()
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most ``MOST_CELLS``
    centroids = np.array([r["centroid"] for r in rows], dtype=np.float64).reshape(len(rows), meta["dim"])
    q = usable(queries).where("scope IS NOT NULL").select("scope", "query_id", "embedding")
    return _celled(q, centroids, probes or meta["probes"])


def probed(spark: SparkSession, probes: DataFrame, path: str) -> DataFrame:
    """Stored vectors of the probed (scope, cell) pairs; folders of other cells are not read."""
    wanted = run_dir(spark, "probes")
    probes.select("scope", "cell").distinct().write.parquet(wanted)
    # The comparison, always true, tells Spark that this side may prune partitions of the other.
    pairs = spark.read.parquet(wanted).where(F.col("cell") >= -(2**31))
    meta = spark.read.parquet(f"{path}/meta").first()
    # Stated, as an empty table has no files.
    kind = f"scope string, chunk_id {meta['id_kind']}, embedding {meta['vector_kind']}, cell int"
    return spark.read.schema(kind).parquet(f"{path}/vectors").join(pairs, ["scope", "cell"], "left_semi")


def index_search(
    spark: SparkSession, queries: DataFrame, path: str, k: int = DEFAULTS.top_k, threshold: float = DEFAULTS.threshold, probes: int | None = None,
) -> DataFrame:
    """Best ``k`` chunks per scoped query among the vectors of its probed cells; scores are exact."""
    near = cut_lineage(index_probes(spark, queries, path, probes))
    return best(tile_search(near.drop("near"), probed(spark, near, path), ["scope", "cell"], k, threshold), k)


def scanned_share(spark: SparkSession, queries: DataFrame, path: str, probes: int | None = None) -> DataFrame:
    """``query_id, scanned, stored``: vectors of its scope that a query is compared with, and all of them."""
    sizes = spark.read.parquet(f"{path}/sizes")
    near = index_probes(spark, queries, path, probes).select("scope", "query_id", "cell")
    hit = near.join(sizes, ["scope", "cell"]).groupBy("scope", "query_id").agg(F.sum("n").alias("scanned"))
    return hit.join(sizes.groupBy("scope").agg(F.sum("n").alias("stored")), "scope").drop("scope")
