"""Stored BM25 postings with upper bounds: a search opens the blocks that can matter, and gives the exact result.

Layout below one folder:

* ``blocks``, in folders ``bucket=<hash of scope and term>``: a row per (scope, term, cell) with the term's postings in the cell in
  order of place, in blocks of ``BLOCK`` with the highest impact of each (``tops``), and the ``BEST`` highest postings. A cell is a
  packed block of chunks (:mod:`term_blocks`), so rows are made where the chunks lie and no posting is a row of a shuffle;
* ``cells``: the chunk ids of every cell by place; ``stats`` of every scope;
* ``terms``, in the same buckets: documents, blocks and highest impact of every term.

The impact of a posting is its BM25 part without the query's weight. A search takes these steps:

1. the highest postings of the asked terms give every query a score that its ``k``-th best chunk reaches at least;
2. rows of asked terms are shuffled by cell and meet the blocks of queries of their scope. Terms whose highest impacts together
   stay below half of the bound cannot bring a new chunk among the best; of the others, the blocks are opened whose highest
   impact can reach the bound with all other terms at their highest;
3. chunks found so whose score so far, with all that unopened blocks could add, reaches the bound are candidates; of the unopened
   blocks those that hold one are opened, and the candidates' scores are complete. Scores found raise the bound for later cells.

A task passes on what reaches the bound, so no pair of query and chunk is a row of a shuffle. Scope is part of every key. Folders of
buckets that no asked term falls into are not read (dynamic partition pruning).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.operators import retrieval as R
from lectern.operators import term_blocks as TB
from lectern.operators.sizing import cut_lineage, run_dir
from lectern.operators.vector_search import _arrow

HEAD = 64
BLOCK = 64
# Highest postings that a row names, for the bound.
BEST = 4
# Chunks of a cell at most; larger cells make fewer rows of rare terms.
CELL = 8192
# Share of the bound that the terms left for later may add: less opens more lists whole and leaves fewer candidates.
SPLIT = 0.5
# Queries that meet a cell in one row.
QUERIES = 256
# Postings a bucket holds about, and the fewest and most buckets.
BUCKET_POSTINGS = 5_000_000
FEWEST, MOST = 8, 4096
# Sums of impacts in another order differ by rounding; bounds leave this room.
_ROOM = 1e-6


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("scope", "term"), F.lit(buckets)).cast("int")


def _impacts(k1: float, b: float, block: int):
    """Rows of ``blocks`` of packed blocks with the ``avgdl`` of their scope."""
    listed = [("best", pa.int32()), ("best_impact", pa.float64())]

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                counts, place, tf = (TB._read(batch, n, i) for n in ("counts", "places", "tf"))
                if not len(place):
                    continue
                entry = np.repeat(np.arange(len(counts)), counts)
                norm = (1 - b) + b * TB._read(batch, "dl", i) / batch.column("avgdl")[i].as_py()
                impact = tf * (k1 + 1) / (tf + k1 * norm[entry])
                # Copies of a chunk id are one chunk: their impacts add up, each counts as a document.
                owner = TB._read(batch, "owner", i)[entry].astype(np.int64)
                n_ids = len(batch.column("ids")[i].values)
                keys, at = np.unique(place * np.int64(n_ids) + owner, return_inverse=True)
                impact, term, chunk = np.bincount(at, weights=impact), keys // n_ids, (keys % n_ids).astype(np.int32)
                first = np.flatnonzero(np.diff(term, prepend=-1))
                sizes = np.diff(np.append(first, len(term)))
                inside = np.arange(len(term)) - np.repeat(first, sizes)
                runs = np.flatnonzero(inside % block == 0)
                tops = np.maximum.reduceat(impact, runs)
                n_runs = -(-sizes // block)
                order = np.lexsort((chunk, -impact, term))[inside < BEST]
                ends = pa.array(np.append(0, np.cumsum(np.minimum(sizes, BEST))).astype(np.int32))
                own = [order.astype(np.int64), impact[order]]
                cut = lambda x, width, n: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n) * width).astype(np.int32)), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(batch.column("scope")[i], len(first)), batch.column("terms")[i].values.take(pa.array(term[first])),
                    pa.repeat(batch.column("cell")[i], len(first)), pa.array(np.bincount(place, minlength=term[-1] + 1)[term[first]].astype(np.int64)),
                    pa.array(n_runs.astype(np.int32)), pa.array(np.maximum.reduceat(impact, first)), cut(chunk, 4, sizes), cut(impact, 8, sizes), cut(tops, 8, n_runs),
                    *(pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, (_, t) in zip((chunk[own[0]], own[1]), listed)),
                ], names=["scope", "term", "cell", "df", "n_blocks", "top", "places", "impacts", "tops", "best", "best_impact"])

    return run


def build(chunks: DataFrame, path: str, k1: float = DEFAULTS.k1, b: float = DEFAULTS.b, head: int = HEAD, block: int = BLOCK, buckets: int | None = None) -> None:
    """Store the postings of scoped chunks ``(scope, chunk_id, content)``. ``k1`` and ``b`` are part of the impacts."""
    spark = chunks.sparkSession
    packed = TB.pack(chunks, CELL)
    n = packed.agg(F.coalesce(F.sum(F.aggregate("df", F.lit(0).cast("bigint"), lambda s, x: s + x)), F.lit(0))).first()[0]
    buckets = buckets or min(MOST, max(FEWEST, -(-n // BUCKET_POSTINGS)))
    spark.createDataFrame([(buckets, head, block)], "buckets int, head int, block int").coalesce(1).write.parquet(f"{path}/meta")
    TB.totals(packed).withColumn("avgdl", F.greatest("avgdl", F.lit(1e-12))).write.parquet(f"{path}/stats")
    cells = packed.withColumn("cell", F.xxhash64("scope", "ids"))
    cells.select("scope", "cell", "ids").write.parquet(f"{path}/cells")
    named = "scope", "ids", "terms", "owner", "dl", "counts", "places", "tf", "cell", "avgdl"
    kind = (
        f"scope {packed.schema['scope'].dataType.simpleString()}, term string, cell bigint, df bigint, n_blocks int, top double, places binary, "
        "impacts binary, tops binary, best array<int>, best_impact array<double>"
    )
    rows = cells.join(spark.read.parquet(f"{path}/stats").select("scope", "avgdl"), "scope").select(*named).mapInArrow(_impacts(k1, b, block), kind)
    salt = F.pmod(F.col("cell"), F.lit(4))
    rows.withColumn("bucket", _bucket(buckets)).repartition("bucket", salt).sortWithinPartitions("bucket", "scope", "term").write.partitionBy("bucket").parquet(f"{path}/blocks")
    terms = spark.read.parquet(f"{path}/blocks").groupBy("bucket", "scope", "term").agg(
        F.sum("df").alias("df"), F.max("top").alias("top"), F.sum("n_blocks").alias("n_blocks")
    )
    terms.repartition("bucket").sortWithinPartitions("bucket", "scope", "term").write.partitionBy("bucket").parquet(f"{path}/terms")


def asked_terms(spark: SparkSession, queries: DataFrame, path: str) -> DataFrame:
    """``query_id, scope, term, weight, top, ub, n_blocks, bucket, n_chunks, dfs`` of the scoped queries' known terms, written
    and read again, so that its size is known and it prunes folders; ``ub`` is the most the term can add to a score."""
    asked = R.query_terms(queries).withColumn("bucket", _bucket(spark.read.parquet(f"{path}/meta").first()["buckets"]))
    out = asked.join(spark.read.parquet(f"{path}/terms"), ["scope", "term", "bucket"]).join(spark.read.parquet(f"{path}/stats"), "scope")
    out = out.withColumn("weight", F.col("qtf") * R.idf("n_chunks", "df")).withColumn("ub", F.col("weight") * F.col("top"))
    out = out.withColumn("dfs", F.sum("df").over(W.partitionBy("query_id")))
    folder = run_dir(spark, "asked")
    out.select("query_id", "scope", "term", "weight", "top", "ub", "n_blocks", "bucket", "n_chunks", "dfs").write.parquet(folder)
    # Always true; a comparison lets this side prune the folders of the other.
    return spark.read.parquet(folder).where(F.col("bucket") >= 0)


def bounded(spark: SparkSession, asked: DataFrame, path: str, k: int) -> DataFrame:
    """The asked terms with ``floor``, a score the query's ``k``-th best chunk reaches (0 with fewer chunks), ``total``, the sum
    of all ``ub``, and ``essential``: whether the term can bring a new chunk among the best."""
    key, head = ["scope", "term", "bucket"], spark.read.parquet(f"{path}/meta").first()["head"]
    best = spark.read.parquet(f"{path}/blocks").join(asked.select(*key).distinct(), key, "left_semi").select(*key, "cell", F.explode(F.arrays_zip("best", "best_impact")).alias("x"))
    best = R.top_k(best.select(*key, "cell", "x.best", "x.best_impact"), ["scope", "term"], [F.desc("best_impact"), F.col("cell"), F.col("best")], head, "_r").drop("_r")
    # What the highest postings add to a chunk is part of its score.
    hits = asked.join(best, key).groupBy("query_id", "cell", "best").agg(F.sum(F.col("weight") * F.col("best_impact")).alias("part"))
    kth = R.top_k(hits, ["query_id"], [F.desc("part"), F.col("cell"), F.col("best")], k, "_r").where(F.col("_r") == k)
    floor = kth.select("query_id", (F.col("part") - F.lit(_ROOM)).alias("floor"))
    out = asked.join(floor, "query_id", "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(0.0)))
    w = W.partitionBy("query_id")
    out = out.withColumn("total", F.sum("ub").over(w))
    # Long lists first among equal bounds: they cost most.
    below = F.sum("ub").over(w.orderBy("ub", F.desc("n_blocks"), "term").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("essential", below >= SPLIT * F.col("floor"))


def _query_blocks(terms: DataFrame) -> DataFrame:
    """Blocks of about ``QUERIES`` queries of one scope ``(scope, q_block, queries)``; a query is bounded by its text."""
    each = terms.groupBy("scope", "query_id").agg(
        F.collect_list(F.struct("term", "weight", "ub", "essential")).alias("terms"), F.max("floor").alias("floor"), F.max("total").alias("total"),
        F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("ub"))).alias("more"), F.max(F.col("dfs") >= F.col("n_chunks")).alias("cover"),
    )
    groups = max(1, -(-terms.select("query_id").distinct().count() // QUERIES))
    no = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    return each.groupBy("scope", no.alias("q_no")).agg(F.collect_list(F.struct("query_id", "terms", "floor", "total", "more", "cover")).alias("queries")).withColumn(
        "q_block", F.xxhash64("scope", "q_no")
    ).drop("q_no")


def _cells(kinds: tuple):
    """A row per cell of sorted rows ``(scope, cell, term, ...)``; the row without a term, first, has the ids."""
    schema = pa.schema([("scope", kinds[0]), ("ids", pa.list_(kinds[1])), ("terms", pa.list_(pa.string())), ("sizes", pa.binary()), ("places", pa.binary()), ("impacts", pa.binary()), ("tops", pa.binary())])

    def one(rows: pa.Table):
        own = rows.slice(1)
        if len(own):
            joined = [b"".join(own.column(n).to_pylist()) for n in ("places", "impacts", "tops")]
            sizes = np.array([len(x) // 4 for x in own.column("places").to_pylist()], np.int32)
            terms = own.column("term").combine_chunks()
            columns = [rows.column("scope").slice(0, 1).to_pylist(), [rows.column("ids")[0].as_py()], [terms.to_pylist()], [sizes.tobytes()], *([x] for x in joined)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    def run(batches):
        carried = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if carried is None else pa.concat_tables([carried, rows])
            starts = np.flatnonzero(rows.column("term").is_null().to_numpy())
            for low, high in zip(starts[:-1], starts[1:]):
                yield from one(rows.slice(low, high - low))
            carried = rows.slice(int(starts[-1])) if len(starts) else rows
        if carried is not None and len(carried):
            yield from one(carried)

    return run


class _Cell:
    """Postings of the asked terms of one cell."""

    def __init__(self, batch, i: int, block: int):
        sizes = TB._read(batch, "sizes", i)
        self.ids, self.block = batch.column("ids")[i].values, block
        self.no = {t: n for n, t in enumerate(batch.column("terms")[i].as_py())}
        self.start = np.append(0, np.cumsum(sizes))
        self.runs = np.append(0, np.cumsum(-(-sizes // block)))
        self.place, self.impact, self.top = TB._read(batch, "places", i), TB._read(batch, "impacts", i, np.float64), TB._read(batch, "tops", i, np.float64)

    def gathered(self, terms: list[dict]):
        """Place, weighted impact and run of all postings of some terms, and the weighted tops of the runs with their terms."""
        at, run, weight, top, ub, seen = [], [], [], [], [], 0
        for t in terms:
            n = self.no.get(t["term"])
            if n is None:
                continue
            low, high = self.start[n], self.start[n + 1]
            a, z = self.runs[n], self.runs[n + 1]
            at.append(np.arange(low, high))
            run.append(seen + np.arange(high - low) // self.block)
            weight.append(np.full(high - low, t["weight"]))
            top.append(self.top[a:z] * t["weight"])
            ub.append(np.full(z - a, t["ub"]))
            seen += z - a
        if not at:
            return None
        at = np.concatenate(at)
        return self.place[at], self.impact[at] * np.concatenate(weight), np.concatenate(run), np.concatenate(top), np.concatenate(ub)


def _scored(cell: _Cell, q: dict, floor: float):
    """Complete scores of the chunks of a cell that can be among the best, and the number of blocks opened."""
    n = len(cell.ids)
    lead = cell.gathered([t for t in q["terms"] if t["essential"]])
    if lead is None:
        return None, None, 0
    place, part, run, top, ub = lead
    open_ = top + q["total"] - ub + _ROOM >= floor
    if not open_.any():
        return None, None, 0
    kept = open_[run]
    score = np.bincount(place[kept], part[kept], n)
    chosen = (score > 0) & (score + q["more"] + _ROOM >= floor)
    if not chosen.any():
        return None, None, int(open_.sum())
    opened = int(open_.sum())
    # A candidate may stand in a block of a leading term that was left out, too.
    late = np.unique(run[~kept & chosen[place]])
    opened += len(late)
    more = np.isin(run, late) if len(late) else None
    if more is not None:
        score += np.bincount(place[more], part[more], n)
    rest = cell.gathered([t for t in q["terms"] if not t["essential"]])
    if rest is not None:
        own = chosen[rest[0]]
        opened += len(np.unique(rest[2][own]))
        score += np.bincount(rest[0][own], rest[1][own], n)
    found = np.flatnonzero(chosen)
    return found, score[found], opened


def _search(k: int, block: int, types: list, counted: bool):
    """Hits ``(query_id, chunk_id, score)``, and a row per query without a chunk: blocks opened, and for queries whose words could
    be in all chunks, how many hold one and their lowest score."""

    def out(query, chunk, score, opened, matched, low):
        return pa.RecordBatch.from_arrays([
            pa.array(query, types[0]), pa.array(chunk, types[1]), pa.array(score, pa.float64()), pa.array(opened, pa.int64()), pa.array(matched, pa.int64()), pa.array(low, pa.float64()),
        ], names=["query_id", "chunk_id", "raw_score", "opened", "matched", "low"])

    def run(batches):
        blocks, best, hits, sums = {}, {}, {}, {}
        for batch in batches:
            for i in range(len(batch)):
                name = batch.column("q_block")[i].as_py()
                if name not in blocks:
                    blocks[name] = batch.column("queries")[i].as_py()
                cell = _Cell(batch, i, block)
                for q in blocks[name]:
                    key = q["query_id"]
                    floor = max(q["floor"], best[key][0] - _ROOM) if len(best.get(key, ())) == k else q["floor"]
                    found, score, opened = _scored(cell, q, floor)
                    total = sums.setdefault(key, [0, 0, np.inf])
                    total[0] += opened
                    if q["cover"] and not counted:
                        every = cell.gathered(q["terms"])
                        if every is not None:
                            whole = np.bincount(every[0], every[1], len(cell.ids))
                            whole = whole[whole > 0]
                            total[1] += len(whole)
                            total[2] = min(total[2], whole.min(initial=np.inf))
                    if found is None or counted:
                        if found is not None:
                            best[key] = np.sort(np.append(best.get(key, []), score))[-k:]
                        continue
                    best[key] = np.sort(np.append(best.get(key, []), score))[-k:]
                    low = best[key][0] - _ROOM if len(best[key]) == k else 0.0
                    kept = score >= low
                    old = [h for h in hits.get(key, ()) if h[1] >= low]
                    hits[key] = old + list(zip(cell.ids.take(pa.array(found[kept])).to_pylist(), score[kept]))
        for key, rows in hits.items():
            if rows:
                none = [None] * len(rows)
                yield out([key] * len(rows), [r[0] for r in rows], [r[1] for r in rows], none, none, none)
        if sums:
            none, rows = [None] * len(sums), list(sums.values())
            yield out(list(sums), none, none, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    return run


def _matched(spark: SparkSession, asked: DataFrame, path: str, k: int, counted: bool = False) -> DataFrame:
    """Scores ``(query_id, chunk_id, raw_score)`` of all chunks that can be among the best, and rows ``(query_id, opened, matched,
    low)`` of the tasks, where the chunk is null."""
    key, blocks, cells = ["scope", "term", "bucket"], spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/cells")
    terms = cut_lineage(bounded(spark, asked, path, k))
    rows = blocks.join(asked.select(*key).distinct(), key, "left_semi").select("scope", "cell", "term", "places", "impacts", "tops")
    known = asked.select("scope").distinct()
    rows = rows.unionByName(cells.join(F.broadcast(known), "scope", "left_semi"), allowMissingColumns=True)
    rows = rows.repartition("scope", "cell").sortWithinPartitions("scope", "cell", F.asc_nulls_first("term"))
    kinds = [cells.schema["scope"].dataType, cells.schema["ids"].dataType.elementType]
    kind = f"scope {kinds[0].simpleString()}, ids array<{kinds[1].simpleString()}>, terms array<string>, sizes binary, places binary, impacts binary, tops binary"
    packed = rows.mapInArrow(_cells(tuple(map(_arrow, kinds))), kind)
    tiles = packed.join(R._side_of(asked)(_query_blocks(terms)), "scope")
    size = spark.read.parquet(f"{path}/meta").first()["block"]
    types = [asked.schema["query_id"].dataType, kinds[1]]
    out = f"query_id {types[0].simpleString()}, chunk_id {types[1].simpleString()}, raw_score double, opened bigint, matched bigint, low double"
    return tiles.mapInArrow(_search(k, size, [_arrow(t) for t in types], counted), out)


def search(spark: SparkSession, queries: DataFrame, path: str, k: int = DEFAULTS.top_k) -> DataFrame:
    """Best ``k`` chunks per scoped query, with the ranks and scaled scores of :func:`retrieval.bm25_search`."""
    asked = asked_terms(spark, queries, path)
    # A few rows per query and task.
    found = cut_lineage(_matched(spark, asked, path, k))
    scores = found.where("chunk_id IS NOT NULL AND raw_score > 0").withColumn("_s", F.round("raw_score", R.RANK_DIGITS)).select("query_id", "chunk_id", "_s")
    best = R.top_k(scores, ["query_id"], [F.desc("_s"), F.col("chunk_id")], k)
    # The lowest score is 0 while a chunk of the scope holds no asked word; only queries whose words could be in all are counted.
    cover = asked.where(F.col("dfs") >= F.col("n_chunks")).groupBy("query_id").agg(F.max("n_chunks").alias("n_chunks"))
    full = found.where("chunk_id IS NULL").groupBy("query_id").agg(F.sum("matched").alias("n"), F.min("low").alias("low"))
    full = full.join(cover, "query_id").where("n = n_chunks").select("query_id", "low")
    low = F.round(F.coalesce(F.col("low"), F.lit(0.0)), R.RANK_DIGITS)
    scaled = F.when(F.col("_max") > low, (F.col("_s") - low) / (F.col("_max") - low)).otherwise(1.0)
    return (
        best.withColumn("_max", F.max("_s").over(W.partitionBy("query_id"))).join(full, "query_id", "left")
        .select("query_id", "chunk_id", "rank", F.col("_s").alias("raw_score"), scaled.alias("score"))
    )


def blocks_read(spark: SparkSession, queries: DataFrame, path: str, k: int = DEFAULTS.top_k) -> DataFrame:
    """``query_id, opened, blocks``: blocks a query needs, and all blocks of its terms."""
    asked = asked_terms(spark, queries, path)
    opened = _matched(spark, asked, path, k, True).where("chunk_id IS NULL").groupBy("query_id").agg(F.sum("opened").alias("opened"))
    of = asked.groupBy("query_id").agg(F.sum("n_blocks").alias("blocks"))
    return of.join(opened, "query_id", "left").fillna(0, ["opened"])
