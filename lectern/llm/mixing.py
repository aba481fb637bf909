"""Mixing sources to target weights: multivariate-hypergeometric splitting tree over permuted blocks.

Documents of a source are dealt into blocks by a hash, and the blocks are put into a hashed order. A source whose target
is ``x`` times its words is passed ``floor(x)`` times as a whole; of the rest, rows are taken from the front of the order
of blocks, in a block the longest first, whenever they fit the room left. Running sums over the blocks tell up to where all
rows that fit by themselves fit together; the block on the border is filled row by row, and what room it leaves is carried
on to the blocks after it, until no row left fits. Room that is then left goes to one more copy of rows, as long as none
comes more often than the cap allows. Every (pass, block) is one
*draw*; the draws of all sources are split over output shards by a tree: a node with a vector of draws per source hands
a multivariate-hypergeometric part of it to its left half and the rest to its right half. Each leaf is a shard that owns
a disjoint range of every source's permuted draws; its documents are shuffled by a hash of their own.

Results: a null text has no words; a null source is a source of its own, ordered last. A document with no words is never
taken, nor is any of a source whose target is zero. Repeated rows (equal id and text) are taken one by one. An empty table
gives an empty plan. Equal inputs give equal plans: every choice is a hash of ids, texts and the seed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import text_of, word_count
from lectern.operators.sizing import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_ROWS = 512
SHARD_DRAWS = 64


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size; the excess is shared again by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_ and left > 0:
        w = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = cap * sizes[i]
            open_.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def _split(lo: int, hi: int, draws: np.ndarray, seed: int, width: int) -> list[tuple[int, int, np.ndarray]]:
    """Nodes of at most ``width`` shards below the node of shards ``lo`` to ``hi``."""
    todo, done = [(lo, hi, draws)], []
    while todo:
        a, b, d = todo.pop()
        if b - a <= width:
            done.append((a, b, d))
            continue
        mid, n = (a + b) // 2, int(d.sum())
        rng = np.random.default_rng([seed, a, b])
        left = rng.multivariate_hypergeometric(d, n * (mid - a) // (b - a), method="marginals")
        todo += [(a, mid, left), (mid, b, d - left)]
    return done


def _shards(spark, draws: list[int], n_shards: int, seed: int) -> DataFrame:
    """``(shard, source_no, n)``: the leaves. The driver splits to a few nodes, tasks split each of them on."""
    top = _split(0, n_shards, np.array(draws, dtype=np.int64), seed, max(1, n_shards // 64))
    nodes = spark.createDataFrame([(a, b, d.tolist()) for a, b, d in top], "lo long, hi long, draws array<long>")

    def leaves(batches):
        for pdf in batches:
            for a, b, d in pdf.itertuples(index=False):
                for s, _, n in _split(int(a), int(b), np.array(d, dtype=np.int64), seed, 1):
                    k = np.nonzero(n)[0]
                    yield pd.DataFrame({"shard": np.full(len(k), s), "source_no": k.astype(np.int32), "n": n[k]})

    return nodes.repartition(len(top), "lo").mapInPandas(leaves, "shard long, source_no int, n long")


def _take(items: DataFrame, rest: dict[int, int], seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the last pass: ``(_no, after, until, room)``, ranges of ranks from which every row of at most ``room``
    words is taken, and ``(source_no, block, key, took)``, rows taken in border blocks.

    Together they are what one walk over the rows in their order takes, each that fits. A round ends at a block, so rounds
    are few: a filled block leaves less room than its smallest row left has. One row per source comes to the driver.
    """
    spark = items.sparkSession

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(small=-pdf["size"]).sort_values(["small", "turn", "key", "doc_id"], kind="stable").drop(columns="small")
        room, took = int(pdf["left"].iloc[0]), []
        for size, rows in zip(pdf["size"].tolist(), pdf["rows"].tolist()):
            took.append(min(rows, room // size))
            room -= took[-1] * size
        pdf = pdf.assign(took=took, words=pdf["size"] * took)
        return pdf.loc[pdf["took"] > 0, ["source_no", "block", "key", "took", "words"]]

    kind, all_ranges, fills = "source_no int, block long, key long, took long, words long", [], []
    todo = {no: (-1, room) for no, room in rest.items() if room > 0}
    by = Window.partitionBy("source_no").orderBy("rank")
    while todo:
        now = spark.createDataFrame([(no, after, room) for no, (after, room) in todo.items()], "source_no int, after long, room long")
        fit = items.join(F.broadcast(now), "source_no").where("rank > after and size between 1 and room")
        sums = fit.groupBy("source_no", "room", "rank").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(by))
        got = sums.groupBy("source_no").agg(
            F.min(F.when(F.col("upto") > F.col("room"), F.col("rank"))).alias("border"),
            F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))).alias("used"),
        ).collect()
        all_ranges += [(r["source_no"], todo[r["source_no"]][0], 2**62 if r["border"] is None else r["border"], todo[r["source_no"]][1]) for r in got]
        todo = {r["source_no"]: (r["border"], todo[r["source_no"]][1] - int(r["used"] or 0)) for r in got if r["border"] is not None}
        if not todo:
            break
        edge = spark.createDataFrame([(no, at, left) for no, (at, left) in todo.items()], "source_no int, rank long, left long")
        full = cut_lineage(
            items.join(F.broadcast(edge), ["source_no", "rank"]).where("size between 1 and left")
            .select("source_no", "block", "doc_id", "key", "size", "rows", "left", F.xxhash64("key", F.lit(seed + 2)).alias("turn"))
            .groupBy("source_no", "block").applyInPandas(fill, kind)
        )
        fills.append(full)
        used = {r["source_no"]: int(r["w"]) for r in full.groupBy("source_no").agg(F.sum("words").alias("w")).collect()}
        todo = {no: (at, left - used.get(no, 0)) for no, (at, left) in todo.items() if left > used.get(no, 0)}
    filled = reduce(DataFrame.unionByName, fills) if fills else spark.createDataFrame([], kind)
    return spark.createDataFrame(all_ranges, "_no int, after long, until long, room long"), filled.drop("words")


def mix_plan(
    docs: DataFrame, weights=WEIGHTS, cap: float = 3.0, block_rows: int = BLOCK_ROWS, shard_draws: int = SHARD_DRAWS, seed: int = 7
) -> DataFrame:
    """One row per distinct (id, text, source) and number of copies:
    ``doc_id, key, source, rows, first, equal, size, source_size, target, copies, shards``.

    ``key`` is the hash of id and text, ``equal`` the number of equal rows, ``rows`` how many of them, after the ``first``
    ones, the row stands for, ``size`` the words of one of them, ``copies`` how often each is taken and ``shards`` where (one entry per copy). ``block_rows`` is the mean number of
    documents in a block, ``shard_draws`` the mean number of blocks in a shard.
    """
    spark = docs.sparkSession
    text = text_of()
    keys = cut_lineage(
        docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("key"), word_count(text).alias("size"))
        .groupBy("doc_id", "source", "key").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"))
    )
    # One row per source comes to the driver, nothing per document.
    per = keys.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("w"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect()
    per.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["w"]) for r in per]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(per))], cap)
    rows = []
    for i, r in enumerate(per):
        want = int(round(goal[i]))
        whole = want // sizes[i] if sizes[i] else 0
        rows.append((r["source"], i, sizes[i], goal[i], whole, want - whole * sizes[i], -(-int(r["n"]) // block_rows)))
    kind = "source string, source_no int, source_size long, target double, whole long, rest long, n_blocks long"
    sources = spark.createDataFrame(rows, kind)
    s = sources.withColumnRenamed("source", "_source")
    placed = keys.join(s, keys["source"].eqNullSafe(s["_source"])).drop("_source").withColumn(
        "block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("n_blocks"))
    )
    order = Window.partitionBy("source_no").orderBy(F.xxhash64("source_no", "block", F.lit(seed + 1)), "block")
    blocks = placed.select("source_no", "block").distinct().withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))
    items = cut_lineage(placed.join(blocks, ["source_no", "block"]))
    inside, least = F.col("size").between(1, F.col("room")), {i: r["least"] for i, r in enumerate(per)}
    room, extras = {r[1]: r[5] for r in rows}, []
    # The last pass; what room it leaves goes to further copies, while rows may come again.
    while room := {no: left for no, left in room.items() if least[no] and left >= least[no] and rows[no][4] + len(extras) < int(cap)}:
        ranges, filled = _take(items, room, seed)
        extras.append(f"extra{len(extras)}")
        items = cut_lineage(
            items.join(F.broadcast(ranges), (items["source_no"] == ranges["_no"]) & (F.col("rank") > F.col("after")) & (F.col("rank") < F.col("until")), "left")
            .join(filled, ["source_no", "block", "key"], "left")
            .withColumn(extras[-1], F.when(inside, F.col("rows")).otherwise(F.coalesce("took", F.lit(0).cast("bigint"))))
            .drop("_no", "after", "until", "room", "took", "words")
        )
        used = {r["source_no"]: int(r["w"] or 0) for r in items.groupBy("source_no").agg(F.sum(F.col(extras[-1]) * F.col("size")).alias("w")).collect()}
        room = {no: left - used.get(no, 0) for no, left in room.items()}
    # Times that some row of the block is taken once more.
    more = sum((F.max(F.col(e) > 0).cast("int") for e in extras), F.max(F.lit(0)))
    # Blocks that rows are taken from once more stand before all others, the more often the earlier.
    front = Window.partitionBy("source_no").orderBy(F.col("more").desc(), "rank")
    blocks = items.groupBy("source_no", "block", "rank").agg(more.alias("more"))
    blocks = cut_lineage(blocks.select("source_no", "block", "more", (F.row_number().over(front) - 1).cast("bigint").alias("rank")))
    taken = {r["source_no"]: r for r in blocks.groupBy("source_no").agg(*[F.count_if(F.col("more") > i).alias(f"d{i}") for i in range(len(extras) or 1)]).collect()}
    drawn = [[int(taken[r[1]][f"d{i}"]) for i in range(len(extras) or 1)] for r in rows]
    draws = [r[4] * r[6] + sum(d) for r, d in zip(rows, drawn)]
    if not sum(draws):
        draws = [1] + draws[1:] if draws else [1]
    leaves = _shards(spark, draws, max(1, sum(draws) // shard_draws), seed)
    upto = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard"))
    leaves = leaves.withColumn("upto", upto)
    draw = leaves.select("source_no", "shard", F.explode(F.expr("sequence(upto - n, upto - 1)")).alias("draw"))
    # Draws are numbered pass by pass and, in a pass, by rank, so a block meets its shards by an equi-join.
    ends = [(r[1], sum(([r[6]] * r[4] + d)[: i + 1]), ([r[6]] * r[4] + d)[i], i) for r, d in zip(rows, drawn) for i in range(r[4] + len(d))]
    passes = spark.createDataFrame(ends, "source_no int, _end long, _size long, pass long")
    draw = draw.join(F.broadcast(passes), "source_no").where((F.col("draw") < F.col("_end")) & (F.col("draw") >= F.col("_end") - F.col("_size"))).select(
        "source_no", (F.col("draw") - F.col("_end") + F.col("_size")).alias("rank"), "pass", "shard"
    )
    dealt = draw.groupBy("source_no", "rank").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("drawn"))
    table = blocks.join(dealt, ["source_no", "rank"], "left").select("source_no", "block", "drawn")
    out = items.drop("rank").withColumnRenamed("rows", "equal").join(table, ["source_no", "block"])
    # The first rows of an item are taken more often than the others.
    whole = F.when(F.col("size") == 0, 0).otherwise(F.col("whole")).cast("bigint")
    upto = F.array_sort(F.array(F.lit(0).cast("bigint"), *[F.col(e) for e in extras], F.col("equal")))
    parts = F.transform(
        F.sequence(F.lit(1), F.lit(len(extras) + 1)),
        lambda i: F.struct(
            (F.get(upto, i) - F.get(upto, i - 1)).alias("rows"), F.get(upto, i - 1).alias("first"), (whole + F.lit(len(extras) + 1) - i).alias("copies")
        ),
    )
    out = out.withColumn("part", F.explode(F.filter(parts, lambda p: p["rows"] > 0))).select("*", "part.*")
    return out.select(
        "doc_id", "key", "source", "rows", "first", "equal", "size", "source_size", "target", "copies",
        F.slice(F.coalesce(F.transform("drawn", lambda x: x["shard"]), F.array().cast("array<bigint>")), 1, F.col("copies").cast("int")).alias("shards"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every input column, one row per copy, with ``mix_shard`` and ``mix_turn``, the place in the
    shard's own shuffle. Write with ``repartition('mix_shard').sortWithinPartitions('mix_shard', 'mix_turn')``."""
    plan = cut_lineage(mix_plan(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("key").alias("_key"), F.col("shards").alias("_shards"),
        F.col("first").alias("_first"), F.col("rows").alias("_rows"), F.col("equal").alias("_equal"),
    ))
    d = docs.withColumn("_llm_key", F.xxhash64("doc_id", "text"))

    def meet(rows: DataFrame, part: DataFrame) -> DataFrame:
        return rows.join(part, (rows["_llm_key"] == part["_key"]) & rows["doc_id"].eqNullSafe(part["_id"]) & rows["source"].eqNullSafe(part["_src"]))

    own = [*docs.columns, "_llm_key"]
    met = meet(d, plan.where("_rows = _equal")).select(*own, "_shards")
    # Of the few items taken in part, rows equal in every column are one row with their number.
    some = plan.where("_rows < _equal")
    few = meet(d, some.select("_key", "_id", "_src").distinct()).groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("_llm_key", "doc_id", "source").orderBy(*[F.xxhash64(c) for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()])
    few = few.withColumn("_upto", F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    shared = F.least("_upto", F.col("_first") + F.col("_rows")) - F.greatest(F.col("_upto") - F.col("_n"), F.col("_first"))
    few = meet(few, some).withColumn("_hit", shared).where("_hit > 0")
    few = few.select(*own, "_shards", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_hit"))).alias("_no")).drop("_no")
    out = met.unionByName(few).select(*own, F.posexplode("_shards").alias("_pass", "mix_shard"))
    return out.withColumn("mix_turn", F.xxhash64("mix_shard", "_llm_key", "_pass")).drop("_llm_key", "_pass")
