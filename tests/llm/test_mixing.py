"""Mixing against a walk over the rows in their order: nulls, empty table, repeated rows, one giant document per source."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing

KIND = "doc_id long, text string, source string, extra string"


def rows_of(hot: int, giant: int):
    rng = np.random.default_rng(2)
    rows = []
    for s, (source, n) in enumerate([("a", 150), ("b", 400), ("c", 500), (None, 300)]):
        rows += [(1000 * s + i, " ".join(["w"] * int(rng.integers(3, 30))), source, f"x{i}") for i in range(n)]
        rows.append((1000 * s + 998, " ".join(["g"] * giant), source, None))
        rows += [(1000 * s + 999, "seven words that come again and again", source, f"y{i % 2}") for i in range(hot)]
    return rows + [(9000, None, "a", None), (None, "a text of no name", "b", None), (None, "a text of no name", "b", None), (9001, "", None, None)]


def words(t):
    return len((t or "").split())


@pytest.mark.parametrize("hot, giant", [(0, 3000), (500, 10), (500, 3000)])
def test_mixing_fills_the_room(spark, hot, giant):
    rows = rows_of(hot, giant)
    d = spark.createDataFrame(rows, KIND)
    plan = mixing.mix_plan(d, block_rows=16, shard_draws=4).collect()
    sizes = {s: sum(words(t) for _, t, x, _ in rows if x == s) for s in ("a", "b", "c", None)}
    goal = dict(zip(sizes, mixing.targets(list(sizes.values()), [5.0, 2.0, 1.0, 5.0])))
    for s in sizes:
        mine = [r for r in plan if r.source == s]
        # The rows of the plan are those of the table.
        assert Counter({k: n for k, n in Counter((i, words(t)) for i, t, x, _ in rows if x == s).items()}) == sum(
            (Counter({(r.doc_id, r.size): r.rows}) for r in mine), Counter())
        left = round(goal[s]) - sum(r.rows * r.copies * r.size for r in mine)
        whole = round(goal[s]) // sizes[s]
        assert {r.copies for r in mine if r.size} <= set(range(whole, 4)) and all(r.copies == 0 for r in mine if not r.size)
        assert 0 <= left and all(left < r.size for r in mine if r.size and r.copies < 3), "no row that may come again fits the room"
    assert all(len(r.shards) == r.copies for r in plan)
    out = mixing.mix(d, block_rows=16, shard_draws=4).collect()
    want = Counter()
    for r in plan:
        want[(r.source, r.doc_id)] += r.rows * r.copies
    assert Counter((r.source, r.doc_id) for r in out) == +want
    times, there = Counter(tuple(r[:4]) for r in out), Counter(rows)
    assert all(n <= 3 * there[k] for k, n in times.items())


def test_mixing_is_the_walk_in_order(spark):
    rows = rows_of(200, 2000)
    d = spark.createDataFrame(rows, KIND)
    plan = mixing.mix_plan(d, block_rows=16).collect()
    keys = d.groupBy("doc_id", "source", F.xxhash64("doc_id", "text").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("text"))
    at = {s: i for i, s in enumerate(["a", "b", "c", None])}
    items = [(at[r.source], r.key, r.doc_id, words(r.text), r.n) for r in keys.collect()]
    n_blocks = {s: -(-sum(i[0] == s for i in items) // 16) for s in at.values()}
    h = spark.createDataFrame([(s, k, n_blocks[s]) for s, k, *_ in items], "s int, k long, n long").withColumn("b", F.expr("pmod(xxhash64(k, 7), n)"))
    place = {(r.s, r.k): (r.rank, r.b, r.turn) for r in h.select("s", "k", "b", F.expr("xxhash64(s, b, 8)").alias("rank"), F.expr("xxhash64(k, 9)").alias("turn")).collect()}
    got = {(at[r.source], r.key): r.rows for r in plan if r.first == 0 and r.copies and r.copies > r.target // r.source_size}
    for s in at.values():
        size = sum(i[3] * i[4] for i in items if i[0] == s)
        room = round(next(r.target for r in plan if at[r.source] == s)) % size
        want = {}
        for i in sorted((i for i in items if i[0] == s and i[3]), key=lambda i: (*place[i[:2]][:2], -i[3], place[i[:2]][2], i[1])):
            take = min(i[4], room // i[3])
            room -= take * i[3]
            if take:
                want[i[:2]] = take
        assert {k: v for k, v in got.items() if k[0] == s} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_are_met_with_giant_documents(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(100 * s + i, " ".join(["w"] * int(n)), source) for s, source in enumerate("abcdefgh") for i, n in enumerate(rng.lognormal(4, 1.2, 10) + 5)]
    rows += [(100 * s + 50, " ".join(["g"] * 2500), source) for s, source in enumerate("bdg")]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "abcdefgh":
        mine = [r for r in plan if r.source == source]
        reach = 3 * sum(r.size * r.rows for r in mine if r.size <= mine[0].target)
        taken, want = sum(r.copies * r.rows * r.size for r in mine), min(mine[0].target, reach)
        assert taken <= round(mine[0].target) and taken >= 0.95 * want, (source, taken, want)
        assert max(r.copies for r in mine) <= 3


def test_mixing_empty(spark):
    d = spark.createDataFrame([], KIND)
    assert mixing.mix_plan(d).count() == 0 and mixing.mix(d).count() == 0
