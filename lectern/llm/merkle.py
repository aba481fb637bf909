"""Merkle manifest of a table by sibling-shift self-joins.

Nodes are narrow rows ``(tree, node, digest)``; a level's slot of node ``i`` is ``i mod arity`` and its run ``i div arity``. One
level is one or more equijoins of the nodes with themselves on computed indices: slot offset ``s`` of a node meets the
node at ``run * arity + (slot + s) mod arity`` (for two slots, the exclusive or with one). The joined row holds the digests of
its whole run, so it knows its siblings; rows of slot zero emit the run's parent. Every level is written once; trees with
one node left leave the loop. Leaves of all trees climb together: a third of all rows in one tree are rows like others,
as nodes are dealt by tree *and* run.

A leaf is the digest of its columns, each ``-`` for null, otherwise the number of UTF-8 bytes, ``:`` and the value. Nodes
are in ascending order of the key (nulls first, then by digest), trees in ascending order of their name (null first, by
bytes). The trees' roots are leaves of one more tree in which all of them climb alike.

A proof of a row are its siblings level by level, left to right. Rows of one run share one proof path upwards, so proofs
go down the levels again: each level joins its nodes with the path of their parents, and only the last join has a row for
every leaf.

Results: equal rows are leaves of their own (their places among each other are interchangeable). An empty table has no
leaf and no root. Input columns called like an output are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import numbered
from lectern.operators.sizing import cut_lineage, written

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value as it enters a digest."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(columns=COLUMNS, **changed: Column) -> Column:
    """Digest of a row; ``changed`` columns stand for those of the table."""
    return digest(*[field(changed.get(c, F.col(f"`{c}`"))) for c in columns])


def with_siblings(level: DataFrame, arity: int = ARITY) -> DataFrame:
    """Nodes of a level with the digests of their run's slots ``d0 .. d(arity - 1)``; missing ones are null."""
    run, slot = F.floor(F.col("node") / arity).cast("long"), (F.col("node") % arity).cast("int")
    out = level.withColumn("run", run).withColumn("slot", slot)
    for s in range(1, arity):
        # The other end of the shift: who meets slot ``j`` at offset ``s`` stands at slot ``j - s``.
        other = level.select(
            F.col("tree").alias("_tree"), F.col("digest").alias(f"_d{s}"),
            (run * arity + F.pmod(slot - s, F.lit(arity))).alias("_node"),
        )
        out = out.join(other, (out["tree"] == other["_tree"]) & (out["node"] == other["_node"]), "left").drop("_tree", "_node")
    for j in range(arity):
        shifted = F.col("digest")
        for s in range(1, arity):
            shifted = F.when((F.col("slot") + s) % arity == j, F.col(f"_d{s}")).otherwise(shifted)
        out = out.withColumn(f"d{j}", shifted)
    return out.drop(*[f"_d{s}" for s in range(1, arity)])


def _concat(parts: list[Column]) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def climb(leaves: DataFrame, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """Roots ``(tree, root)``, and the leaves ``(tree, node, digest, ...)`` with the column ``proof``.

    A proof is an array, from the leaf upwards, of the siblings left and right of it. The single node of a tree is its root.
    """
    sizes = leaves.groupBy("tree").agg(F.max("node").alias("last"))
    level = written(leaves.join(sizes, "tree"))
    levels, tops = [], [level.where("last = 0")]
    highest = level.agg(F.max("last")).first()[0] or 0
    while highest:
        levels.append(written(with_siblings(level.where("last > 0"), arity)))
        level = levels[-1].where("slot = 0").select(
            "tree", F.col("run").alias("node"), digest(_concat([F.col(f"d{j}") for j in range(arity)])).alias("digest"),
            F.floor(F.col("last") / arity).cast("long").alias("last"),
        )
        tops.append(level.where("last = 0"))
        highest //= arity
    roots = reduce(DataFrame.unionByName, [t.select("tree", F.col("digest").alias("root")) for t in tops])
    # From the roots down: a node's path is its own step and its parent's path. Trees join at the level of their root.
    none = F.array().cast("array<struct<left:string,right:string>>").alias("proof")
    paths, slots = tops[-1].drop("last").withColumn("proof", none), [F.col(f"d{j}") for j in range(arity)]
    for height, joined, ended in reversed(list(zip(range(len(levels)), levels, tops))):
        left = _concat([F.when(F.col("slot") > j, c) for j, c in enumerate(slots)])
        right = _concat([F.when(F.col("slot") < j, c) for j, c in enumerate(slots)])
        up = paths.select(F.col("tree").alias("_t"), F.col("node").alias("_run"), F.col("proof").alias("_up"))
        met = joined.join(up, (joined["tree"] == up["_t"]) & (joined["run"] == up["_run"]))
        met = met.withColumn("proof", F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "_up"))
        own = [c for c in ended.columns if c != "last"]
        paths = met.select(*own, "proof").unionByName(ended.select(*own, none))
        # The widest level stays a plan; the ones above are written, so that no plan holds several levels.
        paths = written(paths) if height else paths
    return roots, paths


def folded(start: Column, proof: Column) -> Column:
    """Root recomputed from a leaf's digest and its proof."""
    return F.aggregate(proof, start, lambda d, s: digest(s["left"], d, s["right"]))


def manifest(rows: DataFrame, columns=COLUMNS, tree: str = "source", key: str = "doc_id", arity: int = ARITY, carry: dict[str, Column] | None = None) -> DataFrame:
    """``key, leaf, subroot, root, proof`` of every row, and the columns ``carry``, computed next to the leaf.

    ``proof`` leads from the leaf over its tree's root to the root of all.
    """
    carry = carry or {}
    own = cut_lineage(
        rows.select(F.col(key).alias("_key"), F.col(tree).alias("_tree"), leaf(columns).alias("digest"), *[c.alias(n) for n, c in carry.items()])
    )
    leaves = numbered(own, "_tree", [F.col("_key").asc_nulls_first(), F.col("digest")])
    # Trees by number: null is a name, too.
    names = cut_lineage(own.select("_tree").distinct().withColumn("_all", F.lit(0)))
    trees = numbered(names, "_all", [F.col("_tree").asc_nulls_first()]).select(F.col("_tree").alias("_name"), F.col("node").alias("tree"))
    trees = written(trees)
    leaves = leaves.join(trees, leaves["_tree"].eqNullSafe(trees["_name"])).drop("_name", "_tree")
    subroots, proved = climb(leaves, arity)
    top = written(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), F.col("root").alias("digest")))
    root, ways = climb(top, arity)
    # One digest; an empty table has none.
    found = root.first()
    ways = ways.select(F.col("node").alias("_sub"), F.col("digest").alias("subroot"), F.col("proof").alias("_way"))
    met = proved.join(ways, F.col("tree") == F.col("_sub"))
    return met.select(
        F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", F.lit(found["root"] if found else None).cast("string").alias("root"),
        F.concat("proof", "_way").alias("proof"), *carry,
    )


def siblings(proof: Column) -> Column:
    """Digests of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")
