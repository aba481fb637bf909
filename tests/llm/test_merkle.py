"""Merkle manifest against a plain restatement, with odd rows."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from lectern.llm import merkle, queries, sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """Root, and for each leaf its siblings and their sides."""
    spots, steps = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        for i, at in enumerate(spots):
            lo = at // 3 * 3
            steps[i].append(("".join(digests[lo:at]), "".join(digests[at + 1 : lo + 3])))
            spots[i] = at // 3
        digests = [h("".join(digests[i : i + 3])) for i in range(0, len(digests), 3)]
    return digests[0], steps


def plain(rows):
    names = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[3] == n), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for n in names]
    subs = [tree([leaf(*r) for r in g]) for g in groups]
    root, ways = tree([s for s, _ in subs])
    out = []
    for g, (sub, steps), way in zip(groups, subs, ways):
        for r, own in zip(g, steps):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            fold = leaf(r[0], text, *r[2:])
            for left, right in own + way:
                fold = h(left + fold + right)
            out.append((r[0], leaf(*r), sub, root, h("".join(a + b for a, b in own + way)), fold, fold == root))
    return out


def order(rows):
    return sorted(rows, key=str)


def make(n, sources, seed=2):
    rnd = random.Random(seed)
    words = ["a\nb", "", "é\n", "x" * 9000, None, "plain"]
    return [(i, rnd.choice(words), rnd.choice(["en", None, ""]), rnd.choice(sources), rnd.choice([None, i])) for i in range(n)]


def run(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
    return [tuple(r) for r in queries.op13_merkle(spark, str(tmp_path / name)).collect()]


def test_manifest(spark, tmp_path):
    # Trees of several heights, a null name, a null and a repeated id, equal rows.
    rows = make(70, ["big", "big", "big", "b", None, "", "É", "zz"]) + [(None, "t\n", "en", "b", 1), (3, "again", "en", "b", 1)] + [(500, "c", "en", "big", 1)] * 3
    rows += [(900 + i, f"lone{i}", "x", f"lone{i}", i) for i in range(3)]
    got = run(spark, tmp_path, rows, "many")
    assert order(got) == order(plain(rows))
    assert {g[-1] for g in got} == {True, False}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/many/documents.parquet/*.parquet'")
        assert order(db.execute(sql.MERKLE_SQL).fetchall()) == order(got)


def test_small_tables(spark, tmp_path):
    for name, rows in (("one", [(7, "x\ny", "en", "s", 3)]), ("two", [(1, "a", "en", "s", 1), (2, "b", "en", None, 1)]), ("four", make(4, ["s"]))):
        assert order(run(spark, tmp_path, rows, name)) == order(plain(rows))
    assert run(spark, tmp_path, [], "none") == []


def test_every_arity(spark):
    rows = spark.createDataFrame(make(20, ["s", "t"]), SCHEMA)
    for arity in (2, 4):
        got = merkle.manifest(rows, arity=arity)
        assert got.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 20
