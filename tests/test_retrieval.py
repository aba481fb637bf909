import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import filters as FL
from lectern.operators import retrieval as R
from lectern.operators import vector_search as VS

CHUNKS = "chunk_id string, doc_id long, user_id string, content string, embedding array<float>"
QUERIES = "query_id long, user_id string, text string, embedding array<float>"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def corpus(seed=1, n=60, users=("a", "b", "c")):
    rnd = random.Random(seed)
    # One owner holds most of the rows.
    owner = lambda: users[0] if rnd.random() < 0.6 else rnd.choice(users)
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12)))
        vector = None if i % 9 == 0 else [rnd.uniform(-1, 1) for _ in range(8)]
        rows.append((f"c{i:03d}", i // 3, owner(), text, vector))
    return rows


def asked(seed=2, n=12, users=("a", "b", "c")):
    rnd = random.Random(seed)
    return [
        (i, rnd.choice(users), " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 4))), [rnd.uniform(-1, 1) for _ in range(8)])
        for i in range(n)
    ]


def okapi(query, texts):
    n = len(texts)
    avg = (sum(map(len, texts)) / n) or 1.0
    seen = Counter(w for t in texts for w in set(t))
    weight = {w: max(0.0, math.log((n - d + 0.5) / (d + 0.5) + 1)) for w, d in seen.items()}
    return [
        sum(weight.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query)
        for t in texts
    ]


def expected(rows, queries, k, shared=False, subset=None):
    out = {}
    for qid, user, text, *_ in queries:
        mine = [r for r in rows if (shared or r[2] == user) and (not subset or not subset[qid] or r[1] in subset[qid])]
        if not mine or not text.split():
            continue
        raw = [round(s, 9) for s in okapi(text.split(), [r[3].split() for r in mine])]
        hi, lo = max(raw), min(raw)
        best = sorted(((-s, r[0]) for s, r in zip(raw, mine, strict=True) if s > 0))[:k]
        for rank, (s, cid) in enumerate(best, 1):
            out[(qid, rank)] = (cid, pytest.approx((-s - lo) / (hi - lo) if hi > lo else 1.0, abs=1e-7))
    return out


@pytest.mark.parametrize("shared", [False, True])
def test_bm25_equals_the_formula(spark, shared):
    rows, queries = corpus(), asked()
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CHUNKS)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in R.bm25_search(q, c, 4, shared).collect()}
    assert got == expected(rows, queries, 4, shared)


def test_bm25_when_every_chunk_matches(spark):
    rows = [(f"c{i}", i, "a", "alpha " * (i + 1), None) for i in range(4)]
    queries = [(1, "a", "alpha", None)]
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CHUNKS)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in R.bm25_search(q, c, 4).collect()}
    assert got == expected(rows, queries, 4) and min(s for _, s in got.values()) == 0


def test_bm25_without_broadcast(spark, monkeypatch):
    rows, queries = corpus(3), asked(4)
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CHUNKS)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in R.bm25_search(q, c, 4).collect()}
    assert got == expected(rows, queries, 4)


def test_bm25_from_a_stored_index(spark, tmp_path):
    from lectern.sources.tables import read_index, write_index

    rows, queries = corpus(11), asked(12)
    q, c = FL.scope(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CHUNKS))
    write_index(R.bm25_index(c), str(tmp_path / "index"))
    found = R.bm25_search(q, None, 4, index=read_index(spark, str(tmp_path / "index")))
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in found.collect()} == expected(rows, queries, 4)


def test_document_subsets(spark):
    rows, queries = corpus(5), asked(6)
    subset = {qid: [] if qid % 3 == 0 else [qid, qid + 2, 7] for qid, *_ in queries}
    q = spark.createDataFrame([(*x, subset[x[0]]) for x in queries], QUERIES + ", document_ids array<long>")
    sq, sc = FL.subset_scopes(q, spark.createDataFrame(rows, CHUNKS))
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in R.bm25_search(sq, sc, 4, scoped=True).collect()}
    assert got == expected(rows, queries, 4, subset=subset)


def cosines(rows, queries, k, threshold, shared):
    out = {}
    for qid, user, _, v in queries:
        found = []
        for cid, _, owner, _, e in rows:
            if e is not None and (shared or owner == user):
                a, b = np.float32(v).astype(float), np.float32(e).astype(float)
                s = max(0.0, min(1.0, float(a @ b / np.sqrt((a @ a) * (b @ b)))))
                if round(s, 9) >= threshold:
                    found.append((-round(s, 9), cid))
        for rank, (s, cid) in enumerate(sorted(found)[:k], 1):
            out[(qid, rank)] = (cid, pytest.approx(-s, abs=1e-7))
    return out


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_vector_search_is_exact(spark, shared, small, monkeypatch):
    rows, queries = corpus(7), asked(8)
    if small:
        # Many slices and tiles; hits are dropped on the way.
        for name, value in (("SLICE_ROWS", 7), ("BLOCK_ROWS", 3), ("_HELD", 2)):
            monkeypatch.setattr(VS, name, value)
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CHUNKS)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in R.vector_search(q, c, 4, 0.2, shared).collect()}
    assert got == cosines(rows, queries, 4, 0.2, shared)


def test_lsh_finds_most_neighbours(spark):
    rows, queries = corpus(9, 200), asked(10)
    q, c = FL.scope(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CHUNKS).where("embedding IS NOT NULL"), True)
    near = {(r.query_id, r.chunk_id) for r in R.lsh_search(q, c, 5, 0.3).collect()}
    exact = {(k[0], v[0]) for k, v in cosines(rows, queries, 5, 0.3, True).items()}
    assert len(near & exact) / len(exact) > 0.8


def test_lsh_passes_no_proposed_pair(spark):
    """The neighbours of Spark's own join over the same hashes, without its pairs as rows of a shuffle."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from lectern.functions.vectors import cosine, l2_normalize

    rows, queries = ([r for r in some if r[-1] is not None] for some in (corpus(9, 200), asked(10)))
    dim = max(len(r[-1]) for r in rows)
    rows, queries = ([r for r in some if len(r[-1]) == dim] for some in (rows, queries))
    q, c = FL.scope(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CHUNKS), True)
    found = R.lsh_search(q, c, 5, 0.3, bucket_length=0.4, tables=2)
    u, v = (d.withColumn("unit", array_to_vector(l2_normalize("embedding"))) for d in (q, c))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=0.4, numHashTables=2, seed=7).fit(v.select("unit"))
    pairs = model.approxSimilarityJoin(u, v, (2.0 - 0.6) ** 0.5 + 1e-9, "distance").select(
        F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.chunk_id").alias("chunk_id"), F.round(cosine("datasetA.embedding", "datasetB.embedding"), 9).alias("score")
    )
    want = R.top_k(pairs.where("score >= 0.3"), ["query_id"], [F.desc("score"), F.col("chunk_id")], 5)
    plain = lambda d: {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in d.collect()}
    assert plain(found) == plain(want)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_no_foreign_rows(spark):
    q, c = spark.createDataFrame(asked(), QUERIES), spark.createDataFrame(corpus(), CHUNKS)
    owners = {r[0]: r[2] for r in corpus()}
    askers = {r[0]: r[1] for r in asked()}
    for found in (R.bm25_search(q, c), R.vector_search(q, c, threshold=0.0), R.hybrid_search(q, c, threshold=0.0), R.retrieve(q, c, threshold=0.0)):
        rows = found.collect()
        assert rows and all(owners[r.chunk_id] == askers[r.query_id] for r in rows)


def test_hybrid_alpha(spark):
    with pytest.raises(ValueError):
        R.hybrid_search(None, None, alpha=1.5)


def test_rrf_and_rerank(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in R.rrf([a, b], weights=[1.0, 2.0]).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 2 / 61)}
    cands = spark.createDataFrame(
        [(1, "x", "q w", "none", 0.9, 1), (1, "y", "q w", "q w", 0.8, 2), (2, "z", "q", "other", 0.5, 1)],
        "query_id int, chunk_id string, text string, content string, score double, rank int",
    )
    got = {(r.query_id, r.final_rank): (r.chunk_id, r.score) for r in R.rerank(cands, R.overlap_scorer).collect()}
    assert got == {(1, 1): ("y", 1.0), (1, 2): ("x", 0.0), (2, 1): ("z", 0.5)}
    off = {(r.query_id, r.final_rank): r.chunk_id for r in R.rerank(cands, None, 1).collect()}
    assert off == {(1, 1): "x", (2, 1): "z"}
    failed = R.rerank(cands, lambda q, c: F.when(c == "none", 1.0))
    assert {(r.query_id, r.final_rank): r.chunk_id for r in failed.collect()} == {(1, 1): "x", (1, 2): "y", (2, 1): "z"}


def test_quality(spark):
    rows = [(1, "a", "d1", 1, 0.9), (1, "b", "d1", 2, 0.7), (1, "c", "d2", 1, 0.8), (1, "d", "d2", None, 0.8)]
    r = R.quality(spark.createDataFrame(rows, "query_id int, chunk_id string, doc_id string, page_number int, score double")).first()
    assert (r.top_score, r.min_score, r.avg_score, r.unique_documents, r.unique_pages, r.citations) == (0.9, 0.7, 0.8, 2, 3, 4)


def test_passages(spark):
    text = "one two  three four\nfive six seven eight nine"
    docs = spark.createDataFrame([(1, text), (2, "xone two"), (3, "nothing")], "doc_id int, text string")
    p = [(1, "two  three four\nfive six seven eight"), (2, "two three four five six seven eight"), (3, "ne two"), (4, "three four\nfive")]
    got = {tuple(r) for r in R.passage_truth(spark.createDataFrame(p, "query_id int, text string"), docs).collect()}
    assert got == {(1, 1), (3, 1), (3, 2), (4, 1)}


def test_plans(spark):
    """Retrieval pairs nothing by a cross join, and BM25 needs no Python."""
    q, c = spark.createDataFrame(asked(), QUERIES), spark.createDataFrame(corpus(), CHUNKS)
    found = R.bm25_search(q, c)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    for bad in ("Python", "Cartesian", "NestedLoop"):
        assert bad not in plan
    assert "WindowGroupLimit" in plan and "ReusedExchange" in plan


def test_nested_children_are_split(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1, i) for i in range(25)], "k int, pos int")
    rows = FL.nest_children(parent, child, "k", "pos", ["pos"], block=10).orderBy("k", "block_no").collect()
    assert [(r.k, r.block_no, len(r.children)) for r in rows] == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 0)]


def test_nested_children_are_one_row_of_any_length(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1, i) for i in range(2499, -1, -1)] + [(1, None)], "k int, pos int")
    rows = FL.nest_children(parent, child, "k", "pos", ["pos"]).orderBy("k").collect()
    assert [(r.k, r.block_no, len(r.children)) for r in rows] == [(1, 0, 2501), (2, 0, 0)]
    assert [c.pos for c in rows[0].children] == [None, *range(2500)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = corpus(11, 300)
    c = spark.createDataFrame(rows, CHUNKS)
    path = str(tmp_path_factory.mktemp("index"))
    VS.build_index(FL.scope(None or spark.createDataFrame(asked(12), QUERIES), c, True)[1], path, cells=6)
    return rows, path


def test_index_with_all_cells_is_exact(spark, index):
    rows, path = index
    q = FL.scope(spark.createDataFrame(asked(13), QUERIES), spark.createDataFrame(rows, CHUNKS), True)[0]
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in VS.index_search(spark, q, path, 4, 0.2, probes=6).collect()}
    assert got == cosines(rows, asked(13), 4, 0.2, True)


def test_index_reads_probed_cells_alone(spark, index):
    rows, path = index
    q = FL.scope(spark.createDataFrame(asked(13), QUERIES), spark.createDataFrame(rows, CHUNKS), True)[0]
    near = VS.index_probes(spark, q, path, 1)
    read = VS.probed(spark, near, path)
    plan = read._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    cells = {r.cell for r in near.collect()}
    assert {r.cell for r in read.collect()} <= cells
    share = VS.scanned_share(spark, q, path, 1).collect()
    stored = sum(r[4] is not None for r in rows)
    assert share and all(0 < r.scanned < r.stored == stored for r in share)
    exact = {(k[0], v[0]) for k, v in cosines(rows, asked(13), 4, 0.2, True).items()}
    found = {(r.query_id, r.chunk_id) for r in VS.index_search(spark, q, path, 4, 0.2).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_index_odd_vectors(spark, tmp_path):
    kind = "chunk_id string, user_id string, embedding array<float>"
    nan = float("nan")
    rows = [("a", "x", [1.0, 0.0]), ("b", "x", [0.0, 0.0]), ("c", "y", [1.0, 0.1]), ("d", "x", [1.0, 0.0, 0.0]), ("e", "x", None), ("f", "x", [nan, 1.0]), ("g", None, [1.0, 0.0]), ("h", "x", [])]
    c = spark.createDataFrame(rows, kind)
    q = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "x", [2.0, 0.0, 0.0]), (3, "z", [1.0, 0.0]), (4, "x", None)], "query_id long, user_id string, embedding array<float>")
    sq, sc = FL.scope(q, c)
    VS.build_index(sc, str(tmp_path / "i"))
    want = [(1, "a", 1.0), (2, "d", 1.0)]
    assert [(r.query_id, r.chunk_id, r.score) for r in VS.index_search(spark, sq, str(tmp_path / "i"), 5, 0.5).orderBy("query_id").collect()] == want
    assert [(r.query_id, r.chunk_id, r.score) for r in VS.vector_search(q, c, 5, 0.5).orderBy("query_id").collect()] == want
    VS.build_index(sc.where("false"), str(tmp_path / "none"))
    assert VS.index_search(spark, sq, str(tmp_path / "none")).count() == 0
    assert VS.vector_search(q, c.where("false")).count() == 0 and VS.vector_search(q.where("false"), c).count() == 0


def test_no_passages_and_odd_options(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    empty = spark.createDataFrame([], "query_id long, text string")
    assert R.passage_truth(empty, docs).collect() == [] and R.passage_truth(empty, docs).columns == ["query_id", "doc_id"]
    nan = float("nan")
    q = spark.createDataFrame([(1, "t", 5, 0.5, None), (2, "t", 5, 0.5, 1.5), (3, "t", 5, 0.5, nan), (4, "t", 5, 0.5, 0.0)], "id int, text string, top_k int, threshold double, alpha double")
    ok, bad = FL.validate_queries(q)
    assert {r.id for r in ok.collect()} == {1, 4} and {r.id: r.reason for r in bad.collect()} == {2: "alpha", 3: "alpha"}
    m = spark.createDataFrame([(1, "c", None), (2, "c", -0.1), (3, None, 0.5), (4, "c", nan), (5, "c", 1.0)], "id int, content string, importance double")
    ok, bad = FL.validate_memories(m)
    assert {r.id for r in ok.collect()} == {1, 5} and {r.id: r.reason for r in bad.collect()} == {2: "importance", 3: "content", 4: "importance"}
