"""Stages of the corpus pipeline against plain restatements."""

import numpy as np

import corpus_pipeline
from lectern.llm import mixing
from tests.llm.test_operators import WORDS, components_of, plain_fingerprint, texts


def test_one_row_of_every_class_stays(spark):
    rng = np.random.default_rng(3)
    long = lambda: " ".join(rng.choice(WORDS, 50))
    x, y, z, v, u = long(), long(), long(), long(), long()
    rows = [(i, t, "a") for i, t in texts(40)]
    # One id with two unlinked texts; the head of a group that is also a copy in another one; null copies of a named
    # document; null ids alone; a repeated row; equal id and text with other columns.
    rows += [(100, x, "a"), (100, y, "a"), (90, y, "a"), (110, x, "a"), (None, z, "a"), (120, z, "a"), (None, z, "b")]
    rows += [(None, u, "a"), (None, u, "a"), (130, v, "a"), (130, v, "a"), (130, v, "b"), (130, v, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.drop_copies(spark, d, "").collect()]
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    near = [[j for j, b in enumerate(fps) if (a ^ b).bit_count() <= 4] for a in fps]
    of = components_of(near, list(range(len(rows))))
    assert len(got) == len(set(of)), "one row of every class"
    for i, text, source in got:
        at = rows.index((i, text, source))
        ids = [rows[j][0] for j in range(len(rows)) if of[j] == of[at] and rows[j][0] is not None]
        assert i == (min(ids) if ids else None)
    kept = {of[rows.index(r)] for r in got}
    assert kept == set(of)
    assert (100, x) in [r[:2] for r in got] and (90, y) in [r[:2] for r in got]
    assert corpus_pipeline.drop_copies(spark, d.where("false"), "").count() == 0


def test_mixed_rows_are_written_in_the_order_of_their_shards(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7 + 1), "abc"[i % 3]) for i in range(8000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "in"))
    d = spark.read.parquet(str(tmp_path / "in"))
    corpus_pipeline.mix_sources(spark, d, "").write.parquet(str(tmp_path / "out"))
    out = [r.doc_id for f in sorted((tmp_path / "out").glob("*.parquet")) for r in spark.read.parquet(str(f)).select("doc_id").collect()]
    places = {}
    for r in mixing.mix(d).orderBy("mix_shard", "mix_turn").collect():
        places.setdefault(r.mix_shard, []).append(r.doc_id)
    joined = ",".join(map(str, ["", *out, ""]))
    assert sum(map(len, places.values())) == len(out)
    assert all("," + ",".join(map(str, ids)) + "," in joined for ids in places.values()), "a shard is one run in its order"
