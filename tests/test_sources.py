"""Tables with versions, document files, stored postings."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import filters as FL
from lectern.operators import postings as P
from lectern.operators import retrieval as R
from lectern.sources import document_files, snapshots
from tests.test_retrieval import CHUNKS, QUERIES, asked, corpus, expected


def docx_bytes(paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return held.getvalue()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def test_versions_are_pinned_and_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.manifest(spark, path) is None
    snapshots.replace(spark, path, table(spark, [(i, "a") for i in range(50)]), "k", bucket_rows=5)
    first = snapshots.read(spark, path)
    snapshots.replace(spark, path, table(spark, [(3, "b"), (3, "c"), (99, "d")]), "k", bucket_rows=5)
    snapshots.delete(spark, path, table(spark, [(4, None), (1000, None)]), "k", bucket_rows=5)
    want = sorted([(i, "a") for i in range(50) if i not in (3, 4)] + [(3, "b"), (3, "c"), (99, "d")])
    assert rows(snapshots.read(spark, path)) == want
    assert rows(first) == rows(snapshots.read(spark, path, 0)) == [(i, "a") for i in range(50)]
    one, two = snapshots.manifest(spark, path, 0), snapshots.manifest(spark, path, 1)
    same = [b for b in one["folders"] if one["folders"][b] == two["folders"].get(b)]
    assert one["buckets"] >= 4 and len(same) >= len(one["folders"]) - 2, "buckets without a change keep their files"


def test_a_write_that_fails_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.replace(spark, path, table(spark, [(1, "a"), (2, "b")]), "k", batch=("s", 0))
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            snapshots.replace(spark, path, table(spark, [(1, "z")]), "k", batch=("s", 1))
    assert rows(snapshots.read(spark, path)) == [(1, "a"), (2, "b")]
    # Run again, then a third time: noted batches change nothing.
    assert snapshots.replace(spark, path, table(spark, [(1, "z")]), "k", batch=("s", 1)) == 1
    assert snapshots.replace(spark, path, table(spark, [(1, "y")]), "k", batch=("s", 1)) == 1
    assert rows(snapshots.read(spark, path)) == [(1, "z"), (2, "b")]
    assert snapshots.expire(spark, path, keep=1) >= 1 and rows(snapshots.read(spark, path)) == [(1, "z"), (2, "b")]


def test_the_second_writer_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.replace(spark, path, table(spark, [(1, "a")]), "k")

    def merge(old, new):
        snapshots.replace(spark, path, table(spark, [(1, "first")]), "k")
        return new

    with pytest.raises(snapshots.Conflict):
        snapshots.change(spark, path, table(spark, [(1, "second")]), "k", merge)
    assert rows(snapshots.read(spark, path)) == [(1, "first")]


def test_empty_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.replace(spark, path, table(spark, []), "k")
    assert rows(snapshots.read(spark, path)) == []
    snapshots.replace(spark, path, table(spark, [(None, "n"), (1, None)]), "k")
    snapshots.delete(spark, path, table(spark, [(1, None)]), "k")
    assert rows(snapshots.read(spark, path)) == [(None, "n")]


def test_document_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("é one\n")
    (folder / "b.txt").write_bytes(b"caf\xe9")
    (folder / "c.docx").write_bytes(docx_bytes(["first", "second"]))
    (folder / "d.docx").write_bytes(b"broken")
    (folder / "e.pdf").write_bytes(b"%PDF")
    (folder / "_unfinished").write_bytes(b"x")
    got = {os.path.basename(r.path): r for r in document_files.read(spark, str(folder), share_bytes=8).collect()}
    assert sorted(got) == ["a.txt", "b.txt", "c.docx", "d.docx", "e.pdf"]
    assert (got["a.txt"].text, got["b.txt"].text, got["c.docx"].paras) == ("é one\n", "café", ["first", "second"])
    assert "DOCX" in got["d.docx"].error_message and "Unsupported" in got["e.pdf"].error_message and got["a.txt"].error_message is None
    assert document_files.read(spark, str(tmp_path / "nowhere")).count() == 0


def test_document_stream_takes_late_files(spark, tmp_path):
    folder, log, out, state = (str(tmp_path / n) for n in ("in", "log", "out", "state"))
    os.mkdir(folder)

    def run():
        stream = document_files.stream(spark, folder, log, max_files=2)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(out).collect())

    for n in ("m", "n", "o"):
        open(f"{folder}/{n}.txt", "w").write(n)
    # One trigger may leave files to the next.
    while len(got := run()) < 3:
        pass
    assert got == ["m.txt", "n.txt", "o.txt"]
    open(f"{folder}/a.txt", "w").write("late, with an early name")
    assert run() == ["a.txt", "m.txt", "n.txt", "o.txt"]


@pytest.mark.parametrize("shared", [False, True])
def test_pruned_postings_are_exact(spark, tmp_path, shared):
    data, queries = corpus(5, 150), asked(6)
    q, c = FL.scope(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(data, CHUNKS), shared)
    P.build(c, str(tmp_path / "p"), head=2, block=4, buckets=8)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in P.search(spark, q, str(tmp_path / "p"), 4).collect()}
    assert got == expected(data, queries, 4, shared)


def test_pruned_postings_leave_blocks_alone(spark, tmp_path):
    # A rare word decides; the lists of frequent words are long.
    data = [(f"c{i:04d}", i, "u", "common words of every text " + ("needle " * 3 if i < 3 else f"w{i % 7}"), None) for i in range(900)]
    queries = [(1, "u", "needle common every", None)]
    q, c = FL.scope(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(data, CHUNKS), True)
    path = str(tmp_path / "p")
    P.build(c, path, head=8, block=8, buckets=8)
    read = P.blocks_read(spark, q, path, 2).first()
    assert read.opened < 0.2 * read.blocks
    want = [(r.chunk_id, round(r.raw_score, 6)) for r in R.bm25_search(q, c, 2, scoped=True).orderBy("rank").collect()]
    assert [(r.chunk_id, round(r.raw_score, 6)) for r in P.search(spark, q, path, 2).orderBy("rank").collect()] == want
    asked_ = P.asked_terms(spark, q, path)
    plan = asked_.join(spark.read.parquet(f"{path}/blocks"), ["scope", "term", "bucket"])._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_pruned_search_passes_no_pair(spark, tmp_path):
    """Scores come out of the cells complete: no pair of query and chunk is a row of a join or an aggregate. Copies add up."""
    data = corpus(5, 60) + [(r[0], r[1], r[2], f"{r[3]} {r[3]}", r[4]) for r in corpus(5, 60)[:20]]
    q, c = FL.scope(spark.createDataFrame(asked(6), QUERIES), spark.createDataFrame(data, CHUNKS), True)
    path = str(tmp_path / "p")
    P.build(c, path, head=2, block=4, buckets=8)
    got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.raw_score, 6)) for r in P.search(spark, q, path, 4).collect()}
    assert got == {(r.query_id, r["rank"]): (r.chunk_id, round(r.raw_score, 6)) for r in R.bm25_search(q, c, 4, scoped=True).collect()}
    plan = P._matched(spark, P.asked_terms(spark, q, path), path, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")
