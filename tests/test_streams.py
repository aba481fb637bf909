"""Streams over tables as they lie on disk."""

import pytest
from pyspark.sql import functions as F

from lectern.catalog import streaming_queries as SQ
from lectern.operators import documents as D
from lectern.streaming.runner import read_stream, run_available, run_batches


def test_stream_reads_a_table_of_one_file_and_one_of_many(spark, tmp_path):
    rows = spark.range(100).repartition(4)
    rows.write.parquet(f"{tmp_path}/many.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/raw")
    next((tmp_path / "raw").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    for name in ("one", "many"):
        out = run_available(read_stream(spark, str(tmp_path), name, rows.schema), name)
        assert sorted(r.id for r in out.collect()) == list(range(100)), name


@pytest.mark.parametrize("splits", [1, 9])
def test_batches_are_ranges_written_by_several_tasks(spark, splits):
    rows = spark.range(0, 3000, 1, splits).select("id", F.lit("x").alias("text"))
    seen = []

    def step(batch, batch_id):
        rows = batch.select("id", F.input_file_name().alias("file")).collect()
        seen.append((sorted(r.id for r in rows), len({r.file for r in rows})))

    run_batches(SQ.in_batches(rows, "ranges", "id"), "ranges-state", step)
    assert [r for ids, _ in seen for r in ids] == list(range(3000))
    assert [n for _, n in seen] == [-(-splits // SQ.BATCHES)] * SQ.BATCHES


def test_batches_with_empty_splits_stay_apart(spark):
    # One value fills the table, so that the last two ranges are empty.
    rows = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 9)], "at long, id long").repartition(9)
    seen = []
    run_batches(SQ.in_batches(rows, "few", "at"), "few-state", lambda batch, no: seen.append(sorted(r.at for r in batch.collect())))
    assert sum(seen, []) == [1] * 5 + [2] and not any({1, 2} <= set(s) for s in seen)


def test_python_chunks_leave_the_worker_in_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "_DOCUMENTS_AT_ONCE", 3)
    docs = spark.range(0, 10, 1, 1).select("id", F.concat_ws(" ", *[F.lit("One sentence here.")] * 60).alias("text"))
    got = D.chunk(docs, strategy="sentence_aware", size=100, overlap=0)
    want = D.split_text(docs.first().text, "sentence_aware", 100, 0)
    assert sorted((r.id, r.chunk_index, r.content) for r in got.collect()) == [(i, j, t) for i in range(10) for j, t in enumerate(want)]
