"""Registered queries: names, twins, and a comparison with DuckDB on the smallest tables."""

import os
import sys

import pytest

from tests.conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from lectern import catalog  # noqa: E402

FAST = [
    "clean_documents", "tokenize_documents", "chunk_documents", "text_measures", "vector_topk", "guard_input", "query_signals",
    "context_plans", "extracted_memories", "cache_lookup", "fused_contexts", "stage_latencies", "latency_percentiles", "audit_log_page",
    "stream_counters",
]
NO_TWIN = {"chunk_sentences", "chunk_paragraphs", "embed_chunks", "vector_neighbours_lsh", "answer_contexts"}


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == NO_TWIN
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", catalog.QUERIES if os.environ.get("ALL_QUERIES") else FAST)
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES, bag

    if name not in entry.oracle_sql():
        assert entry.queries()[name](spark, SF).count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(names, cur.fetchall())
