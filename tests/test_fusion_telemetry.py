import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.config import Budget
from lectern.functions import fixed_values as V
from lectern.operators import fusion as K
from lectern.operators import prompts as L
from lectern.operators import telemetry as N

COLS = "query_id int, caller_id string, source string, source_id string, priority int, score double, content string, owner_id string, turn_index int"


def fuse(spark, rows, budget):
    return {(r.query_id, r.source, r.source_id): (r.reason, r.position) for r in K.fuse(spark.createDataFrame(rows, COLS), budget).collect()}


def replay(rows, budget):
    out = {}
    for q in {r[0] for r in rows}:
        mine, seen, left = [r for r in rows if r[0] == q], set(), []
        rank = lambda r: (r[4], -(r[5] if r[5] is not None else -1.0), r[3])
        for r in sorted(mine, key=rank):
            key = " ".join(r[6].lower().split())
            if r[7] is not None and r[7] != r[1]:
                out[(q, r[2], r[3])] = "security_user_mismatch"
            elif key in seen:
                out[(q, r[2], r[3])] = "duplicate"
            elif budget.min_score and r[2] != "conversation" and r[5] is not None and r[5] < budget.min_score:
                out[(q, r[2], r[3])] = "below_relevance_threshold"
                seen.add(key)
            else:
                seen.add(key)
                left.append(r)
        total, used = 0, dict.fromkeys(K.SOURCES, 0)
        for r in left:
            cost, cap = -(-len(r[6]) // 4), budget.of(r[2])
            if cap is not None and used[r[2]] + cost > cap:
                out[(q, r[2], r[3])] = "source_token_budget"
            elif total + cost > budget.total:
                out[(q, r[2], r[3])] = "token_budget"
            else:
                out[(q, r[2], r[3])] = None
                total += cost
                used[r[2]] += cost
    return out


@pytest.mark.parametrize("budget", [
    Budget(60, 30, 20, None, 10, 0.2), Budget(100, None, 15, 15, 40), Budget(25), Budget(1000, 10, 10, 10, 10), Budget(12, 50, 50, 50, 50),
])
def test_equals_a_replay(spark, budget):
    rnd = random.Random(budget.total)
    rows = []
    for i in range(400):
        s = rnd.randrange(4)
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 60))).strip() or "x"
        owner = rnd.choice([None, None, "me", "you"]) if s in (1, 2) else None
        score = None if s == 1 else (float(i) if s == 3 else round(rnd.random(), 2))
        # One question holds most of the rows.
        rows.append((rnd.choice([1, 1, 1, 1, 2, 3]), "me", K.SOURCES[s], f"i{i}", 3 + s, score, text, owner, i if s == 3 else None))
    got = fuse(spark, rows, budget)
    assert {k: v[0] for k, v in got.items()} == replay(rows, budget)
    kept = sorted((k[0], v[1]) for k, v in got.items() if v[0] is None)
    assert kept == [(q, i) for q in (1, 2, 3) for i in range(1, 1 + sum(k == q for k, _ in kept))]


def test_literal_budgets(spark):
    two = [(1, "u", "rag", i, 3, s, c * 40, None, None) for i, s, c in (("a", 0.9, "x"), ("b", 0.8, "y"))]
    assert [r for r, _ in fuse(spark, two, Budget(15)).values()] == [None, "token_budget"]
    got = fuse(spark, [*two, (1, "u", "cag", "c", 4, None, "z" * 40, None, None)], Budget(100, rag=12))
    assert {k[2]: v[0] for k, v in got.items()} == {"a": None, "b": "source_token_budget", "c": None}
    same = [(1, "u", s, s, V.PRIORITY[s], 0.5, "The  Claim", None, 0) for s in K.SOURCES]
    assert {k[1]: v[0] for k, v in fuse(spark, same, Budget()).items()} == {"rag": None, "cag": "duplicate", "mag": "duplicate", "conversation": "duplicate"}
    turns = [(1, "u", "conversation", f"conv_{i}_user", 6, float(i), f"turn {i} " + "t" * 29, None, i) for i in range(3)]
    df = K.fuse(spark.createDataFrame(turns, COLS), Budget(18))
    assert [t.turn_index for t in K.bundle(df).first().conversation] == [1, 2]
    m = K.fusion_metrics(df, Budget(18)).first()
    assert (m.total_items, m.dropped_items, m.estimated_tokens, m.context_count, m.selected_sources) == (3, 1, 18, 0, ["conversation"])


def test_empty_content_costs_nothing(spark):
    rows = [
        (1, "u", "cag", "a", 1, 0.9, "", None, None), (1, "u", "cag", "b", 1, 0.8, "x" * 40, None, None),
        (2, "u", "cag", "c", 1, 0.9, "", None, None),
    ]
    for budget in (Budget(), Budget(total=5)):
        assert {k: v[0] for k, v in fuse(spark, rows, budget).items()} == {
            k: v for k, v in replay(rows, budget).items()
        }


def test_normalize(spark):
    callers = spark.createDataFrame([(1, "u")], "query_id int, caller_id string")
    talk = spark.createDataFrame([(1, [("user", "hi"), ("assistant", " "), ("user", "bye")])], "query_id int, history array<struct<role:string,content:string>>")
    rag = spark.createDataFrame([(1, "c1", 0.5, "text", "u"), (1, "c2", 0.5, " ", "u")], "query_id int, chunk_id string, score double, content string, owner_id string")
    got = {(r.source, r.source_id, r.score) for r in K.normalize_contexts(callers, rag, conversation=talk).collect()}
    assert got == {("rag", "c1", 0.5), ("conversation", "conv_0_user", 0.0), ("conversation", "conv_2_user", 2.0)}


RESULTS = "query_id int, chunk_id string, rank int, doc_id int, filename string, page_number int, chunk_index int, content string, score double"


def test_context_text(spark):
    rows = [(1, "a", 1, 1, "f.txt", 3, 0, "alpha", 0.92), (1, "a", 2, 1, "f.txt", 3, 0, "alpha", 0.9), (1, "b", 3, 1, None, None, 1, "b" * 300, 0.88)]
    r, q = spark.createDataFrame(rows, RESULTS), spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {x.query_id: x for x in L.build_context(q, r).collect()}
    assert got[1].context.startswith("[Source 1]\nDocument: f.txt\nPage: 3\nContent:\nalpha\n\n---\n\n[Source 3]\nDocument: Unknown Document\nPage: N/A\n")
    assert got[1].chunk_ids == ["a", "b"] and got[2].context == V.NO_CONTEXT and got[2].chunk_ids == []
    cites = L.citations(r).orderBy("rank").collect()
    assert [c["rank"] for c in cites] == [1, 3] and cites[1].preview == "b" * 250 + "..."
    assert L.context_blocks(r, 60).count() == 1 and L.context_blocks(r, 1).count() == 1


def test_prompt(spark):
    row = [(1, "Q?", "CTX", [("user", "a"), ("assistant", "b")], [("id", None, "cached")], [])]
    schema = "query_id int, text string, context string, history array<struct<role:string,content:string>>, cached array<struct<cache_id:string,version:string,content:string>>, memories array<struct<memory_type:string,content:string>>"
    p = L.build_prompts(spark.createDataFrame(row, schema)).first().prompt
    assert p == (
        "CONVERSATION HISTORY:\nUser: a\nAssistant: b\n\nDOCUMENT CONTEXT:\n---------------------\nCTX\n---------------------\n\n"
        "CACHED KNOWLEDGE CONTEXT:\n---------------------\n[Cached Knowledge 1] (ID: id, Version: 1)\ncached\n---------------------\n\n"
        "USER QUESTION: Q?\n\nGROUNDED ANSWER (with [Source X] citations):"
    )
    assert spark.range(1).select(L.system_prompt("S", "more")).first()[0] == "S\nAdditional Guidelines:\nmore"


def test_statistics(spark):
    cols = [c for _, c, _ in N.STAGE_COLUMNS]
    flags = ["routing_enabled", "rag_selected", "cag_selected", "mag_selected"]
    df = spark.createDataFrame([(float(v),) for v in (100, 200, 300)], "v double")
    df = df.select(*[F.col("v").alias(c) for c in cols], *[F.lit(f == "rag_selected").alias(f) for f in flags])
    got = {r.stage: (r["count"], r.min_ms, r.max_ms, r.avg_ms) for r in N.pipeline_latencies(df).collect()}
    assert got["request"] == got["rag"] == (3, 100.0, 300.0, 200.0) and got["mag"] == (0, None, None, 0.0)
    m = spark.createDataFrame([(True, True), (False, True), (False, True), (False, False)], "cag_cache_hit boolean, cag_cache_miss boolean")
    assert tuple(N.hit_rate(m).first()) == (1, 2, 0.3333)


def test_redaction_of_nested_payloads(spark):
    df = spark.sql("SELECT named_struct('user_token', 'x', 'ok', array(named_struct('Password', 'y', 'n', 1)), 'm', map('api_key', 'z', 'b', 'c')) AS p")
    p = N.redact_struct(df, "p").first().p
    assert (p.user_token, p.ok[0].Password, p.ok[0].n, p.m) == ("[REDACTED]", "[REDACTED]", 1, {"api_key": "[REDACTED]", "b": "c"})


def test_redaction_at_any_depth(spark):
    deep = '{"a": ' * 60 + '{"api_key": [1, {"x": 2}]}' + "}" * 60
    texts = [
        '{"level1": [{"token": "t", "id": "123"}, {"nested_auth": {"bearer": {"b": 1}}}]}', deep, '[{"User_Password": null}, 1.5, "secret in a text"]',
        '{"pass\\u0077ord": "hidden"}', '{"plain": [1, {"k": "v"}]}', '{"token": "cut', None, "", '"token"', "[" * 5000 + '"secret"' + "]" * 5000,
    ]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(N.redact_text("t"), "i").orderBy("i").collect()]
    assert json.loads(got[0]) == {"level1": [{"token": "[REDACTED]", "id": "123"}, {"nested_auth": {"bearer": "[REDACTED]"}}]}
    assert got[1].count("[REDACTED]") == 1 and '"x"' not in got[1] and json.loads(got[1])
    assert json.loads(got[2]) == [{"User_Password": "[REDACTED]"}, 1.5, "secret in a text"]
    assert json.loads(got[3]) == {"password": "[REDACTED]"} and got[4] == texts[4]
    assert got[5] == "[REDACTED]" and got[6] is None and got[7] == "" and got[8] == '"token"' and got[9] in (texts[9], "[REDACTED]")
    flat = spark.createDataFrame([('{"k": 1, "n": {"secret": "s", "o": [{"token": 1}]}, "Api_Key": "z"}',)], "t string").select(N.redact_json("t").alias("m")).first().m
    assert flat["k"] == "1" and flat["Api_Key"] == "[REDACTED]" and json.loads(flat["n"]) == {"secret": "[REDACTED]", "o": [{"token": "[REDACTED]"}]}


def test_redaction_of_typed_maps(spark):
    df = spark.sql("SELECT map('password', 5, 'n', 7) AS a, map('x', named_struct('secret', 's', 'o', 1), 'token', named_struct('secret', 't', 'o', 2)) AS b")
    row = N.redact_struct(N.redact_struct(df, "a"), "b").first()
    assert row.a == {"password": "[REDACTED]", "n": "7"}
    assert row.b == {"x": '{"secret":"[REDACTED]","o":1}', "token": "[REDACTED]"}


def test_paging(spark):
    logs = spark.range(30).select(F.col("id").alias("log_id"), F.lit("u").alias("user_id"), F.when(F.col("id") % 2 == 0, "hybrid").otherwise("none").alias("retrieval_method"), F.col("id").alias("created_at"))
    rows, total = N.audit_log(logs, "u", "hybrid", 2, 3)
    assert [r.log_id for r in rows.collect()] == [24, 22, 20] and total.first().total == 15
