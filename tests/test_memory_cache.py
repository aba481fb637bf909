import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import cache as C
from lectern.operators import memory as M
from lectern.sources import tables as TB

T0 = datetime(2024, 1, 1)
NOW = lambda: F.lit("2024-01-10 00:00:00").cast("timestamp")


def extract(spark, *texts):
    m = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in M.extract_memories(m, NOW()).orderBy("id", "rule_no").collect():
        out[r.id].append((r.memory_type, r.content, r.importance, r.expires_at))
    return [out[i] for i in range(len(texts))]


def test_rules(spark):
    pref, ins, rem, temp, many = extract(
        spark, "I prefer Python over JavaScript for the backend.", "Always respond in bullet points with concise explanations.",
        "Remember that our production deployment uses Kubernetes on port 8080.", "Right now debugging login. More",
        "We're building a search engine!\nOur stack uses Spark.",
    )
    assert pref == [("preference", "User prefers Python over JavaScript for the backend", 0.85, None)]
    assert ins == [("instruction", "User instruction: Always respond in bullet points with concise explanations.", 0.9, None)]
    assert rem == [("project_context", "Remembered: our production deployment uses Kubernetes on port 8080.", 0.95, None)]
    assert temp == [("temporary_context", "User is currently focused on login. More", 0.6, datetime(2024, 1, 17))]
    assert [m[1] for m in many] == ["User is building a search engine", "User project tech stack: Spark"]


def test_gate(spark):
    quiet = ["ok", "thanks", "hello there", "sure, got it", "i prefer password = hunter2", "remember sk-" + "a" * 24, "I prefer Bearer " + "x" * 24]
    assert all(found == [] for found in extract(spark, *quiet))


def resolve(rows):
    """Arrivals one by one over the newest twenty live rows."""
    table = []
    for mid, user, kind, content, expires, at in rows:
        own = sorted((m for m in table if m["user"] == user and m["kind"] == kind and (m["expires"] is None or m["expires"] > at)), key=lambda m: m["no"])[::-1][:20]
        group = next((p for p in ("user prefers", "user instruction") if content.lower().startswith(p)), None)
        hit = next((m for m in own if group and m["content"].lower().startswith(group)), None)
        if hit:
            hit.update(content=content, expires=expires or hit["expires"], updated=at)
        else:
            table.append(dict(id=mid, user=user, kind=kind, content=content, expires=expires, updated=at, no=len(table)))
    return {m["id"]: (m["content"], m["expires"], m["updated"]) for m in table}


@pytest.mark.parametrize("seed,n,expiring", [(1, 60, False), (2, 300, False), (3, 300, True), (4, 12, True)])
def test_conflicts_equal_a_replay(spark, seed, n, expiring):
    rnd = random.Random(seed)
    kinds = {"preference": ["User prefers {}"], "instruction": ["Remembered: {}", "Remembered: {}", "Remembered: {}", "User instruction: Always use {}"], "project_context": ["User is building {}", "User prefers {}"]}
    rows = []
    for i in range(n):
        kind = rnd.choice(list(kinds))
        at = T0 + timedelta(minutes=i)
        expires = at + timedelta(minutes=rnd.randint(1, 80)) if expiring and rnd.random() < 0.3 else None
        # Most arrivals belong to one user.
        rows.append((f"m{i:04d}", rnd.choice("aaab"), kind, rnd.choice(kinds[kind]).format(i), expires, at))
    df = spark.createDataFrame(rows, "memory_id string, user_id string, memory_type string, content string, expires_at timestamp, created_at timestamp")
    df = df.select("memory_id", "user_id", "memory_type", "content", F.lit(0.5).alias("importance"), F.create_map(F.lit("s"), F.lit("t")).alias("metadata"), "expires_at", "created_at", F.col("created_at").alias("updated_at"))
    got = {r.memory_id: (r.content, r.expires_at, r.updated_at) for r in M.apply_memories(df.limit(0), df).collect()}
    assert got == resolve(rows)


def memories(spark, rows):
    cols = "memory_id string, user_id string, memory_type string, content string, importance double, expires_at timestamp, created_at timestamp"
    return spark.createDataFrame(rows, cols).withColumn("updated_at", F.col("created_at"))


def test_ranking(spark):
    now = datetime(2024, 1, 10)
    m = memories(spark, [
        ("a", "u", "preference", "FastAPI backend", 0.5, None, now), ("b", "u", "preference", "FastAPI backend", 0.95, None, now),
        ("c", "u", "instruction", "be concise", 0.9, None, now), ("d", "u", "preference", "FastAPI", 1.0, now, now),
        ("e", "v", "preference", "FastAPI", 1.0, None, now), ("f", "u", "preference", "unrelated", 1.0, None, now),
    ])
    q = spark.createDataFrame([(1, "u", "FastAPI"), (2, "w", "FastAPI")], "query_id int, user_id string, text string")
    got = M.memory_search(q, m, NOW()).orderBy("rank").collect()
    assert [(r.query_id, r.memory_id) for r in got] == [(1, "b"), (1, "a"), (1, "c")]
    assert got[0].score == pytest.approx(0.6 + 0.2375 + 0.15) and got[2].relevance == 0.4


def test_recency(spark):
    ages = [timedelta(hours=1), timedelta(days=20), timedelta(days=90), timedelta(days=-1)]
    df = spark.createDataFrame([(datetime(2024, 1, 10) - a,) for a in ages], "t timestamp")
    assert [round(r[0], 5) for r in df.select(M.recency("t", NOW())).collect()] == [0.99875, 0.4, 0.1, 1.0]


ENTRY = "namespace string, identifier string, content string, user_id string, metadata map<string,string>, version int, ttl_seconds long"


def entries(spark):
    rows = [
        ("Policy", " Leave ", "global text", None, {"a": "1"}, 1, None), ("policy", "mine", "own text", "A", {}, 1, None),
        ("policy", "old", "expired", None, {}, 1, 60),
    ]
    return C.make_entries(spark.createDataFrame(rows, ENTRY), F.lit("2024-01-01").cast("timestamp"))


def test_cache_isolation_and_keys(spark, tmp_path):
    e = entries(spark)
    assert {r.key: r.cache_id for r in e.collect()} == {"policy:leave": "cag_policy_leave", "policy:A:mine": "cag_policy_A_mine", "policy:old": "cag_policy_old"}
    looks = spark.createDataFrame([(1, "A", "policy:A:mine"), (2, "B", "policy:A:mine"), (3, "B", "policy:leave"), (4, "A", "policy:old"), (5, "A", "none")], "query_id int, user_id string, cache_key string")
    assert {r.query_id: r.hit for r in C.cache_access(looks, e, NOW()).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    req = spark.createDataFrame([("policy:A:mine", "B"), ("policy:leave", "B")], "key string, caller_id string")
    assert {r.key for r in C.cache_invalidate(e, req).collect()} == {"policy:A:mine", "policy:old"}
    assert {r.key for r in C.cache_list(e, NOW(), "B").collect()} == {"policy:leave"}
    assert {r.key for r in C.cache_list(e, NOW(), None, scope="all").collect()} == {"policy:leave", "policy:A:mine"}
    TB.save_cache(e, str(tmp_path / "c"))
    rows = lambda d: {r.key: r.asDict() for r in d.collect()}
    assert rows(TB.load_cache(spark, str(tmp_path / "c"))) == rows(e)


def test_cache_refresh(spark):
    up = spark.createDataFrame([("policy:leave", "new", "B", {"a": "2", "b": "3"}), ("policy:A:mine", "hack", "B", None)], "key string, new_content string, caller_id string, new_metadata map<string,string>")
    got = {r.key: (r.content, r.version, r.metadata) for r in C.cache_refresh(entries(spark), up, NOW()).collect()}
    assert got["policy:leave"] == ("new", 2, {"a": "2", "b": "3"}) and got["policy:A:mine"][:2] == ("own text", 1)


def test_domains(spark):
    d = spark.createDataFrame([(1, "leave", "policy:leave", None), (2, "ave", "policy:leave", None), (3, "mine", "policy:A:mine", "A")], "seq int, keyword string, cache_key string, user_id string")
    q = spark.createDataFrame([(1, "A", "Is LEAVE mine?"), (2, "B", "Is mine?"), (3, "B", "Calculate 2 + 2"), (4, "B", "security overview")], "query_id int, user_id string, text string")
    assert {(r.query_id, r.cache_key, r.seq) for r in C.resolve_keys(q, d).collect()} == {(1, "policy:leave", 1), (1, "policy:A:mine", 3)}
    assert {r.query_id: r.eligible for r in C.is_eligible(q, d).collect()} == {1: True, 2: True, 3: False, 4: True}
    empty = spark.createDataFrame([(9, "", "k", None)], d.schema)
    assert C.match_domains(q, d.unionByName(empty).withColumnRenamed("user_id", "o")).where("keyword = ''").count() == 4
    found = C.cache_search(q, d, entries(spark), NOW(), max_chars=6).collect()
    assert {(r.query_id, r.cache_id) for r in found} == {(1, "cag_policy_leave"), (1, "cag_policy_A_mine")}
    assert all(r.content.endswith("size limit]") and r.metadata["namespace"].lower() == "policy" for r in found)
    plan = C.match_domains(q, d.withColumnRenamed("user_id", "o"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_conflicts_across_slices(spark, seed):
    """One user holds nearly everything, so its arrivals are cut into several slices of time."""
    rnd = random.Random(seed)
    texts = ["Remembered: {}"] * (2 + 5 * (seed % 3)) + ["User instruction: Always use {}", "User prefers {}"]
    rows = [
        (f"m{i:05d}", rnd.choice("aaaaaaab"), "instruction", rnd.choice(texts).format(i), None, T0 + timedelta(minutes=i))
        for i in range(1200)
    ]
    df = spark.createDataFrame(rows, "memory_id string, user_id string, memory_type string, content string, expires_at timestamp, created_at timestamp")
    df = df.select("memory_id", "user_id", "memory_type", "content", F.lit(0.5).alias("importance"), F.create_map(F.lit("s"), F.lit("t")).alias("metadata"), "expires_at", "created_at", F.col("created_at").alias("updated_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = df.select("user_id", "memory_type", F.lit(None).cast("string").alias("klass"), "memory_id", F.col("created_at").alias("at"), F.lit(True).alias("is_new"))
        assert cut.repartitionByRange("user_id", "memory_type", "is_new", "at", "memory_id").withColumn("s", F.spark_partition_id()).where("user_id = 'a'").select("s").distinct().count() > 1
        got = {r.memory_id: (r.content, r.expires_at, r.updated_at) for r in M.apply_memories(df.limit(0), df).collect()}
        assert got == resolve(rows)
        # The same when the first half is already stored.
        first = M.apply_memories(df.limit(0), df.where("memory_id < 'm00600'"))
        second = M.apply_memories(first, df.where("memory_id >= 'm00600'"))
        again = {r.memory_id: (r.content, r.expires_at, r.updated_at) for r in second.collect()}
        assert again == got
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
