"""Conversation repair against a search over all edits, on odd rows, with chunks of every size."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(*r[2:])))
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = text.strip(BLANK)
        faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))

    @functools.cache
    def best(i, done, left):
        """Least (cost, audit, roles) from row ``i`` after the initials ``done`` (their last and whether any), with ``left`` inserts."""
        out = []
        if i == len(rows) and done in ("", "a"):
            out.append((0, "", ()))
        for role in ("user", "assistant"):
            if left and fits(done, role[0]):
                c, a, r = best(i, role[0], left - 1)
                out.append((3 + c, "I" + a, (f"{role}:", *r)))
        if i < len(rows):
            role, text, f = rows[i][2], rows[i][3], faults[i]
            c, a, r = best(i + 1, done, 3)
            out.append((4 + c, "D" + a, r))
            if f not in (1, 2):
                late = 3 if f == 3 else 0
                for edit, price, new in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if fits(done, new[:1]):
                        c, a, r = best(i + 1, new[0], 3)
                        out.append((price + late + c, edit + a, (f"{new}:{text}", *r)))
        return min(out, default=(10**9, "", ()))

    def fits(done, new):
        return new != "" and done + new in ("s", "u", "su", "ua", "au")

    cost, audit, left = best(0, "", 3)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def make(n, seed, longest):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uber"]
    texts = ["Yes.", "No!", "why?", "cut off", " ", "", None, " ", "é.", "Yes. \n", "x" * 5000 + "."]
    rows = []
    for conv in [*range(n), None]:
        for at in range(rnd.randint(1, longest)):
            turn = rnd.choice([at, at, at, at + 5, None, rnd.randint(0, 30)])
            role = rnd.choice(roles) if rnd.random() < 0.4 else ("user", "assistant")[at % 2]
            rows.append((conv, turn, role, rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.randint(0, 9)}."))
    return rows


def plain_all(rows):
    kept = damaged(rows)
    return sorted((plain(c, [r for r in kept if r[0] == c]) for c in {r[0] for r in rows}), key=str)


@pytest.mark.parametrize("size", [3, 256])
def test_repair(spark, size):
    rows = make(60, 4, 25)
    # A conversation that is dropped as a whole.
    rows.append((next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0), 0, "user", "x."))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("state", F.lit("clash")).repartition(3)
    got = repair.repair(repair.damage(df), df.select(F.col("conv_id").alias("conv")), size).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_all(rows)


def test_long_runs_that_settle_late(spark):
    # Roles that let vectors through: blank rows, and rows that flip what is needed.
    rows = [(1, i, "system", f"s{i}.") for i in range(90)] + [(2, i, "user", " ") for i in range(60)] + [(2, 60, "user", "a."), (2, 61, "assistant", "b.")]
    rows += [(3, i, "user", f"{i // 40}.") for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((plain(c, [r for r in rows if r[0] == c]) for c in (1, 2, 3)), key=str)
    d = df.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    got = repair.repair(d, d.select("conv"), 2).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert queries.op11_repair(spark, str(tmp_path / "none")).collect() == []
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_repair(spark, "/root/testdata/sf0.001")
    assert got.columns == ["conv_id", *repair.RESULT[1:]]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_all(rows)
