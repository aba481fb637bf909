"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A conversation's rows, in order, are kept, re-roled or deleted, and empty turns are inserted, at the least cost, so that
the initials of its roles read ``(s?(ua)+)?``. Four states tell what may come next: nothing yet, after ``s``, after ``u``,
after ``a``. As costs to the end differ by few amounts only, there are few vectors of them up to a constant (``CLASSES``).

1. Rows are numbered by a range sort (no window over a conversation) and reduced to one byte each; ``CHUNK`` of them are a
   chunk, so a conversation of any length is many rows.
2. Every chunk runs backward from a speculative vector, that of a conversation's end. In fix-up passes a chunk runs again
   from each vector its right neighbour came out with, unless that differs from one already run by a constant only. Most
   settle at once; where rows let vectors through unchanged, the last pass runs every chunk from all that are left.
3. The chunks' maps between vectors are stitched to the true vectors by doubling joins.
4. With these backward costs each chunk traces the least audit from each state it may be entered in: at every step the
   first edit in ASCII order that keeps the cost. An edit and a state leave one next state, so this is the least text.
5. Rows and traces of a conversation meet in order in one pass that holds a few numbers, and hashes what is left.

The hash and the audit of a conversation are one value each, so the last pass (alone) reads a conversation in one task,
row by row.

Results: a null role or text is one space, as is a null in the text whose CRC chooses the damage; null turns come first;
rows of one turn are in the order of role and text digest. A null id is a conversation. Roles count by their first
character; an empty role has none and cannot be kept. Repeated rows are duplicates. An empty table gives an empty one.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import numbered
from lectern.operators.sizing import cut_lineage, written

CHUNK = 256
PASSES = 6
SOLID = r"[^\x20\x09-\x0D]"
RANGE_COST = 1 << 20
# Costs of the edits; a kept truncated row costs as much as ``TRUNCATED``.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
EDITS = "DIKR"
FAULTS = ("", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. ``GIVEN`` is the state that a new or re-roled row leads to.
GIVEN = np.array([2, 2, 3, 2])
ROLE_GIVEN = ("user", "user", "assistant", "user")
# State after keeping an initial (s, u, a, any other), -1 where it may not stand.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
ENDS = np.array([0, RANGE_COST, RANGE_COST, 0])


# --- costs ---------------------------------------------------------------------------------------
def _with_inserts(v: np.ndarray) -> np.ndarray:
    for _ in range(3):
        v = np.minimum(v, INSERT + v[..., GIVEN])
    return v


def _row_costs() -> np.ndarray:
    """``[code, state, edit]`` costs of deleting, keeping and re-roling a row; a code is a byte of :func:`code`."""
    out = np.full((16, 4, 3), RANGE_COST, dtype=np.int64)
    for c in range(16):
        forced, late = c >> 3 & 1, (c >> 2 & 1) * TRUNCATED
        out[c, :, 0] = DELETE
        if not forced:
            out[c, :, 1] = np.where(KEPT[c & 3] >= 0, KEEP + late, RANGE_COST)
            out[c, :, 2] = REROLE + late
    return out


ROW_COSTS = _row_costs()


def back(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs before a row of each code, given those after it; arrays of ``(rows, 4)``."""
    costs = ROW_COSTS[codes & 15]
    kept = np.maximum(KEPT[codes & 3], 0)
    open_ = np.minimum(costs[:, :, 0] + after, costs[:, :, 1] + np.take_along_axis(after, kept, axis=1))
    return _with_inserts(np.minimum(open_, costs[:, :, 2] + after[:, GIVEN]))


def _classes() -> list[tuple[int, ...]]:
    """All vectors of costs, up to a constant, that any rows can lead to; the first is that of an end."""
    found = [tuple(int(x) for x in _with_inserts(ENDS))]
    codes = np.arange(16)
    for v in found:
        for new in back(codes, np.tile(v, (16, 1))):
            new = tuple(int(x) for x in new - new.min())
            if new not in found:
                found.append(new)
    return found


CLASSES = _classes()
_VECTORS = np.array(CLASSES)
_NUMBER = {v: i for i, v in enumerate(CLASSES)}


def class_of(v: np.ndarray) -> int:
    return _NUMBER[tuple((v - v.min()).tolist())]


# --- chunks --------------------------------------------------------------------------------------
def _grid(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of chunks as a matrix, filled up with zeros, and their lengths."""
    n = np.array([len(c) for c in chunks])
    grid = np.zeros((len(chunks), int(n.max())), np.int64)
    for i, c in enumerate(chunks):
        grid[i, : len(c)] = np.frombuffer(c, np.uint8)
    return grid, n


def maps(chunks: list[bytes], starts: np.ndarray) -> np.ndarray:
    """Class before each chunk for the class after it."""
    grid, n = _grid(chunks)
    v = _VECTORS[starts].copy()
    for at in range(grid.shape[1] - 1, -1, -1):
        live = np.flatnonzero(n > at)
        new = back(grid[live, at], v[live])
        v[live] = new - new.min(axis=1, keepdims=True)
    return np.array([class_of(x) for x in v])


def trace(codes: bytes, after: int) -> list[bytes]:
    """Least edits of a chunk for each state it is entered in; a byte is ``inserts << 2 | edit`` (0 delete, 1 keep, 2 re-role)."""
    row = np.frombuffer(codes, np.uint8).astype(np.int64)
    costs = np.zeros((len(row) + 1, 4), np.int64)
    costs[-1] = _VECTORS[after]
    for i in range(len(row) - 1, -1, -1):
        costs[i] = back(row[i : i + 1], costs[i + 1 : i + 2])[0]
    cost, price, out = costs.tolist(), ROW_COSTS.tolist(), []
    for state in range(4):
        edits = bytearray()
        for i, c in enumerate(row.tolist()):
            inserts, own = 0, price[c & 15]
            while True:
                now = cost[i][state]
                if own[state][0] + cost[i + 1][state] == now:
                    edits.append(inserts << 2)
                    break
                if INSERT + cost[i][GIVEN[state]] == now:
                    inserts, state = inserts + 1, int(GIVEN[state])
                    continue
                kept = int(KEPT[c & 3][state])
                if kept >= 0 and own[state][1] + cost[i + 1][kept] == now:
                    edits.append(inserts << 2 | 1)
                    state = kept
                else:
                    edits.append(inserts << 2 | 2)
                    state = int(GIVEN[state])
                break
        out.append(bytes(edits))
    return out


def _run(batches):
    for pdf in batches:
        todo = pdf.explode("todo", ignore_index=True)
        codes, starts = todo["codes"].tolist(), todo["todo"].to_numpy(dtype=np.int64)
        order = np.argsort([len(c) for c in codes], kind="stable")
        got = np.empty(len(codes), np.int64)
        # Chunks of like length together, so that few are filled up.
        for i in range(0, len(order), 4096):
            part = order[i : i + 4096]
            got[part] = maps([codes[j] for j in part], starts[part])
        todo["before"] = got
        yield todo[["conv", "chunk", "todo", "before"]].astype({"conv": "Int64", "todo": "int64"})


def _trace(batches):
    for pdf in batches:
        memo, out = {}, []
        for codes, after in zip(pdf["codes"], pdf["after"]):
            key = (bytes(codes), int(after))
            out.append(memo.get(key) or memo.setdefault(key, trace(*key)))
        pdf["trace"] = out
        yield pdf[["conv", "chunk", "trace"]].astype({"conv": "Int64"})


def settled(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """``conv, chunk, codes, after``: chunks ``(conv, chunk, codes, last)`` with the class of the true costs after them."""
    key, kind = ["conv", "chunk"], "conv long, chunk long, todo int, before int"
    lone, many = chunks.where("last = 0"), chunks.where("last > 0")
    todo, known = many.withColumn("todo", F.array(F.lit(0))), None
    for number in range(1, passes + 2):
        new = written(todo.select(*key, "codes", "todo").mapInPandas(_run, kind))
        if new.isEmpty():
            break
        known = new if known is None else written(known.unionByName(new))
        # What the right neighbour came out with, and all vectors in the last pass.
        table = known.groupBy(*key).agg(F.collect_set("todo").alias("done"), F.collect_set("before").alias("out"))
        near = table.select(F.col("conv").alias("_conv"), (F.col("chunk") - 1).alias("_chunk"), F.col("out").alias("_out"))
        met = many.join(table, _same(many, table)).select(many["*"], "done")
        met = met.join(near, met["conv"].eqNullSafe(near["_conv"]) & (met["chunk"] == near["_chunk"]), "left")
        wanted = F.array_except("_out", "done")
        todo = met.where(F.size(wanted) > 0).select(*key, "codes", wanted.alias("todo"))
        if number == passes and not todo.isEmpty():
            left = F.array_except(F.array(*[F.lit(i) for i in range(len(CLASSES))]), "done")
            todo = met.select(*key, "codes", left.alias("todo")).where(F.size("todo") > 0)
    if known is None:
        return lone.select(*key, "codes", F.lit(0).alias("after"))
    # Doubling: ``g`` maps the class after a stretch of chunks to the class before it.
    g = known.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("todo", "before"))).alias("g"))
    g, step, most = written(g), 1, many.agg(F.max("last")).first()[0]
    while step <= most:
        right = g.select(F.col("conv").alias("_conv"), (F.col("chunk") - step).alias("_chunk"), F.col("g").alias("_g"))
        g = g.join(right, g["conv"].eqNullSafe(right["_conv"]) & (g["chunk"] == right["_chunk"]), "left")
        g = written(g.select(*key, F.when(F.col("_g").isNull(), F.col("g")).otherwise(F.transform_values("_g", lambda k, v: F.try_element_at("g", v))).alias("g")))
        step *= 2
    before = g.select(F.col("conv").alias("_conv"), (F.col("chunk") - 1).alias("_chunk"), F.try_element_at("g", F.lit(0)).alias("_after"))
    met = many.join(before, many["conv"].eqNullSafe(before["_conv"]) & (many["chunk"] == before["_chunk"]), "left")
    out = met.select(*key, "codes", F.coalesce("_after", F.lit(0)).alias("after"))
    return out.unionByName(lone.select(*key, "codes", F.lit(0).alias("after")))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv"].eqNullSafe(b["conv"]) & (a["chunk"] == b["chunk"])


# --- rows ----------------------------------------------------------------------------------------
def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` of the damaged rows: dropped, emptied, truncated, repeated or re-roled by a CRC."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(key), F.lit(":"), blank(turn))) % 20
    d = rows.select(F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind"))
    return d.where("kind <> 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``conv, chunk, codes, last, first`` of rows ``(conv, turn, role, text)``; ``first`` are the sort keys of its first row."""
    end = F.regexp_extract("text", rf"({SOLID})[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    narrow = cut_lineage(rows.select(
        "conv", "turn", "role", _digest().alias("digest"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"),
    ))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = cut_lineage(numbered(narrow, "conv", order))
    again = placed.groupBy("conv", "digest").agg(F.min("node").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = again.select(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), "_first")
    d = placed.join(again, placed["conv"].eqNullSafe(again["_conv"]) & (placed["digest"] == again["_digest"]), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("node") > F.col("_first"), 2).when(F.col("truncated"), 3).otherwise(0)
    d = d.withColumn("fault", fault)
    # Initial, truncated, forced, then the fault.
    code = F.col("initial") + F.when(F.col("fault") == 3, 4).otherwise(0) + F.when(F.col("fault").isin(1, 2), 8).otherwise(0) + F.col("fault") * 16
    d = d.select("conv", F.floor(F.col("node") / size).cast("long").alias("chunk"), "node", F.lpad(F.hex(code), 2, "0").alias("code"), F.struct("node", "turn", "role", "digest").alias("spot"))
    codes = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "code"))), lambda x: x["code"]), ""))
    d = d.groupBy("conv", "chunk").agg(codes.alias("codes"), F.min("spot").alias("first"))
    last = d.groupBy("conv").agg(F.max("chunk").alias("last")).select(F.col("conv").alias("_conv"), "last")
    return cut_lineage(d.join(last, d["conv"].eqNullSafe(last["_conv"])).drop("_conv"))


class _Conversation:
    """What one pass over the ordered rows of a conversation keeps."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit = conv, 0, 0, []
        self.hash, self.first, self.faults, self.illegal, self.last = hashlib.sha256(), True, [0] * 4, 0, None
        self.low = self.high = None
        self.turns, self.traces, self.rows = 0, deque(), 0
        self.codes = self.edits = b""
        self.at = 0

    def _add(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + role.encode() + b":" + text.encode("utf-8", "surrogatepass"))
        self.first = False

    def _insert(self) -> None:
        self.audit.append("I")
        self.cost += INSERT
        self._add(ROLE_GIVEN[self.state], "")
        self.state = int(GIVEN[self.state])

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        initial = role[:1]
        self.illegal += self.rows > 0 and self.last + initial not in LEGAL
        self.last, self.rows = initial, self.rows + 1
        if self.at == len(self.codes):
            self.codes, traces = self.traces.popleft()
            self.edits, self.at = traces[self.state], 0
        code, edit = self.codes[self.at], self.edits[self.at]
        self.at += 1
        self.faults[code >> 4] += 1
        for _ in range(edit >> 2):
            self._insert()
        late = TRUNCATED if code & 4 else 0
        if edit & 3 == 0:
            self.audit.append("D")
            self.cost += DELETE
        elif edit & 3 == 1:
            self.audit.append("K")
            self.cost += KEEP + late
            self._add(role, text)
            self.state = int(KEPT[code & 3][self.state])
        else:
            self.audit.append("R")
            self.cost += REROLE + late
            self._add(ROLE_GIVEN[self.state], text)
            self.state = int(GIVEN[self.state])

    def result(self) -> tuple:
        while self.state in (1, 2):
            self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _finish(batches):
    """Marks, traces and rows of whole conversations, in order."""
    held, out = None, []

    def frame(rows):
        pdf = pd.DataFrame(rows, columns=RESULT)
        return pdf.astype({c: "Int64" for c in RESULT[:7]})

    for batch in batches:
        for r in batch.to_pylist():
            if r["part"] == 0:
                if held is not None:
                    out.append(held.result())
                held = _Conversation(r["conv"])
            elif r["part"] == 1:
                held.traces.append((r["codes"], r["trace"]))
            else:
                held.row(r["turn"], r["role"], r["text"])
        if len(out) > 10_000:
            yield _batch(frame(out))
            out = []
    if held is not None:
        out.append(held.result())
    if out:
        yield _batch(frame(out))


def _batch(pdf):
    import pyarrow as pa

    return pa.RecordBatch.from_pandas(pdf, preserve_index=False)


def repair(rows: DataFrame, originals: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per conversation of ``originals`` (``conv``) from the rows ``(conv, turn, role, text)``."""
    chunks = chunked(rows, size)
    settle = settled(chunks.select("conv", "chunk", "codes", "last"))
    traces = cut_lineage(settle.mapInPandas(_trace, "conv long, chunk long, trace array<binary>"))
    shape = chunks.select("conv", "chunk", "codes", "first")
    traced = shape.join(traces.withColumnRenamed("conv", "_conv").withColumnRenamed("chunk", "_chunk"), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    nothing = [none("codes", "binary"), none("trace", "array<binary>")]
    marks = originals.select("conv").distinct().select(
        "conv", F.lit(0).alias("part"), F.lit(0).alias("stage"), none("turn", "bigint"), none("role", "string"), none("text", "string"), none("digest", "binary"), *nothing, F.lit(0).cast("long").alias("chunk"),
    )
    # A trace stands before the first row of its chunk; among equal rows all their traces come first, in order.
    paths = traced.select(
        "conv", F.lit(1).alias("part"), F.lit(1).alias("stage"), "first.turn", "first.role", none("text", "string"), "first.digest", "codes", "trace", "chunk",
    )
    texts = rows.select("conv", F.lit(2).alias("part"), F.lit(1).alias("stage"), "turn", "role", "text", _digest().alias("digest"), *nothing, F.lit(0).cast("long").alias("chunk"))
    every = marks.unionByName(paths).unionByName(texts).repartition("conv")
    every = every.sortWithinPartitions(
        F.col("conv").asc_nulls_first(), "stage", F.col("turn").asc_nulls_first(), "role", "digest", "part", "chunk",
    ).drop("stage", "digest", "chunk")
    return every.mapInArrow(_finish, ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in RESULT))
