"""Keyed state: a cache with expiry and the newest messages of a session.

Both hold a bounded state per key. They need the RocksDB state store of the session
(:func:`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Cache(StatefulProcessor):
    """Value, owner and expiry of one key; an entry past its expiry is removed by an event-time timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "content string, user_id string, expires_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ops = pd.concat(list(rows)).sort_values(["at_ms", "seq"], kind="stable")
        out = []
        held = self.entry.get()
        for op in ops.itertuples(index=False):
            live = held is not None and not (held[2] is not None and held[2] >= 0 and op.at_ms > held[2])
            if op.op == "put":
                expires = op.at_ms + int(op.ttl_ms) if op.ttl_ms and op.ttl_ms > 0 else -1
                held = (op.content, op.user_id, expires)
                continue
            hit = live and (held[1] is None or held[1] == op.user_id)
            if held is not None and not live:
                held = None
            out.append((key[0], op.seq, bool(hit), held[0] if hit else None))
        if held is None:
            self.entry.clear()
        else:
            self.entry.update(held)
            if held[2] is not None and held[2] >= 0:
                self.handle.registerTimer(held[2] + 1)
        yield pd.DataFrame(out, columns=["key", "seq", "hit", "content"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get()
        if held is not None and held[2] is not None and 0 <= held[2] < expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame([], columns=["key", "seq", "hit", "content"])

    def close(self) -> None:
        pass


def stream_cache(ops: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Outcome of every ``get`` in a stream of ``(key, seq, at, op, content, user_id, ttl_ms)``.

    Operations of a key take effect in event time within each trigger. A get misses when the key is
    missing, expired or owned by someone else.
    """
    rows = ops.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(
        _Cache(), "key string, seq bigint, hit boolean, content string", "Append", "EventTime"
    )


def _newest(n: int) -> type:
    class _Newest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.items = handle.getListState("items", "turn bigint, role string, content string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            held = list(self.items.get())
            for batch in rows:
                # Only the newest of a batch can matter, whatever its size.
                batch = batch.nlargest(n, "turn")
                new = list(zip((int(t) for t in batch["turn"]), batch["role"], batch["content"], strict=True))
                held = sorted([*(tuple(h) for h in held), *new])[-n:]
            self.items.put(held)
            yield pd.DataFrame({
                "session_id": [key[0]], "turns": [[int(h[0]) for h in held]], "contents": [[h[2] for h in held]],
            })

        def close(self) -> None:
            pass

    return _Newest


def stream_history(messages: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` messages of a session after every trigger that brought one."""
    return messages.groupBy("session_id").transformWithStateInPandas(
        _newest(n)(), "session_id bigint, turns array<bigint>, contents array<string>", "Update", "None"
    )
