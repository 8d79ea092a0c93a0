"""The judgement cache as state of a stream: one cache for each name, with time to live and a bounded number of entries.

An operation is a row (cache, seq, at, kind, key, judgement): ``get``, ``put`` or ``clear`` at a time in milliseconds, in the order of ``seq``. A get finds an entry
until it runs out; it makes the entry the most recently used one but does not prolong it, and it drops one that ran out. A put stores and drops the
least recently used entries beyond the bound, those that ran out counting like others until they are read. A time to live of 0 turns the cache off.

State is one record an entry, at most ``entries`` of them and one more for a moment, so caches spread over tasks by name and none grows. ``replay`` is the same for a stream
and for a table of operations; a stream puts the operations of one cache in one batch in order in memory, as each depends on the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from inkspan.operators.cache import ENTRIES, TTL_MINUTES
from inkspan.streaming.pending import _STORE

OUTPUT = "cache string, seq long, key string, hit boolean, judgement string"


class JudgementState(StatefulProcessor):
    def __init__(self, ttl_ms: int = TTL_MINUTES * 60_000, entries: int = ENTRIES):
        self.ttl_ms, self.entries = ttl_ms, entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", "judgement string, expires long, used long")

    def _put(self, op: Row) -> None:
        self.known.updateValue((op["key"],), (op["judgement"], op["at"] + self.ttl_ms, op["seq"]))
        held = sorted((value[2], key[0]) for key, value in self.known.iterator())
        for _, key in held[: max(0, len(held) - self.entries)]:
            self.known.removeKey((key,))

    def _get(self, op: Row) -> str | None:
        if not self.known.containsKey((op["key"],)):
            return None
        judgement, expires, _ = self.known.getValue((op["key"],))
        if expires <= op["at"]:
            self.known.removeKey((op["key"],))
            return None
        self.known.updateValue((op["key"],), (judgement, expires, op["seq"]))
        return judgement

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for op in sorted(rows, key=lambda r: r["seq"]):
            if op["kind"] == "clear":
                self.known.clear()
            elif op["kind"] == "put" and self.ttl_ms > 0:
                self._put(op)
            elif op["kind"] == "get":
                found = self._get(op) if self.ttl_ms > 0 else None
                yield Row(cache=key[0], seq=op["seq"], key=op["key"], hit=found is not None, judgement=found)

    def close(self) -> None:
        pass


def _replayed(ttl_ms: int, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What JudgementState does, over rows by cache and ``seq``: one cache is held at a time, in the order of use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = None, {}  # key: (judgement, expires), the least recently used first
        for batch in batches:
            out = []
            for name, seq, at, kind, key, judgement in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != cache:
                    cache, known = name, {}
                if kind == "clear":
                    known.clear()
                elif kind == "put" and ttl_ms > 0:
                    known.pop(key, None)
                    known[key] = (judgement, at + ttl_ms)
                    while len(known) > entries:
                        del known[next(iter(known))]
                elif kind == "get":
                    found = known.pop(key, None) if ttl_ms > 0 else None
                    found = found if found and found[1] > at else None
                    if found:
                        known[key] = found
                    judged = found[0] if found else None
                    out.append((name, seq, key, judged is not None, judged))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["cache", "seq", "key", "hit", "judgement"])

    return run


def replay(operations: DataFrame, ttl_ms: int = TTL_MINUTES * 60_000, entries: int = ENTRIES) -> DataFrame:
    """(cache, seq, key, hit, judgement) of every get of a stream or table of operations.

    A stream keeps its caches as state and sets Spark's state store to the one that map state needs; the operations of a table are dealt by cache, ordered and
    replayed as they pass, without a store.
    """
    spark = operations.sparkSession
    rows = operations.select("cache", "seq", "at", "kind", "key", "judgement").where("cache is not null and seq is not null")
    if not operations.isStreaming:
        # sortWithinPartitions spills, so no cache must fit in memory
        return rows.repartition("cache").sortWithinPartitions("cache", "seq").mapInArrow(_replayed(ttl_ms, entries), OUTPUT)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return rows.groupBy("cache").transformWithState(JudgementState(ttl_ms, entries), OUTPUT, "append", "none")
