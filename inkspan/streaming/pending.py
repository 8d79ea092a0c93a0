"""Notes whose metadata is not there yet wait in state, path by path.

A change without tags (null) takes its note out of the index and waits. Tags that come later, with or without the text, let it go on; a newer change takes its
place, a delete ends it. A timer looks again every ``interval_ms``; after ``passes`` looks the note leaves for good, as a row of kind ``expired``.

State is one small record a path, kept by Spark's state store and checkpointed with the stream; timers survive restarts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PASSES, INTERVAL_MS = 80, 250
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ["stamp", "kind", "path", "old_path", "mtime", "title", "text", "tags", "passes"]
OUTPUT = "stamp long, kind string, path string, old_path string, mtime long, title string, text string, tags array<string>, passes int"


class AwaitMetadata(StatefulProcessor):
    def __init__(self, passes: int = PASSES, interval_ms: int = INTERVAL_MS):
        self.passes, self.interval_ms = passes, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.note = handle.getValueState("note", "stamp long, mtime long, title string, text string, passes int, timer long")

    def _wait(self, now: int, stamp: int, mtime: Any, title: Any, text: Any, passes: int) -> None:
        self._forget()
        self.handle.registerTimer(now + self.interval_ms)
        self.note.update((stamp, mtime, title, text, passes, now + self.interval_ms))

    def _forget(self) -> None:
        if self.note.exists():
            self.handle.deleteTimer(self.note.get()[5])
            self.note.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r["stamp"] is not None, r["stamp"])):
            waiting = self.note.get() if self.note.exists() else None
            if waiting and row["stamp"] is not None and row["stamp"] < waiting[0]:
                continue  # older than what waits
            given = row.asDict()
            if row["kind"] == "delete":
                self._forget()
            elif row["tags"] is None:
                self._wait(timerValues.getCurrentProcessingTimeInMs(), row["stamp"], row["mtime"], row["title"], row["text"], 0)
                given |= {"kind": "delete", "text": None}
            elif waiting:
                self._forget()
                own = row["text"] is not None
                given |= {"kind": "modify", "mtime": row["mtime"] if own else waiting[1], "title": row["title"] if own else waiting[2], "text": row["text"] if own else waiting[3]}
            yield Row(**{c: given.get(c) for c in _COLUMNS} | {"passes": waiting[4] if waiting else 0})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.note.exists():
            return
        stamp, mtime, title, text, passes, timer = self.note.get()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        if passes + 1 < self.passes:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.interval_ms)
            self.note.update((stamp, mtime, title, text, passes + 1, now + self.interval_ms))
            return
        self.note.clear()
        yield Row(stamp=stamp, kind="expired", path=key[0], old_path=None, mtime=mtime, title=title, text=None, tags=None, passes=passes + 1)

    def close(self) -> None:
        pass


def await_metadata(changes: DataFrame, passes: int = PASSES, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """A streaming frame of changes in which every note has its tags, and ``passes`` it waited; sets Spark's state store to the one that timers need.

    Renames are two changes here, a delete of the old path and a create. A change of tags alone for a note that does not wait passes as it is.
    """
    from pyspark.sql import functions as F

    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    # one row in, one or two out: no second scan of the stream
    away = F.struct(F.lit("delete").alias("kind"), F.col("old_path").alias("path"))
    here = F.struct(F.when(F.col("kind") == "rename", "create").otherwise(F.col("kind")).alias("kind"), "path")
    both = F.explode(F.when((F.col("kind") == "rename") & F.col("old_path").isNotNull(), F.array(away, here)).otherwise(F.array(here))).alias("_o")
    split = changes.where("path is not null").select("*", both)
    rest = [F.when(F.col("_o.kind") == "delete", None).otherwise(F.col(c)).alias(c) for c in ("mtime", "title", "text", "tags")]
    routed = split.select("stamp", "_o.kind", "_o.path", F.lit(None).cast("string").alias("old_path"), *rest)
    return routed.groupBy("path").transformWithState(AwaitMetadata(passes, interval_ms), OUTPUT, "append", "processingTime")


def settled(changes: DataFrame) -> DataFrame:
    """What an index takes of ``await_metadata``: without the notes that waited in vain, which are out of it already."""
    return changes.where("kind <> 'expired'").drop("passes")
