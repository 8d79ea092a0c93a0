"""Judgements kept for a while: content-addressed key, time to live, least recently used go first."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TTL_MINUTES, ENTRIES = 30, 200


def judgement_key(body: str, target: str, key: str) -> str:
    """SHA-256 over target, key and body, made on the driver so that no plan holds a key."""
    return hashlib.sha256("\0".join((target, key, body)).encode("utf-8", "surrogatepass")).hexdigest()


class JudgementCache:
    """The cache of one session, in memory only."""

    def __init__(self, ttl_minutes: int = TTL_MINUTES, entries: int = ENTRIES):
        self.ttl_ms, self.entries = ttl_minutes * 60_000, entries
        self._kept: OrderedDict[str, tuple[Any, int]] = OrderedDict()

    def __len__(self) -> int:
        return len(self._kept)

    def lookup(self, key: str, now_ms: int) -> Any:
        """The value, made the most recent; None if unknown or run out (which removes it). The time to live stays."""
        value, expires = self._kept.get(key, (None, 0))
        if not self.ttl_ms or key not in self._kept:
            return None
        if expires <= now_ms:
            del self._kept[key]
            return None
        self._kept.move_to_end(key)
        return value

    def store(self, key: str, value: Any, now_ms: int) -> None:
        if not self.ttl_ms:
            return
        self._kept[key] = (value, now_ms + self.ttl_ms)
        self._kept.move_to_end(key)
        while len(self._kept) > self.entries:
            self._kept.popitem(last=False)

    def clear(self) -> None:
        self._kept.clear()

    def get(self, body: str, target: str, key: str) -> Any:
        import time

        return self.lookup(judgement_key(body, target, key), int(time.time() * 1000))

    def put(self, body: str, target: str, key: str, value: Any) -> None:
        import time

        self.store(judgement_key(body, target, key), value, int(time.time() * 1000))


def live_entries(table: DataFrame, now: int, entries: int = ENTRIES) -> DataFrame:
    """Of a cache table (key, judgement, expires, used) what has not run out, the most recently used ``entries``.

    A sorted limit (each task keeps that many), then nothing larger than the limit is ordered.
    """
    return table.where(F.col("expires") > now).orderBy(F.col("used").desc(), "key").limit(entries)


def refresh(table: DataFrame, puts: DataFrame, uses: DataFrame, now: int, ttl_minutes: int = TTL_MINUTES, entries: int = ENTRIES) -> DataFrame:
    """The cache table after stores (key, judgement, used) and reads (key, used); reads refresh recency only."""
    if ttl_minutes == 0:
        return table.limit(0)
    stored = puts.withColumn("expires", F.lit(now + ttl_minutes * 60_000).cast("long")).select("key", "judgement", "expires", F.col("used").cast("long").alias("used"))
    both = table.select("key", "judgement", "expires", "used").unionByName(stored)
    newest = both.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(F.col("expires").desc(), F.col("used").desc()))).where("_n = 1").drop("_n")
    last = uses.groupBy("key").agg(F.max("used").alias("_used"))
    touched = newest.join(last, "key", "left").withColumn("used", F.greatest("used", F.coalesce("_used", "used"))).drop("_used")
    return live_entries(touched, now, entries)
