import random

import pytest

from inkspan.operators.cache import JudgementCache
from inkspan.streaming.judgements import replay

OPS = "cache string, seq long, at long, kind string, key string, judgement string"


def operations(seed, caches=6, count=400):
    rng = random.Random(seed)
    at, rows = 0, []
    for seq in range(count):
        at += rng.choice([0, 1, 20_000])
        rows.append((f"c{rng.randrange(caches)}", seq, at, rng.choice(["get"] * 5 + ["put"] * 4 + ["clear"] * (rng.random() < 0.1)), f"k{rng.randrange(7)}", f"v{seq}"))
    return rows


def in_memory(rows, ttl_minutes, entries):
    """The same operations on the caches of single sessions."""
    caches, out = {}, set()
    for cache, seq, at, kind, key, judgement in rows:
        own = caches.setdefault(cache, JudgementCache(ttl_minutes, entries))
        if kind == "put":
            own.store(key, judgement, at)
        elif kind == "clear":
            own.clear()
        else:
            found = own.lookup(key, at)
            out.add((cache, seq, key, found is not None, found))
    return out


@pytest.mark.parametrize(("ttl_minutes", "entries"), [(5, 3), (1, 200), (0, 3)])
def test_replay_equals_sessions(spark, ttl_minutes, entries):
    rows = operations(ttl_minutes)
    frame = spark.createDataFrame([*rows, (None, 1, 1, "get", "k1", None)], OPS).repartition(5)
    assert {tuple(r) for r in replay(frame, ttl_minutes * 60_000, entries).collect()} == in_memory(rows, ttl_minutes, entries)


def test_state_stays_between_batches(spark, tmp_path):
    rows, feed = operations(9, 3, 120), tmp_path / "feed"
    feed.mkdir()
    found = replay(spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(feed)), 300_000, 3)
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], OPS).coalesce(1).write.mode("append").parquet(str(feed))
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == in_memory(rows, 5, 3)


def test_tables_are_replayed_without_a_state_store(spark):
    """every entry of every cache went through the state store."""
    plan = replay(spark.createDataFrame(operations(1), OPS), 300_000, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "TransformWithState" not in plan
