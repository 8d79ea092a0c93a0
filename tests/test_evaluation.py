import json
import math

import pytest
from pyspark.sql import functions as F

from inkspan.operators import corpora, metrics
from inkspan.operators.index import build
from inkspan.operators.search import search
from inkspan.sources import notes as src
from inkspan.streaming.changes import IndexMaintainer, is_pending, last_by_path, operations, unchanged_since


def test_recall_and_causes(spark):
    ranks = spark.createDataFrame([("a", "literal", 1, 1), ("b", "literal", None, 70), ("c", "synonym", 3, 3), ("d", "synonym", None, None)], "key string, kind string, rank int, deep_rank int")
    rows = {r.kind: r for r in metrics.recall_table(ranks).collect()}
    assert rows["all"].queries == 4 and rows["all"].recall_5 == 0.5 and rows["all"].recall_100 == 0.75 and rows["all"].matched == 0.75
    assert math.isclose(rows["all"].mrr, (1 + 1 / 3) / 4) and rows["all"].median_rank == 3 and rows["synonym"].median_rank == 3
    shared = spark.createDataFrame([("b", 2), ("d", 1)], "key string, n_shared long")
    got = metrics.miss_causes(ranks, shared, 50).first()
    assert tuple(got) == (2, 0, 1, 1, 70, 70)


def test_ndcg_and_movement(spark):
    ranks = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "key string, path string, rank int")
    wanted = spark.createDataFrame([("q", "b", 2), ("q", "z", 2), ("r", "z", 2)], "key string, path string, grade int")
    got = {r.key: r.ndcg for r in metrics.ndcg(ranks, wanted).collect()}
    assert math.isclose(got["q"], (1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got["r"] == 0
    a = spark.createDataFrame([("1", 5), ("2", None), ("3", 1), ("4", None)], "key string, rank int")
    b = spark.createDataFrame([("1", 2), ("2", 9), ("3", 4), ("4", None)], "key string, rank int")
    assert tuple(metrics.rank_movement(a, b).first()) == (2, 1, 1)
    x, y = (spark.createDataFrame([("1", v), ("2", 0.5)], "key string, ndcg double") for v in (0.1, 0.4))
    assert tuple(metrics.compare_ndcg(x, y).first())[3:] == (1, 0, 1)
    frames = spark.createDataFrame([(float(k),) for k in range(1, 301)], "gap_ms double")
    assert tuple(metrics.frame_stats(frames).first())[:3] == (300.0, 285.0, 100)


def test_truth_builders(spark, tmp_path):
    notes = spark.createDataFrame([("a", "デプロイの手順"), ("b", "プロの話とデプロイ"), ("c", "プログラマー")], "path string, text string")
    queries, relevance = corpora.word_relevance(notes)
    assert {r.query for r in queries.collect()} == {"デプロイ", "プログラマー"} and relevance.count() == 3
    passages = spark.createDataFrame([("1", "x the quick fox y"), ("2", "fox"), ("3", "absent words here")], "key string, query string")
    told = spark.createDataFrame([("a", "ax the quick fox yb"), ("b", "the quick fox")], "path string, text string")
    assert sorted((r.key, r.path) for r in corpora.passage_relevance(told, passages).collect()) == [("1", "a"), ("2", "a"), ("2", "b")]
    src.write_truth(queries, relevance, str(tmp_path / "t.json"), seed=1)
    q, r = src.read_truth(spark, str(tmp_path / "t.json"))
    assert q.count() == 2 and r.count() == 3


def test_made_corpus_is_searchable(spark, tmp_path):
    notes, queries, relevance = src.make_corpus(spark, 60, 5)
    again, *_ = src.make_corpus(spark, 60, 5)
    assert notes.count() == 60 and notes.exceptAll(again).count() == 0 and queries.count() == 48
    assert search(build(notes), "蜂箱の点検", 5).first().path == "手引き/蜂箱の点検.md" and relevance.groupBy("key").count().where("count <> 2").count() == 0
    src.write_corpus(notes, str(tmp_path / "c"))
    src.write_report(relevance.groupBy("grade").count(), str(tmp_path / "r"))
    assert corpora.diff(notes, spark.read.parquet(str(tmp_path / "c"))).count() == 0


def test_markdown_files(spark, tmp_path):
    root = tmp_path / "vault [x]"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "Note.md").write_text("héllo", encoding="utf-8")
    (root / "big.md").write_text("x" * 2000)
    (root / "skip.txt").write_text("x")
    base = str(tmp_path)
    got = src.read_markdown(spark, base, 1000).collect()
    assert [(r.path, r.title, r.text) for r in got] == [("vault [x]/sub/Note.md", "Note", "héllo")] and src.count_oversized(spark, base, 1000) == 1


def test_fetching_keeps_what_it_got():
    calls = []

    def get(url):
        calls.append(url)
        if len(calls) in (1, 3, 4, 5, 6, 7, 8):
            raise OSError
        return {"query": {"pages": {"1": {"pageid": 1, "title": "T", "extract": "text"}, "2": {"pageid": 2, "title": "U", "extract": ""}}}}

    got = src.fetch_pages("https://pages.example/api", list(range(25)), get, sleep=lambda s: None)
    assert [p["pageid"] for p in got] == [1] and len(calls) == 8


def change(stamp, kind, path, text="", old=None, tags=()):
    return (stamp, kind, path, old, 0, "", text, None if tags is None else list(tags))


DDL = "stamp long, kind string, path string, old_path string, mtime long, title string, text string, tags array<string>"


def test_operations(spark):
    rows = [change(1, "create", "a"), change(2, "rename", "b", old="a"), change(3, "modify", "c"), change(4, "delete", "c"), change(5, "create", "d", tags=None)]
    ops = operations(spark.createDataFrame(rows, DDL))
    assert {(r.path, r.op) for r in last_by_path(ops).collect()} == {("a", "delete"), ("b", "upsert"), ("c", "delete"), ("d", "upsert")}
    assert [r.path for r in is_pending(ops.withColumn("passes", F.lit(3))).collect()] == ["d"]
    assert is_pending(ops.withColumn("passes", F.lit(80))).count() == 0
    files = spark.createDataFrame([("b", 0), ("d", 9)], "path string, mtime long")
    assert {r.path for r in unchanged_since(ops.where("op = 'upsert'"), files).collect()} == {"b"}


def test_stream_keeps_the_index_current(spark, tmp_path):
    feed, root = tmp_path / "feed", f"file://{tmp_path}/index"
    feed.mkdir()
    keep = IndexMaintainer(spark, root)
    base = spark.createDataFrame([(f"n{k:02}.md", "", f"base word{k}") for k in range(20)], "path string, title string, text string")
    keep.rebuild(base)
    rows = [change(k, "create", f"c{k}.md", f"created word{k}") for k in range(10)]
    rows += [change(100 + k, "modify", f"n{k:02}.md", "edited") for k in range(5)] + [change(200 + k, "delete", f"n{10 + k}.md") for k in range(4)]
    rows += [change(300 + k, "rename", f"r{k}.md", "renamed", old=f"c{k}.md") for k in range(3)]
    names = [c.split()[0] for c in DDL.split(", ")]

    def emit(name, some):
        (feed / name).write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in some))

    emit("1.json", rows)
    stream = spark.readStream.schema(DDL).json(str(feed))
    query = keep.start(stream, str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
        index = keep.current()
        assert index.size().first()["n_notes"] == 26
        assert {r.path for r in search(index, "edited", 50).collect()} == {f"n{k:02}.md" for k in range(5)}
        emit("2.json", [change(50, "modify", "n00.md", "stale"), change(400, "modify", "n01.md", "newest")])
        query.processAllAvailable()
        index = keep.current()
        assert search(index, "stale", 5).count() == 0 and [r.path for r in search(index, "newest", 5).collect()] == ["n01.md"]
    finally:
        query.stop()


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/index"
    keep = IndexMaintainer(spark, root)
    keep.rebuild(spark.createDataFrame([("a.md", "", "first words"), ("b.md", "", "other words")], "path string, title string, text string"))
    batch = spark.createDataFrame([change(1, "modify", "a.md", "second words")], DDL)
    # dies after the tables, before the mark
    with monkeypatch.context() as m:
        m.setattr(keep.spark, "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(OSError("gone")) if a[1:] == ("value string",) else type(spark).createDataFrame(spark, *a, **b))
        with pytest.raises(OSError, match="gone"):
            keep.apply(batch, 0)
    assert keep.version == 0 and search(keep.current(), "first", 5).count() == 1
    # a mark without commit counts for nothing
    (tmp_path / "index" / "current-7.json").mkdir()
    again = IndexMaintainer(spark, root)
    again.apply(batch, 0)
    assert again.version == 1 and search(again.current(), "second", 5).count() == 1 and search(again.current(), "first", 5).count() == 0
    again.apply(batch, 0)  # the batch ran already
    assert again.version == 1
    for k in range(4):
        again.clear()
    assert again.version == 5 and not (tmp_path / "index" / "v1").exists() and (tmp_path / "index" / "v3").exists()


@pytest.mark.parametrize("name", ["corpus_hash", "chunk_general_literals", "exclusion_policy", "cache_ttl_lru"])
def test_entry(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
