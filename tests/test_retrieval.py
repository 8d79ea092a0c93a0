import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspan.operators.chunk import chunk, fixed_windows, fragments
from inkspan.operators.index import Index, build, clear, remove, upsert
from inkspan.operators import scan
from inkspan.operators.metrics import ranks_by_counting
from inkspan.operators.search import first_of_each_note, in_one_pass, rank_order, render, scores, search, search_many

NOTE = "path string, title string, text string"


def notes(spark, *rows):
    return spark.createDataFrame([(p, t, x) for p, x, t in ((*r, "")[:3] for r in rows)], NOTE)


def hits(index, query, limit=50):
    return search(index, query, limit).collect()


def test_front_matter_lines_and_headings():
    text = "﻿---\r\nsecret: hidden\r\n---\r\nintro\r\n# Topic ##\r\nbody\r\n"
    assert fragments(text) == [("", "intro\r\n", 4), ("Topic", "# Topic ##\r\nbody\r\n", 5)]
    assert fragments("---\nsecret: hidden") == []
    assert fragments("---\nsecret: hidden\n...\nvisible") == [("", "visible", 4)]


def test_fences():
    text = "lead\n# Real\n````js\n# fake\n```\n# still\n````\n~~~\n## tilde\n~~~\n###### Last\n[link](target.md)"
    assert [(h, n) for h, _, n in fragments(text)] == [("", 1), ("Real", 2), ("Last", 11)]
    assert [h for h, _, _ in fragments("# First\n~~~\n# no\n")] == ["First"]


def test_windows():
    text = "😀" * 2500
    got = fragments(text)
    assert [len(t) for _, t, _ in got] == [1200, 1200, 340] and got[0][1] + got[1][1][120:] + got[2][1][120:] == text
    text = "a" * 700 + "\r\n\r\n" + "b" * 700
    got = fragments(text)
    assert [n for *_, n in got] == [1, 3] and "".join(t for _, t, _ in got) == text
    assert [n for *_, n in fragments(("x" * 99 + "\n") * 25)] == [1, 11, 22]
    assert [len(t) for _, t, _ in fragments(("x" * 98 + "\r\n") * 25)] == [1200, 1200, 340]
    assert fragments("\n \t\r\n") == [] and fragments("") == []


def test_plain_windows_equal_the_scan(spark):
    texts = ["", " \n", "x" * 1200, "x" * 1201, ("word " * 7 + "\n") * 400, "😀" * 2500, "a" * 1300 + " " * 3000 + "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", fixed_windows(F.col("text")).alias("w")).collect()
    for r in rows:
        assert [(w.text, w.start_line) for w in r.w] == [(t, n) for _, t, n in fragments(texts[r.k])]


def test_chunk_takes_both_ways(spark):
    got = chunk(notes(spark, ("a.md", "plain text"), ("b.md", "# h\nx"), ("c.md", "x" * 1048577), ("d.md", "日" * 350000), ("e.md", None)))
    assert sorted((r.path, r.heading) for r in got.collect()) == [("a.md", ""), ("b.md", "h")]


def test_exact_score_boosts_and_duplicates(spark):
    index = build(notes(spark, ("a.md", "apple")))
    assert abs(hits(index, "apple")[0].score - math.log(1 + 0.5 / 1.5)) < 1e-12
    assert hits(index, "apple apple") == hits(index, "apple")
    index = build(notes(spark, ("body.md", "needle filler"), ("title.md", "other filler", "needle")))
    assert hits(index, "needle")[0].path == "title.md"
    index = build(notes(spark, ("body.md", "needle filler"), ("heading.md", "# needle\nfiller"), ("ja.md", "再ランキングと管理")))
    assert hits(index, "再ランキング")[0].path == "ja.md"
    found = [r.path for r in hits(index, "needle")]
    assert found.index("heading.md") < found.index("body.md")


def test_limits_and_ties(spark):
    index = build(notes(spark, *((f"{k:02}.md", "word") for k in range(60)))).persist()
    assert len(hits(index, "word")) == 50
    assert [r.path for r in hits(index, "word", 2)] == ["00.md", "01.md"]
    assert len(hits(index, "word", math.inf)) == 60 and len(hits(index, "word", 1.9)) == 1
    for limit in (0, -1, math.nan):
        assert hits(index, "word", limit) == []
    for query in ("", "😀!?", "unmatched"):
        assert hits(index, query) == []
    index.unpersist()


def test_incremental_equals_rebuilt(spark):
    index = build(notes(spark, ("a.md", "# apple\napple pear", "apple"), ("b.md", "pear pear apple", "pear"), ("c.md", "obsolete apple")))
    changed = ("a.md", "# pear\napple pear pear", "pear")
    index = remove(upsert(index, notes(spark, changed)), spark.createDataFrame([("c.md",), ("missing.md",)], "path string"))
    fresh = build(notes(spark, changed, ("b.md", "pear pear apple", "pear")))
    a, b = hits(index, "apple pear"), hits(fresh, "apple pear")
    assert [(r.id, round(r.score, 12)) for r in a] == [(r.id, round(r.score, 12)) for r in b]
    assert hits(index, "obsolete") == []
    gone = upsert(index, notes(spark, ("a.md", "x" * 1048577)))
    assert {r.path for r in hits(gone, "pear")} == {"b.md"}
    assert clear(index).size().first() == (0, 0)


def test_save_and_load(spark, tmp_path):
    index = build(notes(spark, ("a.md", "apple pear"), ("b.md", "pear")))
    index.save(str(tmp_path / "i"))
    assert hits(Index.load(spark, str(tmp_path / "i")), "pear") == hits(index, "pear")


def test_many_queries_and_rendering(spark):
    index = build(notes(spark, ("a.md", "# x\nword\n# y\nword word"), ("b.md", "word other")))
    asked = spark.createDataFrame([("1", "word"), ("2", "other"), ("3", "none")], "key string, query string")
    found = search_many(index, asked, 10)
    assert found.groupBy("key").count().orderBy("key").collect() == [("1", 3), ("2", 1)]
    assert [(r.path, r.rank) for r in first_of_each_note(found).where("key = 1").orderBy("rank").collect()] in ([("a.md", 1), ("b.md", 2)], [("b.md", 1), ("a.md", 2)])
    assert {r.label for r in render(found).collect()} == {"not evaluated"}


@pytest.mark.parametrize("limit", [3, 100])
def test_one_query_and_many_agree(spark, limit):
    index = build(notes(spark, *((f"{k}.md", f"word {'pear ' * (k % 4)} apple") for k in range(20))))
    asked = spark.createDataFrame([("q", "pear word")], "key string, query string")
    assert [r.id for r in hits(index, "pear word", limit)] == [r.id for r in search_many(index, asked, limit).orderBy("pos").collect()]


def test_many_queries_in_one_pass(spark, monkeypatch):
    """F2 to F12: each pair of a query and a chunk that share a word was shuffled."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    index = build(notes(spark, *((f"n{k:03}", " ".join(rng.choices(words, k=rng.randint(1, 700))), rng.choice(words)) for k in range(60)), ("copy", "w1 w2"), ("copy2", "w1 w2"), ("none", "zzz")))
    asked = spark.createDataFrame([(f"q{k}", " ".join(rng.sample(words, 3))) for k in range(20)] + [("nothing", "absent"), ("empty", None)], "key string, query string")
    told = spark.createDataFrame([(f"q{k}", f"n{3 * k:03}", 1 + k % 2) for k in range(15)] + [("nothing", "none", 2)], "key string, path string, grade int")
    kinds = asked.withColumn("kind", F.lit("x"))
    places = index.chunks.select("id", "path", "start_line")
    whole = scores(index, asked).join(places, "id")
    deep = {tuple(r) for r in whole.groupBy("key").agg(F.count("*"), F.round(F.max("score"), 9)).collect()}
    ranks = {tuple(r) for r in ranks_by_counting(scores(index, asked), places, kinds, told, 5).collect()}
    ordered = [(r.key, r.pos, r.id) for r in whole.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(*rank_order()))).where("pos <= 7").collect()]
    monkeypatch.setattr(scan, "CELLS", 2000)  # many slices
    wanted = in_one_pass(index, asked)
    assert {(r[0], r[1], round(r[2], 9)) for r in scan.counts(index, asked, wanted).collect()} == deep
    assert {tuple(r) for r in scan.first_ranks(index, kinds, wanted, told, 5).collect()} == ranks
    found = search_many(index, asked, 7)
    assert sorted((r.key, r.pos, r.id) for r in found.collect()) == sorted(ordered)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # of pairs


def test_few_words_leave_others_out_of_the_postings(spark):
    """all postings were made and shuffled for the words of one query."""
    index = build(notes(spark, ("a", "pear apple"), ("b", "plum pear")))
    plan = scores(index, spark.createDataFrame([("q", "pear")], "key string, query string"))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode(tokens") - 400 : plan.index("Generate explode(tokens")]
    assert "= pear" in below


def test_an_upsert_cuts_texts_once(spark, monkeypatch):
    """scores of an index kept by upsert and remove joined and hashed all texts again for each of its tables."""
    index = build(notes(spark, ("a.md", "apple pear", "apple"), ("b.md", "pear pear apple", "pear"), ("c.md", "obsolete apple")))
    index = remove(upsert(index, notes(spark, ("a.md", "apple pear pear", "pear"))), spark.createDataFrame([("c.md",)], "path string"))
    assert sorted(tuple(r) for r in index.stats.collect()) == [(0, 2, 2), (1, 2, 0), (2, 2, 6)]
    plan = index.stats._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "_hash" not in plan.split("Join LeftAnti")[0] and "text" not in plan.split("Join LeftAnti")[0]
    assert "chunk_id" not in plan and "content_hash" not in plan
