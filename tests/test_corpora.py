import hashlib
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from inkspan.functions import text as tx
from inkspan.operators import corpora
from inkspan.operators.order import order_statistics
from inkspan.sources import pages as pg


def test_passages_of_common_words_meet_by_rare_grams(spark):
    """Words that nearly all notes have: anchors are runs of them, and few notes share one."""
    rng = random.Random(3)
    words = ["the", "of", "and", "to", "in", "a", "is", "it"]
    notes = [(f"n{k:03}", " ".join(rng.choice(words) for _ in range(60))) for k in range(400)]
    passages = []
    for k in range(60):
        text = rng.choice(notes)[1]
        at = rng.randrange(0, 20)
        passages.append((f"p{k}", text[at : at + rng.choice([1, 2, 3, 5, 9, 30, 80])]))
    passages += [("none", "words that nowhere occur at all"), ("empty", ""), ("null", None), ("edge", notes[0][1]), ("twice", notes[1][1][3:50])] + [("lines", "of\nand")]
    notes += [("line", "x of\nand y"), ("same", notes[0][1]), ("null", None), ("empty", "")]
    told, asked = spark.createDataFrame(notes, "path string, text string"), spark.createDataFrame(passages, "key string, query string")
    expected = {(k, p) for k, q in passages for p, t in notes if q and t is not None and q in t}
    assert {(r.key, r.path) for r in corpora.passage_relevance(told, asked).collect()} == expected
    anchors = corpora.passage_anchors(told, asked).collect()
    long = {k for k, q in passages if q and len(q.split(" ")) >= 8}
    assert long and all(r.df <= len(notes) * 0.1 for r in anchors if r.key in long)
    assert corpora.passage_relevance(told, asked.limit(0)).count() == 0


def test_grades_in_one_join_and_without_texts_of_other_notes(spark):
    """A note that is a passage has a grade of its own; a word that a note repeats counts once; texts of notes without a passage are not shuffled."""
    notes = [("a", "x one two three four y"), ("b", "one two three four"), ("c", "x one two three four y one two three four"), ("d", "two three"), ("e", None), ("a", "x one two three four y")]
    passages = [("1", "one two three four"), ("2", "x one two three four y"), ("3", "two three")]
    told, asked = spark.createDataFrame(notes, "path string, text string"), spark.createDataFrame(passages, "key string, query string")
    expected = {(k, p, 3 if t == q else 2) for k, q in passages for p, t in notes if t is not None and q in t}
    assert sorted(map(tuple, corpora.passage_relevance(told, asked, 2, 3).collect())) == sorted(expected)
    assert {(r.key, r.df) for r in corpora.passage_anchors(told, asked).collect()} >= {("1", 4)}
    many = told.unionByName(spark.range(20000).select(F.concat(F.lit("z"), "id").alias("path"), F.repeat(F.lit("other words "), 20).alias("text")))
    plan = corpora.passage_relevance(many, asked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [path" in plan and "LeftSemi" in plan


def test_tokens_are_counted_by_word(spark):
    """The same numbers as from whole texts, and a word that occurs often is cut once."""
    rng = random.Random(7)
    words = ["pear", "管理ランキング", "ー", "a管b", "ΑΣ", "ｆｉｇ", "", "x\ny", "検索 ", "´", "\u0301é", "\u3000管"]
    texts = [(" ".join(rng.choice(words) for _ in range(rng.randrange(60))),) for _ in range(80)] + [(None,), ("",), (" ",)]
    frame = spark.createDataFrame(texts, "text string")
    for stable in (True, False):
        whole = frame.select(F.explode(tx.tokens(tx.fold(F.col("text"), stable))).alias("term")).groupBy("term").count()
        counted = corpora.token_counts(frame, lambda word, stable=stable: tx.fold(word, stable))
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, whole.collect()))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(word):
        seen.add(1)
        return [word]

    assert corpora.token_counts(spark.createDataFrame([("fig " * 499 + "fig",)] * 20, "text string"), lambda word: word, cut).collect() == [("fig", 10000)]
    assert seen.value == 1


@pytest.mark.parametrize("falling", [False, True])
def test_order_statistics_against_sorting(spark, falling):
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.0, 2.0, 2.0, rng.random() * 9])) for _ in range(3000)] + [("one", 4.0), ("two", 1.0), ("two", 3.0), ("nulls", None), (None, 7.0), (None, 5.0)] + [(f"g{k % 40}", float(k)) for k in range(500)]
    places = {"first": 0.0, "median": 0.5, "p90": 0.9, "last": 1.0}
    got = {r.g: r for r in order_statistics(spark.createDataFrame(rows, "g string, x double").repartition(7), ["g"], "x", places, falling).collect()}
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, values in groups.items():
        values.sort(reverse=falling)
        assert got[g].n == len(values)
        for name, share in places.items():
            assert got[g][name] == values[min(int(len(values) * share), len(values) - 1)], (g, name)


def test_exact_digest_hands_its_state_from_range_to_range(spark, monkeypatch):
    """Ranges of pieces, one task after the other, give the digest of one stream; without a library that gives its state one task does."""
    rng = random.Random(9)
    notes = [(f"p{k * 7919 % 500}é", "ü" * rng.randrange(200) + "\0") for k in range(500)]
    whole = hashlib.sha256("".join(f"{p}\0{t}\0" for p, t in sorted(notes, key=lambda n: n[0].encode())).encode()).hexdigest()
    frame, states = spark.createDataFrame(notes, "path string, text string").repartition(6), []
    go_on = corpora._digest_from
    monkeypatch.setattr(corpora, "_digest_from", lambda state: states.append(state) or go_on(state))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tuple(corpora.exact_corpus_hash(frame).first()) == (500, whole)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert states[0] is None and len(states) == len(set(states)) > 2
    assert tuple(corpora.exact_corpus_hash(frame.limit(0)).first()) == (0, hashlib.sha256().hexdigest())
    monkeypatch.setattr(corpora, "_sha256_library", lambda: None)
    assert tuple(corpora.exact_corpus_hash(frame).first()) == (500, whole)


def test_hash_tree_and_exact_digest(spark):
    notes = [(f"p{k}", f"text {k}") for k in range(300)] + [("é", "ü\x00"), ("z", "")]
    frame = spark.createDataFrame(notes, "path string, text string")
    whole = hashlib.sha256("".join(f"{p}\0{t}\0" for p, t in sorted(notes, key=lambda n: n[0].encode())).encode()).hexdigest()
    assert tuple(corpora.exact_corpus_hash(frame.repartition(5)).first()) == (302, whole)
    for depth in (1, 2):
        leaves = {}
        for p, t in notes:
            h = hashlib.sha256(p.encode()).hexdigest()
            leaves.setdefault(h[:depth], []).append((h, hashlib.sha256(f"{p}\0{t}".encode()).hexdigest()))
        level = {k: hashlib.sha256("".join(d for _, d in sorted(v)).encode()).hexdigest() for k, v in leaves.items()}
        for n in range(depth - 1, -1, -1):
            above = {}
            for k in sorted(level):
                above.setdefault(k[:n], []).append(level[k])
            level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in above.items()}
        assert tuple(corpora.hash_root(corpora.hash_leaves(frame, depth), depth).first()) == (302, level[""])
    after = frame.where("path <> 'p7'").withColumn("text", F.when(F.col("path") == "p8", "new").otherwise(F.col("text"))).unionByName(spark.createDataFrame([("added", "x")], "path string, text string"))
    changed = spark.createDataFrame([("p7",), ("p8",), ("added",)], "path string")
    assert corpora.hash_root(corpora.update_leaves(corpora.hash_leaves(frame), after, changed)).first() == corpora.hash_root(corpora.hash_leaves(after)).first()
    assert corpora.hash_root(corpora.hash_leaves(frame.limit(0))).first()[0] == 0


TEXT = "。".join(f"この文は番号{{0}}の{k}番目で十五文字より長い" for k in range(8)) + "。"


class Service(BaseHTTPRequestHandler):
    """Pages 1 to 99 have text, 0 has none; ids from 60 are refused; every third request is told to come back."""

    asked: list[str] = []

    def do_GET(self):
        query = parse_qs(urlparse(self.path).query)
        type(self).asked.append(self.path)
        ids = [int(k) for k in query["pageids"][0].split("|")] if "pageids" in query else [200 + len(self.asked) * 20 + k for k in range(int(query["grnlimit"][0]))]
        if len(self.asked) % 3 == 0:
            return self.say(429, {})
        if len(self.asked) % 7 == 0:
            return self.say(200, {"error": {"code": "maxlag"}})
        if "pageids" in query and any(60 <= k < 100 for k in ids):
            return self.say(404, {})
        pages = [{"pageid": k, "title": f"T/{k}", "extract": TEXT.format(k) if k else "", "revisions": [{"revid": k * 10}]} for k in ids]
        return self.say(200, {"query": {"pages": pages}})

    def say(self, status, body):
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked = []
    yield f"http://127.0.0.1:{server.server_port}/api"
    server.shutdown()


def test_pages_come_in_partitions_and_failures_stay_in_theirs(spark, service, tmp_path):
    spark.dataSource.register(pg.PageSource)
    read = spark.read.format("encyclopedia").option("api", service).option("pause", "0.001").option("batchesPerPartition", "1")
    pages = read.option("ids", ",".join(map(str, [*range(0, 80), 5, 5]))).load().persist()
    rows = pages.collect()
    assert {r.pageid for r in rows if r.error is None} == set(range(1, 60)) and {(r.pageid, r.error) for r in rows if r.error} == {(k, "http-404") for k in range(60, 80)}
    kept = pg.usable(pages.unionByName(pages)).persist()
    assert kept.count() == 59 and kept.where("pageid = 7").first().path == "T_7.md"
    notes, queries, relevance = pg.truth_of(kept)
    assert notes.count() == 59 and queries.count() == 59 and relevance.where("key = 'w7'").first().path == "T_7.md"
    pg.write_manifest(kept, str(tmp_path / "m"), "test")
    lines = sorted(f"{k}:{k * 10}" for k in range(1, 60))
    expected = hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]
    head = spark.read.json(str(tmp_path / "m/header")).first()
    assert (head["articles"], head["corpus_hash"]) == (59, expected)
    again = pg.fetch(pg.read_manifest(spark, str(tmp_path / "m")), pg.Client(service, pause=0.001), 3)
    assert pg.manifest_is_whole(spark, str(tmp_path / "m"))(pg.usable(again)) and not pg.manifest_is_whole(spark, str(tmp_path / "m"))(kept.limit(5))
    assert read.option("ids", "").option("random", "45").load().where("error is null").count() == 45


def test_owners_of_sentences(spark):
    rows = [("shared", "a"), ("shared", "b"), ("shared", "a"), ("own", "c")] + [("everywhere", f"p{k}") for k in range(100)]
    got = {r.sentence: (r.owners, r.n) for r in pg.sentence_owners(spark.createDataFrame(rows, "sentence string, path string")).collect()}
    assert got == {"shared": (["a", "b"], 2), "own": (["c"], 1), "everywhere": (None, 100)}
