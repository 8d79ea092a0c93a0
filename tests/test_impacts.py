import glob
import math
import random

import pyarrow.parquet as pq
import pytest

from inkspan.operators import impacts as im
from inkspan.operators.index import build
from inkspan.operators.search import search

NOTE = "path string, title string, text string"


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rng = random.Random(2)
    rare = [f"rare{k}" for k in range(40)]
    notes = []
    for k in range(3000):
        words = ["common"] * rng.choice([1, 1, 2, 3, 8]) + ["usual"] * rng.choice([0, 1, 4]) + [f"filler{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        words += [rng.choice(rare)] * (rng.random() < 0.02) + ["管理"] * (rng.random() < 0.1)
        rng.shuffle(words)
        notes.append((f"n{k:05}.md", rng.choice(["", "common things", "rare1"]) if k % 50 == 0 else "", ("# usual heading\n" if k % 90 == 0 else "") + " ".join(words)))
    index = build(spark.createDataFrame(notes, NOTE)).persist()
    path = str(tmp_path_factory.mktemp("impacts"))
    return index, im.ImpactIndex.save(index, path), path


def rows(hits):
    return [(r.path, r.start_line, r.id, round(r.score, 9), r.text) for r in hits.collect()]


@pytest.mark.parametrize("query", ["common", "common usual", "common usual rare1", "rare3 common", "管理 common", "rare1 rare2 rare3", "nothing", "", "common filler7 usual filler9"])
@pytest.mark.parametrize("limit", [1, 10])
def test_the_same_hits(saved, query, limit):
    index, pruned, _ = saved
    found = pruned.top(query, limit)
    assert rows(found.hits) == rows(search(index, query, limit))


def test_odd_limits(saved):
    index, pruned, _ = saved
    assert rows(pruned.top("rare1", math.inf).hits) == rows(search(index, "rare1", math.inf))
    assert rows(pruned.top("rare1 common", 5000).hits) == rows(search(index, "rare1 common", 5000))
    assert rows(pruned.top("rare1", 0).hits) == [] and rows(pruned.top("rare1", math.nan).hits) == []


def test_few_postings_of_common_terms_are_read(saved):
    _, pruned, path = saved
    for query in ("common", "common usual"):
        found = pruned.top(query, 10)
        assert found.total > 3000 and found.read < found.total / 5, (query, found.read, found.total)
    # the bound is one that the statistics of row groups can use: impacts fall within a list
    values = []
    for name in sorted(glob.glob(f"{path}/impacts/*.parquet")):
        table = pq.read_table(name, columns=["term", "field", "impact"]).to_pylist()
        values += [r["impact"] for r in table if r["term"] == "common" and r["field"] == 2]
        stats = pq.ParquetFile(name).metadata.row_group(0).column(2).statistics if table else None
        assert stats is None or stats.has_min_max
    assert values == sorted(values, reverse=True) and len(values) == 3000


def test_cuts_give_away_less_than_the_threshold():
    rng = random.Random(4)
    for _ in range(200):
        lists = [im.List(f"t{k}", 2, rng.random() * 5 + 0.01, {b: rng.randrange(1, 1000) for b in rng.sample(range(71), rng.randrange(1, 20))}) for k in range(rng.randrange(1, 6))]
        threshold = rng.random() * 10 - 1
        cuts = im.cheapest_cuts(lists, threshold)
        given = sum(one.below(c) for one, c in zip(lists, cuts, strict=True))
        assert given == 0 or given < threshold
        assert sum(one.size(c) for one, c in zip(lists, cuts, strict=True)) <= sum(one.size(0) for one in lists)


def test_many_close_chunks_are_scored_in_one_pass(saved, monkeypatch):
    """the texts of all chunks that might win were shuffled, and all their words."""
    index, pruned, _ = saved
    monkeypatch.setattr(im, "LOOKED_UP", 0)
    ran, whole = [], im.ImpactIndex._pass
    monkeypatch.setattr(im.ImpactIndex, "_pass", lambda self, query, k: ran.append(query) or whole(self, query, k))
    for query in ("common usual", "common rare1"):
        assert rows(pruned.top(query, 10).hits) == rows(search(index, query, 10))
    assert ran


def test_lists_of_some_words(saved, tmp_path, monkeypatch):
    """for one query the postings of all words were made, shuffled and sorted, and all texts with them."""
    index, whole, _ = saved
    some = im.ImpactIndex.save(index, str(tmp_path), ["common", "usual", "nothing"])
    assert {r.term for r in some.impacts.select("term").distinct().collect()} == {"common", "usual"} and not (tmp_path / "chunks").exists()
    for looked_up in (im.LOOKED_UP, 0):
        monkeypatch.setattr(im, "LOOKED_UP", looked_up)
        for query in ("common usual", "common", "usual nothing"):
            assert rows(some.top(query, 10).hits) == rows(search(index, query, 10))
