import random
import zlib
from collections import Counter

import numpy as np
import pytest

from inkspan.llm import packing as pk
from inkspan.llm.common import connected_components, ordered_positions
from inkspan.llm.sharding import interleave

DOCS = "doc_id long, text string, source string, size string, position int"


def odd_docs(spark, n=200):
    """A hot source, nulls in every column, repeated rows, clashing further columns."""
    rng = random.Random(3)
    rows = [(k, f"text {rng.randrange(50)}", rng.choice(["hot"] * 5 + ["a", "b", None]), "x", 1) for k in range(n)]
    rows += [(None, None, None, None, None), (None, "", "a", "x", 1), rows[0], rows[0]]
    return rows


def test_shards_hold_the_mixture(spark):
    rows = odd_docs(spark)
    out = interleave(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert {r.text_crc32 for r in out} == {zlib.crc32((r[1] or "").encode()) for r in rows}
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    total = Counter(r.source for r in out)
    for (s, source), n in Counter((r.shard, r.source) for r in out).items():
        assert abs(n - total[source] / 8) <= 2, (s, source)
    again = interleave(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard) for r in out)


def test_shards_of_nothing_and_little(spark):
    assert interleave(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.slot for r in interleave(spark.createDataFrame([(1, "x", "s", "", 0)], DOCS)).collect()] == [0]


def test_positions_and_components(spark):
    rows = ordered_positions(spark.createDataFrame([(k * 7 % 50, k) for k in range(50)], "a int, b int").repartition(9), ["a"], "pos").collect()
    assert all(r.a == r.pos for r in rows)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


TEXTS = ["Hello, world! It's fine.", "don't WE'LL İstanbul ΣΑΣ naïve café² ½", "x<|endoftext|>y \x1c a\x1cb \x01", "日本語 한국어 ﬁ", "", None, "é ́x A B　C ª º ß ſ", "word " * 3000, ",., '"]


@pytest.fixture(scope="module")
def tokenizer():
    return pk.tokenizer_text()


def test_packing_round_trip(spark, tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = TEXTS + ["tok " * rng.randrange(1, 900) for _ in range(60)] + ["same"] * 30
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "null id", 1), (3, texts[3], 1)]
    out = pk.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), tokenizer).collect()
    plain = Tokenizer.from_str(tokenizer)
    expected = Counter()
    for doc_id, text, _ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            expected[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.02 * -(-sum(r.length for r in out) // 2048) + 1


def test_packing_of_nothing(spark, tokenizer):
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer).count() == 0


def test_plan_equals_best_fit_decreasing_on_items():
    rng = random.Random(11)
    for _ in range(30):
        items = [rng.choice([1, 2, 3, 30, 50, 64, 100, rng.randrange(1, 101)]) for _ in range(rng.randrange(0, 300))]
        bins = []
        for size in sorted(items, reverse=True):
            fit = [k for k, room in enumerate(bins) if room >= size]
            if fit:
                bins[min(fit, key=lambda k: bins[k])] -= size
            else:
                bins.append(100 - size)
        plan = pk.best_fit_plan(dict(Counter(items)), 100)
        starts = sorted({(p[3]) for p in plan})
        counts, used = Counter(items), {}
        by_length = {}
        for length, rank, each, sequence, offset in plan:
            by_length.setdefault(length, []).append((rank, each, sequence, offset))
        for length, runs in by_length.items():
            runs.sort()
            for k, (rank, each, sequence, offset) in enumerate(runs):
                end = runs[k + 1][0] if k + 1 < len(runs) else counts[length]
                for r in range(rank, end):
                    used.setdefault(sequence + (r - rank) // each, []).append((offset + (r - rank) % each * length, length))
        assert sum(map(len, used.values())) == len(items) and (not items or starts[0] == 0)
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 100
        assert len(used) == len(bins)
