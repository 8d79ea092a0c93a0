import os
import random
from urllib.parse import urlparse

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkspan.llm import common as cm
from inkspan.llm import embeddings as em
from inkspan.llm import linededup as ld
from inkspan.llm import neardup as nd
from inkspan.llm import simhash as sh
from inkspan.llm.common import passing, stage


class Sets:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        x, y = self.find(a), self.find(b)
        self.parent[max(x, y)] = min(x, y)


def slow_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


WORDS = [f"word{k}" for k in range(400)]


def made_texts(seed=1, n=40):
    rng = random.Random(seed)
    out = [None, "", " \t", "One", "one", "ÀÉ é", "a b", "x " * 3000]
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(3, 120))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            edited = list(words)
            edited[rng.randrange(len(edited))] = "edited"
            out += [" ".join(edited), " ".join(words)]
    return out


def test_fingerprints_match_the_definition():
    texts = made_texts()
    got = sh.fingerprints_of([None if t is None else t.encode() for t in texts])
    assert got.tolist() == [slow_print(t) for t in texts]


@pytest.mark.parametrize("group_rows", [1024, 5])
def test_links_equal_all_pairs(spark, monkeypatch, group_rows):
    """Also with so small groups that hot ones are cut to the last level."""
    monkeypatch.setattr(sh, "GROUP_ROWS", group_rows)
    rng = random.Random(2)
    codes = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for code in list(codes)[:30]:
        for _ in range(4):
            for k in rng.sample(range(64), rng.randrange(1, 6)):
                code ^= 1 << k
            codes.add(code)
    base = rng.getrandbits(64)
    codes |= {base ^ (1 << k) for k in range(64)}
    codes = sorted(codes)
    rows = [(k, c - (1 << 64) if c >> 63 else c) for k, c in enumerate(codes)] + [(1000, 0), (None, 0)]
    sets = Sets()
    for a in range(len(codes)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= 3:
                sets.join(a, b)
    got = {r.doc_id: r.component_id for r in sh.components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert all(got[k] == sets.find(k) for k in range(len(codes))) and got[1000] == got[None] == got[codes.index(0)]


def test_simhash_of_odd_rows(spark):
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string, fp int")).count() == 0
    rows = [(5, None, 1), (3, "", 1), (9, "a b c d", 1), (9, "a b c d", 1)]
    got = sorted((r.doc_id, r.fp == 0, r.component_id) for r in sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect())
    assert got == [(3, True, 3), (5, True, 3), (9, False, 9), (9, False, 9)]


def test_one_of_each_near_copy(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(80, 300))]
        texts.append(words)
        for _ in range(rng.randrange(4)):
            edited = list(words)
            for k in rng.sample(range(len(edited)), max(1, len(edited) // 80)):
                edited[k] = rng.choice(WORDS)
            texts.append(edited)
    rows = [(k, " ".join(w), 1) for k, w in enumerate(texts)] + [(900, "", 1), (901, None, 1), (902, "short one", 1), (902, "short one", 1), (None, "short  ONE", 1)]
    parts = {}
    for k, (_, text, _) in enumerate(rows):
        words = (text or "").lower().split()
        parts[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    sets = Sets()
    for a in parts:
        for b in range(a):
            shared = len(parts[a] & parts[b])
            if shared >= 0.8 * (len(parts[a]) + len(parts[b]) - shared):
                sets.join(a, b)
    kept = sorted((r.doc_id is None, r.doc_id) for r in nd.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, words int")).collect())
    assert kept == sorted((rows[k][0] is None, rows[k][0]) for k in parts if sets.find(k) == k)
    assert nd.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def kept_by_brute_force(texts):
    parts = []
    for text in texts:
        words = text.lower().split()
        parts.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    sets = Sets()
    for a in range(len(parts)):
        for b in range(a):
            if 5 * min(len(parts[a]), len(parts[b])) >= 4 * max(len(parts[a]), len(parts[b])):
                shared = len(parts[a] & parts[b])
                if shared >= 0.8 * (len(parts[a]) + len(parts[b]) - shared):
                    sets.join(a, b)
    return {k for k in range(len(texts)) if sets.find(k) == k}


def test_near_copies_of_any_length_around_a_hot_passage(spark):
    """Short texts, texts that repeat one passage, and copies among hundreds of texts that share a passage."""
    rng = random.Random(21)
    texts = []

    def add(words, edits):
        texts.append(" ".join(words))
        for _ in range(edits):
            edited = list(words)
            at = rng.randrange(1, len(edited) - 1)
            edited[at if len(edited) > 60 else rng.choice((0, -1))] = "edited"
            texts.append(" ".join(edited))

    for n in [*range(20, 90, 2)] * 2:
        add([rng.choice(WORDS) for _ in range(n)], rng.randrange(3))
    for _ in range(10):
        add([rng.choice(WORDS) for _ in range(15)] * 9 + [rng.choice(WORDS) for _ in range(9)], 1)
    hot = [rng.choice(WORDS) for _ in range(50)]
    for k in range(240):
        own = [rng.choice(WORDS) for _ in range(40)]
        add(hot + own if k % 2 else own + hot, int(k % 12 == 0))
    want = kept_by_brute_force(texts)
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, row int, `d.e` string")
    left = nd.one_of_each(docs)
    got = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and len(want) < len(texts) - 40
    assert want <= got and len(got - want) <= 1, (len(texts), len(want), sorted(got - want))


def brute_vectors(rows):
    sets, links = Sets(), {}
    for k, (vec_id, v, label) in enumerate(rows):
        links[k] = 0
    for a in range(len(rows)):
        for b in range(a):
            (i, v, x), (j, w, y) = rows[a], rows[b]
            if i is None or j is None or x is None or x != y or not v or not w or len(v) != len(w) or None in v or None in w:
                continue
            p, q = np.array(v, float), np.array(w, float)
            if not (np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any()):
                continue
            if p @ q / np.sqrt(p @ p) / np.sqrt(q @ q) >= 0.93:
                links[a] += 1
                links[b] += 1
                sets.join(a, b)
    return links, sets


@pytest.mark.parametrize(("cell", "block"), [(4096, 2048), (12, 5)])
def test_vectors_equal_all_pairs(spark, monkeypatch, cell, block):
    """Also with cells and blocks so small that bits, visitors and several blocks take part."""
    monkeypatch.setattr(em, "CELL_ROWS", cell)
    monkeypatch.setattr(em, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        v = rng.standard_normal(16)
        near = v + rng.standard_normal(16) * 0.08
        rows += [(3 * k, v.astype(np.float32).tolist(), k % 3), (3 * k + 1, near.astype(np.float32).tolist(), k % 3)]
    rows += [(900 + k, rows[0][1], 0) for k in range(20)]
    rows += [(950, None, 1), (951, [0.0] * 16, 1), (952, [float("nan")] * 16, 1), (953, [1.0, None], 1), (954, rows[0][1], None), (955, [], 1), (956, [1.0, 2.0], 0), (957, [2.0, 4.0], 0), (958, [float("inf")] * 16, 0)]
    links, sets = brute_vectors(rows)
    got = {r.vec_id: r for r in em.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    for k, (vec_id, *_) in enumerate(rows):
        assert (got[vec_id].n_links, got[vec_id].component_id) == (links[k], rows[sets.find(k)][0]), vec_id
        assert got[vec_id].kept == (rows[sets.find(k)][0] == vec_id)


def test_vectors_of_many_cells(spark, monkeypatch):
    """Nine bits of cells and pairs just within the threshold."""
    monkeypatch.setattr(em, "CELL_ROWS", 1)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(200):
        v, w = rng.standard_normal((2, 64))
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        near = 0.932 * v + (1 - 0.932**2) ** 0.5 * w / np.linalg.norm(w)
        rows += [(2 * k, v.tolist(), 1), (2 * k + 1, near.tolist(), 1)]
    links, sets = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in em.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (links[k], sets.find(k)) for k in range(len(rows))} and sum(links.values()) == 400


@pytest.mark.parametrize(("cell", "block", "blocks"), [(12, 5, 9), (40, 5, 8), (1, 5, 4), (1 << 20, 1 << 14, 5)])
def test_blocks_meet_once(spark, monkeypatch, cell, block, blocks):
    """Every two blocks share one task, every block is compared with itself in one, and no task has more visitors than its span."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(em, "CELL_ROWS", cell)
    monkeypatch.setattr(em, "BLOCK_ROWS", block)
    sent = spark.range(blocks).select(F.col("id").cast("int").alias("b")).select("b", F.inline(em.meetings(F.col("b"), F.lit(blocks)))).collect()
    tasks, met = {}, []
    for r in sent:
        tasks.setdefault((r.to, r.span), {True: [], False: []})[r.visitor].append(r)
    for (to, _), rows in tasks.items():
        assert [r.b for r in rows[False]] == [to] and len(rows[True]) <= max(1, cell // block)
        met += [(to, r.b) for r in rows[True]] + [(to, to)] * rows[False][0].own
    assert sorted(met) == [(i, j) for i in range(blocks) for j in range(i, blocks)]
    assert sum(r.visitor for r in sent) == blocks * (blocks - 1) // 2


def test_vectors_without_id(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 1), (7, v, 1), (5, [1.0, 2.0, 3.1], 1), (None, [9.0, -1.0, 0.0], 1)]
    got = sorted(map(tuple, em.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (7, 2, 5, False), (5, 2, 5, True), (None, 0, None, False)], key=str)


def test_vectors_of_nothing(spark):
    assert em.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


LINES = "doc_id long, text string, id int"


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog while many people watch it from afar in the park today"
    other = "entirely different content that shares nothing with any of the lines above, at all, in any way"
    rows = [
        (2, f"{base}\nunique second line here\n\n{other}", 1),
        (1, f"  {base.upper()}  \nshort\nfirst document only has this", 1),
        (3, base.replace("afar", "near"), 1),
        (4, f"{other}\nshort\nshort", 1),
        (None, "short", 1),
        (5, None, 1),
        (6, "", 1),
        (7, "日本語の行はここにあります全部同じです\n別の行", 1),
        (8, "日本語の行はここにあります全部同じです", 1),
        (9, " \n\t", 1),
    ]
    docs = spark.createDataFrame(rows, LINES)
    kept = {r.doc_id: (r.text, r._n_removed) for r in ld.without_repeated_lines(docs, keep_emptied=True).collect()}
    assert kept[1] == (rows[1][1], 0) and kept[2] == (f"unique second line here\n\n{other}", 1)
    assert kept[3] == ("", 1) and kept[4] == ("", 3) and kept[None] == ("", 1)
    assert kept[5] == (None, 0) and kept[6] == ("", 0) and kept[7][1] == 0 and kept[8] == ("", 1) and kept[9] == (" \n\t", 0)
    left = ld.without_repeated_lines(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 2, 5, 6, 7, 9}
    assert ld.without_repeated_lines(spark.createDataFrame([], LINES)).count() == 0


def character_runs(form, size=7):
    return {form[k : k + size] for k in range(len(form) - size + 1)} or {form}


def jaccard(a, b):
    a, b = character_runs(a), character_runs(b)
    return len(a & b) / len(a | b)


def test_lines_are_compared_by_all_their_characters(spark):
    """Short, numbered and long-token lines: equal but for what no word starts with."""
    lines = ["chapter 12", "chapter 13", "total amount: 15", "total amount: 99", "the answer is yes", "the answer is no"]
    lines += ["invoice2024000117", "invoice2024999832", "a", "ab", "seven77", "eight888", "日本語の行はここにあります一", "日本語の行はここにあります二"]
    lines += [f"token{'x' * 60}{k}" for k in range(3)] + [f"item number {k} of the list of all items that were sold in the year, by place and by month of sale" for k in (1, 2, 30)]
    pairs = [(a, b) for a in range(len(lines)) for b in range(a)]
    forms = spark.createDataFrame(list(enumerate(lines)), "id long, form string")
    got = {(r.a, r.b) for r in ld.similar(spark.createDataFrame(pairs, "a long, b long"), forms).collect()}
    assert got == {(a, b) for a, b in pairs if jaccard(lines[a], lines[b]) >= 0.8} and got
    docs = spark.createDataFrame([(k, line, 1) for k, line in enumerate(lines[:8])], LINES)
    assert {r.doc_id for r in ld.without_repeated_lines(docs).collect()} == set(range(8))


def line_components(lines):
    """Brute force: smallest index reachable over similar lines."""
    sets = Sets()
    parts = [character_runs(line) for line in lines]
    for a in range(len(lines)):
        for b in range(a):
            shared = len(parts[a] & parts[b])
            if shared >= 0.8 * (len(parts[a]) + len(parts[b]) - shared):
                sets.join(a, b)
    return [sets.find(k) for k in range(len(lines))]


@pytest.mark.parametrize("block", [128, 3])
def test_every_pair_of_a_band_counts(spark, monkeypatch, block):
    """One minimum a band, so that keys hold many clusters; also chains of which only one end is near a leader."""
    monkeypatch.setattr(ld, "BANDS", [[j] for j in range(8)])
    monkeypatch.setattr(ld, "BLOCK", block)
    monkeypatch.setattr(ld, "AGREEING", 1)
    rng = random.Random(6)
    shared = " ".join(rng.choice(WORDS) for _ in range(14))
    lines = []
    for _ in range(12):
        words = f"{shared} {' '.join(rng.choice(WORDS) for _ in range(8))}".split()
        for _ in range(5):
            words[rng.randrange(14, 22)] = rng.choice(WORDS)
            lines.append(" ".join(words))
    lines = sorted({*lines, "short", "short 2", "x" * 50})
    table = spark.createDataFrame([(line,) for line in lines], "form string").selectExpr("xxhash64(form) as id", "form").cache()
    forms = {r.id: r.form for r in table.collect()}
    signs = ld.signatures(table, ["id"]).cache()
    keys = {}
    for r in ld.band_members(signs).collect():
        keys.setdefault(r.key, set()).add(r.id)
    sets = Sets()
    for ids in keys.values():
        for a in ids:
            for b in ids:
                if a < b and jaccard(forms[a], forms[b]) >= 0.8:
                    sets.join(a, b)
    got = {r.id: r.root for r in ld.line_classes(signs, table).collect()}
    assert {k: got.get(k, k) for k in forms} == {k: sets.find(k) for k in forms}
    assert 3 < len(set(got.values())) and len(forms) > len(got)


def test_lines_of_one_template(spark):
    """A family of numbered lines with the parameters of the query: as many are left as brute force leaves."""
    rng = random.Random(7)
    head = "shipment of goods from the warehouse in the north to the customer on the list of the year, number"
    lines = sorted({f"{head} {rng.randrange(10 ** rng.randrange(2, 9))} weight {rng.randrange(10 ** rng.randrange(1, 6))}" + " urgent" * rng.randrange(3) for _ in range(500)})
    lines += [" ".join(rng.choice(WORDS) for _ in range(400)) for _ in range(4)]
    for k in range(4):  # long lines, of which a sample is compared first
        words = lines[-1 - k - k].split()
        for _ in range(4 + 5 * k):
            words[rng.randrange(400)] = "edited"
        lines.append(" ".join(words))
    want = line_components(lines)
    docs = spark.createDataFrame([(k, line, 1) for k, line in enumerate(lines)], LINES)
    kept = {r.doc_id for r in ld.without_repeated_lines(docs).collect()}
    missed = kept - set(want)
    assert set(want) <= kept and len(missed) <= 0.02 * len(lines), (len(set(want)), len(kept))


def test_repeated_rows_long_lines_and_clashing_names(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice(WORDS) for _ in range(20000))
    rows = [(1, "one line of text\n\nanother line\r", 5, "a"), (2, long, 5, "a"), (3, f"\tOne line of text \x0b\n{long}x", 5, "a")]
    rows += [rows[0]] * 3 + [(None, "a line without id", 5, None)] * 2
    schema = "doc_id long, text string, row int, `gone.d` string"
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, ld.without_repeated_lines(docs, keep_emptied=True).collect()), key=str)
    want = [(1, rows[0][1], 5, "a", 0), (2, long, 5, "a", 0), (3, "", 5, "a", 2), (None, "a line without id", 5, None, 0), (None, "", 5, None, 1)] + [(1, "", 5, "a", 2)] * 3
    assert got == sorted(want, key=str)
    left = ld.without_repeated_lines(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == sorted([(1, rows[0][1], 5, "a"), (2, long, 5, "a"), (None, "a line without id", 5, None)], key=str)
    with pytest.raises(ValueError, match="_n_removed"):
        ld.without_repeated_lines(docs.withColumnRenamed("row", "_n_removed"), keep_emptied=True)


def test_staging_leaves_no_shuffle_files(spark):
    """they stayed on disk, stage after stage, until the driver collected its garbage."""

    def left():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getPath() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before = left()
    table = stage(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")))
    assert not left() - before and table.count() == 100
    with passing(spark):
        short = stage(table)
        files = [urlparse(f).path for f in short.inputFiles()]
        long = stage(short, keep=True)
    assert long.count() == 100 and files and not any(map(os.path.exists, files))


def test_equal_lines_are_one_member_of_their_bands(spark, monkeypatch):
    """every occurrence sent its bands."""
    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(k, text) for k in range(50)] + [(50, text + "s")], "doc_id long, text string")
    seen, whole = [], ld.band_members
    monkeypatch.setattr(ld, "band_members", lambda signs: seen.append(signs.count()) or whole(signs))
    rows = ld.without_repeated_lines(docs, keep_emptied=True).collect()
    assert {r.doc_id: r["_n_removed"] for r in rows} == {0: 0} | dict.fromkeys(range(1, 51), 1)
    assert seen == [2]


def test_lines_that_share_a_passage_are_not_all_compared(spark, monkeypatch):
    """Findings r03, op9_linededup: all pairs of lines that share most, but not enough, were joined; so were their cells."""
    rng = random.Random(11)
    head = " ".join(rng.choice(WORDS) for _ in range(24))
    tail = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(len(head) // 6))
    lines = sorted({f"{head} {tail()}" for _ in range(300)})
    lines += [f"{lines[k][:-2]}{k % 10}?" for k in (3, 50, 120)]  # a copy of three of them
    rows, whole = [], cm.stage
    monkeypatch.setattr(cm, "stage", lambda df, keep=False: [out := whole(df, keep), rows.append(out.count())][0])
    table = spark.createDataFrame([(line,) for line in lines], "form string").selectExpr("xxhash64(form) as id", "form").cache()
    got = {r.id: r.root for r in ld.line_classes(ld.signatures(table, ["id"]).cache(), table).collect()}
    ids = {r.form: r.id for r in table.collect()}
    want = line_components(lines)
    assert len(got) == 6 and all((got.get(ids[a], ids[a]) == got.get(ids[b], ids[b])) == (want[k] == want[j]) for k, a in enumerate(lines) for j, b in enumerate(lines))
    assert max(rows) < 40 * len(lines), max(rows)


def test_only_results_stay_staged_and_keys_go_in_slices(spark, monkeypatch):
    """Findings r04, F1 and F2: all members of keys were shuffled at once, and what was staged on the way stayed on disk."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(40)]
    texts += [f"{t} again" for t in texts[:10]] + [f"{t} once more" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = urlparse(cm.shared_dir(spark)).path
    results = {}
    for rows in (cm.SLICE_ROWS, 100):
        monkeypatch.setattr(cm, "SLICE_ROWS", rows)
        for name, run in (("lines", ld.without_repeated_lines), ("texts", nd.one_of_each)):
            before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
            kept = {r.doc_id for r in run(docs).collect()}
            assert len(set(os.listdir(folder)) - before) <= 2
            assert results.setdefault(name, kept) == kept == set(range(40))
    keys = [(k % 30, k) for k in range(90)] + [(k, 1000 + k) for k in range(25, 60)]
    members, seen, whole = spark.createDataFrame(keys, "key long, id long"), [], cm.stage
    monkeypatch.setattr(cm, "stage", lambda df, keep=False: [seen.append(df), whole(df, keep)][1])
    monkeypatch.setattr(cm, "is_small", lambda df: False)
    pairs, more = cm.shared_keys(members)
    assert len(seen) > 2 and {tuple(r) for r in more.collect()} == {(k, i) for k, i in keys if k < 30} and pairs.count() == 0
