import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from inkspan.llm import mixing as mx
from inkspan.llm import turns as tn
from inkspan.llm import whitening as wh
from inkspan.llm.queries import ORACLE_SQL

# Mixing ---------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, key string, n int"


def chained(seed, *longs):
    """Spark's xxhash64 of an int and longs."""
    h = xxhash.xxh64(struct.pack("<i", seed), 42).intdigest()
    for v in longs:
        h = h if v is None else xxhash.xxh64(struct.pack("<q", v), h).intdigest()
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_fold(units, seed):
    """units: [doc_id, size, n, words]; (the open one, [(unit, up)])."""
    one, closed = units[0], []
    for two in units[1:]:
        to_two, to_one = min(one[3], two[1] - two[3]), min(two[3], one[1] - one[3])
        chance = (chained(seed, one[0], one[1], two[0], two[1]) >> 11) * 2.0**-53
        gives = chance * (to_two + to_one) < to_one
        both = one[3] + two[3]
        leaves = both <= two[1] if gives else both > one[1]
        up = gives != leaves
        gone, stays = (one, two) if leaves else (two, one)
        closed.append((gone, int(up)))
        one = (*stays[:3], both - (gone[1] if up else 0.0))
    return one, closed


def plain_mix(rows, seed=23):
    """{(doc_id, source, size): copies of its rows, most first} by the same duels, in plain Python."""
    units = Counter((r[2], r[0], sum(1 for w in __import__("re").finditer(mx.WORD, r[1] or ""))) for r in rows)
    sizes = Counter()
    for (source, _, size), n in units.items():
        sizes[source] += size * n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: float(mx.WEIGHTS[k % 3]) for k, s in enumerate(order)}
    capped: set = set()
    while True:
        left, open_ = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(w for s, w in weights.items() if s not in capped)
        level = left / open_ if open_ else 0.0
        more = {s for s in order if 3 * sizes[s] <= weights[s] * level}
        if more == capped or not open_:
            break
        capped = more
    target = {s: 3.0 * sizes[s] if s in capped else weights[s] * level for s in order}
    taken, open_units = {}, defaultdict(list)
    for (source, doc_id, size), n in units.items():
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        part = (rate - math.floor(rate)) * n if size else 0.0
        taken[doc_id, source, size] = [math.floor(rate), math.floor(part), n]
        if part - math.floor(part) > 0:
            open_units[source].append((doc_id, size, n, (part - math.floor(part)) * size))
    key = lambda u: signed(chained(-seed, u[0], u[1]))
    tie = lambda u: (u[0] is not None, u[0] or 0, u[1])
    for source, found in open_units.items():
        classes, level = defaultdict(list), 0
        for u in found:
            classes[math.floor(math.log(u[1]) / math.log(2))].append(u)
        while any(len(c) > mx.OPEN for c in classes.values()):
            for c, members in classes.items():
                if len(members) > mx.OPEN:
                    blocks, count = defaultdict(list), max(math.ceil(len(members) / mx.BLOCK), mx.OPEN // 2)
                    for u in members:
                        blocks[signed(chained(seed + level, u[0], u[1])) % count].append(u)
                    classes[c] = []
                    for block in blocks.values():
                        one, closed = plain_fold(sorted(block, key=lambda u: (key(u), tie(u))), seed + level)
                        classes[c].append(one)
                        for u, up in closed:
                            taken[u[0], source, u[1]][1] += up
            level += 1
        last = sorted(((-c, key(u), tie(u), u) for c, members in classes.items() for u in members))
        draws = []
        for k in range(mx.DRAWS):
            one, closed = plain_fold([u for *_, u in last], -seed * 1000 + k)
            up = int(one[3] * 2 >= one[1])
            draws.append((abs(one[3] - up * one[1]), k, [*closed, (one, up)]))
        for u, up in min(draws)[2]:
            taken[u[0], source, u[1]][1] += up
    return {k: [base + (i < more) for i in range(n)] for k, (base, more, n) in taken.items()}, target


def mixed_docs():
    rng = random.Random(4)
    rows = [(k, "w " * rng.choice([1, 2, 3, 30, 31, 200, rng.randrange(1, 60)]), rng.choice(["hot"] * 4 + ["a", "b", "ç", None]), "x", 1) for k in range(900)]
    rows += [(None, None, None, None, None), (None, "", "a", "x", 1), (2000, "\x0b tab\tand more \x1c", "b", "x", 1), (2001, "long " * 50_000, "long", "x", 1), (2002, "few words", "small", "x", 1)]
    rows += [(7, "the same row", "rep", "x", 1)] * 9 + [(None, "no id", "rep", "x", 1)] * 5 + [(3000, "", "empty", "x", 1)]
    return rows


def test_mix_equals_plain_duels(spark, monkeypatch):
    monkeypatch.setattr(mx, "RUN", 4)
    rows = mixed_docs()
    out = mx.mix(spark.createDataFrame(rows, DOCS)).collect()
    expected, target = plain_mix(rows)
    got = defaultdict(list)
    for r in out:
        got[r.doc_id, r.source, r.size].append(r.copies)
    assert {k: sorted(v, reverse=True) for k, v in got.items()} == expected
    assert max(max(v) for v in expected.values()) == 3
    words = Counter()
    for r in out:
        words[r.source] += r.copies * r.size
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
    assert abs(words["hot"] - target["hot"]) < 2
    assert words["empty"] == 0 and sum(target.values()) == pytest.approx(sum(r.size for r in out))
    again = mx.mix(spark.createDataFrame(rows, DOCS).repartition(9)).collect()
    assert Counter(again) == Counter(out)


def test_mix_keeps_expectations():
    """Over many seeds a unit goes up as often as its fraction says."""
    units = [(k, size, 1, size * part) for k, (size, part) in enumerate([(10, 0.3), (3, 0.5), (40, 0.8), (7, 0.1), (1, 0.6)])]
    ups, runs = Counter(), 4000
    for seed in range(runs):
        one, closed = plain_fold(units, seed)
        assert sum(u[1] * up for u, up in closed) + one[3] == pytest.approx(sum(u[3] for u in units))
        for u, up in closed:
            ups[u[0]] += up
        ups[one[0]] += one[3] / one[1]
    for k, size, _, words in units:
        assert ups[k] / runs == pytest.approx(words / size, abs=0.03)


def test_mix_of_nothing(spark):
    assert mx.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert [(r.target, r.copies) for r in mx.mix(spark.createDataFrame([(1, " ", "a", "", 1), (2, None, None, "", 1)], DOCS)).collect()] == [(0.0, 0)] * 2
    assert [r.copies for r in mx.mix(spark.createDataFrame([(1, "a b", "a", "", 1)], DOCS)).collect()] == [1]


# Whitening ------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n int, whitened string"


def exact_parts(vectors):
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    cov = [[(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j]) / n**2 for j in range(d)] for i in range(d)]
    return x, n, sums, np.array(cov)


def whitened(spark, rows, most=8):
    df = spark.createDataFrame(rows, VECTORS)
    return wh.whiten(df, most).collect()


def test_whitening_against_exact_integers(spark):
    rng = np.random.default_rng(5)
    mixing = rng.normal(size=(12, 12)) * np.logspace(0, -2, 12)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(300, 12)) @ mixing + 3.0] + [[0.5] * 12] * 100
    rows = [(k, v, 1, "x") for k, v in enumerate(good)]
    odd = [(1000, None, 1, "x"), (1001, [], 1, "x"), (1002, [float("nan")] + [1.0] * 11, 1, "x"), (1003, [float("-inf")] + [1.0] * 11, 1, "x"), (1004, [None] + [1.0] * 11, 1, "x"), (1005, [1.0] * 11, 1, "x")]
    out = whitened(spark, rows + odd)
    x, n, sums, cov = exact_parts(good)
    assert sorted(r.vec_id for r in out) == list(range(400)) and {r.n for r in out} == {400}
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    plain = (np.array([[v - s / n for v, s in zip(r, sums, strict=True)] for r in x]) @ vectors) / np.sqrt(values)
    by = {r.vec_id: r for r in out}
    got = np.array([by[k].whitened for k in range(400)])
    signs = np.sign((got * plain).sum(axis=0))
    assert np.allclose(got, plain * signs, rtol=1e-6, atol=1e-8)
    assert np.allclose(out[0].explained, values / np.trace(cov), rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in out)
    centred = got - got.mean(axis=0)
    assert np.abs(centred.T @ centred / n - np.eye(8)).max() < 1e-9
    for k in (0, 17, 399):
        exact = sum((n * v - s) ** 2 for v, s in zip(x[k], sums, strict=True))
        assert by[k].deviation == exact and by[k].deviation_exact == str(exact)


def test_scatter_of_any_size():
    rng = np.random.default_rng(2)
    for high in (10, 1 << 20, 1 << 40, 1 << 61):
        x = rng.integers(-high, high, size=(9000 if high < 1 << 30 else 50, 3))
        n, sums, products = wh.scatter(x)
        whole = x.astype(object)
        assert n == len(x) and (sums == whole.sum(axis=0)).all() and (products == whole.T.dot(whole)).all()


def test_whitening_of_odd_tables(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, [1.0, 2.0], 1, "x")]) == [] and whitened(spark, [(k, [1.0, 2.0], 1, "x") for k in range(5)]) == []
    out = whitened(spark, [(None, [0.0, 1.0, 1.0], 1, "x"), (2, [1.0, 1.0, 1.0], 1, "x"), (2, [1.0, 1.0, 1.0], 1, "x")])
    assert {len(r.whitened) for r in out} == {1} and out[0].explained == [pytest.approx(1.0)] and {r.vec_id for r in out} == {None, 2}
    far = whitened(spark, [(1, [3e38, 0.0], 1, "x"), (2, [-3e38, 1.0], 1, "x")])
    assert {r.deviation for r in far} == {None} and all(int(r.deviation_exact) > 1 << 63 for r in far)
    assert whitened(spark, [(1, [1.0], 1, "x"), (2, [2.0, 3.0], 1, "x"), (3, [2.0, 4.0], 1, "x")])[0].n == 2


# Conversations --------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, seg long, pos string"


def faults(rows):
    """b, d, t or nothing for each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(tn.SPACE)
        out.append("b" if not shown else "d" if (role, text) in seen else "" if shown[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def every_repair(rows):
    """The least (cost, audit, lines) of all edits of a short conversation, tried one by one."""
    kinds, best = faults(rows), None
    fills = ["", "u", "a", "ua", "au"]
    names = {"u": "user", "a": "assistant"}
    options = [["D"] + ([] if k in ("b", "d") else ["K"] * bool(role) + ["Ru", "Ra"]) for k, (role, _) in zip(kinds, rows, strict=True)]
    for edits in itertools.product(*options):
        for inserted in itertools.product(fills, repeat=len(rows) + 1):
            cost, audit, roles, lines = 0, "", "", []
            for (role, text), kind, edit, fill in zip(rows + [("", "")], kinds + [""], [*edits, ""], inserted, strict=True):
                cost, audit, roles = cost + 3 * len(fill), audit + "I" * len(fill), roles + fill
                lines += [f"{names[c]}:" for c in fill]
                if edit == "D":
                    cost, audit = cost + 4, audit + "D"
                elif edit:
                    cost += (3 if kind == "t" else 0) + (3 if edit[0] == "R" else 0)
                    audit += edit[0]
                    roles += role[:1] if edit == "K" else edit[1]
                    lines.append(f"{role if edit == 'K' else names[edit[1]]}:{text}")
            body = roles[1:] if roles.startswith("s") else roles
            if (body == "ua" * (len(body) // 2) and (body or not roles)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def reported(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    return {r.conv_id: r for r in tn.report(df, df).collect()}


def test_repairs_against_all_edits(spark):
    rng = random.Random(8)
    roles, texts = ["system", "user", "assistant", "User", "", "a"], ["Fine.", "Cut", "", " \t", "Why? ", "Done!"]
    convs = {c: [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(0, 4))] for c in range(120)}
    convs[5] = [("user", "Hi."), ("user", "Hi."), ("assistant", "Yes")]
    got = reported(spark, [(c, k, role, text, 1, "x") for c, found in convs.items() for k, (role, text) in enumerate(found)])
    for c, found in convs.items():
        if found:
            cost, audit, lines = every_repair(found)
            kinds = Counter(faults(found))
            pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(found)]
            r = got[c]
            assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), found
            assert (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps) == (kinds["b"], kinds["d"], kinds["t"], sum(p not in ("su", "ua", "au") for p in pairs), 0)


def odd_turns():
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["One.", "Two", "", f"{k}!"]), 1, "x") for k in range(700)]
    rows += [(2, None, None, None, None, None), (2, None, "user", "Hi.", 1, "x"), (2, 5, "user", None, 1, "x"), (2, -3, "assistant", "Ok.", 1, "x"), (2, -3, "assistant", "A tie.", 1, "x")]
    rows += [(None, 0, "user", "No id.", 1, "x"), (None, 1, "assistant", "word " * 60_000 + ".", 1, "x"), (3, None, "user", "  ", 1, "x"), (4, 9, "user", "a:b\nc.", 1, "x"), (4, 12, "assistant", " ", 1, "x")]
    rows += [(5, 0, "user", "Same.", 1, "x")] * 5 + [(c, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.", 1, "x") for c in range(10, 90) for k in range(6)]
    return rows


@pytest.mark.parametrize("batch", [tn.BATCH, 256])
def test_repairs_against_sql(spark, monkeypatch, batch):
    """Long conversations in segments, nulls, ties, repeated rows: the rows of the SQL, which goes through whole conversations."""
    monkeypatch.setattr(tn, "BATCH", batch)
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = [tuple(r) for r in tn.report(tn.damage(df), df).collect()]
    with duckdb.connect() as db:
        frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "seg", "pos"])
        db.register("conversations", pa.Table.from_pylist([{k: None if v is None or v != v else v for k, v in r.items()} for r in frame.astype(object).to_dict("records")], pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
        columns = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
        expected = db.sql(f"SELECT {columns} FROM ({ORACLE_SQL['op13_turns']})").fetchall()
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=order) == sorted(expected, key=order) and len(got) == len({r[0] for r in rows})


def test_damage_and_repaired_turns(spark):
    rows = [(c, k, "assistant", "Some. Text", 1, "x") for c in range(40) for k in range(3)]
    df = spark.createDataFrame(rows, TURNS)
    expected = Counter()
    for c, k, role, text, *_ in rows:
        kind = zlib.crc32(f"{c}:{k}".encode()) % 20
        if kind:
            expected[c, k, "user" if kind == 4 else role, "" if kind == 1 else "Some Text" if kind == 2 else text] += 2 if kind == 3 else 1
    assert Counter(tuple(r) for r in tn.damage(df).collect()) == expected
    repaired = defaultdict(list)
    for r in tn.repair(df).collect():
        if r.edit != "D":
            repaired[r.conv_id].append((r.place, r.role[:1]))
    for places in repaired.values():
        assert [p for p, _ in sorted(places)] == list(range(len(places))) and "".join(c for _, c in sorted(places)) == "ua" * (len(places) // 2)


def test_conversations_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert tn.report(tn.damage(empty), empty).count() == 0 and tn.repair(empty).count() == 0
    one = spark.createDataFrame([(7, 0, "user", "Gone.", 1, "x")], TURNS)
    assert [tuple(r) for r in tn.report(one.limit(0), one).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
