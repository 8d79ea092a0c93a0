"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is r times its size takes every document floor(r) times and rounds the rest, a fraction of a copy. Fractions are
rounded by duels: two documents of a source move words between them, at random so that each keeps its expected number, until one of
them has a whole number of copies; the other goes on. So the words of a source stay the same in every duel.

1. Rows that repeat (source, doc_id, size) are one unit with a count, as whole copies can be dealt among them at once.
2. The words of sources (one aggregation), weights by their order, and the level at which targets stop: a source gets its weight times the
   level, three times its size at most; the level rises until all words are shared, one small aggregation a step.
3. A reduction tree: units of a source and of about one size (a power of two) fall by hash into blocks, every block is folded to one unit
   that is still open, the open ones are the next level's units; a hot source is thus as many blocks as it needs. A level is one shuffle
   of narrow rows, written once.
4. When a source has at most ``OPEN`` units of each size they are folded from the largest to the smallest, so what large documents leave is
   taken up by smaller ones, and what is open at last is a small one; it goes to the nearer side. Of ``DRAWS`` draws of this last fold
   that one counts which leaves the smallest rest; this matters for sources of few documents.

All randomness is XXH64 of the units' ids, so reruns and other partitionings agree.

Defined cases: a null source is a source of its own, the last; a null text has no words; documents without words take none; a null doc_id
is an id like others; rows that repeat share their copies, the first of them (any order, as they are equal) get more; texts are counted whole;
tables without words have targets of 0; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import lookup_join, ordered_positions, read_table, stage

#: Weights by the order of sources, the most copies, words.
WEIGHTS, MOST, WORD = (5, 2, 1), 3, r"[^\x20\x09-\x0D]+"
#: Units of a block on average, and units of a source and size that are left to the last fold.
BLOCK, OPEN = 256, 32
#: Draws of the last fold.
DRAWS = 16
#: Rows of one unit that are written by one task.
RUN = 4096


def _key(c: str) -> Column:
    """A string for a join that knows null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("-"))


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) that XXH64 of the parts decides."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def units_of(docs: DataFrame, source: str = "source") -> DataFrame:
    """(key, source, doc_id, size, n), staged: n rows have this source, id and number of words."""
    rows = docs.select(F.col(source).cast("string").alias("source"), "doc_id", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return stage(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("key", _key("source")))


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source, source_size, target), staged: words of each source and its share of all words by weight, ``most`` times its words at most."""
    sizes = units.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = ordered_positions(sizes, [F.col("source").isNull(), "source"], "k")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("key", "source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    level, full = 0.0, -1
    while True:
        # sources that the level fills keep their cap, the others share what is left
        filled = F.col("cap") <= F.col("weight") * level if full >= 0 else F.lit(False)
        row = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(filled, F.col("cap")).otherwise(0)).alias("kept"), F.sum(F.when(filled, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(F.when(filled, 1).otherwise(0)).alias("full")).first()
        if row["full"] == full or not row["open"]:
            break
        level, full = (row["all"] - row["kept"]) / row["open"], row["full"]
    return stage(ranked.select("key", "source", "source_size", F.least(F.col("weight") * level, F.col("cap").cast("double")).alias("target")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(units: Column, seed: Column) -> Column:
    """(open, closed) of an array of units: the one that is left, and the others with ``up`` 0 or 1."""

    def duel(state: Column, other: Column) -> Column:
        def decide(s: Column) -> Column:
            one, two = s["one"], s["two"]
            to_two = F.least(one["words"], two["size"] - two["words"])
            to_one = F.least(two["words"], one["size"] - one["words"])
            # the first gives with the chance that keeps both expectations
            gives = _chance(seed, one["doc_id"], one["size"], two["doc_id"], two["size"]) * (to_two + to_one) < to_one
            both = one["words"] + two["words"]
            leaves = F.when(gives, both <= two["size"]).otherwise(both > one["size"])
            return F.struct(one.alias("one"), two.alias("two"), both.alias("both"), leaves.alias("leaves"), (gives != leaves).alias("up"))

        def settle(d: Column) -> Column:
            gone, stays = F.when(d["leaves"], d["one"]).otherwise(d["two"]), F.when(d["leaves"], d["two"]).otherwise(d["one"])
            words = d["both"] - F.when(d["up"], gone["size"].cast("double")).otherwise(0.0)
            closed = F.struct(gone["doc_id"].alias("doc_id"), gone["size"].alias("size"), gone["n"].alias("n"), d["up"].cast("int").alias("up"))
            return F.struct(_unit(stays, words).alias("open"), F.concat(state["closed"], F.array(closed)).alias("closed"))

        return _let(_let(F.struct(state["open"].alias("one"), other.alias("two")), decide), settle)

    first = F.get(units, F.lit(0))
    plain = F.transform(units, lambda u: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["n"].alias("n"), F.lit(0).alias("up")))
    none = F.slice(plain, F.lit(1), F.lit(0))
    start = F.struct(_unit(first, first["words"]).alias("open"), none.alias("closed"))
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), start, duel)


def _unit(u: Column, words: Column) -> Column:
    return F.struct(u["order"].alias("order"), u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["n"].alias("n"), words.alias("words"))


def _folded(units: DataFrame, by: list[str], order: Column, seed: int, draws: int = 1) -> DataFrame:
    """The groups ``by`` of (key, class, doc_id, size, n, words), each folded in ``order``; of several draws that which leaves the smallest rest."""

    def draw(k: Column) -> Column:
        def judged(f: Column) -> Column:
            open_ = f["open"]
            return F.struct(F.abs(open_["words"] - F.when(open_["words"] * 2 >= open_["size"], open_["size"]).otherwise(0)).alias("rest"), k.alias("k"), f.alias("f"))

        return _let(_fold(F.col("units"), F.lit(seed) + k), judged)

    element = F.struct(order.alias("order"), "doc_id", "size", "n", "words")
    gathered = units.groupBy(*by).agg(F.sort_array(F.collect_list(element)).alias("units"))
    return stage(gathered.select(*by, F.array_min(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), draw))["f"].alias("f")))


def _closed(folded: DataFrame) -> DataFrame:
    return folded.select("key", F.explode("f.closed").alias("u")).select("key", "u.doc_id", "u.size", "u.n", "u.up")


def round_fractions(units: DataFrame, seed: int) -> DataFrame:
    """(key, doc_id, size, n, up) of staged open units (key, doc_id, size, n, words): 1 or 0 more copies, words of a key kept but for the last unit's rest."""
    done = []
    sized = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    units = units.select("key", sized.alias("class"), "doc_id", "size", "n", "words")
    level = 0
    while True:
        many = stage(units.groupBy("key", "class").agg(F.count("*").alias("count")).where(f"count > {OPEN}"))
        if many.isEmpty():
            break
        blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.lit(OPEN // 2)).cast("long")
        known = lookup_join(units, many.select("key", "class", blocks.alias("blocks")), ["key", "class"], "left")
        known = known.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size"), F.col("blocks")))
        folded = _folded(known.where("blocks is not null"), ["key", "class", "block"], F.xxhash64(F.lit(-seed), "doc_id", "size"), seed + level)
        done.append(_closed(folded))
        left = folded.select("key", "class", "f.open.doc_id", "f.open.size", "f.open.n", "f.open.words")
        units = stage(left.unionByName(known.where("blocks is null").select(*left.columns)))
        level += 1
    # the largest first
    last = _folded(units, ["key"], F.struct((-F.col("class")).alias("c"), F.xxhash64(F.lit(-seed), "doc_id", "size").alias("h")), -seed * 1000, DRAWS)
    done.append(_closed(last))
    done.append(last.select("key", "f.open.doc_id", "f.open.size", "f.open.n", (F.col("f.open.words") * 2 >= F.col("f.open.size")).cast("int").alias("up")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _with_shares(units: DataFrame, shares: DataFrame) -> DataFrame:
    """``units`` with their source's columns: copies that every row takes (base), further whole copies of the n rows (whole), what is left (part)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = lookup_join(units, shares, ["key"]).withColumn("base", F.floor(rate).cast("long"))
    part = F.when(F.col("size") > 0, (rate - F.col("base")) * F.col("n")).otherwise(0.0)
    return known.withColumn("whole", F.floor(part).cast("long")).withColumn("part", part - F.floor(part))


def _rows(units: DataFrame) -> DataFrame:
    """One row for each of the n rows of a unit, numbered by ``k``; units of many rows are dealt over tasks."""
    few = units.where(F.col("n") <= RUN).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    runs = units.where(F.col("n") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}")))).repartition("key", "doc_id", "size", "run")
    return few.unionByName(runs.withColumn("k", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1))).drop("run"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 23, source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of ``docs``."""
    units = units_of(docs, source)
    shares = targets(units, weights, most)
    known = stage(_with_shares(units.drop("source"), shares).select("key", "doc_id", "size", "n", "part"))
    rounded = round_fractions(known.where("part > 0").withColumn("words", F.col("part") * F.col("size")).drop("part"), seed)
    every = rounded.unionByName(known.where("part = 0").select("key", "doc_id", "size", "n", F.lit(0).alias("up")))
    rows = _rows(_with_shares(every, shares).withColumn("more", F.col("whole") + F.col("up")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.when(F.col("k") < F.col("more"), 1).otherwise(0)).alias("copies"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
