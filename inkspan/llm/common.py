"""Shared pieces of the corpus operators: staging, ordered positions, lookups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkspan.saving import write_clean

#: Rows up to which a counted side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: The same for a side that is one column of longs (some 20 MB as a hash table).
BROADCAST_KEYS = 500_000
#: Bytes of strings and arrays that a broadcast side may hold in all.
BROADCAST_BYTES = 24 << 20
#: Members of keys, or parts of forms, that are shuffled at once (some 23 bytes each), and into how many slices they are cut at most.
SLICE_ROWS, SLICES = 2_000_000, 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one if the session is local too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = f"file://{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", local)
    return local


#: Folders that the passing() blocks that are open have staged.
_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what was staged in it without ``keep``; blocks may lie in one another."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, keep: int = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage, so a lost executor costs no more than the reading of a file again. The shuffle files of the write
    go with it. It stays for the ``passing`` block that is ``keep`` levels further out.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkspan-{uuid.uuid4().hex}"
    if len(_PASSING) > keep:
        _PASSING[-1 - keep].append(path)
    write_clean(spark, df.write, path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete what stage() wrote for this application; call it when no result is needed any more."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "inkspan-*")) or []:
        fs.delete(status.getPath(), True)


def is_small(df: DataFrame) -> bool:
    """Whether a staged table may be broadcast: few rows, of numbers, short strings and short arrays of numbers, by count and bytes.

    The count comes from the file footers; bytes are summed only where it is low.
    """
    kinds = [t for _, t in df.dtypes]
    numbers = {f"array<{t}>" for t in ("int", "bigint", "double")}
    if any(t.startswith(("array", "map", "struct", "binary")) and t not in numbers for t in kinds):
        return False
    if df.count() > (BROADCAST_KEYS if kinds == ["bigint"] else BROADCAST_ROWS):
        return False
    wide = [F.octet_length(c) if t == "string" else 8 * F.size(c) for c, t in df.dtypes if t == "string" or t in numbers]
    if not wide:
        return True
    return (df.agg(F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0)))).first()[0] or 0) <= BROADCAST_BYTES


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", hint: str = "merge") -> DataFrame:
    """Join with a staged ``small`` side: broadcast if it is small by its counts, else a shuffled join (AQE splits hot keys)."""
    if is_small(small):
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint(hint), on, how)


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed: equal for rows that repeat wholly."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t))


def packed(docs: DataFrame, *extra: Column) -> DataFrame:
    """(d, ...): the columns of ``docs`` in one struct, so that working columns beside it can't clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), *extra)


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that packed() put into ``d``; ``new`` takes the place of those of its names."""
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"d.`{c}`") for c in columns), *(v.alias(c) for c, v in new.items() if c not in columns))


def ordered_positions(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """``df`` with a gapless 0-based position ``out`` (long) in the global order.

    One range shuffle; every task sorts its own range. Only the row count of each range is
    gathered (one row for a partition), so no task sees more than its range. ``order`` should end
    in columns that tell rows apart; equal rows are interchangeable.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    tagged = stage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return tagged.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_row")).drop("_mid", "_part", "_row", "_before")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (u, v: long or string) the smallest node reachable.

    Large-star and small-star steps alternate until the set of links stays the same; each step is
    one aggregation by node (pre-aggregated before its shuffle) and one join that AQE can split
    for hub nodes. Every round is staged, so lineage stays short.
    """
    links = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _fingerprint(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = stage(small)
        old, mark = mark, _fingerprint(links)
        if old == mark:
            break
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def shared_keys(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): both ends of the keys that two of the ``members`` (key, id) hold; (key, id): members of the keys that more of them hold.

    Most keys have one member, so members are shuffled in slices of the keys, of which one at a time lies on disk.
    """
    n = max(1, min(SLICES, members.count() // SLICE_ROWS))
    parts = [members.where(F.pmod("key", F.lit(n)) == k) for k in range(n)] if n > 1 else [members]
    held = [stage(part.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("a < b")) for part in parts]
    keys = stage(reduce(DataFrame.unionByName, held).where("n > 2").select("key"))
    if is_small(keys):
        more = stage(members.join(F.broadcast(keys), "key", "left_semi").distinct(), keep=True)
    else:
        some = [stage(part.join(own.where("n > 2").select("key").hint("shuffle_hash"), "key", "left_semi").distinct(), keep=True) for part, own in zip(parts, held, strict=True)]
        more = reduce(DataFrame.unionByName, some)
    return stage(reduce(DataFrame.unionByName, held).where("n = 2").select("a", "b").distinct(), keep=True), more


def _with_leaders(members: DataFrame) -> DataFrame:
    """Distinct (lead, id): the members of each key with the one that shares most.

    The weight of a member is the sum of its keys' sizes; an original has more of it than its copies, which are all like the
    original but not like one another.
    """
    sizes = stage(members.groupBy("key").agg(F.count("*").alias("n")))
    weights = stage(lookup_join(members, sizes, ["key"]).groupBy("id").agg(F.sum("n").alias("weight")))
    lead = stage(lookup_join(members, weights, ["id"]).groupBy("key").agg(F.max(F.struct("weight", "id")).getField("id").alias("lead")))
    return stage(lookup_join(members, lead, ["key"]).where("id <> lead").select("lead", "id").distinct())


def _rare_parts(apart: DataFrame) -> DataFrame:
    """(part, pair, id, root, linked, m, n, ahead, near): the parts of ``apart`` that two forms of one leader cannot but share if they are similar.

    ``apart`` (pair, lead, id, root, n_lead, n, linked, apart) has the parts in which a form x of n parts and its leader L differ, S(x).
    Forms x and y are similar (0.8) if S(x) and S(y) differ in at most (|x| + |y|) / 9 parts, and L and y are not linked if |S(y)| is
    over (|L| + |y|) / 9. So x shares over (|S(x)| + (|L| - |x|) / 9) / 2 parts of S(x) with such a y, and |S(x)| - |x| / 4 at
    least with any. Where that many must be shared, one of them is among the others and one more, the rarest of a leader's forms first.
    ``near`` tells the parts for forms that are not linked; the rest is for those that are. ``ahead`` of m parts follow, itself included. Parts of one component (root) alone need no look.
    """
    each = apart.select(F.explode("apart").alias("t"), "lead", "pair", "linked", "root").select(F.xxhash64("lead", "t").alias("part"), "pair", "linked", "root")
    often = each.groupBy("part").agg(F.count("*").alias("f"), F.sum(F.col("linked").cast("int")).alias("l"), F.min("root").alias("low"), F.max("root").alias("high"))
    often = stage(often.where("f > l and low <> high").select("part", "f", (F.col("l") > 0).alias("l")))
    held = lookup_join(each.select("part", "pair"), often, ["part"], hint="shuffle_hash").groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("f", "part", "l"))).alias("p"))
    sizes = stage(apart.select("pair", "id", "root", "linked", "n_lead", "n", F.size("apart").alias("m")))
    ranked = lookup_join(held, sizes, ["pair"]).withColumn("any", F.expr("greatest(1, cast(ceil(m - n / 4) as int))"))
    ranked = ranked.withColumn("far", F.expr("greatest(any, cast(floor((9 * m + n_lead - n) / 18) as int) + 1)"))
    first = F.expr("slice(p, 1, greatest(0, size(p) - if(linked, far, any) + 1))")
    ranked = ranked.select("pair", "id", "root", "linked", "m", "n", F.expr("size(p) - far").alias("near"), F.size("p").alias("of"), F.posexplode(first).alias("at", "p"))
    ranked = ranked.select("p.part", "pair", "id", "root", "linked", "m", "n", (F.col("of") - F.col("at")).alias("ahead"), (F.col("at") <= F.col("near")).alias("near"), F.col("p.l").alias("l"))
    return ranked.where("near or l").drop("l")


def band_links(pairs: DataFrame, members: DataFrame, compare: Callable[[DataFrame], DataFrame], block: int, rounds: int) -> DataFrame:
    """(a, b): links that connect all similar ones of the ``pairs`` (a, b) and of those that share a key of ``members`` (key, id).

    ``compare`` gives (lead, id, grouped, n_lead, n, linked, apart) for (lead, id, grouped). Members of a key are compared with the one that
    shares most. Two of them that are not both linked with it can be similar only if they share parts in which they differ from it; by
    these, the rarest first, the pairs of different components are found, and decided without another look at the texts. Where over
    ``block`` forms share such a part it is a key of its own with another leader, ``rounds`` times.
    """
    spark, links, lone = members.sparkSession, None, pairs.select(F.col("a").alias("lead"), F.col("b").alias("id"), F.lit(False).alias("grouped"))
    for turn in range(rounds + 1):
        with passing(spark):
            with passing(spark):
                with passing(spark):
                    tried = _with_leaders(members).withColumn("grouped", F.lit(True))
                    if not turn:
                        tried = tried.unionByName(lone).groupBy("lead", "id").agg(F.max("grouped").alias("grouped"))
                    met = stage(compare(stage(tried)), keep=1)
                found = stage(met.where("linked").select(F.col("lead").alias("a"), F.col("id").alias("b")), keep=2)
                links = found if links is None else links.unionByName(found)
                with passing(spark):
                    roots = stage(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id"), keep=1)
                # the arrays of parts are moved for the groups alone that are looked at
                met = met.where("grouped").drop("grouped")
                named = lookup_join(met.select("lead", "id", "linked"), roots, ["id"], "left", "shuffle_hash").withColumn("root", F.coalesce("root", "id"))
                groups = named.groupBy("lead").agg(F.count("*").alias("n"), F.sum(F.col("linked").cast("int")).alias("l"), F.min("root").alias("low"), F.max("root").alias("high"))
                groups = stage(groups.where("n > l and low <> high").select("lead"))
                if groups.isEmpty():
                    return links
                apart = lookup_join(lookup_join(met, groups, ["lead"], "left_semi"), roots, ["id"], "left", "shuffle_hash").withColumn("root", F.coalesce("root", "id"))
                apart = stage(apart.withColumn("pair", F.xxhash64("lead", "id")), keep=1)
            # parts are those of one leader, so leaders go in slices, of which one at a time lies on disk
            n = max(1, min(SLICES, (apart.agg(F.sum(F.size("apart"))).first()[0] or 0) // SLICE_ROWS))
            wide = []
            for k in range(n):
                own = apart.where(F.pmod(F.xxhash64("lead"), F.lit(n)) == k) if n > 1 else apart
                with passing(spark):
                    with passing(spark):
                        parts = stage(_rare_parts(own))
                        spans = stage(parts.groupBy("part").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("part", "held"))
                        parts = stage(lookup_join(parts, spans, ["part"], hint="shuffle_hash"), keep=1)
                    links = links.unionByName(stage(_decided(parts if turn == rounds else parts.where(F.col("held") <= block), own), keep=2))
                    if turn < rounds:
                        wide.append(stage(parts.where(F.col("held") > block).select(F.col("part").alias("key"), "id").distinct(), keep=2))
            if turn == rounds or all(w.isEmpty() for w in wide):
                return links
            members = reduce(DataFrame.unionByName, wide)
    return links


def _decided(parts: DataFrame, apart: DataFrame) -> DataFrame:
    """(a, b): the similar ones of the pairs that share a part and are of different components, by what of ``apart`` they share.

    From the first part that similar forms share, as many must be left of both as they must share.
    """
    left = parts.select("part", "pair", "root", "linked", "m", "n", "ahead", "near")
    right = left.select("part", *(F.col(c).alias(f"r{c}") for c in left.columns if c != "part"))
    both = left.join(right.hint("merge"), "part").where("root <> rroot and pair < rpair and not (linked and rlinked) and (linked or rlinked or (near and rnear)) and 9 * abs(m - rm) <= n + rn and 9 * (m + rm) - (n + rn) <= 18 * least(ahead, rahead)")
    both = stage(both.select("pair", "rpair").distinct())
    sides = apart.select("pair", "id", "n", "apart")
    both = lookup_join(both, sides, ["pair"], hint="shuffle_hash")
    both = lookup_join(both, sides.select(*(F.col(c).alias(f"r{c}") for c in sides.columns)), ["rpair"], hint="shuffle_hash")
    both = both.select("id", "rid", (F.col("n") + F.col("rn")).alias("s"), (F.size("apart") + F.size("rapart") - 2 * F.size(F.array_intersect("apart", "rapart"))).alias("d"))
    return both.where("10 * (s - d) >= 8 * (s + d)").select(F.col("id").alias("a"), F.col("rid").alias("b"))


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]
