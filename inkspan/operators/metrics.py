"""Ranking evaluation: hits at k, reciprocal rank, upper median, miss causes, nDCG, movement, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.operators.order import better, order_statistics, with_all

#: Scores are summed in any order, so ranks go by scores rounded to so many places.
RANK_PLACES = 9
CUTS = (5, 10, 20, 50, 100, 200, 500, 1000)
EPSILON = 1e-9


def upper_median(value: Column) -> Column:
    """The element at floor(n / 2) of the sorted values, nulls left out; null if there are none."""
    ranked = F.sort_array(F.collect_list(value))
    return F.when(F.count(value) > 0, F.get(ranked, F.floor(F.size(ranked) / 2).cast("int")))


def rank_at(value: Column, share: float) -> Column:
    """The element at floor(n * share) of the sorted values (the last one at most)."""
    ranked = F.sort_array(F.collect_list(value))
    return F.get(ranked, F.least(F.floor(F.size(ranked) * share), F.size(ranked) - 1).cast("int"))


def first_ranks(queries: DataFrame, note_ranks: DataFrame, relevance: DataFrame, limit: int) -> DataFrame:
    """For each query the rank of its first relevant note: deep_rank (no cut), rank (null beyond ``limit`` notes' chunks) and the same for grade 2.

    ``note_ranks``: (key, path, rank, pos) with pos the position of the note's first chunk.
    """
    hits = note_ranks.join(relevance.select("key", "path", "grade"), ["key", "path"])
    inside = F.col("pos") <= limit
    best = hits.groupBy("key").agg(
        F.min("rank").alias("deep_rank"),
        F.min(F.when(inside, F.col("rank"))).alias("rank"),
        F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("deep_rank_exact"),
        F.min(F.when(inside & (F.col("grade") >= 2), F.col("rank"))).alias("rank_exact"),
    )
    return queries.select("key", "kind").join(best, "key", "left")


def ranks_by_counting(scored: DataFrame, places: DataFrame, queries: DataFrame, relevance: DataFrame, limit: int) -> DataFrame:
    """The same as ``first_ranks`` from scores (key, id, score) of all matching chunks and their places (id, path, start_line), without ordering them.

    The best relevant chunk of a query is a minimum; its rank is one more than the notes that have a better chunk, its position one more than
    the better chunks. Both are sums that map tasks begin; only chunks that score as high as the best relevant one meet their places.
    """
    best = ("path", "start_line", "id")
    wanted = places.join(relevance.groupBy("path", "key").agg(F.max("grade").alias("grade")), "path")
    order = better(F.col("score"), RANK_PLACES, *best)
    hits = scored.join(wanted, ["key", "id"]).select("key", order.alias("o"), "grade")
    marks = hits.groupBy("key").agg(F.min("o").alias("any"), F.min(F.when(F.col("grade") >= 2, F.col("o"))).alias("exact"))
    # a relevant chunk of grade 2 is a relevant one, so it cannot rank before the best
    far = marks.withColumn("far", F.coalesce("exact", "any"))
    reach = scored.join(far, "key").where(-F.round("score", RANK_PLACES) <= F.col("far.s")).join(places, "id").withColumn("o", order).where("o < far")
    return ranks_of_marks(marks, reach, queries, limit)


def ranks_of_marks(marks: DataFrame, reach: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``first_ranks`` from the best relevant chunks (key, any, exact) and the chunks (key, path, o, any, exact) that may rank before them."""
    of_note = reach.groupBy("key", "path").agg(F.sum(F.when(F.col("o") < F.col("any"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("o") < F.col("exact"), 1).otherwise(0)).alias("e"))
    count = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    ahead = of_note.groupBy("key").agg(count("a").alias("notes"), F.sum("a").alias("chunks"), count("e").alias("notes_exact"), F.sum("e").alias("chunks_exact"))
    both = marks.join(ahead, "key", "left")
    rank = lambda c: (F.coalesce(c, F.lit(0)) + 1).cast("int")
    exact = F.col("exact").isNotNull()
    out = both.select(
        "key",
        rank("notes").alias("deep_rank"),
        F.when(rank("chunks") <= limit, rank("notes")).alias("rank"),
        F.when(exact, rank("notes_exact")).alias("deep_rank_exact"),
        F.when(exact & (rank("chunks_exact") <= limit), rank("notes_exact")).alias("rank_exact"),
    )
    return queries.select("key", "kind").join(out, "key", "left")


def recall_table(ranks: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """For all queries (kind ``all``) and each kind: queries, hit shares at the cuts, matched share, mrr, median rank."""
    hit = [F.avg(F.when(F.col("deep_rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in cuts]
    out = ranks.rollup("kind").agg(
        F.grouping("kind").alias("_all"),
        F.count("*").alias("queries"),
        *hit,
        F.avg(F.when(F.col("deep_rank").isNotNull(), 1.0).otherwise(0.0)).alias("matched"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )
    out = out.withColumn("kind", F.when(F.col("_all") == 1, "all").otherwise(F.col("kind"))).drop("_all")
    medians = order_statistics(with_all(ranks.select("kind", "rank"), "kind"), ["kind"], "rank", {"median_rank": 0.5}).drop("n")
    return out.join(medians.withColumnRenamed("kind", "_kind"), F.col("kind").eqNullSafe(F.col("_kind")), "left").drop("_kind")


def miss_causes(ranks: DataFrame, shared: DataFrame, limit: int) -> DataFrame:
    """One row: missed queries and why. ``shared``: (key, n_shared) terms that a query and its relevant notes have in common."""
    missed = ranks.where(F.col("deep_rank").isNull() | (F.col("deep_rank") > limit)).join(shared, "key", "left")
    none = F.coalesce("n_shared", F.lit(0)) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    deep = F.col("deep_rank")
    out = missed.agg(
        F.count("*").alias("missed"),
        count(none).alias("no_shared_term"),
        count(~none & deep.isNotNull()).alias("ranked_below_cut"),
        count(~none & deep.isNull()).alias("matched_but_absent"),
        F.max("deep_rank").alias("deep_rank_max"),
    )
    median = order_statistics(missed.withColumn("_one", F.lit(1)), ["_one"], "deep_rank", {"deep_rank_median": 0.5})
    columns = ["missed", "no_shared_term", "ranked_below_cut", "matched_but_absent", "deep_rank_median", "deep_rank_max"]
    return out.withColumn("_one", F.lit(1)).join(median, "_one", "left").select(*columns)


def shared_terms(queries: DataFrame, relevance: DataFrame, notes: DataFrame, tokens_of: object) -> DataFrame:
    """(key, n_shared, shared): distinct terms a query shares with any relevant note, eight of them as a sample."""
    asked = queries.select("key", F.array_distinct(tokens_of(F.col("query"))).alias("_q"))
    told = notes.select("path", F.array_distinct(tokens_of(F.col("text"))).alias("_n"))
    common = asked.join(relevance.select("key", "path"), "key").join(told, "path").select("key", F.explode(F.array_intersect("_q", "_n")).alias("term")).distinct()
    return common.groupBy("key").agg(F.count("*").alias("n_shared"), F.slice(F.sort_array(F.collect_list("term")), 1, 8).alias("shared"))


def ndcg(note_ranks: DataFrame, relevance: DataFrame, cut: int = 10) -> DataFrame:
    """(key, ndcg) with binary gains over notes (each counted once); null without a relevant note."""
    wanted = relevance.select("key", "path").distinct()
    gained = note_ranks.where(F.col("rank") <= cut).join(wanted, ["key", "path"]).groupBy("key").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("_n", F.lit(cut)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + F.lit(1.0)))
    best = wanted.groupBy("key").agg(F.count("*").alias("_n"))
    return best.join(gained, "key", "left").select("key", (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def compare_ndcg(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: queries, mean before and after, improved, worsened, same."""
    both = before.select("key", F.col("ndcg").alias("a")).join(after.select("key", F.col("ndcg").alias("b")), "key").where("a is not null and b is not null")
    change = F.col("b") - F.col("a")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(F.count("*").alias("queries"), F.avg("a").alias("before"), F.avg("b").alias("after"), count(change > EPSILON).alias("improved"), count(change < -EPSILON).alias("worsened"), count(F.abs(change) <= EPSILON).alias("same"))


def rank_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many queries rank better, worse and the same; no rank is behind all ranks."""
    far = F.lit(float("inf"))
    both = before.select("key", F.col("rank").cast("double").alias("a")).join(after.select("key", F.col("rank").cast("double").alias("b")), "key", "left")
    a, b = F.coalesce("a", far), F.coalesce("b", far)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(count(b < a).alias("better"), count(b > a).alias("worse"), count(a == b).alias("same"))


def report_samples(hits: DataFrame, size: int = 3) -> DataFrame:
    """(key, top): paths of the first hits of each query."""
    few = hits.where(F.col("rank") <= size)
    return few.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda r: r["path"]).alias("top"))


def frame_stats(frames: DataFrame, column: str = "gap_ms", slow_ms: float = 200) -> DataFrame:
    """Largest value, the one at 5 % from the top, how many exceed ``slow_ms``, and the sum."""
    sums = frames.agg(F.max(column).alias("max"), F.sum(F.when(F.col(column) > slow_ms, 1).otherwise(0)).cast("long").alias("slow"), F.sum(column).alias("total"))
    top = order_statistics(frames.withColumn("_one", F.lit(1)), ["_one"], column, {"p95": 0.05}, falling=True)
    return sums.withColumn("_one", F.lit(1)).join(top, "_one", "left").select("max", "p95", "slow", "total")


def ordered_first(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rank_within(df: DataFrame, key: str, *order: Column) -> Column:
    return F.row_number().over(W.partitionBy(key).orderBy(*order))
