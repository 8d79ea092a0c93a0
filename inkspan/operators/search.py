"""Weighted BM25 over three fields, for one query or many at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions import text as tx
from inkspan.operators import scan
from inkspan.operators.index import FIELD_WEIGHTS, Index
from inkspan.operators.metrics import RANK_PLACES

#: BM25 saturation and length normalization.
K1, B = 1.2, 0.75
#: Queries up to this number and these bytes are broadcast with their terms.
BROADCAST_QUERIES, BROADCAST_QUERY_BYTES = 10_000, 8 << 20
#: Queries up to which postings of their terms are read; more of them are answered in one pass over the chunks.
FEW_QUERIES = 8
#: Hits (key, place, id, score) that are broadcast to their chunks.
BROADCAST_HITS = 100_000


def idf() -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5))."""
    return F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def term_score() -> Column:
    """What a posting (with df, n and total) adds to its chunk's score."""
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in FIELD_WEIGHTS.items() for x in pair)), F.col("field"))
    length = (1 - B) + B * F.col("dl") / (F.col("total") / F.col("n"))
    return weight * tx.token_weight(F.col("term")) * idf() * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * length)


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """(key, term): distinct tokens of each query."""
    return queries.select("key", F.explode(F.array_distinct(index.tokenizer(tx.fold(F.col("query"), index.stable)))).alias("term"))


def _size(queries: DataFrame) -> tuple[int, bool]:
    """(number of queries, whether they may be sent to all tasks)."""
    size = queries.limit(BROADCAST_QUERIES + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("query")), F.lit(0)).alias("bytes")).first()
    return size["n"], size["n"] <= BROADCAST_QUERIES and size["bytes"] <= BROADCAST_QUERY_BYTES


def in_one_pass(index: Index, queries: DataFrame, weighted: bool = True, few: int = 0) -> scan.Asked | None:
    """The queries for a scan of the chunks; None where they are too many to send to all tasks, or no more than ``few``."""
    n, fit = _size(queries)
    return scan.asked(index, query_terms(queries, index).collect(), K1, B, weighted) if fit and n > few else None


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """(key, id, score) of every chunk that shares a term with the query."""
    terms = query_terms(queries, index)
    n, fit = _size(queries)
    postings, term_df = index.postings, index.term_df
    if fit and n <= FEW_QUERIES:
        # as literals the terms reach the scan of saved postings, and go below the aggregation of those that are made anew
        words = [r["term"] for r in terms.select("term").distinct().collect()]
        postings, term_df = postings.where(F.col("term").isin(words)), term_df.where(F.col("term").isin(words))
    if fit:
        terms = F.broadcast(terms)  # their number and bytes are checked
    found = postings.join(terms, "term")
    found = found.join(term_df.join(terms.select("term").distinct(), "term", "left_semi"), ["field", "term"])
    found = found.join(F.broadcast(index.stats), "field")  # three rows
    return found.groupBy("key", "id").agg(F.sum(term_score()).alias("score"))


def rank_order() -> list[Column]:
    return [F.round("score", RANK_PLACES).desc(), F.col("path"), F.col("start_line"), F.col("id")]


def search_many(index: Index, queries: DataFrame, limit: float = 50) -> DataFrame:
    """(key, pos, hit columns) of the best ``limit`` chunks of each query (key, query); pos counts from 1."""
    keep = rows_of(limit)
    if keep == 0:
        queries = queries.limit(0)
    wanted = in_one_pass(index, queries, few=FEW_QUERIES) if keep else None
    if wanted is not None:
        found = scan.best(index, queries, wanted, keep)
    else:
        found = scores(index, queries).join(index.chunks.select("id", "path", "start_line"), "id")
    ranked = found.withColumn("pos", F.row_number().over(W.partitionBy("key").orderBy(*rank_order())))
    if keep is not None:
        ranked = ranked.where(F.col("pos") <= keep)
    # texts join only after the cut
    hits = ranked.select("key", "pos", "id", "score")
    if wanted is not None and keep * len(wanted.keys) <= BROADCAST_HITS:
        hits = F.broadcast(hits)  # bounded by the cut
    return hits.join(index.chunks, "id").select("key", "pos", "path", "title", "heading", "text", "start_line", "score", "id")


def rows_of(limit: float) -> int | None:
    """How many rows a limit means: none for NaN, zero and below, None (all) for infinity, else its floor."""
    if math.isnan(limit) or limit <= 0:
        return 0
    return None if math.isinf(limit) else math.floor(limit)


def search(index: Index, query: str, limit: float = 50) -> DataFrame:
    """The best chunks for one query, in order."""
    keep = rows_of(limit)
    spark = index.chunks.sparkSession
    one = spark.createDataFrame([("q", query)], "key string, query string")
    places = index.chunks.select("id", "path", "start_line")
    ranked = scores(index, one if keep != 0 else one.limit(0)).join(places, "id").orderBy(*rank_order())
    top = ranked if keep is None else ranked.limit(keep)
    hits = top.select("id", "score").join(index.chunks, "id")
    return hits.select("path", "title", "heading", "text", "start_line", "score", "id").orderBy(*rank_order())


def first_of_each_note(hits: DataFrame) -> DataFrame:
    """For each query the first chunk of each note, with positions (``rank``) counted anew; hits have key, pos and path."""
    best = hits.withColumn("_n", F.row_number().over(W.partitionBy("key", "path").orderBy("pos"))).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("pos")))


def render(hits: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """One row a note: excerpt, heading and score label (``not evaluated`` without a judgement by id)."""
    rows = first_of_each_note(hits)
    if judged is not None:
        rows = rows.join(judged.select("id", F.col("judge_score")), "id", "left")
    else:
        rows = rows.withColumn("judge_score", F.lit(None).cast("double"))
    label = F.when(F.col("judge_score").isNotNull(), F.format_string("%.2f", "judge_score")).otherwise("not evaluated")
    return rows.select("key", "rank", "path", "title", "heading", tx.excerpt(F.col("text")).alias("excerpt"), label.alias("label"))
