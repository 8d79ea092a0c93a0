"""Best chunks for a query without scoring all postings of its terms.

Saved are the postings ordered by term, field and falling impact, that is the part of a posting's score that does not hang on the query; the
statistics of Parquet's row groups and pages are thus block maxima, and a bound on the impact skips whole blocks. A histogram of impacts for each
list (term and field; at most 71 buckets, whatever its length) tells what a bound would read.

A search for k chunks:

1. reads the highest postings of lists until each has k or would cost too much; the k-th best sum is a threshold below the k-th best score;
2. sets a cut for each list, such that what lies below all cuts adds up to less than the threshold, and reads what lies above: a chunk that is in no
   part read cannot be among the best. Cuts are set where they save most postings for the score that they give away;
3. bounds each chunk found by what it has and what the cuts leave open, and computes the score of those that may still win from their text;
   if these are many, in one pass over all texts.

The result is that of ``search``, chunk by chunk.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import text as tx
from inkspan.operators import scan
from inkspan.operators.index import FIELD_WEIGHTS, Index, postings_of
from inkspan.operators.search import B, K1, query_terms, rank_order, rows_of, search
from inkspan.saving import write_clean

#: Buckets for each unit of impact; an impact is below K1 + 1.
BUCKETS = 32
#: Bytes of a row group: what one bound can skip.
ROW_GROUP = 4 << 20
#: Postings of one list, for each chunk wanted, that the first look may read.
FIRST_LOOK = 50
#: Scores are compared with this much room for the order of sums.
ROOM = 1e-8
#: Chunks whose row groups are looked up by path; more of them are found by a join.
LOOKED_UP = 256


@dataclass
class Found:
    """The hits, and how many postings were read of how many that the query's terms have."""

    hits: DataFrame
    read: int
    total: int


def impact() -> Column:
    """The saturated frequency of a posting (tf, dl) under the field's statistics (n, total)."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / (F.col("total") / F.col("n"))))


@dataclass
class List:
    """A term in a field: the weight of its impacts and the number of postings of each bucket."""

    term: str
    field: int
    weight: float
    buckets: dict[int, int]

    def size(self, cut: int) -> int:
        """Postings in buckets from ``cut`` on."""
        return sum(n for b, n in self.buckets.items() if b >= cut)

    def below(self, cut: int) -> float:
        """What a posting below the cut can add at most."""
        under = [b for b in self.buckets if b < cut]
        return self.weight * (max(under) + 1) / BUCKETS if under else 0.0


def first_cuts(lists: list[List], k: int) -> dict[int, int]:
    """For the lists that the first look reads the highest cut that gives k postings."""
    out = {}
    for i, one in enumerate(lists):
        cut = next((b for b in sorted(one.buckets, reverse=True) if one.size(b) >= k), 0)
        if one.size(cut) <= FIRST_LOOK * k:
            out[i] = cut
    return out


def cheapest_cuts(lists: list[List], threshold: float) -> list[int]:
    """A cut for each list; what lies below all of them adds up to less than the threshold."""
    cuts, left = [0] * len(lists), threshold
    while True:
        best = None
        for i, one in enumerate(lists):
            for cut in {b + 1 for b in one.buckets if b >= cuts[i]}:
                price = one.below(cut) - one.below(cuts[i])
                saved = one.size(cuts[i]) - one.size(cut)
                if price < left and (best is None or saved / price > best[0]):
                    best = (saved / price, i, cut, price)
        if best is None:
            return cuts
        _, i, cuts[i], price = best
        left -= price


class ImpactIndex:
    """Tables ``impacts``, ``histogram``, ``chunks`` and ``stats`` below one folder."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: tx.Tokenizer = tx.tokens, stable: bool = False, chunks: DataFrame | None = None):
        self.spark, self.path, self.tokenizer, self.stable = spark, path, tokenizer, stable
        self.impacts, self.histogram, self.stats = (spark.read.parquet(f"{path}/{t}") for t in ("impacts", "histogram", "stats"))
        self.chunks = spark.read.parquet(f"{path}/chunks") if chunks is None else chunks

    @staticmethod
    def save(index: Index, path: str, terms: list[str] | None = None) -> ImpactIndex:
        """Write the tables; one range shuffle of the postings, in which a frequent term is split by its impacts.

        With ``terms`` only their lists are made and other words find nothing; chunks, which are saved already, are read where they are.
        """
        postings = index.postings if terms is None else index.postings.where(F.col("term").isin(terms))
        rows = postings.join(F.broadcast(index.stats), "field").withColumn("impact", impact()).select("term", "field", "impact", "id", "tf", "dl")  # three rows
        order = [F.col("term"), F.col("field"), F.col("impact").desc(), F.col("id")]
        spark = index.chunks.sparkSession
        write_clean(spark, rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", ROW_GROUP), f"{path}/impacts")
        known = spark.read.schema(rows.schema).parquet(f"{path}/impacts")
        counted = known.groupBy("term", "field", F.floor(F.col("impact") * BUCKETS).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
        counted.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/histogram")
        index.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        if terms is not None:
            return ImpactIndex(spark, path, index.tokenizer, index.stable, index.chunks)
        ranged = index.chunks.repartitionByRange("path", "ordinal").sortWithinPartitions("path", "ordinal")
        ranged.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("parquet.bloom.filter.enabled#path", "true").parquet(f"{path}/chunks")
        return ImpactIndex(spark, path, index.tokenizer, index.stable)

    def whole(self) -> Index:
        """The same postings for a search of all of them."""
        return Index(self.chunks, self.impacts.select("field", "term", "id", "tf", "dl"), self.histogram.groupBy("field", "term").agg(F.sum("n").alias("df")), self.stats, self.tokenizer, self.stable)

    def lists(self, query: str) -> list[List]:
        """The lists of a query's terms; a query is short text and a list has a bounded number of buckets."""
        asked = self.spark.createDataFrame([("q", query)], "key string, query string")
        terms = [r.term for r in query_terms(asked, Index(*[None] * 4, self.tokenizer, self.stable)).collect()]
        stats = {r["field"]: r["n"] for r in self.stats.collect()}
        buckets: dict[tuple[str, int], dict[int, int]] = {}
        for r in self.histogram.where(F.col("term").isin(terms)).collect() if terms else []:
            buckets.setdefault((r["term"], r["field"]), {})[r["bucket"]] = r["n"]
        out = []
        for (term, field), found in sorted(buckets.items()):
            df = sum(found.values())
            mark = tx.WORD_WEIGHT if term.startswith(tx.WORD_PREFIX) else tx.CHAR_WEIGHT if term.startswith(tx.CHAR_PREFIX) else 1.0
            out.append(List(term, field, FIELD_WEIGHTS[field] * mark * math.log1p((stats[field] - df + 0.5) / (df + 0.5)), found))
        return out

    def _read(self, lists: list[List], cuts: dict[int, int]) -> DataFrame:
        """(id, score, open): what the postings from the cuts on add, and what the same lists could have added below their cuts."""
        parts = []
        for i, cut in cuts.items():
            one = lists[i]
            if one.size(cut):
                # a bound on the impact reaches the scan; the bucket decides
                rows = self.impacts.where((F.col("term") == one.term) & (F.col("field") == one.field) & (F.col("impact") >= cut / BUCKETS)).where(F.floor(F.col("impact") * BUCKETS) >= cut)
                parts.append(rows.select("id", (F.col("impact") * one.weight).alias("score"), F.lit(one.below(cut)).alias("open")))
        if not parts:
            return self.spark.createDataFrame([], "id string, score double, open double")
        return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score"), F.sum("open").alias("open"))

    @staticmethod
    def _kth(rows: DataFrame, k: int) -> float:
        """The k-th best score, 0 if there are fewer."""
        found = rows.orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        return found["least"] if found["n"] == k else 0.0

    def top(self, query: str, limit: float = 50) -> Found:
        """What ``search`` finds for ``query``."""
        k, lists = rows_of(limit), self.lists(query)
        total = sum(one.size(0) for one in lists)
        if k is None or k == 0 or not lists:
            return Found(search(self.whole(), query, limit), total if k != 0 else 0, total)
        first = first_cuts(lists, k)
        threshold = self._kth(self._read(lists, first), k) - ROOM
        cuts = dict(enumerate(cheapest_cuts(lists, threshold)))
        found = self._read(lists, cuts).persist()
        try:
            read = sum(one.size(cuts[i]) for i, one in enumerate(lists)) + sum(lists[i].size(c) for i, c in first.items())
            unknown = sum(one.below(cuts[i]) for i, one in enumerate(lists))
            may_win = found.where(F.col("score") + (F.lit(unknown) - F.col("open")) >= self._kth(found, k) - ROOM)
            if unknown and may_win.limit(LOOKED_UP + 1).count() > LOOKED_UP:
                placed = self._pass(query, k)
            else:
                scored = may_win.select("id", "score") if unknown == 0 else self._complete(may_win.select("id"), lists)
                placed = scored.join(self._chunks_of(scored).select("id", "path", "start_line"), "id")
            hits = self._rows(placed.orderBy(*rank_order()).limit(k).select("id", "score").collect())
        finally:
            found.unpersist()
        return Found(hits, read, total)

    def _pass(self, query: str, k: int) -> DataFrame:
        """What may be the best k of all chunks, where the bounds leave too many to look up: one pass over the texts, which are not shuffled."""
        index, one = self.whole(), self.spark.createDataFrame([("q", query)], "key string, query string")
        return scan.best(index, one, scan.asked(index, query_terms(one, index).collect(), K1, B), k)

    def _rows(self, top: list) -> DataFrame:
        """Hits of at most k (id, score) that were chosen."""
        chosen = self.spark.createDataFrame([tuple(r) for r in top], "id string, score double")
        return chosen.join(self._chunks_of(chosen), "id").select("path", "title", "heading", "text", "start_line", "score", "id").orderBy(*rank_order())

    def _chunks_of(self, ids: DataFrame) -> DataFrame:
        """The chunks of ``ids``; of few of them only row groups that hold their paths are read."""
        few = ids.select("id").limit(LOOKED_UP + 1).collect()
        if len(few) > LOOKED_UP:
            return self.chunks.join(ids.select("id"), "id", "left_semi")
        wanted = {r["id"] for r in few}
        known = self.chunks.where(F.col("id").isin(wanted)) if wanted else self.chunks.limit(0)
        paths = self._paths(wanted)
        return known.where(reduce(Column.__or__, (F.col("path") == p for p in paths))) if paths else known

    @staticmethod
    def _paths(ids: set[str]) -> set[str]:
        """The paths that ids name, where all of them do: an id is JSON that begins with its path, or path and ordinal behind ``#``."""
        import json

        out = set()
        for one in ids:
            if one.startswith("["):
                out.add(json.loads(one)[0])
            elif "#" in one:
                out.add(one.rsplit("#", 1)[0])
            else:
                return set()
        return out

    def _complete(self, ids: DataFrame, lists: list[List]) -> DataFrame:
        """(id, score): the whole score of each of ``ids`` from the tokens of its text."""
        weights = self.spark.createDataFrame([(one.term, one.field, one.weight) for one in lists], "term string, field int, weight double")
        rows = postings_of(self._chunks_of(ids), self.tokenizer, self.stable).join(F.broadcast(weights), ["term", "field"]).join(F.broadcast(self.stats), "field")  # terms of a query; three rows
        return rows.groupBy("id").agg(F.sum(impact() * F.col("weight")).alias("score"))
