"""Scores of many queries from one pass over the chunks.

What the words of all queries add is summed where a chunk lies, as a product of matrices, and only what a task still needs leaves it: the best chunks or
notes of each query, counts, or chunks from a given score on. No pair of chunk and query is shuffled. The scores are those of the postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from inkspan.functions import text as tx
from inkspan.operators.index import FIELD_WEIGHTS, FIELDS, Index
from inkspan.operators.metrics import RANK_PLACES, ranks_of_marks
from inkspan.operators.order import better

#: Queries whose scores are computed at once, and numbers of the matrices of some chunks.
BLOCK, CELLS = 256, 2_000_000
#: Scores are compared with this much room for the order of sums.
ROOM = 1e-8
PLACES = ("id", "path", "start_line")


@dataclass
class Block:
    """Some queries: which of all keys and terms they are, and how often a query (column) has a term (row)."""

    keys: np.ndarray
    terms: np.ndarray
    has: tuple[np.ndarray, np.ndarray]

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.terms), len(self.keys)))
        np.add.at(out, self.has, 1.0)
        return out


@dataclass
class Asked:
    """Queries as numbers; of checked size, so they go to the tasks whole. ``weights`` (field, term) is None where terms are counted."""

    keys: list
    terms: list[str]
    blocks: list[Block]
    weights: np.ndarray | None
    average: np.ndarray
    k1: float
    b: float

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
        """(rows by path, start line and id; block; its scores of them)."""
        matrices, known = [b.matrix() for b in self.blocks], pa.array(self.terms, pa.string())
        step = max(16, CELLS // (len(self.terms) + min(BLOCK, len(self.keys)) + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                used, sums = self._sums(part, known)
                order = pc.sort_indices(pa.table({c: part.column(c) for c in PLACES}), sort_keys=[(c, "ascending") for c in (*PLACES[1:], PLACES[0])])
                rows, order = part.select([c for c in part.schema.names if not c.startswith("t_")]).take(order), order.to_numpy()
                for k, block in enumerate(self.blocks):
                    _, here, there = np.intersect1d(used, block.terms, assume_unique=True, return_indices=True)
                    yield rows, k, (sums[:, here] @ matrices[k][there])[order]

    def _sums(self, part: pa.RecordBatch, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The terms that some chunks have, and what each adds to each chunk."""
        fields = []
        for field in FIELDS.values():
            tokens = part.column(f"t_{field}")
            length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(part.num_rows), length)
            fields.append((field, length, rows[found >= 0], found[found >= 0]))
        used = np.flatnonzero(np.bincount(np.concatenate([f for *_, f in fields]), minlength=len(known)))
        sums = np.zeros((part.num_rows, len(used)))
        for field, length, rows, found in fields:
            at, tf = np.unique(rows * len(used) + np.searchsorted(used, found), return_counts=True)
            if self.weights is None:
                sums.reshape(-1)[at] = 1.0
                continue
            row, term = np.divmod(at, max(1, len(used)))
            sums.reshape(-1)[at] += self.weights[field][used[term]] * (tf * (self.k1 + 1)) / (tf + self.k1 * ((1 - self.b) + self.b * length[row] / self.average[field]))
        return used, sums


def asked(index: Index, terms: list, k1: float, b: float, weighted: bool = True) -> Asked:
    """From (key, term) rows and, if weighted, the document frequencies of their terms."""
    keys, words = list(dict.fromkeys(r["key"] for r in terms)), list(dict.fromkeys(r["term"] for r in terms))
    key_at, word_at = {k: n for n, k in enumerate(keys)}, {w: n for n, w in enumerate(words)}
    pairs = np.array([(key_at[r["key"]], word_at[r["term"]]) for r in terms], dtype=np.int64).reshape(-1, 2)
    blocks = []
    for at in range(0, len(keys), BLOCK):
        own = pairs[(pairs[:, 0] >= at) & (pairs[:, 0] < at + BLOCK)]
        used, place = np.unique(own[:, 1], return_inverse=True)
        blocks.append(Block(np.arange(at, min(at + BLOCK, len(keys))), used, (place, own[:, 0] - at)))
    average, weights = np.ones(len(FIELDS)), None
    if weighted:
        weights = np.zeros((len(FIELDS), len(words)))
        stats = {r["field"]: r for r in index.stats.collect()}  # three rows
        for r in index.term_df.where(F.col("term").isin(words)).collect() if words else []:
            n = stats[r["field"]]["n"]
            mark = tx.WORD_WEIGHT if r["term"].startswith(tx.WORD_PREFIX) else tx.CHAR_WEIGHT if r["term"].startswith(tx.CHAR_PREFIX) else 1.0
            weights[r["field"], word_at[r["term"]]] = FIELD_WEIGHTS[r["field"]] * mark * np.log1p((n - r["df"] + 0.5) / (r["df"] + 0.5))
        average = np.array([stats[f]["total"] / stats[f]["n"] if f in stats and stats[f]["n"] else 1.0 for f in FIELDS.values()])
    return Asked(keys, words, blocks, weights, average, k1, b)


def _tokens(index: Index, chunks: DataFrame, *more: str) -> DataFrame:
    bags = [index.tokenizer(tx.fold(F.col(name), index.stable)).alias(f"t_{n}") for name, n in FIELDS.items()]
    return chunks.select(*PLACES, *more, *bags)


def _schema(queries: DataFrame, *names: str) -> StructType:
    kinds = {"key": queries.schema["key"].dataType, "start_line": IntegerType(), "score": DoubleType(), "best": DoubleType(), "matched": LongType()}
    return StructType([StructField(n, kinds.get(n, StringType())) for n in names])


def _rows(keys: pa.Array, rows: pa.RecordBatch, key: np.ndarray, row: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    places = rows.select(list(PLACES)).take(pa.array(row))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(key)), *places.columns, pa.array(scores)], names=["key", *PLACES, "score"])


def best(index: Index, queries: DataFrame, wanted: Asked, limit: int, notes: bool = False) -> DataFrame:
    """(key, id, path, start_line, score): of each task what may be among the best ``limit`` chunks of each query; with ``notes`` the best notes, each by its best chunk's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.array(wanted.keys)
        # a chunk below the limit-th best score so far is not wanted; a note may come in parts, so notes are cut where they lie alone
        tops = {k: np.full((limit, len(b.keys)), -np.inf) for k, b in enumerate(wanted.blocks)} if not notes and limit * len(keys) <= CELLS else {}
        for rows, k, scores in wanted.parts(batches):
            if notes:
                paths = rows.column("path").to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, paths[1:] != paths[:-1]])
                scores, rows = np.maximum.reduceat(scores, starts, axis=0), rows.take(pa.array(starts))
            round_ = np.where(scores > 0, np.round(scores, RANK_PLACES), -np.inf)
            order = np.argsort(-round_, axis=0, kind="stable")[:limit]  # ties by place
            values = np.take_along_axis(round_, order, 0)
            stay = values > -np.inf
            if tops:
                stay &= values >= tops[k][0]
                tops[k] = np.sort(np.concatenate([tops[k], values]), axis=0)[-limit:]
            at, col = np.nonzero(stay)
            row = order[at, col]
            yield _rows(keys, rows, wanted.blocks[k].keys[col], row, scores[row, col])

    return _tokens(index, index.chunks).mapInArrow(run, _schema(queries, "key", *PLACES, "score"))


def from_score(index: Index, queries: DataFrame, wanted: Asked, least: dict) -> DataFrame:
    """(key, id, path, start_line, score) of the chunks that match and score at least what ``least`` has for the key; keys that it lacks have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bounds = pa.array(wanted.keys), np.array([least.get(k, np.inf) for k in wanted.keys]) - ROOM
        for rows, k, scores in wanted.parts(batches):
            row, col = np.nonzero((scores > 0) & (scores >= bounds[wanted.blocks[k].keys]))
            yield _rows(keys, rows, wanted.blocks[k].keys[col], row, scores[row, col])

    return _tokens(index, index.chunks).mapInArrow(run, _schema(queries, "key", *PLACES, "score"))


def of_told(index: Index, queries: DataFrame, wanted: Asked, relevance: DataFrame) -> DataFrame:
    """(key, id, path, start_line, score) of the chunks of notes that ``relevance`` (key, path) names, for its keys."""
    told = relevance.groupBy("path").agg(F.collect_set("key").alias("told"))  # at most all queries, which are few

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.array(wanted.keys)
        at = {k: n for n, k in enumerate(wanted.keys)}
        for rows, k, scores in wanted.parts(batches):
            mask, block = np.zeros(scores.shape, dtype=bool), wanted.blocks[k].keys
            for n, found in enumerate(rows.column("told").to_pylist()):
                own = [at[x] - block[0] for x in found if x in at and block[0] <= at[x] <= block[-1]]
                mask[n, own] = True
            row, col = np.nonzero(mask & (scores > 0))
            yield _rows(keys, rows, block[col], row, scores[row, col])

    few = relevance.count() <= 200_000
    chunks = index.chunks.join(F.broadcast(told) if few else told, "path")  # counted
    return _tokens(index, chunks, "told").mapInArrow(run, _schema(queries, "key", *PLACES, "score"))


def counts(index: Index, queries: DataFrame, wanted: Asked) -> DataFrame:
    """(key, matched, best): how many chunks match a query, and the best score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.array(wanted.keys)
        for _, k, scores in wanted.parts(batches):
            matched = (scores > 0).sum(axis=0)
            some = np.flatnonzero(matched)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(wanted.blocks[k].keys[some])), pa.array(matched[some]), pa.array(scores.max(axis=0)[some])], names=["key", "matched", "best"])

    part = _tokens(index, index.chunks).mapInArrow(run, _schema(queries, "key", "matched", "best"))
    return part.groupBy("key").agg(F.sum("matched").alias("matched"), F.max("best").alias("best"))


def first_ranks(index: Index, queries: DataFrame, wanted: Asked, relevance: DataFrame, limit: int) -> DataFrame:
    """``metrics.ranks_by_counting`` in two passes: the best relevant chunk of each query, then what is better."""
    relevance = relevance.groupBy("path", "key").agg(F.max("grade").alias("grade")).persist(StorageLevel.MEMORY_AND_DISK)
    order = better(F.col("score"), RANK_PLACES, "path", "start_line", "id")
    hits = of_told(index, queries, wanted, relevance).join(relevance, ["key", "path"]).select("key", order.alias("o"), "grade")
    found = hits.groupBy("key").agg(F.min("o").alias("any"), F.min(F.when(F.col("grade") >= 2, F.col("o"))).alias("exact"))
    rows = found.collect()  # a row a query at most
    marks = queries.sparkSession.createDataFrame(rows, found.schema)
    least = {r["key"]: -(r["exact"] or r["any"])["s"] for r in rows}
    far = F.broadcast(marks.withColumn("far", F.coalesce("exact", "any")))
    reach = from_score(index, queries, wanted, least).join(far, "key").withColumn("o", order).where("o < far")
    return ranks_of_marks(marks, reach, queries, limit)
