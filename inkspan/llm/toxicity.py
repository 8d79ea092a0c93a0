"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fit, on the driver, from at most ``PER_CLASS`` examples of each label:

* vocabulary: all terms of the examples (lower-cased words, runs of symbols, not repetitions). A term's weight is its
  inverse document frequency times z^8 / (z^8 + 3^8), z being the log-odds of its document counts under the two labels over
  their standard error: terms that go with a label count in full, those of no association hardly (under 0.1: not at all).
  There is no limit on their number but that on the examples;
* inverse document frequencies: counted over all documents of the corpus, in one scan that moves one row a
  term and task;
* a block-max inverted index over the examples: postings lists in blocks of ``BLOCK`` examples with the largest weight of each
  (term, block). A search visits blocks by falling bound and passes over those whose bound is below the k-th best
  cosine, which makes it exact;
* votes: labels of the ``NEIGHBOURS`` best examples, weighted by 1 / (distance + 0.05), and made a probability by a
  monotone fit on leave-one-out votes, with the classes weighted back to their shares among labelled rows.

Scoring is a scan of whole texts; nothing is shuffled. Evidence of a score are the examples that voted: doc_id, label,
cosine. The bound on what executors get is that on the examples.

Defined cases: texts that are null, empty or without any term of weight get the share of label 1 among
examples without such terms, and no evidence; without labels of both kinds every score is the share of label 1 (0.0 where
there are no labels); null doc_ids and repeated rows are scored as any row; examples of equal cosine vote in the order of the
index; texts are read whole, whatever their length, in slices of bounded bytes; all columns of the input are kept, whatever
their names; of a doc_id that repeats the least text teaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import read_table, unpacked
from inkspan.llm.labelled import REPEAT, Example, examples, folded, held_out, isotonic, term_hashes
from inkspan.llm.textscan import HashSet, slices

PER_CLASS = 2048
#: z at which a term has half its weight, the steepness, and the share under which it has none.
HALF_Z, STEEPNESS, LEAST_SHARE = 3.0, 8, 0.1
NEIGHBOURS = 15
#: Examples of a block, and blocks that are laid out at once.
BLOCK, GROUP = 64, 8
THRESHOLD = 0.7


def associated_terms(sample: list[Example]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted terms, association in 0 to 1) of all terms of the examples that have any."""
    sizes = [sum(e.label == c for e in sample) for c in (0, 1)]
    found = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(e.terms for e in sample if e.label == c)]), return_counts=True) for c in (0, 1)]
    terms = np.union1d(found[0][0], found[1][0])
    counts = np.zeros((2, len(terms)))
    for c in (0, 1):
        counts[c, np.searchsorted(terms, found[c][0])] = found[c][1]
    odds = [np.log((counts[c] + 0.5) / (sizes[c] - counts[c] + 0.5)) for c in (0, 1)]
    z = np.abs(odds[1] - odds[0]) / np.sqrt((1 / (counts + 0.5)).sum(axis=0))
    share = z**STEEPNESS / (z**STEEPNESS + HALF_Z**STEEPNESS)
    some = (terms != REPEAT) & (share >= LEAST_SHARE)
    return terms[some], share[some]


def corpus_counts(docs: DataFrame, terms: HashSet) -> tuple[np.ndarray, int]:
    """For each term the number of documents that have it, and the number of documents."""
    size = len(terms.keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                owner, hashes = term_hashes(part.column(0))
                at, term = terms.find(hashes)
                total[: size] += np.bincount(np.unique(owner[at] * size + term) % size, minlength=size) if size else 0
                total[size] += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = docs.select(folded().alias("_folded")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, dtype=np.int64)
    for row in rows:
        out[row["term"]] = row["n"]
    return out[:size], int(out[size])


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors: postings lists in blocks of vectors, with the largest weight of each (term, block).

    ``row``, ``term`` and ``weight`` are the entries of the vectors. Queries come in batches; of a group of blocks the postings
    are laid out for one matrix product with the queries that the bounds let in.
    """

    def __init__(self, rows: int, terms: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int = BLOCK):
        self.terms, self.block, blocks = terms, block, -(-rows // block)
        order = np.lexsort((term, row // block))
        self.row, self.term, self.weight = row[order], term[order], weight[order]
        self.ends = np.searchsorted(self.row // block, np.arange(blocks + 1))
        self.highest = np.zeros((terms, blocks))
        np.maximum.at(self.highest, (self.term, self.row // block), self.weight)

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k best with a positive cosine of each query (a row over the terms), best first; -1 and 0 fill up.

        Ties go to the lower row. Row skip[i] is not found by query i.
        """
        n = len(queries)
        rows, cosines = np.full((n, k), -1), np.zeros((n, k))
        bound = queries @ self.highest
        order = np.argsort(-bound.sum(axis=0), kind="stable")
        for at in range(0, len(order), GROUP):
            some = order[at : at + GROUP]
            most = bound[:, some].max(axis=1)
            open_ = np.flatnonzero((most > 0) & (most >= cosines[:, -1] - 1e-9))  # others cannot reach their k-th best here
            if not len(open_):
                continue
            laid = np.zeros((self.terms, len(some) * self.block))
            for j, b in enumerate(some.tolist()):
                own = slice(self.ends[b], self.ends[b + 1])
                laid[self.term[own], j * self.block + self.row[own] % self.block] = self.weight[own]
            place = (some[:, None] * self.block + np.arange(self.block)).ravel()
            found = queries[open_] @ laid
            if skip is not None:
                found[place[None, :] == skip[open_, None]] = 0
            found = np.concatenate((cosines[open_], found), axis=1)
            where = np.concatenate((rows[open_], np.broadcast_to(place, (len(open_), len(place)))), axis=1)
            value = np.where(found > 1e-12, np.round(found, 12) - where * 1e-16, 0)
            best = np.argpartition(-value, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(value, best, axis=1), axis=1, kind="stable"), axis=1)
            good = np.take_along_axis(value, best, axis=1) > 0
            rows[open_] = np.where(good, np.take_along_axis(where, best, axis=1), -1)
            cosines[open_] = np.where(good, np.take_along_axis(found, best, axis=1), 0)
        return rows, cosines


class ToxicityModel:
    def __init__(self, sample: list[Example], totals: dict[int, int], terms: HashSet, association: np.ndarray, counts: np.ndarray, documents: int):
        self.terms = terms
        self.idf = (np.log((documents + 1) / (counts + 1)) + 1) * association
        labels = np.array([e.label for e in sample], dtype=np.int64)
        vectors = []
        for e in sample:
            at, term = terms.find(e.terms)
            weight = (1 + np.log(e.counts[at])) * self.idf[term]
            vectors.append((term, weight / max(np.linalg.norm(weight), 1e-12)))
        # examples that share their strongest term lie in the same blocks, which keeps the bounds low
        strongest = np.array([term[weight.argmax()] if len(term) else -1 for term, weight in vectors], dtype=np.int64)
        order = np.lexsort((labels, strongest))
        self.labels, vectors = labels[order], [vectors[k] for k in order]
        self.doc_ids = np.array([e.doc_id for e in sample], dtype=np.int64)[order]
        row = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        term, weight = (np.concatenate([np.zeros(0, kind), *(v[k] for v in vectors)]) for k, kind in ((0, np.int64), (1, float)))
        self.index = BlockMaxIndex(len(vectors), len(terms.keys), row, term, weight)
        sizes = np.bincount(labels, minlength=2)
        self.share = totals.get(1, 0) / max(sum(totals.values()), 1)
        both = sizes.min() > 0
        share = np.array([totals.get(c, 0) / max(sizes[c], 1) for c in (0, 1)])[self.labels] if both else np.ones(len(labels))
        raw = np.zeros(len(vectors))
        for some in self.batches(len(vectors)):
            own = (row >= some.start) & (row < some.stop)
            queries = np.zeros((some.stop - some.start, len(terms.keys)))
            queries[row[own] - some.start, term[own]] = weight[own]
            raw[some] = self._vote(*self.index.search(queries, NEIGHBOURS, np.arange(some.start, some.stop)))
        self.at, self.chance = isotonic(raw, self.labels, share) if both else (np.zeros(1), np.full(1, self.share))

    def batches(self, n: int) -> Iterator[slice]:
        """Slices of so many texts that their vectors hold a bounded number of weights."""
        step = max(1, min(512, (1 << 21) // max(len(self.terms.keys), 1)))
        return (slice(at, min(at + step, n)) for at in range(0, n, step))

    def _vote(self, near: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """-1 without neighbours, else the weighted share of label 1."""
        weight = np.where(near >= 0, 1 / (np.maximum(1 - cosine, 0) + 0.05), 0)
        total = weight.sum(axis=1)
        labels = np.append(self.labels, 0)[near]
        return np.where(total > 0, (weight * labels).sum(axis=1) / np.maximum(total, 1e-12), -1.0)

    def explain(self, column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Score and evidence (a list of doc_id, label, cosine) of each text."""
        n, size = len(column), len(self.terms.keys)
        owner, hashes = term_hashes(column)
        at, term = self.terms.find(hashes)
        key, counts = np.unique(owner[at] * max(size, 1) + term, return_counts=True)
        text, term = key // max(size, 1), key % max(size, 1)
        ends = np.searchsorted(text, np.arange(n + 1))
        rows, cosines = np.full((n, NEIGHBOURS), -1), np.zeros((n, NEIGHBOURS))
        for some in self.batches(n):
            own = slice(ends[some.start], ends[some.stop])
            queries = np.zeros((some.stop - some.start, size))
            queries[text[own] - some.start, term[own]] = (1 + np.log(counts[own])) * self.idf[term[own]]
            queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
            rows[some], cosines[some] = self.index.search(queries, NEIGHBOURS)
        raw = self._vote(rows, cosines)
        score = np.clip(0.99 * np.interp(raw, self.at, self.chance) + 0.01 * np.maximum(raw, 0), 0, 1)
        good = rows >= 0
        near = rows[good]
        structs = pa.StructArray.from_arrays([pa.array(self.doc_ids[near]), pa.array(self.labels[near].astype(np.int32)), pa.array(cosines[good])], names=["doc_id", "label", "cosine"])
        return score, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(good.sum(axis=1)))), pa.int32()), structs)

    def score(self, column: pa.Array) -> np.ndarray:
        return self.explain(column)[0]


EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    sample, totals = examples(docs, labels, "toxic", 3, 1, PER_CLASS)
    known, association = associated_terms(sample)
    terms = HashSet(known)  # in the same order, as both are sorted
    return ToxicityModel(sample, totals, terms, association, *corpus_counts(docs, terms))


def scored(docs: DataFrame, model: object, evidence: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(d, score[, evidence]): the columns ``keep`` (all) of ``docs`` in a struct and model.score of every whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the examples
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep))).alias("d"), folded().alias("text"))
    names = ["d", "score", "evidence"][: 2 + evidence]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    if evidence:
                        score, voters = shared.value.explain(some.column(1))
                        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(score, pa.float64()), voters], names=names)
                    else:
                        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(shared.value.score(some.column(1)), pa.float64())], names=names)

    fields = [given.schema["d"], T.StructField("score", T.DoubleType()), T.StructField("evidence", EVIDENCE)]
    return given.mapInArrow(run, T.StructType(fields[: 2 + evidence]))


def with_score(docs: DataFrame, model: object, out: str) -> DataFrame:
    """``docs`` with model.score of every whole text as a further column ``out``."""
    if out in docs.columns:
        raise ValueError(f"docs have a column {out} already")
    return unpacked(scored(docs, model), docs.columns, **{out: F.col("score")})


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    return unpacked(scored(docs, fit(docs, labels)).where(F.col("score") < THRESHOLD), docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    found = scored(docs, model, evidence=True, keep=["doc_id"]).select("d.doc_id", "score", "evidence")
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
