"""Quality by voting of labelled neighbours in a latent-semantic space.

Fit, on the driver, from at most ``PER_CLASS`` examples of each label: TF-IDF over the ``TERMS`` terms (words,
runs of symbols, repetitions of a word) that most examples hold, a randomised truncated SVD to ``RANK`` dimensions, and the examples'
unit vectors in that space. Document frequencies are counted over all documents of the corpus.

Score of a document: exact cosines with all examples by blocked matrix products, then the labels of the
``NEIGHBOURS`` nearest, weighted by exp(``SHARPNESS`` * cosine), then a monotone fit on leave-one-out votes with
classes weighted back to their shares. What executors get (projection and example vectors) is bounded by these
numbers; scoring shuffles nothing and reads whole texts.

Defined cases: a text that is null, empty or without known terms gets the share of label 1; without labels of both
kinds every score is that share (0.0 where there are no labels); null doc_ids and repeated rows are scored as
any row; examples that tie with the last of the nearest vote too; texts are read whole, whatever their length, in slices of
bounded bytes; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import read_table
from inkspan.llm.labelled import REPEAT, Example, examples, held_out, isotonic, term_hashes
from inkspan.llm.textscan import HashSet
from inkspan.llm.toxicity import corpus_counts, scored

PER_CLASS = 2048
TERMS = 4096
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 12.0
THRESHOLD = 0.3
#: Repeated words weigh more than their frequency alone gives.
REPEAT_WEIGHT = 2.0


def common_terms(sample: list[Example], limit: int = TERMS) -> np.ndarray:
    """The terms that most examples hold, three examples at least."""
    terms, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(e.terms for e in sample)]), return_counts=True)
    order = np.lexsort((terms, -counts))[:limit]
    return terms[order[counts[order] >= 3]]


def truncated_svd(matrix: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """Right singular vectors (columns) for the ``rank`` largest values, by a randomised range finder with two power steps."""
    rank = min(rank, *matrix.shape)
    basis = matrix @ np.random.default_rng(seed).standard_normal((matrix.shape[1], min(rank + 8, *matrix.shape))).astype(matrix.dtype)
    for _ in range(2):
        basis = matrix @ (matrix.T @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    return np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:rank].T


class QualityModel:
    def __init__(self, sample: list[Example], totals: dict[int, int], terms: HashSet, counts: np.ndarray, documents: int):
        self.terms = terms
        self.idf = (np.log((documents + 1) / (counts + 1)) + 1).astype(np.float32)
        self.idf[terms.keys == REPEAT] *= REPEAT_WEIGHT
        found = np.zeros((len(sample), len(terms.keys)), dtype=np.float32)
        for row, e in enumerate(sample):
            at, term = terms.find(e.terms)
            found[row, term] = e.counts[at]
        unit = self._unit(found)
        del found
        self.share = totals.get(1, 0) / max(sum(totals.values()), 1)
        self.labels = np.array([e.label for e in sample], dtype=np.float64)
        sizes = np.bincount(self.labels.astype(int), minlength=2)
        self.fitted = bool(sizes.min() > 1 and unit.shape[1])
        if not self.fitted:
            return
        self.projection = truncated_svd(unit, RANK)
        self.vectors = self._latent(unit)
        raw = self._votes(self.vectors, leave_out=True)
        weight = np.array([totals.get(c, 0) / sizes[c] for c in (0, 1)])[self.labels.astype(int)]
        self.at, self.chance = isotonic(raw, self.labels, weight)

    def _unit(self, counts: np.ndarray) -> np.ndarray:
        weights = np.log1p(counts) * self.idf
        norm = np.linalg.norm(weights, axis=1, keepdims=True)
        return weights / np.where(norm > 0, norm, 1)

    def _latent(self, unit: np.ndarray) -> np.ndarray:
        latent = unit @ self.projection
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return latent / np.where(norm > 0, norm, 1)

    def _votes(self, latent: np.ndarray, leave_out: bool = False, block: int = 512) -> np.ndarray:
        k = min(NEIGHBOURS, len(self.vectors) - leave_out)
        out = np.zeros(len(latent))
        for at in range(0, len(latent), block):
            cosine = latent[at : at + block] @ self.vectors.T
            if leave_out:
                own = np.arange(len(cosine))
                cosine[own, at + own] = -2
            least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]  # all that tie with the k-th vote
            weight = np.where(cosine >= least, np.exp(SHARPNESS * cosine.astype(np.float64)), 0)
            out[at : at + block] = weight @ self.labels / weight.sum(axis=1)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        n, size = len(column), len(self.terms.keys)
        out = np.full(n, self.share)
        if not self.fitted or not n:
            return out
        owner, hashes = term_hashes(column)
        at, term = self.terms.find(hashes)
        counts = np.bincount(owner[at] * size + term, minlength=n * size).reshape(n, size).astype(np.float32)
        latent = self._latent(self._unit(counts))
        known = np.flatnonzero(np.abs(latent).sum(axis=1) > 0)
        raw = self._votes(latent[known])
        out[known] = np.clip(0.99 * np.interp(raw, self.at, self.chance) + 0.01 * raw, 0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    sample, totals = examples(docs, labels, "quality", 5, 0, PER_CLASS)
    terms = HashSet(common_terms(sample))
    return QualityModel(sample, totals, terms, *corpus_counts(docs, terms))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model, keep=["doc_id"]).select("d.doc_id", "score").select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
