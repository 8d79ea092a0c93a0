"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of ``GRAMS`` bytes of the lower-cased text, in which everything that is no letter counts as one
boundary; each is hashed to one of ``BUCKETS`` embeddings. A document is the mean of its subwords' embeddings, and a
linear softmax gives the languages' chances. Embeddings and softmax are trained together by stochastic
gradient descent in numpy, from at most ``PER_LANGUAGE`` examples of each language and ``EXAMPLES`` in all (texts of up to 32 KiB) that
are not held out, of the ``LANGUAGES`` languages that most rows have; executors turn them into bucket counts, and the driver holds these sparsely. Of few languages embeddings and weights
fold into one table of scores per bucket after training, so a document costs one lookup a subword.

Calibrated rejection: the temperature of the softmax and the score below which a prediction is ``rejected`` are
set on a part of the examples kept out of training, the latter so that at most ``MISSED`` of right predictions are rejected.

Defined cases: null texts and texts without a letter are ``und`` with score 0.0; without any example so is every text; a
single letter has subwords too, as boundaries stand at both ends; null languages teach nothing; of a doc_id that
repeats the least text teaches; null doc_ids and repeated rows are predicted as any row; languages that tie go to the
first by name; texts are read whole, in slices of bounded bytes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.llm.common import lookup_join, read_table, stage
from inkspan.llm.labelled import held_out
from inkspan.llm.textscan import _random, column_bytes, mix, slices

GRAMS = (2, 3, 4)
BUCKETS = 1 << 14
DIMENSIONS = 16
PER_LANGUAGE = 512
#: Bounds of what the driver gets, whatever the column of languages holds.
LANGUAGES, EXAMPLES = 512, 1 << 15
EXAMPLE_BYTES = 1 << 15
MISSED = 0.005
_SALTS = 16

#: Letters (ASCII letters and all bytes beyond ASCII) have values of their own, all else is one boundary.
_LETTERS = _random(72, 256)
_BOUNDARY = _LETTERS[0]
for _b in range(128):
    if not chr(_b).isalpha():
        _LETTERS[_b] = _BOUNDARY
_STEP = np.uint64(0x9E3779B97F4A7C15)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each subword, first subword of each text) for each length of ``GRAMS``."""
    values = _LETTERS[data]
    wall = values == _BOUNDARY
    keep = ~wall
    keep[1:] |= wall[1:] & ~wall[:-1]  # of a run of boundaries the first stays
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    values, first = values[keep], place[offsets]
    for size in GRAMS:
        n = len(values) - size + 1
        total = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(size):
            total = total * _STEP + values[k : k + len(total)]
        bucket = (mix(total) >> np.uint64(50)).astype(np.int64)
        # a text's subwords lie within it
        begin, end = first[:-1], np.maximum(first[1:] - size + 1, first[:-1])
        good = np.zeros(len(total) + 1, dtype=np.int64)
        np.add.at(good, np.minimum(begin, len(total)), 1)
        np.add.at(good, np.minimum(end, len(total)), -1)
        inside = np.cumsum(good[:-1]) > 0
        yield bucket[inside], np.concatenate(([0], np.cumsum(np.maximum(np.minimum(end, len(total)) - np.minimum(begin, len(total)), 0))))


def ended() -> Column:
    """The lower-cased text between boundaries."""
    return F.encode(F.concat(F.lit(" "), F.lower(F.col("text").cast("string")), F.lit(" ")), "UTF-8")


def bucket_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    found = subwords(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    return np.unique(np.concatenate([bucket for bucket, _ in found]), return_counts=True)


class LanguageModel:
    def __init__(self, names: list[str], examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 9, steps: int = 640, batch: int = 32, rate: float = 60.0):
        self.names = names if examples else []
        if not self.names:
            return
        rng = np.random.default_rng(seed)

        def dense(some: np.ndarray) -> np.ndarray:
            """Shares of the buckets in a few examples."""
            rows = np.zeros((len(some), BUCKETS), dtype=np.float32)
            for k, e in enumerate(some.tolist()):
                bucket, count = examples[e]
                rows[k, bucket] = count / max(count.sum(), 1)
            return rows

        order = rng.permutation(len(examples))
        held = order[: len(order) // 5] if len(order) >= 20 else order[:0]
        train = order[len(held) :]
        embed = (rng.standard_normal((BUCKETS, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
        weights, bias = np.zeros((DIMENSIONS, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
        target = np.eye(len(names), dtype=np.float32)
        epochs = -(-steps // max(1, -(-len(train) // batch)))  # few examples are seen more often
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            for at in range(0, len(train), batch):
                some = train[at : at + batch]
                rows = dense(some)
                mean = rows @ embed
                error = (self._softmax(mean @ weights + bias) - target[labels[some]]) / len(some)
                back = error @ weights.T
                weights -= 0.05 * pace * mean.T @ error
                bias -= 0.005 * pace * error.sum(axis=0)
                embed -= pace * rows.T @ back
        few = len(names) <= DIMENSIONS
        self.table = (embed @ weights if few else embed).astype(np.float64)
        self.head = np.eye(len(names)) if few else weights.astype(np.float64)
        self.bias = bias.astype(np.float64)
        check = held if len(held) else train
        raw = np.concatenate([dense(check[at : at + batch]) @ self.table for at in range(0, len(check), batch)]) @ self.head + self.bias
        heats = np.geomspace(0.1, 20, 60)
        loss = [-np.log(np.maximum(self._softmax(raw * h)[np.arange(len(check)), labels[check]], 1e-12)).mean() for h in heats]
        self.heat = float(heats[int(np.argmin(loss))])
        chance = self._softmax(raw * self.heat)
        right = chance.argmax(axis=1) == labels[check]
        self.least = float(np.quantile(chance.max(axis=1)[right], MISSED)) if right.any() else 0.0

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language index, chance) of each text."""
        data, offsets = column_bytes(column)
        width = self.table.shape[1]
        total, count = np.zeros((len(column), width)), np.zeros(len(column))
        for bucket, first in subwords(data, offsets):
            n = np.diff(first)
            some = np.flatnonzero(n)
            count += n
            if len(some):
                for c in range(width):
                    total[some, c] += np.add.reduceat(self.table[:, c][bucket], first[:-1][some])
        chance = self._softmax(((total / np.maximum(count, 1)[:, None]) @ self.head + self.bias) * self.heat)
        return chance.argmax(axis=1), chance.max(axis=1)


def fit(docs: DataFrame) -> LanguageModel:
    """Learns from text and language of documents that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(3, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    frequent = stage(known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang"))
    each = min(PER_LANGUAGE, EXAMPLES // max(1, frequent.count()))
    known = lookup_join(known, frequent, ["lang"])
    order = F.md5(F.col("doc_id").cast("string"))
    # each (language, salt) keeps its first rows already before the shuffle, so a frequent language moves no more than a rare one
    salted = known.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(order, "doc_id"))).where(f"_rank <= {each // _SALTS}")
    ids = stage(ranked.select("doc_id", F.col("lang").alias("_lang")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ended().alias("_ended")).where(f"octet_length(_ended) between 3 and {EXAMPLE_BYTES}")
    texts = lookup_join(texts, ids, ["doc_id"]).groupBy("doc_id", "_lang").agg(F.min("_ended").alias("_ended"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bucket_counts(text) for text in batch.column(2).to_pylist()]
            blobs = [pa.array([f[j].astype(np.int32).tobytes() for f in found], pa.binary()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *blobs], names=["doc_id", "lang", "buckets", "counts"])

    rows = sorted(map(tuple, texts.select("doc_id", "_lang", "_ended").mapInArrow(count, "doc_id long, lang string, buckets binary, counts binary").collect()))
    # repeated texts teach once
    rows = list({(lang, bytes(b), bytes(c)): None for _, lang, b, c in rows})
    names = sorted({lang for lang, _, _ in rows})
    at = {lang: k for k, lang in enumerate(names)}
    return LanguageModel(names, [(np.frombuffer(b, np.int32), np.frombuffer(c, np.int32)) for _, b, c in rows], np.array([at[lang] for lang, _, _ in rows], dtype=np.int64))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.names, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                lettered = part.column(1).to_numpy(zero_copy_only=False)
                if shared.value.names:
                    which, score = shared.value.predict(part.column(2))
                else:
                    which, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                which = np.where(lettered, which, -1)
                score = np.where(which < 0, 0.0, score)
                least = shared.value.least if shared.value.names else 1.0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[which], pa.string()), pa.array(score), pa.array(score < least)], names=["doc_id", "lang_pred", "score", "rejected"])

    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lettered.alias("_lettered"), ended().alias("_ended")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")
