"""Bounded samples of labelled documents, as the features that classifiers learn from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.textscan import WORDS, byte_table, column_bytes, shingle_hashes, slices, word_hashes

#: Runs of ASCII symbols; letters, digits, white space and control characters separate them.
SYMBOLS = byte_table(bytes(b for b in range(256) if b <= 32 or b >= 127 or chr(b).isalnum()))
#: Texts from which examples are taken have at most so many bytes. Scoring always reads whole texts.
EXAMPLE_BYTES = 1 << 16
_SKETCH = 64
#: The term that counts words equal to the word before them.
REPEAT = np.uint64(0x52455045_41540001)


@dataclass
class Example:
    doc_id: int
    label: int
    terms: np.ndarray
    counts: np.ndarray


def held_out(modulus: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``rest`` (a null doc_id counts as the empty text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return (F.crc32(F.encode(key, "UTF-8")) % modulus) == rest


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, term hash) of every word, every run of symbols and every repetition of a word."""
    data, offsets = column_bytes(column)
    owners, terms = [], []
    for table in (WORDS, SYMBOLS):
        hashes, first = word_hashes(data, offsets, table)
        owners.append(np.repeat(np.arange(len(column)), np.diff(first)))
        terms.append(hashes)
    again = np.flatnonzero((terms[0][1:] == terms[0][:-1]) & (owners[0][1:] == owners[0][:-1]))
    owners.append(owners[0][again])
    terms.append(np.full(len(again), REPEAT))
    return np.concatenate(owners), np.concatenate(terms)


def folded(text: str = "text") -> Column:
    return F.lower(F.col(text).cast("string")).cast("binary")


def examples(docs: DataFrame, labels: DataFrame, column: str, modulus: int, rest: int, per_class: int) -> tuple[list[Example], dict[int, int]]:
    """At most ``per_class`` examples of each label that are not held out, and the labelled rows of each label.

    Rows are taken in the order of md5(doc_id); labels 0 and 1 only; of several labels of a document
    the largest counts. Of near copies (half of a sketch of three-word shingles seen before) one stays.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("_label"))
    known = known.where(~held_out(modulus, rest))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    picked = [known.where(F.col("_label") == c).orderBy(*order).limit(2 * per_class) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 4 * per_class rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                owner, terms = term_hashes(part.column(2))
                words, first = word_hashes(*column_bytes(part.column(2)))
                rows = []
                for k in range(part.num_rows):
                    own, counts = np.unique(terms[owner == k], return_counts=True)
                    sketch = np.unique(shingle_hashes(words[first[k] : first[k + 1]], 3))[:_SKETCH]
                    rows.append((own.tobytes(), counts.astype(np.int32).tobytes(), sketch.tobytes()))
                blobs = [pa.array([r[j] for r in rows], pa.binary()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *blobs], names=["doc_id", "_label", "terms", "counts", "sketch"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded().alias("_folded")).where(f"octet_length(_folded) between 1 and {EXAMPLE_BYTES}")
    texts = texts.join(ids, "doc_id").groupBy("doc_id", "_label").agg(F.min("_folded").alias("_folded"))  # one row an id, however often it repeats
    rows = texts.mapInArrow(features, "doc_id long, _label int, terms binary, counts binary, sketch binary").collect()
    out: list[Example] = []
    taken, seen = {0: 0, 1: 0}, set()
    for row in sorted(rows, key=lambda r: (-len(r["sketch"]), r["doc_id"], r["_label"])):
        sketch = np.frombuffer(row["sketch"], dtype=np.uint64).tolist()
        if taken[row["_label"]] >= per_class or 2 * sum(h in seen for h in sketch) > len(sketch):
            continue
        seen.update(sketch)
        taken[row["_label"]] += 1
        out.append(Example(row["doc_id"], row["_label"], np.frombuffer(row["terms"], dtype=np.uint64), np.frombuffer(row["counts"], dtype=np.int32)))
    return out, totals


def isotonic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (raw, chance of label 1) of the weighted monotone fit, drawn a little to the overall share."""
    prior = float((label * weight).sum() / max(weight.sum(), 1e-9))
    order = np.argsort(raw, kind="stable")
    points: list[list[float]] = []  # raw sum, weight, label sum
    for x, y, w in zip(raw[order].tolist(), label[order].tolist(), weight[order].tolist(), strict=True):
        if points and points[-1][3] == x:
            points[-1][1] += w
            points[-1][2] += w * y
        else:
            points.append([x, w, w * y, x])
        while len(points) > 1 and points[-2][2] * points[-1][1] >= points[-1][2] * points[-2][1]:
            last = points.pop()
            points[-1] = [points[-1][0], points[-1][1] + last[1], points[-1][2] + last[2], last[3]]
    at, chance = [], []
    for low, w, y, high in points:
        for x in dict.fromkeys((low, high)):
            at.append(x)
            chance.append((y + prior) / (w + 1))
    return np.array(at), np.array(chance)
