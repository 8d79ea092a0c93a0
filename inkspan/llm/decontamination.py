"""Benchmark decontamination with SimHash windows of the size of each item.

Words: lower-cased runs of letters and digits. For every benchmark item of w words, all windows of w
words of every document count (the whole document where it is shorter). A window is a leak of the
item if the weighted Jaccard similarity of their five-word shingles (weights: counts; fewer words:
the whole item) is at least ``similarity``.

1. Windows that hold too few shingles of any item (anchors) cannot reach the similarity and are left out; this is exact.
2. SimHash of each other window from its shingle hashes. A multi-index over Hamming blocks (`hamming.py`), one for the items of
   a size, gives all items within the radius. The radius follows the sizes: at the similarity two bits of codes of n
   shingles differ with a chance that is computed exactly, and the radius is the least that at most ``LOSS`` of such pairs go
   beyond (windows of up to 8 shingles: 0, from 200 on: 20). Shingles are taken as different from one another; runs of one repeated
   shingle weigh more in a code, so a pair that differs in such a run may be lost more often.
3. Of the items found, those of whose shingles the document holds too few go; this is exact. The others' weighted similarity is
   computed exactly.

Documents are scanned in place: no shuffle. A benchmark beyond ``BLOCK_BYTES`` of text is taken in blocks, each in a job of
its own whose leaks are staged and joined with the documents at the end, so what a task holds of it is bounded
whatever its size.

Defined cases: null or empty texts and items match nothing; rows with null ids take part; repeated items are
each reported; repeated rows are each judged; of windows that tie the first is reported; texts are read whole, in slices of
bounded bytes; an empty benchmark leaves every document clean; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import lookup_join, packed, read_table, row_key, stage, unpacked
from inkspan.llm.hamming import HammingIndex
from inkspan.llm.textscan import HashSet, column_bytes, shingle_hashes, slices, spread, word_hashes

BLOCK_BYTES = 16 << 20
WIDTH = 5
#: Share of the pairs at the very similarity whose codes may lie beyond the radius.
LOSS = 0.0005
MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("similarity", T.DoubleType())])
_ARROW_MATCH = pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64())])


def simhash(hashes: np.ndarray) -> np.uint64:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(hashes)).view(">u8")[0].astype(np.uint64)


def _coins(n: int) -> np.ndarray:
    """Chances of 0, 1, ... n ones among n fair bits."""
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    return np.exp(logs[n] - logs - logs[::-1] - n * math.log(2))


def flip_chance(size: int, span: int, shared: int) -> float:
    """Chance that a bit of the codes of ``size`` and ``span`` shingles differs, of which ``shared`` are the same and all others random."""
    same = np.arange(shared + 1)

    def over_half(n: int) -> np.ndarray:
        """Chance of a one for each number of ones among the shared."""
        above = np.concatenate((np.cumsum(_coins(n - shared)[::-1])[::-1], [0.0]))  # chance of at least k ones among the others
        return above[np.clip(n // 2 + 1 - same, 0, n - shared + 1)]

    a, b = over_half(size), over_half(span)
    return float((_coins(shared) * (a * (1 - b) + b * (1 - a))).sum())


@cache
def radius_of(size: int, span: int, similarity: float) -> int:
    """The least radius that all but ``LOSS`` of the pairs of ``size`` and ``span`` shingles at the similarity lie within."""
    shared = math.ceil(similarity * (size + span) / (1 + similarity) - 1e-9)
    if shared > min(size, span):
        return 0
    chance, within = min(1.0, flip_chance(size, span, shared)), 0.0
    for bits in range(64):
        within += math.comb(64, bits) * chance**bits * (1 - chance) ** (64 - bits)
        if within >= 1 - LOSS:
            return bits
    return 64


class ItemIndex:
    """All that a task needs of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes]], similarity: float, radius: int | None = None):
        self.ids = [i for i, _ in items]
        self.similarity = similarity
        data = np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8)
        words, first = word_hashes(data, np.cumsum([0, *(len(t) for _, t in items)]))
        self.shingles: list[tuple[np.ndarray, np.ndarray]] = []
        short: dict[int, dict[int, list[int]]] = {}
        sizes: dict[int, list[int]] = {}
        every, codes = [np.zeros(0, np.uint64)], np.zeros(len(items), dtype=np.uint64)
        for k in range(len(items)):
            own = words[first[k] : first[k + 1]]
            hashes = shingle_hashes(own, min(WIDTH, max(len(own), 1)))
            self.shingles.append(np.unique(hashes, return_counts=True))
            if 0 < len(own) < WIDTH:
                short.setdefault(len(own), {}).setdefault(int(hashes[0]), []).append(k)
            elif len(own):
                sizes.setdefault(len(own), []).append(k)
                every.append(hashes)
                codes[k] = simhash(hashes)
        self.anchors = HashSet(np.concatenate(every), 22)
        self.radius = radius
        self.classes = {w: (np.array(ks), HammingIndex(codes[ks])) for w, ks in sorted(sizes.items())}
        self.need = np.full(len(items), np.iinfo(np.int64).max)
        for w, (ks, _) in self.classes.items():
            self.need[ks] = np.ceil(similarity * (w - WIDTH + 1) - 1e-9)
        # items of each anchor, and how often the item has it
        owner = np.repeat(np.arange(len(items)), [len(u) for u, _ in self.shingles])
        keys = np.concatenate([np.zeros(0, np.uint64), *(u for u, _ in self.shingles)])
        at, key = self.anchors.find(keys)
        order = np.lexsort((owner[at], key))
        self.item_of = owner[at][order]
        self.items_from = np.searchsorted(key[order], np.arange(len(self.anchors.keys) + 1))
        self.short = {w: (HashSet(np.array(list(by), dtype=np.uint64)), by) for w, by in short.items()}
        self.longest = max(self.classes, default=0)

    def weighted(self, window: np.ndarray, item: int) -> float:
        keys, counts = self.shingles[item]
        own, n = np.unique(window, return_counts=True)
        _, a, b = np.intersect1d(keys, own, assume_unique=True, return_indices=True)
        shared = int(np.minimum(counts[a], n[b]).sum())
        return shared / (int(counts.sum()) + len(window) - shared)

    def wanted(self, keys: np.ndarray) -> np.ndarray:
        """Items of which a document with these anchors (repeats included) holds enough shingles for a match."""
        _, at = spread(self.items_from[keys], self.items_from[keys + 1] - self.items_from[keys])
        item, held = np.unique(self.item_of[at], return_counts=True)
        return item[held >= self.need[item]]

    def matches(self, hashes: np.ndarray, anchored: np.ndarray, keys: np.ndarray) -> list[dict]:
        """The best window of each leaked item; hashes: a document's shingles, anchored: positions of item shingles, keys: which."""
        wanted = self.wanted(keys)
        if not len(wanted):
            return []
        begin, end = max(0, int(anchored[0]) - self.longest), min(len(hashes), int(anchored[-1]) + self.longest)
        own = hashes[begin:end]
        held = np.zeros(len(own) + 1, dtype=np.int64)
        held[anchored - begin + 1] = 1
        held = np.cumsum(held)
        bits = None
        best: dict[int, tuple[float, int, int]] = {}
        for words, (group, index) in self.classes.items():
            able = np.isin(group, wanted, assume_unique=True)
            if not able.any():
                continue
            size = words - WIDTH + 1
            span = min(size, len(hashes))
            if span > len(own):
                continue
            start = np.flatnonzero(held[span:] - held[:-span] >= self.similarity * size - 1e-9)
            if not len(start):
                continue
            if bits is None:
                bits = np.zeros((len(own) + 1, 64), dtype=np.int32)
                np.cumsum(np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=bits[1:])
            codes = np.packbits(2 * (bits[start + span] - bits[start]) > span, axis=1).view(">u8")[:, 0].astype(np.uint64)
            window, item = index.near(codes, radius_of(size, span, self.similarity) if self.radius is None else self.radius)
            for w, item in zip(window[able[item]].tolist(), item[able[item]].tolist(), strict=True):
                k, at = int(group[item]), int(start[w])
                if k in best and best[k][0] == 1.0:
                    continue
                found = self.weighted(own[at : at + span], k)
                if found >= self.similarity and (k not in best or found > best[k][0]):
                    best[k] = (found, begin + at, span + WIDTH - 1)
        return [{"item_id": self.ids[k], "first_word": at, "words": n, "similarity": s} for k, (s, at, n) in sorted(best.items())]

    def scan(self, column: pa.Array) -> list[list[dict]]:
        """For each text the items it leaks."""
        words, first = word_hashes(*column_bytes(column))
        out: list[list[dict]] = [[] for _ in range(len(column))]
        hashes = shingle_hashes(words, WIDTH)
        at, key = self.anchors.find(hashes)
        text = np.searchsorted(first, at, side="right") - 1
        inside = at + WIDTH <= first[text + 1]
        at, text, key = at[inside], text[inside], key[inside]
        for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(text)) + 1) if len(at) else []:
            t = int(text[some[0]])
            out[t] = self.matches(hashes[first[t] : first[t + 1] - WIDTH + 1], at[some] - first[t], key[some])
        for width, (known, by) in self.short.items():
            grams = shingle_hashes(words, width)
            at, key = known.find(grams)
            text = np.searchsorted(first, at, side="right") - 1
            inside = at + width <= first[text + 1]
            done = set()
            for p, k, t in zip(at[inside].tolist(), key[inside].tolist(), text[inside].tolist(), strict=True):
                if (t, k) not in done:
                    done.add((t, k))
                    out[t] += [{"item_id": self.ids[i], "first_word": p - int(first[t]), "words": width, "similarity": 1.0} for i in by[int(known.keys[k])]]
        return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of bounded size, streamed to the driver one partition after the other."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.lower(F.col("text").cast("string")).cast("binary"))
    block, size = [], 0
    for item_id, text in rows.toLocalIterator():
        block.append((item_id, bytes(text)))
        size += len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan(rows: DataFrame, block: list[tuple[int | None, bytes]], similarity: float, radius: int | None) -> DataFrame:
    """(d, leaks) of (d, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(ItemIndex(block, similarity, radius))  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scan(part.column(1)), pa.list_(_ARROW_MATCH))], names=["d", "leaks"])

    return rows.mapInArrow(run, T.StructType([rows.schema["d"], T.StructField("leaks", T.ArrayType(MATCH))]))


def leaks_of(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """(d, leaks): the columns of ``docs`` in a struct and an array of its leaks (item_id, first_word, words, similarity); no ``radius``: by size."""
    text = F.lower(F.col("text").cast("string")).cast("binary").alias("text")
    blocks = item_blocks(benchmark)
    block, further = next(blocks, []), next(blocks, None)
    if further is None:
        return _scan(packed(docs, text), block, similarity, radius)
    found = None
    for some in chain((block, further), blocks):
        rows = docs.select(F.struct(row_key(docs).alias("row")).alias("d"), text)
        part = stage(_scan(rows, some, similarity, radius).where("size(leaks) > 0").select("d.row", "leaks").dropDuplicates(["row"]))
        found = part if found is None else found.unionByName(part)
    found = stage(found.groupBy("row").agg(F.flatten(F.collect_list("leaks")).alias("leaks")))
    rows = lookup_join(packed(docs, row_key(docs).alias("row")), found, ["row"], "left", "shuffle_hash")
    return rows.select("d", F.coalesce("leaks", F.array().cast(T.ArrayType(MATCH))).alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int | None = None, out: str = "_leaks") -> DataFrame:
    """``docs`` with an array of its leaks (item_id, first_word, words, similarity) in a further column ``out``."""
    if out in docs.columns:
        raise ValueError(f"docs have a column {out} already")
    return unpacked(leaks_of(docs, benchmark, similarity, radius), docs.columns, **{out: F.col("leaks")})


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their columns."""
    return unpacked(leaks_of(docs, benchmark).where("size(leaks) = 0"), docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), similarity (the largest; 0 without a leak) of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks_of(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("d.doc_id").cast("long").alias("doc_id"),
        (F.size("leaks") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("leaks.item_id"))).alias("item_ids"),
        F.coalesce(F.array_max(F.col("leaks.similarity")), F.lit(0.0)).alias("similarity"),
    )
