"""SimHash fingerprints and their links within a Hamming radius, by a Gray-order hierarchical index.

Fingerprints: whole texts, A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width`` words
(repeats included, fewer words: the whole sequence), XXH64 with seed 42 of each shingle; a bit is set if it is set
in over half of the hashes. No words: fingerprint zero.

Links (radius 3): equal fingerprints are collapsed first. Two fingerprints within the radius agree on
one of four blocks of bits, so the index has four rotations and its top node of each is a shared block
value. A node with over ``GROUP_ROWS`` codes is cut again by blocks of its remaining bits (exact, for the same reason);
after four cuts at most 2^20 codes can share a node. Within a node codes are sorted by Gray rank; runs of
codes form nodes that hold the bits all their codes share, less those that upper nodes have. A search adds up
differing bits downwards and leaves whole subtrees beyond the radius. Each task emits a spanning forest
of the links it found, never the pairs, and connected components join the forests.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a null doc_id takes part
and a component's id is its smallest doc_id that is not null; repeated rows come back as often; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import connected_components, lookup_join, read_table, stage
from inkspan.llm.textscan import slices

#: Codes that one node of the upper index may hold before it is cut again.
GROUP_ROWS = 1024
#: Children of a node of the lower index.
FANOUT = 8
#: Widths of the four blocks, cut by cut.
CUTS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6))

#: Byte value -> its eight bits in eight byte lanes, lane k for bit k.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprints_of(texts: list[bytes | None], width: int = 3) -> np.ndarray:
    """SimHash of each text as uint64."""
    import xxhash

    digest, hashes, counts = xxhash.xxh64_digest, [], []
    for text in texts:
        words = (text or b"").lower().split()
        if len(words) > width:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
            n = len(words) - width + 1
        else:
            shingles, n = [b" ".join(words)] if words else [], min(len(words), 1)
        hashes.append(b"".join(map(digest, shingles, repeat(42))))
        counts.append(n)
    n = np.array(counts, dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    rows = np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(-1, 8)
    # sums of byte lanes over runs of up to 255 shingles, then over a text's runs
    runs = -(-n[full] // 255)
    first_run = np.concatenate(([0], np.cumsum(runs)[:-1]))
    starts = np.repeat(np.concatenate(([0], np.cumsum(n[full])[:-1])) - 255 * first_run, runs) + 255 * np.arange(runs.sum())
    value = np.zeros(len(full), dtype=np.uint64)
    for byte in range(8):  # digests are big-endian
        sums = np.add.reduceat(_LANES[rows[:, byte]], starts)
        bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        value |= ((2 * bits > n[full, None]).astype(np.uint64) << (np.arange(8, dtype=np.uint64) + np.uint64(8 * (7 - byte)))).sum(axis=1, dtype=np.uint64)
    out[full] = value
    return out


def fingerprint(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):  # the words of a slice are lists at once
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1).to_pylist(), width).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, its index and first[i] .. first[i] + count[i] - 1."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


class GrayIndex:
    """Hierarchical index over codes grouped by key; both sorted by (key, Gray rank)."""

    def __init__(self, key: np.ndarray, codes: np.ndarray):
        self.codes = codes
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((first, [len(key)])))
        both, either = codes, codes
        self.levels: list[dict] = []
        while True:
            nodes = -(-size // FANOUT)
            group, index = _spread(np.zeros(len(first), dtype=np.int64), nodes)
            child = first[group] + index * FANOUT
            count = np.minimum(FANOUT, size[group] - index * FANOUT)
            both, either = np.bitwise_and.reduceat(both, child), np.bitwise_or.reduceat(either, child)
            mask = ~(both ^ either)
            self.levels.append({"child": child, "count": count, "mask": mask, "pattern": both & mask, "last": (child + count - 1) if len(self.levels) == 0 else self.levels[-1]["last"][child + count - 1]})
            first, size = np.cumsum(nodes) - nodes, nodes
            if (nodes == 1).all():
                break
        self.root = np.repeat(np.arange(len(first)), np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), [len(key)]))))

    def links(self, radius: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), first <= i < end and i < j, of one key whose codes differ in at most ``radius`` bits."""
        query = np.arange(first, end)
        node, apart = self.root[first:end], np.zeros(end - first, dtype=np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            open_ = level["last"][node] > query
            query, node, apart = query[open_], node[open_], apart[open_]
            owner, child = _spread(level["child"][node], level["count"][node])
            q, used = self.codes[query[owner]], level["mask"][node[owner]]
            if depth:
                below = self.levels[depth - 1]
                differ = (q ^ below["pattern"][child]) & below["mask"][child] & ~used
            else:
                differ = (q ^ self.codes[child]) & ~used
            total = apart[owner] + np.bitwise_count(differ)
            near = total <= radius
            query, node, apart = query[owner[near]], child[near], total[near]
        later = node > query
        return query[later], node[later]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0 .. n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = np.minimum(new, new[new])
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _link_groups(batches: Iterator[pa.RecordBatch], radius: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links within each key; rows come sorted by key."""

    def solve(key: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(codes), key))
        key, codes = key[order], codes[order]
        index, left, right = GrayIndex(key, codes), [], []
        _, sizes = np.unique(key, return_counts=True)
        step = max(1, (1 << 22) // int(sizes.max()))
        label = np.arange(len(codes))
        for first in range(0, len(codes), step):
            i, j = index.links(radius, first, min(first + step, len(codes)))
            left.append(i), right.append(j)
            if sum(map(len, left)) > 1 << 22 or first + step >= len(codes):
                label = forest(len(codes), np.concatenate([*left, np.arange(len(codes))]), np.concatenate([*right, label]))
                left, right = [], []
        linked = np.flatnonzero(label != np.arange(len(codes)))
        return pa.RecordBatch.from_arrays([pa.array(codes[linked].view(np.int64)), pa.array(codes[label[linked]].view(np.int64))], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        if sum(len(k) for k, _ in held) < rows:
            continue
        key, codes = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if cut:
            yield solve(key[:cut], codes[:cut])
        held = [(key[cut:], codes[cut:])]
    if held and sum(len(k) for k, _ in held):
        yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def fingerprint_edges(codes: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) that connect all distinct ``fp`` within ``radius`` (at most 3) of one another."""
    if radius > 3:
        raise ValueError("four blocks guarantee a radius of 3")
    left = codes.select("fp", F.col("fp").alias("_rest"), F.lit(0).cast("long").alias("_key"))
    out = None
    for cut, widths in enumerate(CUTS):
        options, low = [], 0
        for block, width in enumerate(widths):
            value = F.shiftrightunsigned("_rest", low).bitwiseAND(F.lit((1 << width) - 1))
            high = F.shiftleft(F.shiftrightunsigned("_rest", low + width), low) if low + width < sum(widths) else F.lit(0).cast("long")
            rest = high.bitwiseOR(F.col("_rest").bitwiseAND(F.lit((1 << low) - 1)))
            options.append(F.struct(F.xxhash64("_key", F.lit(cut), F.lit(block), value).alias("_key"), rest.alias("_rest")))
            low += width
        rows = stage(left.select("fp", F.explode(F.array(*options)).alias("_o")).select("fp", "_o._key", "_o._rest"))
        last = cut == len(CUTS) - 1
        hot = None if last else stage(rows.groupBy("_key").agg(F.count("*").alias("_n")).where(f"_n > {GROUP_ROWS}").select("_key"))
        if hot is not None and hot.isEmpty():
            hot = None
        ready = rows if hot is None else lookup_join(rows, hot, ["_key"], "left_anti")
        found = ready.select("_key", "fp").repartition("_key").sortWithinPartitions("_key").mapInArrow(lambda b: _link_groups(b, radius), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if hot is None:
            return out
        left = lookup_join(rows, hot, ["_key"], "left_semi")
    return out


def components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for staged ``prints`` (doc_id, fp)."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("_low")))
    roots = stage(connected_components(fingerprint_edges(distinct.select("fp"), radius)).withColumnRenamed("node", "fp"))
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("_low").alias("component_id"))
    names = stage(named.join(lowest, "root").select("fp", "component_id"))
    return lookup_join(prints, names, ["fp"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    return components(stage(fingerprint(docs, width)), radius)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
