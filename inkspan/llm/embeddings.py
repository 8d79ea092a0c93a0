"""Near-duplicate vectors by rotated binary codes with correction factors (one bit a dimension).

1. Exact copies (label and vector) collapse to one class with a count.
2. A seeded random rotation turns each unit vector o into o'; its code is the signs of o', its stored factor is
   f = <o', sign(o')> / sqrt(D). For a query q the value <sign(o'), q'> / (sqrt(D) f) estimates <o, q> without bias,
   and its error stays below ``SPREAD`` * sqrt((1 - f^2) / f^2 / (D - 1)) but for a chance that falls with
   exp(-SPREAD^2 / 2). Pairs whose upper bound reaches the threshold are computed exactly in double precision; all
   others are passed over. A link is always an exact cosine.
3. The classes of a label are dealt to blocks of ``BLOCK_ROWS`` (fewer where vectors are long). A task holds one block, compares it
   with itself and with up to ``CELL_ROWS`` visitors of lower pairs, which stream past it; so each pair of a label meets once, and a
   task's memory and work are bounded however many vectors a label has. No partition of 64 dimensions prunes at this threshold
   (cells by the first 14 bits of the code would leave 0.71 of all cells to visit), so none is made: a vector is sent to as many tasks
   as there are blocks before its own, half of all on average, 31 for a million vectors of a label in 64 dimensions.
4. Tasks emit counts and spanning forests, not pairs.

Defined cases: rows whose label or vector is null, or whose vector is empty, zero or holds null or
non-finite components, link with nothing (component_id: their vec_id); vectors of different length are not compared;
rows that repeat a vec_id count as vectors, those of a null vec_id too (they name no component and are not kept);
ties have no order to decide, as links are counts; equal 64-bit hashes of label and vector count as equal vectors (chance n^2 / 2^65); vectors of any length are compared whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import connected_components, lookup_join, read_table, stage
from inkspan.llm.simhash import forest

THRESHOLD = 0.93
SPREAD = 4.0
#: Visitors and residents of a task at most, and entries of its residents' vectors.
CELL_ROWS, BLOCK_ROWS = 1 << 20, 16384
BLOCK_VALUES = 1 << 20
TILE = 512


@cache
def rotation(size: int, seed: int = 3) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column (all of one length, no nulls) as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated unit vectors, signs, factors)."""
    size = vectors.shape[1]
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ rotation(size)
    return turned, turned >= 0, np.abs(turned).sum(axis=1) / np.sqrt(size)


class _Block:
    """Vectors of (key, visitor, own, cid, n, embedding) rows, as codes, factors and originals."""

    def __init__(self, part: pa.RecordBatch):
        self.cid, self.n = part.column(3).to_numpy(), part.column(4).to_numpy()
        self.vectors = matrix(part.column(5))
        self.turned, self.signs, self.factor = encode(self.vectors)
        self.length = np.linalg.norm(self.vectors, axis=1)


class _Residents(_Block):
    """A block, laid out to be compared with many."""

    def __init__(self, part: pa.RecordBatch, threshold: float):
        super().__init__(part)
        size = self.turned.shape[1]
        self.threshold = threshold
        self.codes = np.where(self.signs, 1, -1).astype(np.float32).T / np.float32(np.sqrt(size))
        self.codes /= self.factor.astype(np.float32)
        margin = SPREAD * np.sqrt(np.maximum(1 - self.factor**2, 0) / self.factor**2 / max(size - 1, 1))
        self.least = (threshold - 1e-5 - margin).astype(np.float32)

    def hits(self, visitors: _Block, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, resident) with an exact cosine of at least the threshold, for a tile of visitors from ``at`` on."""
        v, r = np.nonzero(visitors.turned[at : at + TILE].astype(np.float32) @ self.codes >= self.least)
        v += at
        keep = np.zeros(len(v), dtype=bool)
        for k in range(0, len(v), 1 << 16):
            a, b = v[k : k + (1 << 16)], r[k : k + (1 << 16)]
            keep[k : k + (1 << 16)] = np.einsum("ij,ij->i", visitors.vectors[a], self.vectors[b]) / (visitors.length[a] * self.length[b]) >= self.threshold
        return v[keep], r[keep]


def _report(visitors: _Block, block: _Block, v: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    """Counts (cid, links) and a spanning forest (u, v) of the pairs."""
    size = len(visitors.cid)
    cid = np.concatenate((visitors.cid, block.cid))
    counts = np.bincount(v, block.n[r], minlength=len(cid)) + np.bincount(size + r, visitors.n[v], minlength=len(cid))
    label = forest(len(cid), v, size + r)
    some, tied = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(cid)))
    columns = [np.concatenate((cid[some], np.zeros(len(tied), np.int64))), np.concatenate((counts[some].astype(np.int64), np.zeros(len(tied), np.int64)))]
    edges = [np.concatenate((np.zeros(len(some), np.int64), cid[x])) for x in (tied, label[tied])]
    edge = np.arange(len(some) + len(tied)) >= len(some)
    return pa.RecordBatch.from_arrays([*(pa.array(c, mask=edge) for c in columns), *(pa.array(e, mask=~edge) for e in edges)], names=["cid", "links", "u", "v"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Counts and edges of (key, visitor, own, cid, n, embedding); rows come sorted by (key, visitor), so residents come first."""
    held: list[pa.RecordBatch] = []
    key = block = None

    def settle() -> Iterator[pa.RecordBatch]:
        """The residents are complete: compare them with one another, if this is the task for it."""
        nonlocal block, held
        if held:
            own = held[0].column(2)[0].as_py()
            block = _Residents(pa.Table.from_batches(held).combine_chunks().to_batches()[0], threshold)
            held = []
            for at in range(0, len(block.cid) if own else 0, TILE):
                v, r = block.hits(block, at)
                once = v < r
                if once.any():
                    yield _report(block, block, v[once], r[once])

    for batch in batches:
        keys, guest = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        change = np.flatnonzero((keys[1:] != keys[:-1]) | (guest[1:] != guest[:-1])) + 1
        for at, end in zip([0, *change.tolist()], [*change.tolist(), len(keys)], strict=True):
            if end == at:
                continue
            part = batch.slice(at, end - at)
            if keys[at] != key:
                yield from settle()
                key, block = keys[at], None
            if not guest[at]:
                held.append(part)
                continue
            yield from settle()
            if block is None:  # a hash that leaves a block without residents
                continue
            for k in range(0, part.num_rows, TILE):
                visitors = _Block(part.slice(k, TILE))
                v, r = block.hits(visitors, 0)
                if len(v):
                    yield _report(visitors, block, v, r)
    yield from settle()


def meetings(block: Column, blocks: Column) -> Column:
    """Array of (to, span, visitor, own): where a vector of a block goes. A task is a block (to) with a span of visitors' blocks."""
    span = max(1, CELL_ROWS // BLOCK_ROWS)

    def one(to: Column, of: Column, visitor: Column, own: bool) -> Column:
        return F.struct(to.alias("to"), F.floor(of / span).alias("span"), visitor.alias("visitor"), F.lit(own).alias("own"))

    # a visitor of the blocks before its own, a resident of its own
    here = F.transform(F.sequence(F.lit(0), block), lambda to: one(to, block, to < block, True))
    # and a resident in the tasks of its block that later spans visit
    later = F.filter(F.sequence(F.lit(0), F.floor((blocks - 1) / span)), lambda s: s > F.floor(block / span))
    return F.concat(here, F.transform(later, lambda s: one(block, s * span, F.lit(False), False)))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    vec = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    valid = F.col("label").isNotNull() & sound
    narrow = dict(vectors.dtypes)["embedding"] == "array<float>"  # sent as it is; tasks compute in double precision
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid, F.xxhash64("label", "embedding")).alias("cid"), "label", F.col("embedding") if narrow else vec.alias("embedding"))
    ids = stage(rows.select("vec_id", "cid"))
    classes = stage(
        rows.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("group", F.xxhash64("label", F.size("embedding"))).drop("label")
    )
    rows_of = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_VALUES / F.first(F.size("embedding")))))
    groups = stage(classes.groupBy("group").agg(F.ceil(F.count("*") / rows_of).cast("int").alias("blocks")))
    dealt = lookup_join(classes, groups, ["group"]).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), "blocks").cast("int"))
    sent = dealt.select("cid", "n", "group", "embedding", F.inline(meetings(F.col("block"), F.col("blocks"))))
    sent = sent.select(F.xxhash64("group", "to", "span").alias("key"), "visitor", "own", "cid", "n", "embedding")
    found = stage(sent.repartition("key").sortWithinPartitions("key", "visitor").mapInArrow(lambda b: _compare(b, threshold), "cid long, links long, u long, v long"))
    links = found.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    roots = stage(connected_components(found.where("u is not null").select("u", "v")).withColumnRenamed("node", "cid"))
    named = classes.select("cid", "low", "n").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stage(named.join(lowest, "root").select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    out = lookup_join(ids, named, ["cid"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
