"""Whitening of embeddings by an exact integer scatter.

1. Every entry c becomes the integer x = floor(1024 c) + 100000. Each batch subtracts its first row as a shift, forms the sums of rows and of
   cross-products (by float64 products where every sum stays below 2^53 and so is exact, by Python integers elsewhere), moves them back
   to the common origin in Python integers and adds them to its task's; a task hands on one row for each entry, in two decimal limbs.
2. Spark sums the limbs by entry, so nothing but d (d + 3) / 2 + 1 numbers reaches the driver for d dimensions, whatever the number of rows.
3. n XᵀX - SSᵀ is formed in integers; only then are the quotients by n² rounded to float and decomposed by eigh.
4. A second scan centres each row exactly ((x - S div n) - (S mod n) / n), projects and scales it; the check of the identity sums centred
   products of what it wrote.

Defined cases: rows whose vector is null or empty or holds null or non-finite entries go; where lengths differ, that of most vectors counts
(ties: the least) and the others go; entries beyond ±2^61 in x stop there; components are those whose eigenvalue stands above the
rounding of the decomposition (equal vectors, or one vector, have none and give no rows); of a component's two signs that counts which makes
its entry of largest size positive; ties of eigenvalues keep the order of eigh; rows that repeat, and null vec_ids, are rows like others; a
deviation beyond a long is null and stands in ``deviation_exact`` only; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import read_table, stage

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Largest size of an integer, and the base of the two limbs of a sum.
BOUND, LIMB = 1 << 61, 10**18
#: Rows of a batch that are multiplied at once, and the largest integer below which float64 sums are exact.
BLOCK, EXACT = 4096, 1 << 53


def sound(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    entry = F.transform(column, lambda c: c.cast("double"))
    bad = F.exists(entry, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    return embeddings.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad)


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The length of most vectors, the least of them; 0 without any."""
    most = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return most["d"] if most else 0


def integers(column: pa.Array) -> np.ndarray:
    """x of each entry, one row a vector."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    return (np.clip(values, -BOUND, BOUND).astype(np.int64) + OFFSET).reshape(len(column), -1)


def scatter(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, XᵀX) of int64 rows as Python integers."""
    n, d = x.shape
    shift = [int(v) for v in x[0]]
    sums, products = np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
    for at in range(0, n, BLOCK):
        block = x[at : at + BLOCK]
        far = max(max(abs(int(block.max()) - min(shift)), abs(int(block.min()) - max(shift))), 1)
        if far < EXACT and far * far * len(block) < EXACT:
            y = (block - x[0]).astype(np.float64)
            sums += y.sum(axis=0).astype(np.int64).astype(object)
            products += (y.T @ y).astype(np.int64).astype(object)
        else:
            y = block.astype(object) - np.array(shift, dtype=object)
            sums += y.sum(axis=0)
            products += y.T.dot(y)
    a = np.array(shift, dtype=object)
    across = np.outer(a, sums)
    return n, sums + n * a, products + across + across.T + n * np.outer(a, a)


_LIMBS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count (-1, -1), sums (-1, j) and products (i <= j) of a task's rows (embedding) in limbs."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = scatter(integers(batch.column(0)))
            total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
    if total is None:
        return
    n, sums, products = total
    d = len(sums)
    rows, columns = np.triu_indices(d)
    i = np.concatenate(([-1] * (1 + d), rows)).astype(np.int32)
    j = np.concatenate(([-1], np.arange(d), columns)).astype(np.int32)
    pairs = [divmod(int(v), LIMB) for v in (n, *sums, *products[rows, columns])]
    kind = pa.decimal128(38, 0)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], ["i", "j", "high", "low"])


def moments(vectors: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, n XᵀX - SSᵀ) in Python integers over all rows; vectors are of one length."""
    parts = vectors.select(F.col(column).cast("array<double>").alias("embedding")).mapInArrow(_sums, _LIMBS)
    found = {(r.i, r.j): int(r.high) * LIMB + int(r.low) for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    n = found.get((-1, -1), 0)
    d = sum(i == -1 for i, _ in found) - 1
    if n == 0:
        return 0, np.zeros(0, dtype=object), np.zeros((0, 0), dtype=object)
    sums = np.array([found[-1, j] for j in range(d)], dtype=object)
    products = np.zeros((d, d), dtype=object)
    for (i, j), v in found.items():
        if i >= 0:
            products[i, j] = products[j, i] = v
    return n, sums, n * products - np.outer(sums, sums)


def components(n: int, exact: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors as columns, shares of the trace) of the covariance, at most ``most``, those of no size left out."""
    d = len(exact)
    trace = sum(exact[k, k] for k in range(d))
    if n == 0 or trace == 0:
        return np.zeros(0), np.zeros((d, 0)), np.zeros(0)
    # every quotient of Python integers is rounded once; the trace sets the scale, so no entry leaves the range of a double
    scaled = np.array([[v / trace for v in row] for row in exact], dtype=np.float64)
    values, vectors = np.linalg.eigh(scaled)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > values.max() * d * 2.0**-46]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return values[order] * (trace / (n * n)), vectors, values[order]


def _project(n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
    """A function from batches (embedding, others) to the others with deviation_exact, deviation and whitened."""
    quotient, rest = [s // n for s in sums], [s % n for s in sums]
    scale = vectors / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, part = np.array(quotient, dtype=np.int64), np.array([r / n for r in rest])
        for batch in batches:
            x = integers(batch.column("embedding"))
            near = x - base
            far = max(int(abs(near).max()) if len(near) else 0, 1) + 1
            white = (near - part) @ scale
            if (n * far) ** 2 * x.shape[1] < 1 << 63:
                deviation = ((n * near - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = ((n * near.astype(object) - np.array(rest, dtype=object)) ** 2).sum(axis=1).tolist()
            kept = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != "embedding"]
            names = [name for name in batch.schema.names if name != "embedding"]
            made = [pa.array([str(v) for v in deviation]), pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()), pa.array(white.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "deviation_exact", "deviation", "whitened"])

    return run


def whiten(embeddings: DataFrame, most: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, n, deviation, deviation_exact, whitened array, explained array, identity_error) of each row that has a sound vector; none where nothing varies."""
    spark = embeddings.sparkSession
    kind = dict(embeddings.dtypes)[key]
    vectors = sound(embeddings.select(F.col(key).alias("key"), F.col(column).alias("embedding")))
    vectors = vectors.where(F.size("embedding") == dimension(vectors))
    n, sums, exact = moments(vectors)
    values, axes, shares = components(n, exact, most)
    schema = f"{key} {kind}, n long, deviation long, deviation_exact string, whitened array<double>, explained array<double>, identity_error double"
    if not len(values):
        return spark.createDataFrame([], schema)
    rows = vectors.select("key", F.col("embedding").cast("array<double>").alias("embedding"))
    white = stage(rows.mapInArrow(_project(n, [int(s) for s in sums], values, axes), f"key {kind}, deviation_exact string, deviation long, whitened array<double>"))
    error = identity_error(white, len(values))
    constants = (F.lit(n).cast("long").alias("n"), F.array(*(F.lit(float(s)) for s in shares)).alias("explained"), F.lit(error).alias("identity_error"))
    return white.select(F.col("key").alias(key), constants[0], "deviation", "deviation_exact", "whitened", *constants[1:])


def identity_error(white: DataFrame, size: int) -> float:
    """Largest entry of the covariance of ``whitened`` (divisor n, centred first) less the identity."""
    w = [F.get("whitened", F.lit(k)) for k in range(size)]
    means = white.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(w))).first()
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = white.agg(*(F.avg((w[i] - means[i]) * (w[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(read_table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "w")
    rows = rows.select("vec_id", "n", "deviation", "deviation_exact", "identity_error", each)
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("w.whitened").alias("whitened"), F.col("w.explained").alias("explained"), "identity_error", "deviation_exact")
