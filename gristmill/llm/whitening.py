"""Embedding whitening by weighted multiplicity covariance.

Vectors become whole numbers, and identical ones are grouped with their number. Over the distinct vectors alone, weighted
by one or by these counts, run an exact sum per dimension, a weighted GEMM of what is centred on the mean, and the
projection on the covariance's leading eigenvectors; every row then has its vector's result by a join. A task's part of the
covariance is a number for each pair of dimensions, added up in Spark; only the whole matrix comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import by_batch, map_batches, written

SCALE = 256
COMPONENTS = 4
LONGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_column: str, column: str, scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * c) of each component, for rows whose vector isn't null or empty and has no null or
    non-finite component. What passes 64 bits is the nearest number that has them."""
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).alias("id"), v.alias("v")).where("size(v) > 0").where(F.coalesce(finite, F.lit(False)))
    return rows.select("id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("x"))


def matrix_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def greatest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def weighted_sums(x: np.ndarray, weights: np.ndarray) -> list[int]:
    """Exact sums per dimension, in 64 bits where these suffice."""
    if greatest(x) * int(weights.sum()) <= LONGEST:
        return (x * weights[:, None]).sum(0).tolist()
    return (x.astype(object) * weights.astype(object)[:, None]).sum(0).tolist()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the numerator n x - sums is exact where it has 64 bits."""
    if n * greatest(x) + max(map(abs, sums)) <= LONGEST:
        return (n * x - np.array(sums, np.int64)) / n
    return x - np.array([float(s) for s in sums]) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - sums) squared, exact; null beyond 64 bits."""
    if (n * greatest(x) + max(map(abs, sums))) ** 2 * x.shape[1] <= LONGEST:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    wide = n * x.astype(object) - np.array(sums, object)
    return [s if s <= LONGEST else None for s in (wide * wide).sum(1).tolist()]


def by_tasks(classes: DataFrame, add: Callable[[object, np.ndarray, np.ndarray], object], give: Callable[[object], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``add`` makes of all batches of a task (x, weight), as ``give`` gives it: one batch a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = add(held, matrix_of(batch.column(0)), batch.column(1).to_numpy())
        if held is not None:
            yield give(held)

    return map_batches(classes.select("x", "weight"), run, schema)


def sums_of(classes: DataFrame) -> list[int]:
    """Per dimension the weighted sum, exact."""

    def add(held, x, weights):
        new = weighted_sums(x, weights)
        return new if held is None else [a + b for a, b in zip(held, new, strict=True)]

    def give(held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(map(Decimal, held), pa.decimal128(38, 0))], names=["j", "s"])

    found = by_tasks(classes, add, give, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").alias("s")).collect()  # a row a dimension
    return [int(r["s"]) for r in sorted(found, key=lambda r: r["j"])]


def covariance(classes: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Of the classes by weight, divisor ``n``: centred, then multiplied."""
    dim = len(sums)
    i, j = np.triu_indices(dim)

    def add(held, x, weights):
        c = centred(x, n, sums)
        new = (c * weights[:, None]).T @ c
        return new if held is None else held + new

    def give(held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held[i, j])], names=["i", "j", "v"])

    found = by_tasks(classes, add, give, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # a row for each pair of dimensions
    out = np.zeros((dim, dim))
    i, j, v = (found.column(k).to_numpy() for k in range(3))
    out[i, j] = out[j, i] = v / n
    return out


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, ``most`` at most; a vector's largest component is positive."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def identity_error(table: DataFrame, parts: list[int], n: int) -> float:
    """The greatest entry of the weighted covariance of the ``parts`` of z, less the identity; centred first."""
    if not parts:
        return 0.0
    z = {k: F.element_at("z", k + 1) for k in parts}
    means = table.agg(*((F.sum(F.col("weight") * z[k]) / n).alias(f"m{k}") for k in parts)).first()
    pairs = [(a, b) for a in parts for b in parts if a <= b]
    less = {k: z[k] - F.lit(means[f"m{k}"]) for k in parts}
    found = table.agg(*((F.sum(F.col("weight") * less[a] * less[b]) / n).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, copies_count: bool = False, scale: int = SCALE) -> DataFrame:
    """Per row and component: id, component (from 1 by falling eigenvalue), n (the fit's vectors, by weight), deviation,
    whitened, explained (the eigenvalue's share), identity_error (one value, of the whitened fit vectors).

    Each distinct vector has weight one in the fit, or with ``copies_count`` the number of its rows. Vectors that are
    null or empty, that hold null or non-finite components, or that have another length than most of the distinct ones
    (of two such lengths, the greater) take no part. Rows that repeat an id or a vector have a result each. A component
    without variance has null for whitened, and for explained where no component has any; deviation is null beyond 64
    bits. Other columns are left out; an empty table gives an empty result. One vector that most rows have is one row of
    the fit, and its rows' join is left to Spark's splitting of skewed partitions.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, id_column, column, scale)
    grouped = written(rows.groupBy("x").agg(F.count("*").alias("copies")), "vectors")
    lengths = grouped.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("many"), F.sum("copies").alias("copies")).orderBy(F.col("many").desc(), F.col("dim").desc()).first()  # a row a length
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = lengths["dim"], lengths["copies" if copies_count else "many"]
    classes = grouped.where(F.size("x") == dim).select("x", (F.col("copies") if copies_count else F.lit(1).cast("long")).alias("weight"))
    sums = sums_of(classes)
    matrix = covariance(classes, n, sums)
    values, directions = leading(matrix, components)
    trace = float(np.trace(matrix))
    varies = values > dim * np.finfo(float).eps * max(values[0], 0.0)
    scaled = directions / np.sqrt(np.where(varies, values, 1.0))

    def projected(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = matrix_of(batch.column(0))
        z = centred(x, n, sums) @ scaled
        flat = pa.array(z.ravel(), mask=np.tile(~varies, len(z)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deviations(x, n, sums), pa.int64()), lists], names=["x", "weight", "deviation", "z"])

    table = written(by_batch(classes, projected, "x array<long>, weight long, deviation long, z array<double>"), "whitened")
    error = identity_error(table, np.flatnonzero(varies).tolist(), n)
    shares = F.array(*(F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values))
    hashed = lambda d: d.withColumn("h", F.xxhash64("x"))
    both = hashed(rows).join(hashed(table).drop("weight"), ["h", "x"]).select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return both.select(
        F.col("id").alias(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings`` on its four leading components; each distinct vector counts once in the fit."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
