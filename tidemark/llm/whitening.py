"""Whitening of vectors by distributed block matrices."""

from __future__ import annotations

import functools
from decimal import Decimal

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
#: Entries beyond count as this; sums of squares stay within 38 digits then.
FARTHEST = 1 << 40
#: Row blocks whose products are added up in one task.
BLOCKS_PER_TASK = 16


def whole_entries(vector: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale * c) + shift of every entry c, as longs; null for a null vector or one with null or non-finite entries."""
    c = vector.cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform(c, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(FARTHEST))), F.lit(float(-FARTHEST)))).cast("long") + shift)
    return F.when(c.isNotNull() & ~F.coalesce(bad, F.lit(False)), x)


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """(rows (vec_id, x, at) with `at` from 0 without gaps, their number). Places within partitions are stored with the
    rows, so that reading them again, by whichever executor, gives the same numbers; one count a partition is collected."""
    at = F.monotonically_increasing_id()
    kept = materialise(rows.withColumn("at", at), "vectors")
    part = F.shiftright("at", 33)
    counts = sorted(kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))
    out = kept.join(offsets, part == offsets["part"]).select("vec_id", "x", (F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")).alias("at"))
    return out, total


def block_matrix(rows: DataFrame, n: int, dims: int, rows_per_block: int) -> BlockMatrix:
    """Rows (at, v) as distributed blocks of rows_per_block rows and all columns."""
    of = MLUtils.convertVectorColumnsFromML(rows.select("at", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(of, n, dims).toBlockMatrix(rows_per_block, dims)


def scatter(m: BlockMatrix, n: int, rows_per_block: int) -> np.ndarray:
    """The transpose times the matrix. Row blocks are multiplied where they are dealt to, BLOCKS_PER_TASK in a task, and the
    products added up; only columns by columns come to the driver."""
    splits = max(1, -(-n // (rows_per_block * BLOCKS_PER_TASK)))
    java = m._java_matrix_wrapper
    product = java._java_model.transpose().multiply(java._java_model, splits)
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def times(m: BlockMatrix, w: np.ndarray) -> BlockMatrix:
    """The matrix times a local one."""
    local = DenseMatrix(*w.shape, w.ravel(order="F").tolist())
    one = m.blocks.context.parallelize([((0, 0), local)], 1)
    return m.multiply(BlockMatrix(one, w.shape[0], w.shape[1]))


def as_rows(m: BlockMatrix) -> DataFrame:
    """Rows (at, y) of a distributed matrix, without a way through Python."""
    rows = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select(F.col("index").alias("at"), vector_to_array("vector").alias("y"))


def deviations(x: Column, n: int, sums: list[int], widths: list[int]) -> Column:
    """The sum over dimensions of (n * x - sum) squared, exact, as decimal(38,0). Longs are used where `widths`, largest less
    smallest entry, prove that they hold it."""
    if sum((n * w) ** 2 for w in widths) < 1 << 62:
        s = F.array(*[F.lit(v).cast("long") for v in sums])
        d = F.zip_with(x, s, lambda a, b: (a * n - b) * (a * n - b))
        return F.aggregate(d, F.lit(0).cast("long"), lambda t, v: t + v).cast("decimal(38,0)")
    s = F.array(*[F.lit(Decimal(v)).cast("decimal(38,0)") for v in sums])
    off = F.zip_with(x, s, lambda a, b: (a.cast("decimal(19,0)") * F.lit(Decimal(n)).cast("decimal(18,0)") - b).cast("decimal(38,0)"))
    # beyond 38 digits the product is null, and so is the sum
    return F.aggregate(off, F.lit(0).cast("decimal(38,0)"), lambda t, d: F.call_function("try_add", t, F.call_function("try_multiply", d, d)).cast("decimal(38,0)"))


def whiten(vectors: DataFrame, components: int = 8, rows_per_block: int = 4096) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) for every vector
    (vec_id, embedding) and component, numbered from 1 by falling variance.

    Vectors that are null or hold null or non-finite entries give no rows; repeated rows count and are returned each; a null
    id stays null. Entries become whole numbers (whole_entries()). Vectors of each dimension are whitened for themselves;
    those without entries give no rows. The fit covers all vectors. A component without variance (fewer different vectors
    than dimensions) is returned with `whitened` null and `explained` 0, and identity_error leaves it out. `deviation` is null
    where 64 bits can't hold it; deviation_exact has 38 digits. An empty table gives no rows. Other columns may have any name.

    Centred rows are indexed into blocks of rows_per_block rows; their transpose times themselves, added up over the blocks, is
    the scatter, whose eigenvectors are found on the driver (columns by columns, whatever the number of rows), and
    the blocks times the whitening matrix are the projections. Rows are centred, so projections have the mean 0 to rounding.
    """
    spark = vectors.sparkSession
    of = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_entries(F.col("embedding")).alias("x")).where("size(x) > 0")
    kept = materialise(of, "whole-vectors")
    found = [whiten_dimension(kept.where(F.size("x") == d), d, components, rows_per_block) for (d,) in sorted(kept.select(F.size("x")).distinct().collect())]
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def whiten_dimension(kept: DataFrame, dims: int, components: int, rows_per_block: int) -> DataFrame:
    """whiten() for rows (vec_id, x) of one dimension."""
    rows, n = numbered(kept)
    stats = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), (F.max("v") - F.min("v")).alias("w")).orderBy("i").collect()
    sums, widths = [int(r.s) for r in stats], [r.w for r in stats]
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = block_matrix(rows.select("at", F.zip_with(F.col("x").cast("array<double>"), mean, lambda a, b: a - b).alias("v")), n, dims, rows_per_block)
    values, directions = np.linalg.eigh(scatter(centred, n, rows_per_block) / n)
    values, directions = values[::-1], directions[:, ::-1]
    total = max(float(values.sum()), 0.0)
    k = min(components, dims)
    real = int((values[:k] > total * dims * 1e-14).sum())
    head = rows.select("vec_id", "at", deviations(F.col("x"), n, sums, widths).alias("deviation_exact"))
    if real:
        w = directions[:, :real] / np.sqrt(values[:real])
        y = materialise(as_rows(times(centred, w)), "projections")
        again = block_matrix(y.select("at", F.col("y").alias("v")), n, real, rows_per_block)
        error = float(np.abs(scatter(again, n, rows_per_block) / n - np.eye(real)).max())
        head = head.join(y, "at")
    else:
        error = 0.0
        head = head.withColumn("y", F.array().cast("array<double>"))
    share = F.array(*[F.lit(float(values[i] / total) if i < real else 0.0) for i in range(k)])
    fits = F.abs("deviation_exact") < F.lit(Decimal(1 << 63))
    out = head.select("vec_id", "y", F.posexplode(share).alias("i", "explained"), F.when(fits, F.col("deviation_exact").cast("long")).alias("deviation"), "deviation_exact")
    return out.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.get("y", F.col("i")).alias("whitened"), "explained", F.lit(error).alias("identity_error"), "deviation_exact"
    )


def op13_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten() of all embeddings, with eight components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
