"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Entries are scaled and floored to whole numbers, so equal vectors can be told
exactly. The fit list holds each distinct vector once. Rows get dense indices,
are centred, and become the rows of a distributed block matrix; its transpose
times itself is the scatter of the fit list. That product is d x d and goes to
the driver, where ``eigh`` gives the components; a second block product of all
rows with the whitening matrix projects them.

The middle dimension of the first product is split (``MIDDLE`` block rows a part),
as otherwise every block of rows would meet in the one task of a result block.
Collected are only tables of the vector's dimension d (sums, scatter, d x d).

Defined cases: a vector that is null, or has a null, NaN or infinite entry, or one beyond a
long once scaled, is dropped. If vectors differ in length, the most frequent length (the longer
of equals) is the dimension and others are dropped. Components whose eigenvalue is zero (up to
rounding, ``LEAST`` of the trace) have no direction and are left out, so a table of
equal vectors, or of one, gives no rows. Repeated rows and null ids each get their rows. An
empty table gives an empty result. Only the id and the vector are read, so further columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, stored

BLOCK_ROWS = 1024
BLOCK_COLS = 1024
#: Block rows whose products one task adds up (8 MB of doubles for 64 dimensions).
MIDDLE = 16
LEAST = 1e-11
RESULT = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double")


def whole(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """Stored: vec_id, x (whole numbers), part and place (of the row in its part) of all usable rows."""
    cells = F.transform(F.col(vector), lambda c: c.cast("double") * scale)
    usable = F.forall("cells", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0 ** 62)))
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), cells.alias("cells")).where(
        F.col("cells").isNotNull() & (F.size("cells") > 0) & F.coalesce(usable, F.lit(False)))
    number = F.monotonically_increasing_id()
    return stored(rows.select(
        "vec_id", F.transform("cells", lambda c: F.floor(c).cast("long")).alias("x"),
        F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    ), "vectors")


def indexed(rows: DataFrame, size: int) -> DataFrame:
    """Stored: index (0 to m - 1), vec_id, x, and whether the row is the first of its vector."""
    rows = rows.where(F.size("x") == size)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1)
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task of the scan
    starts = counts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = stored(join_checked(rows, stored(starts, "starts"), ["part"], "inner").select(
        (F.col("_start") + F.col("place")).alias("index"), "vec_id", "x",
        F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2")), "numbered")
    first = numbered.groupBy("h1", "h2").agg(F.min("index").alias("index")).select("index", F.lit(True).alias("first"))
    marked = join_checked(numbered.drop("h1", "h2"), stored(first, "first"), ["index"], "left")
    return stored(marked.withColumn("first", F.coalesce("first", F.lit(False))), "indexed")


def sums_of(rows: DataFrame, size: int) -> list[int]:
    """Exact sum per dimension."""
    cells = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    found = {r["dim"]: int(r["s"]) for r in cells.collect()}  # one row per dimension
    return [found[i] for i in range(size)]


def blocks_of(rows: DataFrame, mean: np.ndarray, n_rows: int) -> BlockMatrix:
    """Centred rows as a block matrix; an index without a row is a row of zeros."""
    centre = F.array(*[F.lit(float(m)) for m in mean])
    centred = rows.select("index", array_to_vector(F.zip_with("x", centre, lambda a, m: a.cast("double") - m)).alias("row"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n_rows, len(mean))
    return matrix.toBlockMatrix(BLOCK_ROWS, min(BLOCK_COLS, len(mean)))


def scatter_of(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, d x d."""
    splits = max(1, math.ceil(blocks.numRowBlocks / MIDDLE))
    # the Python method lacks the argument that splits the middle dimension
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def components_of(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit vectors as columns, trace) of the leading components of the covariance."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    lead = [i for i in np.argsort(values)[::-1][:most].tolist() if values[i] > LEAST * trace]
    return values[lead], vectors[:, lead], trace


def projected(blocks: BlockMatrix, weights: np.ndarray, rows: DataFrame) -> DataFrame:
    """Stored: index, y (coordinates of the centred row)."""
    d, k = weights.shape
    spark = rows.sparkSession
    side = blocks.colsPerBlock
    parts = [((i // side, 0), Matrices.dense(len(w), k, w.ravel(order="F").tolist()))
             for i in range(0, d, side) for w in [weights[i:i + side]]]
    product = blocks.multiply(BlockMatrix(spark.sparkContext.parallelize(parts, 1), side, k, d, k))
    height = blocks.rowsPerBlock

    def cells(block):
        (row, _), matrix = block
        return [(row * height + i, y) for i, y in enumerate(matrix.toArray().tolist())]

    return stored(spark.createDataFrame(product.blocks.flatMap(cells), "index long, y array<double>"), "projected")


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of ``(n x - S)^2``, exact; null beyond 38 digits."""

    @F.pandas_udf("string")
    def exact(rows: pd.Series) -> pd.Series:
        total = sum(s * s for s in sums)
        out = []
        for row in rows:
            row = np.asarray(row, np.int64)
            top = max(1, int(np.abs(row).max())) * max(1, max(map(abs, sums)), int(np.abs(row).max())) * len(sums)
            if top < 1 << 62:
                squares, products = int((row * row).sum()), int((row * np.array(sums, np.int64)).sum())
            else:  # whole numbers without a limit
                squares, products = sum(v * v for v in row.tolist()), sum(v * s for v, s in zip(row.tolist(), sums))
            out.append(str(n * n * squares - 2 * n * products + total))
        return pd.Series(out, dtype=object)

    return exact(x).try_cast("decimal(38,0)")


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``y`` minus the identity; k (k + 3) / 2 sums in one row."""
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    y = [F.col("y")[i] for i in range(k)]
    got = rows.agg(*[F.sum(y[i]).alias(f"s{i}") for i in range(k)],
                   *[F.sum(y[i] * y[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"p{i}_{j}"] / n - got[f"s{i}"] / n * got[f"s{j}"] / n - (i == j)) for i, j in pairs)


def whitened(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = 4, scale: int = 256
) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    nothing = vectors.sparkSession.createDataFrame([], RESULT)
    usable = whole(vectors, id, vector, scale)
    sizes = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return nothing
    size, m = sizes["d"], sizes["count"]
    rows = indexed(usable, size)
    fit = rows.where("first")
    n = fit.count()
    sums = sums_of(fit, size)
    mean = np.array([s / n for s in sums])
    values, components, trace = components_of(scatter_of(blocks_of(fit, mean, m)), n, most)
    if not len(values):
        return nothing
    coordinates = projected(blocks_of(rows, mean, m), components / np.sqrt(values), rows)
    found = rows.join(coordinates, "index")
    error = identity_error(found.where("first"), n, len(values))
    explained = F.array(*[F.lit(float(e / trace)) for e in values])
    return found.select(
        "vec_id", deviation(F.col("x"), n, sums).alias("deviation"), F.posexplode("y").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
