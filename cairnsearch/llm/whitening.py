"""Whitening of vectors: principal components of their covariance, by products of distributed block matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnsearch.llm.common import broadcast_checked, store

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK_ROWS = 1024
BLOCK_COLUMNS = 1024
BLOCKS_PER_TASK = 8
#: An eigenvalue below this share of the trace, per dimension, is rounding: there is no variance to divide by.
NO_VARIANCE = 1e-14
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(column: Column) -> Column:
    """Neither null nor with a null, NaN or infinite entry."""
    infinite = float("inf")
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (c == infinite) | (c == -infinite))
    return column.isNotNull() & ~bad


def whole_numbers(column: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(column, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension of ``x``."""

    def add(batches):
        n, total = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, dim)
            n += len(x)
            total = total + x.sum(axis=0, dtype=np.int64)
        at = [-1, *range(dim)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["at", "sum"])

    parts = rows.select("x").mapInArrow(add, "at int, sum string")
    found = parts.groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()  # dim + 1 rows
    by_place = {r["at"]: int(r["sum"]) for r in found}
    return by_place.get(-1, 0), [by_place.get(i, 0) for i in range(dim)]


def centred_blocks(rows: DataFrame, n: int, total: list[int]) -> DataFrame:
    """``(block, ids, deviations, pieces)``: a row per ``BLOCK_ROWS`` rows of ``rows(id, x)``, numbered from 0.

    ``pieces`` holds, for each ``BLOCK_COLUMNS`` dimensions, the rows less the mean, column by column; zeros fill the last
    block of a task, and add nothing to any product.
    """
    dim, kind = len(total), rows.schema["id"].dataType.simpleString()
    sums = np.array(total, dtype=object)
    height, width = BLOCK_ROWS, min(dim, BLOCK_COLUMNS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, held = TaskContext.get().partitionId(), 0, [], np.empty((0, dim), dtype=np.int64)

        def block(names: pa.Array, x: np.ndarray) -> pa.RecordBatch:
            off, deviations = deviations_of(x, n, sums)
            matrix = np.zeros((height, dim))
            matrix[: len(x)] = off
            pieces = [matrix[:, c : c + width].ravel(order="F") for c in range(0, dim, width)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), names),
                    pa.array([deviations], pa.list_(pa.int64())),
                    pa.array([pieces], pa.list_(pa.list_(pa.float64()))),
                ],
                names=["part", "seq", "ids", "deviations", "pieces"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column("id"))
            held = np.concatenate([held, batch.column("x").flatten().to_numpy().reshape(-1, dim)])
            names, at = pa.concat_arrays(ids), 0
            while len(held) - at >= height:
                yield block(names.slice(at, height), held[at : at + height])
                seq, at = seq + 1, at + height
            ids, held = [names.slice(at)], held[at:]
        if len(held):
            yield block(pa.concat_arrays(ids), held)

    schema = f"part int, seq long, ids array<{kind}>, deviations array<long>, pieces array<array<double>>"
    cut_rows = store(rows.select("id", "x").mapInArrow(cut, schema), "whitening-cut")
    sizes = cut_rows.groupBy("part").agg(F.count("*").alias("n"))
    # a row per task; each numbers its blocks from 0
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = cut_rows.join(broadcast_checked(starts), "part")
    return numbered.select((F.col("start") + F.col("seq")).cast("int").alias("block"), "ids", "deviations", "pieces")


def deviations_of(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list]:
    """Rows less their mean, and the exact sums of ``(n * x - sum) ** 2``, None beyond a long."""
    largest = max(abs(int(v)) for v in (x.min(), x.max(), *sums)) * (n + 1)
    if largest < 1 << 62:
        off = n * x - sums.astype(np.int64)
        if float(np.abs(off).max()) ** 2 * x.shape[1] < float(1 << 62):
            return off / n, (off * off).sum(axis=1).tolist()
    exact = n * x.astype(object) - sums
    squares = [int(v) for v in (exact * exact).sum(axis=1)]
    return (exact / n).astype(np.float64), [v if v < 1 << 63 else None for v in squares]


def block_matrix(blocks: DataFrame, dim: int) -> BlockMatrix:
    """The ``pieces`` as one distributed matrix, kept, since three products read it."""
    height, width = BLOCK_ROWS, min(dim, BLOCK_COLUMNS)

    def matrices(row):
        return [((row["block"], j), Matrices.dense(height, len(p) // height, p)) for j, p in enumerate(row["pieces"])]

    n_blocks = blocks.agg(F.max("block")).first()[0] + 1
    placed = blocks.select("block", "pieces").rdd.flatMap(matrices)
    return BlockMatrix(placed, height, width, n_blocks * height, dim).persist(StorageLevel.MEMORY_AND_DISK)


def scatter(centred: BlockMatrix) -> np.ndarray:
    """``centred`` transposed times itself; the long side is split, so that its blocks meet in many tasks."""
    blocks = math.ceil(centred.numRows() / BLOCK_ROWS)
    turned = centred.transpose()
    # the number of splits is missing from the Python signature
    product = turned._java_matrix_wrapper._java_model.multiply(
        centred._java_matrix_wrapper._java_model, max(1, math.ceil(blocks / BLOCKS_PER_TASK))
    )
    return BlockMatrix(product, turned.rowsPerBlock, centred.colsPerBlock).toLocalMatrix().toArray()


def small_block_matrix(spark, matrix: np.ndarray) -> BlockMatrix:
    """A local ``(dim, k)`` matrix, cut like the columns of :func:`block_matrix`."""
    dim, k = matrix.shape
    height = min(dim, BLOCK_COLUMNS)
    pieces = [matrix[start : start + height] for start in range(0, dim, height)]
    blocks = [((i, 0), Matrices.dense(len(p), k, p.flatten(order="F").tolist())) for i, p in enumerate(pieces)]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), height, k, dim, k)


def with_ids(blocks: DataFrame, product: BlockMatrix) -> DataFrame:
    """``(id, deviation, w)`` from ``blocks`` and the product of their matrix, whose blocks are as high."""
    values = product.blocks.map(lambda block: (block[0][0], block[1].toArray().ravel().tolist()))
    values = blocks.sparkSession.createDataFrame(values, "block int, w array<double>")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, w = batch.column("ids").slice(i, 1).flatten(), batch.column("w").slice(i, 1).flatten()
                k = len(w) // BLOCK_ROWS
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        batch.column("deviations").slice(i, 1).flatten(),
                        pa.ListArray.from_arrays(offsets, w.slice(0, len(ids) * k)),
                    ],
                    names=["id", "deviation", "w"],
                )

    both = blocks.select("block", "ids", "deviations").join(values, "block").select("ids", "deviations", "w")
    return both.mapInArrow(rows, f"id {kind}, deviation long, w array<double>")


def identity_error(projected: DataFrame, kept: list[int]) -> float:
    """The largest absolute entry of the covariance of ``w`` minus the identity, over the components ``kept``."""
    if not kept:
        return 0.0
    means = projected.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in kept]).first()
    shifted = projected.select(*[(F.col("w")[i] - F.lit(means[f"m{i}"])).alias(f"c{i}") for i in kept])
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    found = shifted.agg(*[F.avg(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"v{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"v{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row per usable vector and component.

    Entries become whole numbers ``x = floor(scale * c) + shift``. Rows of ``x`` minus its mean are put into distributed
    blocks; the blocks, transposed, times themselves give the scatter, whose eigenvectors a ``dim`` by ``dim`` matrix on the
    driver gives, and the blocks times those, over the roots of the eigenvalues, the whitened rows. ``deviation`` is the sum
    over dimensions of ``(n * x - sum) ** 2``, or null where that is beyond a long.

    Null vectors and those with a null, NaN or infinite entry take no part, nor do vectors of another length than the most
    frequent one (of equally frequent ones the longest), nor empty ones. Repeated rows and ids count and are returned each;
    null ids stay null. A component without variance, as all are of equal vectors, has a null ``whitened`` and is left out
    of ``identity_error``. Other columns are ignored, whatever their names. An empty table gives an empty result. The
    driver holds ``dim`` by ``dim`` numbers, however many rows there are.
    """
    spark = vectors.sparkSession
    column = F.col(vector_col)
    fitting = vectors.filter(usable(column)).select(F.col(id_col).alias("id"), whole_numbers(column, scale, shift).alias("x"))
    sizes = fitting.filter(F.size("x") > 0).groupBy(F.size("x").alias("dim")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    kind = fitting.schema["id"].dataType.simpleString()
    if common is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {RESULT}")
    dim = common["dim"]
    rows = fitting.filter(F.size("x") == dim)
    n, total = sums(rows, dim)
    blocks = centred_blocks(rows, n, total)
    centred = block_matrix(blocks, dim)

    values, axes = np.linalg.eigh(scatter(centred) / n)
    order = np.argsort(-values, kind="stable")[: min(components, dim)]
    trace = float(values.sum())
    kept = [i for i, e in enumerate(values[order]) if e > NO_VARIANCE * dim * trace]
    scaled = np.zeros((dim, len(order)))
    for i in kept:
        scaled[:, i] = axes[:, order[i]] / math.sqrt(values[order[i]])
    product = centred.multiply(small_block_matrix(spark, scaled))
    projected = store(with_ids(blocks, product), "whitening-projected")
    centred._java_matrix_wrapper._java_model.blocks().unpersist(False)
    error = identity_error(projected, kept)

    shares = [float(e) / trace if trace > 0 else 0.0 for e in values[order]]
    at = F.col("at")
    whitened = F.when(at.isin(kept), F.col("value")) if kept else F.lit(None).cast("double")
    return projected.select("id", "deviation", F.posexplode("w").alias("at", "value")).select(
        F.col("id").alias(id_col),
        (at + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        whitened.alias("whitened"),
        F.array(*[F.lit(s) for s in shares])[at].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
