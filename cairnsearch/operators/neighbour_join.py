"""Exact nearest neighbours for any number of queries: a join that visits cells, nearest first.

Angles between vectors obey the triangle inequality, so a vector of a cell is no nearer to a query
than the angle to the cell's centre less the cell's radius. Every query first visits cells until
they hold k vectors; its k-th distance then rules cells out, round by round. Queries travel to the
cells they still have to visit, in the last round to groups of neighbouring cells: where the radii
rule out little, a query would be copied to nearly every cell. Where there is much to score, the larger
side of a cell or group is dealt over tasks and the smaller one copied to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnsearch.operators.nearest import (
    LEAF_ROWS,
    LEAST_CUT,
    QUERY_BLOCK,
    VECTOR_BLOCK,
    Leaves,
    RunningTopK,
    top_k_per_query,
    vector_matrix,
)
from cairnsearch.session import stored

MARGIN = 1e-6
MORE_CELLS = 4
ROUNDS = 3
MAX_SAMPLED_CENTRES = 1024
#: At most so many groups of cells in the last round, of about so many vectors at least.
LAST_GROUPS, GROUP_VECTORS = 128, 8_192
#: Pairs that one task scores where there are more of them.
TASK_PAIRS = 1 << 28
MAX_TASKS = 20_000
KEY = ["cell", "block", "strip", "side"]


@dataclass(frozen=True)
class CellBounds:
    """Unit centres ``(lists, dim)``, and of each cell the largest angle to its centre and the number of vectors."""

    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def angles(unit_vectors: np.ndarray, unit_centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_vectors @ unit_centres.T, -1.0, 1.0))


def least_angles(queries: np.ndarray, cells: CellBounds) -> tuple[np.ndarray, np.ndarray]:
    """The angle to each centre, and the least one at which its cell may hold a vector; one row per query."""
    if queries.shape[1] != cells.centres.shape[1]:
        raise ValueError(f"vectors have {cells.centres.shape[1]} dimensions, queries {queries.shape[1]}")
    to_centre = angles(unit_rows(queries.astype(np.float64)), cells.centres)
    least = np.maximum(to_centre - cells.radii - MARGIN, 0.0)
    least[np.linalg.norm(queries, axis=1) == 0] = 0.0
    least[:, cells.counts == 0] = np.inf
    return to_centre, least


def reach_of(bound: np.ndarray) -> np.ndarray:
    """The angle up to which a query's k-th distance so far (infinite if unknown) lets a vector be of use."""
    return np.where(np.isfinite(bound), np.arccos(np.clip(1.0 - bound, -1.0, 1.0)) + MARGIN, np.pi + 1)


def visiting_order(queries: np.ndarray, cells: CellBounds) -> tuple[np.ndarray, np.ndarray]:
    """Cells in the order to visit them, and the least angle at which each may hold a vector; one row per query."""
    to_centre, least = least_angles(queries, cells)
    order = np.lexsort((to_centre, least), axis=1)
    return order, np.take_along_axis(least, order, axis=1)


def cells_of_round(queries: np.ndarray, bound: np.ndarray, cells: CellBounds, k: int, number: int) -> list[np.ndarray]:
    """For each query the cells to visit in round ``number``, given its k-th distance so far (infinite if unknown)."""
    order, least = visiting_order(queries, cells)
    held = np.cumsum(cells.counts[order], axis=1)
    first = (held < k).sum(axis=1) + 1
    begin = {0: np.zeros(len(queries), int), 1: first}.get(number, first + MORE_CELLS)
    end = {0: first, 1: first + MORE_CELLS}.get(number, np.full(len(queries), order.shape[1]))
    reach = reach_of(bound)
    return [o[b:e][row[b:e] <= r] for o, row, b, e, r in zip(order, least, begin, end, reach)]


def sampled_centres(vectors: DataFrame, n: int) -> np.ndarray:
    """About the square root of ``n`` vectors, chosen by a hash of their ids, as centres."""
    wanted = min(MAX_SAMPLED_CENTRES, max(1, math.isqrt(n)))
    some = vectors.filter(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(wanted)
    column = some.select("embedding").toArrow().column("embedding").combine_chunks()
    return vector_matrix(column).astype(np.float64)


def with_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(id, embedding, angle, cell)`` with the nearest centre and the angle to it; a zero vector is at an angle of pi."""
    shared = vectors.sparkSession.sparkContext.broadcast(unit_rows(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = vector_matrix(batch.column("embedding")).astype(np.float64)
            if matrix.shape[1] != shared.value.shape[1]:
                raise ValueError(f"vectors have {matrix.shape[1]} dimensions, centres {shared.value.shape[1]}")
            cosine = unit_rows(matrix) @ shared.value.T
            cell = np.argmax(cosine, axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1.0, 1.0))
            angle[~matrix.any(axis=1)] = np.pi
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("embedding"),
                    pa.array(angle.astype(np.float32)),
                    pa.array(cell.astype(np.int32)),
                ],
                names=["id", "embedding", "angle", "cell"],
            )

    usable = vectors.filter(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<float>"))
    return usable.mapInArrow(assign, "id long, embedding array<float>, angle float, cell int")


def measured(vectors: DataFrame) -> DataFrame:
    """``(cell, radius, n)`` of ``vectors(angle, cell)``."""
    return vectors.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))


def bounds_of(centres: np.ndarray, sizes: DataFrame) -> CellBounds:
    """The bounds of cells from ``sizes(cell, radius, n)``, which may have several rows of a cell."""
    radii, counts = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    summed = sizes.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
    for row in summed.collect():  # a row per centre
        radii[row["cell"]], counts[row["cell"]] = row["radius"], row["n"]
    return CellBounds(unit_rows(centres), radii, counts)


def nearest_by_cells(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, dist, r)`` for ``vectors(id, embedding)`` without an index: cells around sampled vectors."""
    kind = queries.schema["query_id"].dataType.simpleString()
    held = stored(vectors.select("id", "embedding"), "join-vectors")
    n = held.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, id long, dist double, r int")
    centres = sampled_centres(held, n)
    if not len(centres):  # zero vectors only
        centres = np.ones((1, len(held.first()["embedding"])))
    placed = stored(with_cells(held, centres), "join-cells")
    return nearest_join(placed, bounds_of(centres, measured(placed)), queries, k)


def nearest_join(vectors: DataFrame, cells: CellBounds, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, dist, r)``, exact, for ``vectors(id, embedding, cell)`` and ``queries(query_id, query_vec)``.

    Every round is written to the shared folder. Its queries are counted by cell, and a round
    without any is the last one.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    spark = vectors.sparkSession
    if queries.schema["query_vec"].dataType != T.ArrayType(T.FloatType()):
        queries = queries.withColumn("query_vec", F.col("query_vec").cast("array<double>"))
    queries = stored(queries.select("query_id", "query_vec"), "join-queries")
    best = spark.createDataFrame([], f"query_id {kind}, id long, dist double")
    for number in range(ROUNDS):
        full = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("dist").alias("bound")).filter(F.col("n") >= k)
        asking = queries.join(full.select("query_id", "bound"), "query_id", "left") if number else queries.withColumn(
            "bound", F.lit(None).cast("double")
        )
        groups = min(LAST_GROUPS, max(1, int(cells.counts.sum()) // GROUP_VECTORS))
        grouped = number == ROUNDS - 1 and len(cells.centres) > groups
        group = neighbouring_cells(cells, groups) if grouped else None
        visits = stored(round_visits(asking, cells, k, number, group), "join-visits")
        asked = {row["cell"]: row["count"] for row in visits.groupBy("cell").count().collect()}  # a row per centre
        if not asked:
            continue
        if not grouped:
            both = best.unionByName(score_visits(vectors, visits, cells, asked, k))
        elif visits.filter("more").isEmpty():
            continue
        else:
            # groups hold cells visited before: all that may hold a neighbour are scored, and earlier hits only bound them
            whole = CellBounds(cells.centres[:groups], cells.radii[:groups], np.bincount(group, cells.counts, groups))
            both = score_visits(in_groups(vectors, group, asked), visits.drop("more"), whole, asked, k)
        best = stored(top_k_per_query(both, k, "dist", "id").drop("r"), "join-best")
    return top_k_per_query(best, k, "dist", "id")


def neighbouring_cells(cells: CellBounds, groups: int) -> np.ndarray:
    """The group, below ``groups``, of each cell: the group with the most vectors is cut in two, across its longest
    direction, until there are enough."""
    weight = cells.counts + 1
    found = [np.arange(len(cells.centres))]
    while len(found) < groups:
        members = max(found, key=lambda m: (len(m) > 1, weight[m].sum()))
        if len(members) < 2:
            break
        found = [m for m in found if m is not members]
        offset = cells.centres[members] - cells.centres[members].mean(axis=0)
        along = offset @ np.linalg.svd(offset, full_matrices=False)[2][0]
        members = members[np.argsort(along, kind="stable")]
        half = np.searchsorted(np.cumsum(weight[members]), weight[members].sum() / 2)
        half = min(max(1, half), len(members) - 1)
        found += [members[:half], members[half:]]
    group = np.empty(len(cells.centres), dtype=np.int64)
    for number, members in enumerate(found):
        group[members] = number
    return group


def in_groups(vectors: DataFrame, group: np.ndarray, asked: dict[int, int]) -> DataFrame:
    """``vectors(id, embedding, cell)`` of the groups ``asked`` for, with the group as their ``cell``."""
    wanted = [cell for cell, number in enumerate(group.tolist()) if number in asked]
    number = F.get(F.array(*[F.lit(int(g)) for g in group]), F.col("cell")).alias("cell")
    return vectors.filter(F.col("cell").isin(wanted)).select("id", "embedding", number)


def round_visits(
    asking: DataFrame, cells: CellBounds, k: int, number: int, group: np.ndarray | None = None
) -> DataFrame:
    """``(query_id, query_vec, bound, cell)``: the cells that each of ``asking(query_id, query_vec, bound)`` visits.

    With a ``group`` of each cell, the groups of all cells that may hold a neighbour, and in ``more`` whether any of these
    cells has not been visited in an earlier round.
    """
    shared = asking.sparkSession.sparkContext.broadcast((cells, group))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(start, QUERY_BLOCK)
                bound = part.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
                cells, group = shared.value
                matrix = vector_matrix(part.column("query_vec"))
                found = cells_of_round(matrix, bound, cells, k, number)
                more = [len(f) > 0 for f in found]
                if group is not None:
                    near = least_angles(matrix, cells)[1] <= reach_of(bound)[:, None]
                    found = [np.unique(group[f]) for f in near]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                cell = pa.array(np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(rows) for c in ("query_id", "query_vec", "bound")], cell, pa.array(more).take(rows)],
                    names=["query_id", "query_vec", "bound", "cell", "more"],
                )

    asking = asking.select("query_id", "query_vec", "bound")
    schema = T.StructType([*asking.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("more", T.BooleanType())])
    visits = asking.mapInArrow(visit, schema)
    return visits.drop("more") if group is None else visits


def strips_of(counts: np.ndarray, asked: dict[int, int], blocks: dict[int, int], pairs: int) -> dict[int, int]:
    """Strips of the queries of a cell, to each of which its vectors are copied, so that in none of them more than ``pairs``
    are scored."""
    return {c: min(asked[c], math.ceil(int(counts[c]) * asked[c] / (pairs * b))) or 1 for c, b in blocks.items()}


def blocks_of(counts: np.ndarray, asked: dict[int, int], vector_block: int, query_block: int) -> dict[int, int]:
    """Blocks per visited cell, so that its vectors are not too many for one, nor, unless the queries are more than the
    vectors (``strips_of``), the pairs to be scored."""
    out = {}
    for cell, n_queries in asked.items():
        n = int(counts[cell])
        by_work = min(n, math.ceil(n * n_queries / (vector_block * query_block))) if n_queries <= n else 1
        out[cell] = max(1, math.ceil(n / vector_block), by_work)
    return out


def place_vectors(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each vector of a visited cell once, with its block."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    return vectors.join(F.broadcast(sizes), "cell").select("cell", block, "id", "embedding")


def score_visits(
    vectors: DataFrame,
    visits: DataFrame,
    cells: CellBounds,
    asked: dict[int, int],
    k: int,
    vector_block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, id, dist)``: the best k per query and block for ``visits(query_id, query_vec, cell)``.

    With a ``bound`` in the visits, hits that are farther may be left out.
    """
    spark = vectors.sparkSession
    if "bound" not in visits.columns:
        visits = visits.withColumn("bound", F.lit(None).cast("double"))
    blocks = blocks_of(cells.counts, asked, vector_block, query_block)
    strips = strips_of(cells.counts, asked, blocks, TASK_PAIRS)
    sizes = spark.createDataFrame([(int(c), int(b), int(strips[c])) for c, b in blocks.items()], "cell int, blocks int, strips int")
    wanted = sorted(blocks)
    if len(wanted) < len(cells.centres):
        vectors = vectors.filter(F.col("cell").isin(wanted))
    id_type, vector_type = visits.schema["query_id"].dataType, visits.schema["query_vec"].dataType
    resting = place_vectors(vectors, sizes.drop("strips"))
    if max(strips.values()) > 1:
        each = F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip")
        resting = resting.join(F.broadcast(sizes.drop("blocks")), "cell").select("*", each).drop("strips")
    else:
        resting = resting.withColumn("strip", F.lit(0))
    resting = resting.select(
        "cell",
        "block",
        "strip",
        F.lit(0).alias("side"),
        "id",
        "embedding",
        F.lit(None).cast(id_type).alias("query_id"),
        F.lit(None).cast(vector_type).alias("query_vec"),
        F.lit(None).cast("double").alias("bound"),
    )
    passing = visits.join(F.broadcast(sizes), "cell").select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.col("strips")).cast("int").alias("strip"),
        F.lit(1).alias("side"),
        F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("array<float>").alias("embedding"),
        "query_id",
        "query_vec",
        "bound",
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, pieces, matrix, leaves = None, [], [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in KEY], axis=1)
            changes = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
            edges = [0, *changes.tolist(), len(keys)] if len(keys) else []
            for start, stop in zip(edges, edges[1:]):
                *place, side = keys[start].tolist()
                if at != place:
                    at, ids, pieces, matrix, leaves = place, [], [], None, None
                if side == 0:
                    ids.append(batch.column("id").slice(start, stop - start).to_numpy())
                    pieces.append(vector_matrix(batch.column("embedding").slice(start, stop - start)))
                    continue
                if not ids:
                    continue
                if matrix is None:
                    ids, matrix = [np.concatenate(ids)], np.concatenate(pieces)
                    pieces = []
                    leaves = Leaves(matrix) if len(matrix) >= LEAST_CUT and stop - start >= LEAF_ROWS else None
                for first in range(start, stop, query_block):
                    many = min(query_block, stop - first)
                    bound = batch.column("bound").slice(first, many).to_numpy(zero_copy_only=False).astype(np.float64)
                    best = RunningTopK(vector_matrix(batch.column("query_vec").slice(first, many)), k, bound)
                    if leaves is None:
                        best.offer(ids[0], matrix)
                    else:
                        best.offer_leaves(ids[0], leaves)
                    names = batch.column("query_id").slice(first, many)
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(best.query)), pa.array(best.id), pa.array(best.distance)],
                        names=["query_id", "id", "dist"],
                    )

    meeting = resting.unionByName(passing)
    pairs = sum(int(cells.counts[c]) * n for c, n in asked.items())
    if pairs > TASK_PAIRS:  # small in bytes, so Spark would put too many of them into one task
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, 2 * pairs // TASK_PAIRS))
        meeting = meeting.repartition(tasks, *KEY[:-1])
    else:
        meeting = meeting.repartition(*KEY[:-1])
    return meeting.sortWithinPartitions(*KEY).mapInArrow(score, f"query_id {id_type.simpleString()}, id long, dist double")
