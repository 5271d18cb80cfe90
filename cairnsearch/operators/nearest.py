"""Exact cosine top-k for one query, a bounded set of queries, or any number of queries.

* One query, or a bounded set: the query matrix is broadcast; each task scores its own Arrow
  batches with one matrix product and hands on at most k rows per query. Vectors stay put.
  On half a million 64-float vectors this took a sixth of the time of a column expression.
* Any number: a join by cells that stays exact (``neighbour_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_VALUES = 8 * 1024 * 1024
VECTOR_BLOCK = 65_536
QUERY_BLOCK = 2_048
SCORED_AT_ONCE = 4_000_000
MAX_ROWS_AT_ONCE = 32_768
#: Single-precision products, and queries, of the pieces that are screened at once.
CACHED, QUERIES_AT_ONCE = 512 * 1024, 512
TIE_MARGIN = 1e-9
#: Vectors of a leaf, and the directions by which leaves are cut; fewer vectors than these are not cut.
LEAF_ROWS, LEAF_AXES, LEAST_CUT = 128, 5, 1024
#: Rounding of a leaf's box and of a query's place, in single precision.
BOX_MARGIN = 1e-5


class Leaves:
    """Vectors in leaves of neighbours, with a box around each that shows which queries may find something in it.

    A unit vector is placed by its shares of the main directions of all vectors and by the length of what they leave, so
    places are unit vectors too, and no nearer to each other than the vectors are. Vectors without a direction are in ``rest``.
    """

    def __init__(self, vectors: np.ndarray):
        vectors = vectors.astype(np.float64)
        self.vectors, self.norms = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        unit, sound = _unit(vectors, self.norms)
        self.rest = np.flatnonzero(~sound)
        rows = np.flatnonzero(sound)
        whole = unit[rows].astype(np.float64)
        self.axes = np.linalg.eigh(whole.T @ whole)[1][:, ::-1][:, :LEAF_AXES]
        places = self.places(whole)
        open_, self.members = [np.arange(len(rows))] if len(rows) else [], []
        while open_:
            part = open_.pop()
            if len(part) <= LEAF_ROWS:
                self.members.append(part)
                continue
            mine = places[part]
            order = np.argpartition(mine[:, np.argmax(mine.max(axis=0) - mine.min(axis=0))], len(part) // 2)
            open_ += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        self.low = np.array([places[part].min(axis=0) for part in self.members])
        self.high = np.array([places[part].max(axis=0) for part in self.members])
        self.members = [rows[part] for part in self.members]
        self.units = [np.ascontiguousarray(unit[part].T) for part in self.members]

    def places(self, unit: np.ndarray) -> np.ndarray:
        along = unit @ self.axes
        left = np.sqrt(np.maximum((unit * unit).sum(axis=1) - (along * along).sum(axis=1), 0.0))
        return np.column_stack([along, left]).astype(np.float32)

    def highest(self, unit: np.ndarray) -> np.ndarray:
        """The highest cosine that a vector of each leaf may have with each of the ``unit`` vectors."""
        places = self.places(unit.astype(np.float64))
        square = np.zeros((len(places), len(self.members)), dtype=np.float32)
        for axis in range(places.shape[1]):
            here = places[:, axis, None]
            gap = np.maximum(self.low[None, :, axis] - here, here - self.high[None, :, axis])
            np.maximum(gap, 0, out=gap)
            square += gap * gap
        return 1 - square / 2 + np.float32(BOX_MARGIN)


class RunningTopK:
    """The k nearest (distance, id) per query over the vectors offered so far.

    A product of unit vectors in single precision screens, in pieces that stay in the processor's
    cache; what it cannot rule out, its rounding allowed for, is measured again pair by pair, in an
    order that does not depend on where a vector lies in its batch. Equal vectors therefore
    get equal distances, and ties fall to the lower id. With a ``bound`` per query, vectors that
    are farther need not be found.
    """

    def __init__(self, queries: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.queries = queries.astype(np.float64)
        self.norms = np.sqrt((self.queries * self.queries).sum(axis=1))
        self.unit, self.sound = _unit(self.queries, self.norms)
        self.margin = (queries.shape[1] + 8) * 2.0**-23 + TIE_MARGIN if queries.ndim == 2 else TIE_MARGIN
        self.k = k
        self.bound = np.full(len(queries), np.inf) if bound is None else np.where(np.isnan(bound), np.inf, bound)
        self.query = np.empty(0, dtype=np.int64)
        self.id = np.empty(0, dtype=np.int64)
        self.distance = np.empty(0, dtype=np.float64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray, only: np.ndarray | None = None) -> None:
        chosen = np.arange(len(self.queries)) if only is None else only
        if not len(ids) or not len(chosen):
            return
        if vectors.shape[1] != self.queries.shape[1]:
            raise ValueError(
                f"vectors have {vectors.shape[1]} dimensions, queries {self.queries.shape[1]}"
            )
        # the first rows give bounds; the better these are, the more rows may pass before they are renewed
        start, rows_at_once = 0, max(1, SCORED_AT_ONCE // len(chosen))
        while start < len(ids):
            stop = start + rows_at_once
            self._offer_slice(ids[start:stop], vectors[start:stop].astype(np.float64), chosen)
            start, rows_at_once = stop, min(2 * rows_at_once, MAX_ROWS_AT_ONCE)

    def offer_leaves(self, ids: np.ndarray, leaves: Leaves) -> None:
        """:meth:`offer` for vectors in leaves: a query first looks into its nearest leaf, then into those its bound leaves.

        A query without a bound is offered all vectors.
        """
        whole = ~(self.sound & np.isfinite(self.bound))
        self.offer(ids[leaves.rest], leaves.vectors[leaves.rest], np.flatnonzero(~whole))
        self.offer(ids, leaves.vectors, np.flatnonzero(whole))
        asked = np.flatnonzero(~whole)
        if not len(asked) or not leaves.members:
            return
        highest = leaves.highest(self.unit[asked])
        nearest_leaf = highest.argmax(axis=1)
        first = np.zeros(highest.shape, dtype=bool)
        first[np.arange(len(asked)), nearest_leaf] = True
        self._offer_visits(ids, leaves, asked, first)
        least = _below(1.0 - self.bound[asked] - self.margin)
        self._offer_visits(ids, leaves, asked, (highest >= least[:, None]) & ~first)

    def _offer_visits(self, ids: np.ndarray, leaves: Leaves, asked: np.ndarray, visits: np.ndarray) -> None:
        least = _below(1.0 - self.bound[asked] - self.margin)
        found, n = [], 0
        for leaf in np.flatnonzero(visits.any(axis=0)):
            here = np.flatnonzero(visits[:, leaf])
            cosine = self.unit[asked[here]] @ leaves.units[leaf]
            at = np.flatnonzero(cosine >= least[here, None])
            found.append((asked[here[at // cosine.shape[1]]], leaves.members[leaf][at % cosine.shape[1]]))
            n += len(at)
            if n > SCORED_AT_ONCE:
                self._measure_found(ids, leaves, found)
                found, n = [], 0
        self._measure_found(ids, leaves, found)

    def _measure_found(self, ids: np.ndarray, leaves: Leaves, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if not found:
            return
        c, r = (np.concatenate(x) for x in zip(*found))
        step = max(1, SCORED_AT_ONCE // leaves.vectors.shape[1])
        for start in range(0, len(r), step):
            self._measure(ids, leaves.vectors, leaves.norms, r[start : start + step], c[start : start + step])

    def _offer_slice(self, ids: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> None:
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit, sound = _unit(vectors, norms)
        columns = max(1, min(len(ids), CACHED // QUERIES_AT_ONCE))
        held = np.empty((min(len(chosen), QUERIES_AT_ONCE), columns), dtype=np.float32)
        found = []
        for first in range(0, len(chosen), QUERIES_AT_ONCE):
            asked = chosen[first : first + QUERIES_AT_ONCE]
            mine, lost = self.unit[asked], ~self.sound[asked]
            least = 1.0 - self.bound[asked] - self.margin
            for start in range(0, len(ids), columns):
                part = slice(start, min(start + columns, len(ids)))
                size = part.stop - start
                cosine = held[: len(asked)] if size == columns else np.empty((len(asked), size), dtype=np.float32)
                np.matmul(mine, unit[part].T, out=cosine)
                if not sound[part].all():
                    cosine[:, ~sound[part]] = -np.inf
                if lost.any():
                    cosine[lost] = -np.inf
                if start == 0 and size > self.k:
                    kth = np.partition(cosine, size - self.k, axis=1)[:, size - self.k]
                    least = np.maximum(least, kth.astype(np.float64) - 2 * self.margin)
                at = np.flatnonzero(cosine >= _below(least)[:, None])
                found.append((asked[at // size], at % size + start))
        c, r = (np.concatenate(x) for x in zip(*found))
        step = max(1, SCORED_AT_ONCE // vectors.shape[1])
        for start in range(0, len(r), step):
            self._measure(ids, vectors, norms, r[start : start + step], c[start : start + step])

    def _measure(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = (vectors[r] * self.queries[c]).sum(axis=1) / (norms[r] * self.norms[c])
        distance = 1.0 - np.clip(cosine, -1.0, 1.0)
        near = ~(distance > self.bound[c])
        self._keep(c[near], ids[r[near]], distance[near])

    def _keep(self, query: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        ids = np.concatenate([self.id, ids])
        distance = np.concatenate([self.distance, distance])
        order = np.lexsort((ids, distance, query))
        query, ids, distance = query[order], ids[order], distance[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        kept = place < self.k
        self.query, self.id, self.distance = query[kept], ids[kept], distance[kept]
        last = place == self.k - 1
        full = distance[last]
        self.bound[query[last]] = np.where(np.isnan(full), np.inf, full)


def _unit(matrix: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one in single precision, and which rows have a direction; the others are zero."""
    sound = (norms > 0) & np.isfinite(norms)
    unit = np.zeros(matrix.shape, dtype=np.float32)
    unit[sound] = matrix[sound] / norms[sound, None]
    return unit, sound


def _below(values: np.ndarray) -> np.ndarray:
    """``values`` in single precision, rounded down."""
    return np.nextafter(values.astype(np.float32), np.float32(-np.inf))


def vector_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as an (n, dim) matrix, without a Python object per row."""
    if not len(column):
        return np.empty((0, 0))
    lengths = np.diff(column.offsets.to_numpy())
    if lengths.min() != lengths.max():
        raise ValueError(f"vectors of different dimensions: {lengths.min()} and {lengths.max()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def top_k_per_query(scored: DataFrame, k: int, *order) -> DataFrame:
    """Best k rows per query with their 1-based place ``r``; pruned per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("r", place).filter(F.col("r") <= k)


def nearest_to_one(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``(id, dist)`` of the k vectors nearest to one bound query vector."""
    vectors = vectors.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    asked = [(0, query)] if query else []
    scored = score_against_broadcast(vectors, asked, T.LongType(), k)
    return scored.select("id", "dist").orderBy("dist", "id").limit(k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, strategy: str = "auto") -> DataFrame:
    """``(query_id, id, dist, r)`` of the k vectors nearest to each query.

    ``vectors(id, embedding)``; ``queries(query_id, query_vec)``. Null vectors never match;
    queries with a null or empty vector get no rows. ``strategy`` is ``auto``, ``broadcast``
    or ``blocks``; ``auto`` broadcasts the queries only if they are few.
    """
    vectors = vectors.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    queries = queries.filter(F.size("query_vec") > 0).select("query_id", "query_vec")
    few = few_queries(queries) if strategy != "blocks" else None
    if few is not None:
        scored = score_against_broadcast(vectors, few, queries.schema["query_id"].dataType, k)
    elif strategy == "broadcast":
        raise ValueError("too many queries to broadcast")
    else:
        from cairnsearch.operators.neighbour_join import nearest_by_cells

        return nearest_by_cells(vectors, queries, k)
    return top_k_per_query(scored, k, "dist", "id")


def few_queries(queries: DataFrame) -> list[tuple[object, list[float]]] | None:
    """The queries themselves if they are few enough to broadcast, else None."""
    found = queries.select("query_id", "query_vec").limit(MAX_BROADCAST_QUERIES + 1).collect()
    values = sum(len(row["query_vec"]) for row in found)
    if len(found) > MAX_BROADCAST_QUERIES or values > MAX_BROADCAST_VALUES:
        return None
    return [(row["query_id"], row["query_vec"]) for row in found]


def score_against_broadcast(
    vectors: DataFrame,
    queries: list[tuple[object, list[float]]],
    query_id_type: T.DataType,
    k: int,
    probes: dict[object, list[int]] | None = None,
) -> DataFrame:
    """Each task's best k per query, for a bounded list of ``(query_id, query_vec)``.

    With ``probes`` (query_id -> cells to look in), ``vectors`` carry a ``cell`` column.
    """
    spark = vectors.sparkSession
    schema = f"query_id {query_id_type.simpleString()}, id long, dist double"
    if not queries:
        return spark.createDataFrame([], schema)
    ids = [query_id for query_id, _ in queries]
    matrix = np.array([vector for _, vector in queries], dtype=np.float64)
    shared = spark.sparkContext.broadcast((ids, matrix, _queries_by_cell(ids, probes)))
    id_type = to_arrow_type(query_id_type)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, by_cell = shared.value
        best = RunningTopK(matrix, k)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            found_here = vector_matrix(batch.column("embedding"))
            if by_cell is None:
                best.offer(ids, found_here)
                continue
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                here = cells == cell
                best.offer(ids[here], found_here[here], by_cell.get(int(cell), np.empty(0, int)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query_ids, type=id_type).take(pa.array(best.query)),
                pa.array(best.id),
                pa.array(best.distance),
            ],
            names=["query_id", "id", "dist"],
        )

    columns = ["id", "embedding"] + (["cell"] if probes is not None else [])
    return vectors.select(*columns).mapInArrow(score, schema)


def _queries_by_cell(query_ids: list, probes: dict | None) -> dict[int, np.ndarray] | None:
    if probes is None:
        return None
    by_cell: dict[int, list[int]] = {}
    for index, query_id in enumerate(query_ids):
        for cell in probes[query_id]:
            by_cell.setdefault(int(cell), []).append(index)
    return {cell: np.array(indexes) for cell, indexes in by_cell.items()}
