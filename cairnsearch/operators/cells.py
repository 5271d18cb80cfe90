"""Vector search by cells (IVF): k-means cells, nearest ones first, ranked exactly.

With a number of ``probes`` a search looks into that many cells, and may miss some neighbours.
Without one it goes on until the radii of the cells left rule out anything nearer, so the result
is exact though most cells may never be read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnsearch.operators import nearest as exact
from cairnsearch.operators import neighbour_join as join
from cairnsearch.operators.neighbour_join import CellBounds
from cairnsearch.sources.documents import path_exists

DEFAULT_LISTS = 100
CELL_FILE_ROWS = 1_000_000
CENTRE_SCHEMA = "cell int, centre array<double>"
SIZE_SCHEMA = "cell int, radius float, n long"
VECTOR_SCHEMA = "id long, embedding array<float>, angle float, cell int"
#: Hits that the driver may hold between the rounds of an exact search.
MAX_HELD_HITS = 1_000_000


@dataclass(frozen=True)
class CellIndex:
    """``centroids`` is (lists, dim); ``vectors`` is ``(id, embedding, angle, cell)``; ``sizes`` is
    ``(cell, radius, n)``, measured in the vectors if it was not stored."""

    centroids: np.ndarray
    vectors: DataFrame
    sizes: DataFrame | None = None

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def bounds(self) -> CellBounds:
        sizes = join.measured(self.vectors) if self.sizes is None else self.sizes
        return join.bounds_of(self.centroids, sizes)


def train_centroids(
    vectors: DataFrame, lists: int = DEFAULT_LISTS, seed: int = 42, training_rows: int | None = None
) -> np.ndarray:
    """Cosine k-means over all rows, or over a sample of about ``training_rows``.

    Centres decide which rows share a cell, and so the recall of a search that does not probe every cell.
    """
    usable = vectors.filter(F.exists("embedding", lambda x: x != 0)).select("embedding")
    if training_rows is not None and (n := usable.count()) > training_rows:
        usable = usable.sample(fraction=training_rows / n, seed=seed)
    features = usable.select(array_to_vector("embedding").alias("features")).cache()
    try:
        model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=10).fit(features)
    finally:
        features.unpersist()
    return np.array(model.clusterCenters())


def assign_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, embedding, angle, cell)`` with the nearest centre of each vector and the angle to it."""
    return join.with_cells(vectors, centroids)


def build_cells(
    vectors: DataFrame, lists: int = DEFAULT_LISTS, seed: int = 42, training_rows: int | None = None
) -> CellIndex:
    centroids = train_centroids(vectors, lists, seed, training_rows)
    return CellIndex(centroids, assign_cells(vectors, centroids))


def write_cells(index: CellIndex, path: str, rows_per_file: int = CELL_FILE_ROWS) -> CellIndex:
    """Store the centres, and the vectors by cell, so a search reads only the folders it probes."""
    spark = index.vectors.sparkSession
    store_centres(spark, index.centroids, path)
    store_vectors(index.vectors, f"{path}/vectors", f"{path}/sizes", rows_per_file)
    return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    """The index stored at ``path``."""
    vectors = spark.read.schema(VECTOR_SCHEMA).parquet(f"{path}/vectors")
    sizes = spark.read.schema(SIZE_SCHEMA).parquet(f"{path}/sizes")
    return CellIndex(read_centres(spark, path), vectors, sizes)


def append_cells(vectors: DataFrame, path: str, rows_per_file: int = CELL_FILE_ROWS) -> CellIndex:
    """Add ``vectors(id, embedding)`` to the index stored at ``path``, in the cells of its centres."""
    spark = vectors.sparkSession
    placed = assign_cells(vectors, read_centres(spark, path))
    store_vectors(placed, f"{path}/vectors", f"{path}/sizes", rows_per_file, "append")
    return read_cells(spark, path)


def store_centres(spark: SparkSession, centres: np.ndarray, path: str) -> None:
    rows = [(cell, centre.tolist()) for cell, centre in enumerate(centres)]
    spark.createDataFrame(rows, CENTRE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read_centres(spark: SparkSession, path: str) -> np.ndarray | None:
    """The centres stored below ``path``; None if there are none."""
    if not path_exists(spark, f"{path}/centres/_SUCCESS"):
        return None
    rows = spark.read.schema(CENTRE_SCHEMA).parquet(f"{path}/centres").orderBy("cell").collect()  # `lists` rows
    return np.array([row["centre"] for row in rows])


def store_vectors(
    vectors: DataFrame, path: str, sizes_path: str, rows_per_file: int = CELL_FILE_ROWS, mode: str = "overwrite"
) -> None:
    """``vectors(id, embedding, angle, cell)`` by cell at ``path``, their sizes at ``sizes_path``.

    Large cells are spread over several tasks and files by id, small ones share a task. The
    vectors are counted first, and kept on disk meanwhile: their cells are found once.
    """
    kept = vectors.select("id", "embedding", "angle", "cell").persist(StorageLevel.DISK_ONLY)
    try:
        sizes = join.measured(kept).toArrow()  # at most `lists` rows
        measured = vectors.sparkSession.createDataFrame(sizes, SIZE_SCHEMA)
        measured.coalesce(1).write.mode(mode).parquet(sizes_path)
        files = F.greatest(F.ceil(F.col("n") / rows_per_file), F.lit(1)).cast("long")
        (
            kept.join(F.broadcast(measured.select("cell", files.alias("files"))), "cell")
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("files")))
            .repartition("cell", "part")
            .drop("files", "part")
            .write.partitionBy("cell")
            .mode(mode)
            .parquet(path)
        )
    finally:
        kept.unpersist()


def search_cells(
    index: CellIndex, queries: DataFrame, k: int, probes: int | None = None, strategy: str = "auto"
) -> DataFrame:
    """``(query_id, id, dist, r)``: exact without ``probes``, else among that many cells nearest to each query.

    With ``probes >= lists`` every cell is read and the result is the exact one too.
    """
    queries = queries.filter(F.size("query_vec") > 0).select("query_id", "query_vec")
    few = exact.few_queries(queries) if strategy != "blocks" else None
    if few is None and strategy == "broadcast":
        raise ValueError("too many queries to broadcast")
    kind = queries.schema["query_id"].dataType
    if not index.lists:
        scored = exact.score_against_broadcast(index.vectors, [], kind, k)
    elif few is not None and (probes is not None or len(few) * k <= MAX_HELD_HITS):
        scored = _search_few_exactly(index, few, kind, k) if probes is None else _search_few(index, few, kind, k, probes)
    elif probes is None:
        return join.nearest_join(index.vectors, index.bounds(), queries, k)
    else:
        scored = _search_many(index, queries, k, min(probes, index.lists))
    return exact.top_k_per_query(scored, k, "dist", "id")


def _nearest_cells(vectors: np.ndarray, unit: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(vectors @ unit.T), axis=1, kind="stable")[:, :probes].astype(np.int32)


def _of_cells(vectors: DataFrame, wanted: list[int], lists: int) -> DataFrame:
    """Only the folders of the cells ``wanted`` are read."""
    return vectors.filter(F.col("cell").isin(wanted)) if len(wanted) < lists else vectors


def _score_few(index: CellIndex, queries: list, kind, k: int, chosen: dict) -> DataFrame:
    wanted = sorted({int(cell) for found in chosen.values() for cell in found})
    return exact.score_against_broadcast(_of_cells(index.vectors, wanted, index.lists), queries, kind, k, chosen)


def _search_few(index: CellIndex, queries: list, kind, k: int, probes: int) -> DataFrame:
    """Vectors are read in place, and only from the cells some query probes."""
    if not queries:
        return exact.score_against_broadcast(index.vectors, queries, kind, k)
    matrix = np.array([vector for _, vector in queries], dtype=np.float64)
    cells = _nearest_cells(matrix, join.unit_rows(index.centroids), min(probes, index.lists))
    return _score_few(index, queries, kind, k, {query_id: found for (query_id, _), found in zip(queries, cells)})


def _search_few_exactly(index: CellIndex, queries: list, kind, k: int) -> DataFrame:
    """Rounds of :mod:`neighbour_join` with the queries on the driver, and the best k of each between rounds."""
    spark = index.vectors.sparkSession
    best = exact.score_against_broadcast(index.vectors, [], kind, k)
    if not queries:
        return best
    matrix = np.array([vector for _, vector in queries], dtype=np.float64)
    place = {query_id: i for i, (query_id, _) in enumerate(queries)}
    bounds, distance = index.bounds(), np.full(len(queries), np.inf)
    for number in range(join.ROUNDS):
        cells = join.cells_of_round(matrix, distance, bounds, k, number)
        chosen = {query_id: found for (query_id, _), found in zip(queries, cells) if len(found)}
        if not chosen:
            continue
        asking = [query for query in queries if query[0] in chosen]
        both = best.unionByName(_score_few(index, asking, kind, k, chosen))
        held = exact.top_k_per_query(both, k, "dist", "id").drop("r").toArrow()  # k rows a query, MAX_HELD_HITS in all
        best = spark.createDataFrame(held, best.schema)
        for query_id, dist in _last_distances(held, k).items():
            distance[place[query_id]] = dist
    return best


def _last_distances(hits, k: int) -> dict:
    """The k-th distance of each query that has k hits; a NaN, from a zero vector, bounds nothing."""
    found: dict = {}
    for query_id, dist in zip(hits.column("query_id").to_pylist(), hits.column("dist").to_pylist()):
        found.setdefault(query_id, []).append(np.inf if dist != dist else dist)
    return {query_id: max(values) for query_id, values in found.items() if len(values) >= k}


def _search_many(index: CellIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Each query finds its own cells in its task and travels to them."""
    shared = queries.sparkSession.sparkContext.broadcast(join.unit_rows(index.centroids))

    @F.pandas_udf("array<int>")
    def nearest_cells(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        return pd.Series(list(_nearest_cells(np.stack(column.to_list()), shared.value, probes)))

    visits = queries.select("query_id", F.col("query_vec").cast("array<double>"), F.explode(nearest_cells("query_vec")).alias("cell"))
    # at most `lists` numbers; as values they prune the folders read
    asked = {row["cell"]: row["count"] for row in visits.groupBy("cell").count().collect()}
    return join.score_visits(index.vectors, visits, index.bounds(), asked, k)
