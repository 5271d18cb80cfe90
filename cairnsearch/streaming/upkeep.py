"""Search indexes kept while documents arrive: a segment for each batch, merged in tiers.

A segment is one folder, ``segment=<first batch>-<last batch>``, complete once Spark's
``_SUCCESS`` stands in it. Which segments count follows from the folder names alone: a merged one
hides those it was made of. So a replayed batch overwrites its own segment and nothing else, a
merge that failed is tried again, and no list has to be kept in step.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnsearch.functions.text import word_tokens
from cairnsearch.operators.cells import (
    SIZE_SCHEMA,
    VECTOR_SCHEMA,
    CellIndex,
    assign_cells,
    read_centres,
    store_centres,
    store_vectors,
    train_centroids,
)
from cairnsearch.operators.postings import (
    BOUNDS_SCHEMA,
    POSTINGS_SCHEMA,
    build_postings,
    shares_of,
    write_largest_shares,
    write_postings,
)
from cairnsearch.operators.ranges import one_in

FAN = 8
Range = tuple[int, int]


def segment_name(batches: Range) -> str:
    return f"segment={batches[0]:09d}-{batches[1]:09d}"


def stored_segments(spark: SparkSession, root: str) -> list[Range]:
    """The complete segments below ``root``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path(root)):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path(root))]
    complete = [n for n in names if n.startswith("segment=") and system.exists(path(f"{root}/{n}/_SUCCESS"))]
    return sorted(tuple(map(int, name.removeprefix("segment=").split("-"))) for name in complete)


def live_segments(segments: list[Range]) -> list[Range]:
    """Those that are not part of a wider one, in order."""
    out: list[Range] = []
    for first, last in sorted(segments, key=lambda s: (s[0], -s[1])):
        if not out or first > out[-1][1]:
            out.append((first, last))
    return out


def due_merge(live: list[Range], fan: int, before: int) -> Range | None:
    """The first ``fan`` neighbours of one tier, all of batches below ``before``; a tier is ``fan`` times the last one."""

    def tier(segment: Range) -> int:
        return int(math.log(segment[1] - segment[0] + 1, fan) + 1e-9)

    for i in range(len(live) - fan + 1):
        run = live[i : i + fan]
        adjoining = all(a[1] + 1 == b[0] for a, b in zip(run, run[1:]))
        if adjoining and run[-1][1] < before and len({tier(s) for s in run}) == 1:
            return run[0][0], run[-1][1]
    return None


@dataclass(frozen=True)
class IndexUpkeep:
    """The inverted index and the vector cells below ``root``, kept by one writer, read by any number.

    With ``lists`` vectors are kept in that many cells; their centres are trained on the first
    batch that has vectors, or stored beforehand with :meth:`set_centres`. Without ``keep_merged`` segments
    go as soon as a merged one hides them, for an index that nobody searches while documents arrive.
    """

    root: str
    lists: int = 0
    fan: int = FAN
    words: Callable[[Column], Column] = word_tokens
    keep_merged: bool = True

    @property
    def postings_root(self) -> str:
        return f"{self.root}/postings"

    @property
    def bounds_root(self) -> str:
        return f"{self.root}/bounds"

    @property
    def vectors_root(self) -> str:
        return f"{self.root}/vectors"

    @property
    def sizes_root(self) -> str:
        return f"{self.root}/sizes"

    def set_centres(self, spark: SparkSession, centres: np.ndarray) -> None:
        store_centres(spark, centres, self.root)

    def add(self, documents: DataFrame, batch: int) -> None:
        """Merge what is due, then index ``documents(id, title, content, embedding)`` as ``batch``.

        Only batches before this one are merged: they will not be replayed.
        """
        spark = documents.sparkSession
        name = segment_name((batch, batch))
        self._merge(spark, self.postings_root, POSTINGS_SCHEMA, write_postings, batch)
        self._merge(spark, self.bounds_root, BOUNDS_SCHEMA, self._store_bounds, batch)
        if self.lists:
            self._merge(spark, self.vectors_root, VECTOR_SCHEMA, self._store_cells, batch)
        if not self.keep_merged:
            self.drop_merged(spark)
        some = build_postings(one_in(documents, "id"), self.words)
        added = write_postings(build_postings(documents, self.words), f"{self.postings_root}/{name}", some=some)
        write_largest_shares(shares_of(added), f"{self.bounds_root}/{name}")
        if self.lists:
            vectors = documents.filter("embedding IS NOT NULL").select("id", "embedding")
            centres = self._centres(spark, vectors)
            placed = spark.createDataFrame([], VECTOR_SCHEMA) if centres is None else assign_cells(vectors, centres)
            self._store_cells(placed, f"{self.vectors_root}/{name}")

    def _store_bounds(self, bounds: DataFrame, path: str) -> None:
        write_largest_shares(bounds.select("lexeme", "block", F.lit(0.0).alias("title"), F.col("share").alias("content")), path)

    def _store_cells(self, vectors: DataFrame, path: str) -> None:
        store_vectors(vectors, path, path.replace(self.vectors_root, self.sizes_root))

    def _centres(self, spark: SparkSession, vectors: DataFrame) -> np.ndarray | None:
        """The stored centres, or new ones from ``vectors``; None as long as there are no vectors."""
        centres = read_centres(spark, self.root)
        first = vectors.first() if centres is None else None
        if first is None:
            return centres
        if vectors.filter(F.exists("embedding", lambda x: x != 0)).isEmpty():
            centres = np.ones((1, len(first["embedding"])))
        else:
            centres = train_centroids(vectors, self.lists)
        store_centres(spark, centres, self.root)
        return centres

    def _merge(self, spark: SparkSession, root: str, schema: str, write: Callable, before: int) -> None:
        while True:
            live = live_segments(stored_segments(spark, root))
            due = due_merge(live, self.fan, before)
            if due is None:
                return
            parts = [s for s in live if due[0] <= s[0] and s[1] <= due[1]]
            write(self._read(spark, root, schema, parts).drop("segment"), f"{root}/{segment_name(due)}")

    def _read(self, spark: SparkSession, root: str, schema: str, segments: list[Range]) -> DataFrame:
        if not segments:
            return spark.createDataFrame([], f"{schema}, segment string")
        names = [segment_name(s).removeprefix("segment=") for s in segments]
        stored = spark.read.schema(f"{schema}, segment string").parquet(root)
        return stored.filter(F.col("segment").isin(names))

    def postings(self, spark: SparkSession) -> DataFrame:
        """The index of all batches so far, from the live segments."""
        live = live_segments(stored_segments(spark, self.postings_root))
        return self._read(spark, self.postings_root, POSTINGS_SCHEMA, live).drop("segment")

    def bounds(self, spark: SparkSession) -> DataFrame:
        live = live_segments(stored_segments(spark, self.bounds_root))
        return self._read(spark, self.bounds_root, BOUNDS_SCHEMA, live).drop("segment")

    def cells(self, spark: SparkSession) -> CellIndex:
        centres = read_centres(spark, self.root)
        live = live_segments(stored_segments(spark, self.vectors_root))
        vectors = self._read(spark, self.vectors_root, VECTOR_SCHEMA, live).drop("segment")
        sizes = self._read(spark, self.sizes_root, SIZE_SCHEMA, live).drop("segment")
        return CellIndex(np.empty((0, 0)) if centres is None else centres, vectors, sizes)

    def drop_merged(self, spark: SparkSession) -> int:
        """Delete the segments that a merged one hides; for when no search started earlier still reads them."""
        jvm = spark.sparkContext._jvm
        dropped = 0
        for root in (self.postings_root, self.bounds_root, self.vectors_root, self.sizes_root):
            stored = stored_segments(spark, root)
            for segment in set(stored) - set(live_segments(stored)):
                path = jvm.org.apache.hadoop.fs.Path(f"{root}/{segment_name(segment)}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                dropped += 1
        return dropped
