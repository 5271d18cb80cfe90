"""Ingestion: read, embed, append and count, as one batch job or as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairnsearch.operators.embed import Embedder, embed
from cairnsearch.operators.vector_store import VectorStore, embed_reusing
from cairnsearch.sources.corpus_table import CORPUS_SCHEMA, append_documents, read_corpus
from cairnsearch.sources.documents import path_exists
from cairnsearch.sources.id_blocks import with_claimed_ids
from cairnsearch.streaming.progress import run_status
from cairnsearch.streaming.upkeep import IndexUpkeep

LOG_SCHEMA = "batch_id long, at timestamp, rows_read long, inserted long"


def embedded_documents(
    rows: DataFrame,
    make_embedder: Callable[[], Embedder],
    dim: int | None = None,
    reuse: VectorStore | None = None,
) -> DataFrame:
    """``rows(id, title, text, namespace, contributors)`` as corpus rows with their vectors, those of known texts from
    ``reuse``."""
    if reuse is None:
        embedded = embed(rows, "text", make_embedder, dim)
    else:
        embedded, _ = embed_reusing(rows, "text", reuse, make_embedder, dim)
    return embedded.withColumnRenamed("text", "content")


def ingest_batch(
    rows: DataFrame,
    path: str,
    make_embedder: Callable[[], Embedder],
    dim: int | None = None,
    ids: str | None = None,
    writer: str | None = None,
    reuse: VectorStore | None = None,
) -> DataFrame:
    """Embed and append all rows; returns ``(rows_read, inserted)``, counted as they pass.

    With ``ids``, a folder that all writers of a corpus share, the rows need no ``id``: blocks of ids
    are claimed there (see ``id_blocks``) under the name ``writer``, by default one of its own. With
    ``reuse`` only texts that the store of vectors lacks are embedded.
    """
    if ids is not None:
        rows = with_claimed_ids(rows, ids, writer or uuid.uuid4().hex)
    if reuse is not None:
        inserted = append_documents(embedded_documents(rows, make_embedder, dim, reuse), path)
        return rows.sparkSession.createDataFrame([(rows.count(), inserted)], "rows_read long, inserted long")
    read = Observation()
    counted = rows.observe(read, F.count(F.lit(1)).alias("rows"))
    inserted = append_documents(embedded_documents(counted, make_embedder, dim), path)
    return rows.sparkSession.createDataFrame(
        [(read.get["rows"], inserted)], "rows_read long, inserted long"
    )


@dataclass(frozen=True)
class StreamTables:
    """Where one streaming ingestion keeps its documents, run log and checkpoint."""

    root: str

    @property
    def documents(self) -> str:
        return f"{self.root}/documents"

    @property
    def log(self) -> str:
        return f"{self.root}/log"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    @property
    def ids(self) -> str:
        return f"{self.root}/ids"

    def index(self, lists: int = 0, **options) -> IndexUpkeep:
        return IndexUpkeep(f"{self.root}/index", lists, **options)


def start_stream(
    rows: DataFrame,
    tables: StreamTables,
    make_embedder: Callable[[], Embedder],
    dim: int | None = None,
    index: IndexUpkeep | None = None,
):
    """Ingest all files now present, in micro-batches, and stop; a restart takes up where it ended.

    A batch is replayed after a failure, so each writes a folder of its own, named by batch id
    and overwritten on replay: documents are stored once, whatever happened on the way. Rows
    without an ``id`` get claimed ones, and a replayed batch the same. ``index`` is kept up with
    the documents: each batch adds a segment from the rows it stored, and none is read again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        if "id" not in batch.columns:
            batch = with_claimed_ids(batch, tables.ids, f"batch {batch_id}")
        folder = f"{tables.documents}/batch_id={batch_id}"
        read, written = Observation(), Observation()
        counted = batch.observe(read, F.count(F.lit(1)).alias("rows"))
        (
            embedded_documents(counted, make_embedder, dim)
            .withColumn("created_at", F.current_timestamp())
            .observe(written, F.count(F.lit(1)).alias("rows"))
            .write.mode("overwrite")
            .option("compression", "zstd")
            .parquet(folder)
        )
        if index is not None:
            index.add(read_corpus(batch.sparkSession, folder), batch_id)
        batch.sparkSession.range(1).select(
            F.current_timestamp().alias("at"),
            F.lit(read.get["rows"]).cast("long").alias("rows_read"),
            F.lit(written.get["rows"]).cast("long").alias("inserted"),
        ).write.mode("overwrite").parquet(f"{tables.log}/batch_id={batch_id}")

    return (
        rows.writeStream.foreachBatch(store)
        .option("checkpointLocation", tables.checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, tables: StreamTables) -> DataFrame:
    if not path_exists(spark, tables.documents):
        return spark.createDataFrame([], CORPUS_SCHEMA)
    return read_corpus(spark, tables.documents)


def stream_status(spark: SparkSession, tables: StreamTables, stream) -> DataFrame:
    """The status of ``stream`` as ``start_stream`` returned it (None: not started) with its logged counts."""
    failure = stream.exception() if stream is not None else None
    return run_status(
        read_log(spark, tables),
        started=stream is not None,
        active=stream is not None and stream.isActive,
        error=None if failure is None else str(failure),
    )


def reset_run(spark: SparkSession, tables: StreamTables) -> None:
    """Forget the counts of earlier runs: their log goes, documents, ids and what has been read stay.

    For when no run is active. The next run's counts start from nothing.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables.log)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_log(spark: SparkSession, tables: StreamTables) -> DataFrame:
    if not path_exists(spark, tables.log):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(tables.log)
