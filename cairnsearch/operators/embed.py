"""Embedding text with a model the caller supplies."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnsearch.functions.text import is_blank, truncate
from cairnsearch.operators.sizing import MAX_ROWS, broadcast_if

EMBED_BATCH = 32
MAX_TEXT_LENGTH = 8192
MAX_QUERY_LENGTH = 512
ROWS_PER_SALT = 1_000_000

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
"""Texts in, one vector per text out, in the same order."""


def once_per_worker(make: Callable[[], Embedder]) -> Callable[[], Embedder]:
    """``make`` for use in tasks: a worker process keeps what it made for its later tasks.

    Functions arrive in each task as new copies, so the model is kept outside them, under a
    name made from the factory's pickled form. A worker holds one model at a time.
    """
    name = "model_" + hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def held() -> Embedder:
        kept = sys.modules.setdefault("cairnsearch_worker", types.ModuleType("cairnsearch_worker"))
        if getattr(kept, "name", None) != name:
            kept.name, kept.model = None, None
            kept.model = make()
            kept.name = name
        return kept.model

    return held


def embed(
    df: DataFrame,
    text_column: str,
    make_embedder: Callable[[], Embedder],
    dim: int | None = None,
    output: str = "embedding",
    batch_size: int = EMBED_BATCH,
    max_length: int | None = None,
) -> DataFrame:
    """Add ``output array<float>``; ``make_embedder`` runs once per Python worker, where the model loads.

    Whole texts are embedded unless a ``max_length`` is given. Only the text travels to Python;
    all other columns stay in the JVM and are put back beside their vectors by Spark, so no
    join is needed. A wrong number of vectors, or with ``dim`` a wrong length, fails the job.
    """
    worker_model = once_per_worker(make_embedder)

    @F.arrow_udf("array<float>")
    def vectors(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = worker_model()
        for column in columns:
            done: list[np.ndarray] = []
            for start in range(0, len(column), batch_size):
                # no more texts than the model is given are Python objects at a time
                batch = column.slice(start, batch_size).to_pylist()
                found = embedder(batch)
                if len(found) != len(batch):
                    raise ValueError(f"{len(found)} vectors returned for {len(batch)} texts")
                done.extend(np.asarray(v, dtype=np.float32) for v in found)
            if dim is not None and any(len(v) != dim for v in done):
                raise ValueError(f"expected {dim} dimensions, got {sorted({len(v) for v in done})}")
            offsets = np.cumsum([0, *map(len, done)], dtype=np.int32)
            values = np.concatenate(done) if done else np.empty(0, dtype=np.float32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    text = F.col(text_column)
    return df.withColumn(output, vectors(text if max_length is None else truncate(text, max_length)))


def embed_distinct(
    queries: DataFrame,
    make_embedder: Callable[[], Embedder],
    dim: int | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    max_length: int | None = None,
) -> DataFrame:
    """Add ``query_vec`` to ``queries(query_id, query_text, ...)``, embedding each distinct text once.

    Whole texts are embedded unless a ``max_length`` is given. A null text keeps its row, with a null vector.

    One text may make up much of ``queries``. The grouping folds repeats before the shuffle;
    joining back is salted for texts above ``rows_per_salt`` rows, so that none of them lands
    in one task. Salts are kept per hash of the text, at most one per ``rows_per_salt`` rows, and
    broadcast if they were counted to be few.
    """
    text_hash = F.xxhash64("query_text").alias("text_hash")
    counted = queries.filter("query_text IS NOT NULL").groupBy("query_text").agg(F.count("*").alias("repeats"))
    salts = (
        counted.groupBy(text_hash)
        .agg(F.ceil(F.sum("repeats") / rows_per_salt).alias("salts"))
        .filter(F.col("salts") > 1)
    )
    few = broadcast_if(salts.limit(MAX_ROWS + 1).count() <= MAX_ROWS, salts)
    n_salts = F.coalesce("salts", F.lit(1).cast("long"))

    def salted(df: DataFrame, salt) -> DataFrame:
        hashed = df.withColumn("text_hash", text_hash).join(few, "text_hash", "left")
        return hashed.withColumn("salt", salt).drop("text_hash", "salts")

    vectors = embed(
        counted.select("query_text"),
        "query_text",
        make_embedder,
        dim,
        output="query_vec",
        max_length=max_length,
    )
    copies = salted(vectors, F.explode(F.sequence(F.lit(0).cast("long"), n_salts - 1)))
    return (
        salted(queries, F.pmod(F.xxhash64("query_id"), n_salts))
        .join(copies, ["query_text", "salt"], "left")
        .select(*queries.columns, "query_vec")
    )


def embed_asked(
    queries: DataFrame, make_embedder: Callable[[], Embedder], dim: int | None = None, reuse=None
) -> DataFrame:
    """``queries`` with a ``query_vec`` made from each text; a given one is replaced.

    Blank texts ask for nothing and are dropped. A row whose ``vector_mode`` is ``NONE`` gets a null vector. With
    ``reuse``, a ``VectorStore``, only texts that it lacks are embedded.
    """
    from cairnsearch.operators.vector_store import embed_reusing

    def embedded(rows: DataFrame) -> DataFrame:
        if reuse is None:
            return embed_distinct(rows, make_embedder, dim)
        return embed_reusing(rows, "query_text", reuse, make_embedder, dim, "query_vec", "query_id")[0]

    asked = queries.drop("query_vec").filter(~is_blank(F.col("query_text")))
    if "vector_mode" not in asked.columns:
        return embedded(asked)
    without = asked.filter("vector_mode <=> 'NONE'").withColumn("query_vec", F.lit(None).cast("array<float>"))
    return embedded(asked.filter("NOT vector_mode <=> 'NONE'")).unionByName(without)


def check_dimension(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fail the job on a vector of another length; null vectors are allowed."""
    checked = F.assert_true(
        F.col(column).isNull() | (F.size(column) == dim),
        F.concat(F.lit(f"expected {dim} dimensions, not "), F.size(column).cast("string")),
    )
    return df.withColumn(column, F.when(checked.isNull(), F.col(column)))
