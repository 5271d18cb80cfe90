"""The stored corpus: append-only writes, generated ids, creation times, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CORPUS_SCHEMA = (
    "id long, title string, content string, embedding array<float>, "
    "namespace string, contributors string, created_at timestamp"
)


def with_generated_id(df: DataFrame, start: int = 0) -> DataFrame:
    """Unique ids from ``start`` upward, in one pass; they have gaps, as a sequence may."""
    return df.withColumn("id", F.monotonically_increasing_id() + F.lit(start))


def next_id(corpus: DataFrame) -> int:
    """One above the highest stored id, for a single writer; see ``id_blocks`` for several."""
    highest = corpus.agg(F.max("id")).first()[0]
    return 0 if highest is None else highest + 1


def append_documents(documents: DataFrame, path: str) -> int:
    """Append ``documents`` and return how many were written; running it twice stores them twice.

    Spark commits the files of a job together, so retried tasks add no rows.
    """
    written = Observation()
    shaped = documents.withColumn("created_at", F.current_timestamp()).select(
        *[field.split()[0] for field in CORPUS_SCHEMA.split(", ")]
    )
    shaped.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return written.get["rows"]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS_SCHEMA).parquet(path)


def count_documents(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("n_documents"))
