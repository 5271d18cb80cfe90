"""Vectors kept by the text they were made from, so that a later run embeds only what is new."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnsearch.operators.embed import Embedder, embed
from cairnsearch.operators.skew import split_join
from cairnsearch.session import stored
from cairnsearch.sources.documents import path_exists

STORE_SCHEMA = "digest string, vector array<float>"


@dataclass(frozen=True)
class VectorStore:
    """Vectors of one ``model`` below ``root``, addressed by the SHA-256 of their texts.

    Any number of writers may add to it. Two that embed the same text at the same time store it twice, with the same
    vector; readers take one. The model's name is part of the address: another model finds nothing.
    """

    root: str
    model: str

    @property
    def path(self) -> str:
        return f"{self.root}/model={hashlib.sha256(self.model.encode()).hexdigest()[:32]}"

    def read(self, spark: SparkSession) -> DataFrame:
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], STORE_SCHEMA)
        return spark.read.schema(STORE_SCHEMA).parquet(f"{self.path}/*")

    def add(self, vectors: DataFrame) -> None:
        """One folder a call, complete or invisible."""
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        vectors.select("digest", "vector").write.parquet(part)


def embed_reusing(
    rows: DataFrame,
    text_column: str,
    store: VectorStore,
    make_embedder: Callable[[], Embedder],
    dim: int | None = None,
    output: str = "embedding",
    key: str = "id",
) -> tuple[DataFrame, int]:
    """``rows`` with ``output array<float>``, and how many texts had to be embedded.

    Each distinct text that the store lacks is embedded once and stored; then every row takes its vector from there. A
    text that many rows share is folded before the shuffle, and its rows are dealt by ``key`` when they get it back. A
    null text has a null vector.
    """
    spark = rows.sparkSession
    digest = F.sha2(F.col(text_column).cast("binary"), 256).alias("digest")
    texts = rows.filter(F.col(text_column).isNotNull()).select(digest, F.col(text_column).alias("text"))
    asked = stored(texts.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("n")), "asked-texts")
    new = asked.join(store.read(spark).select("digest"), "digest", "left_anti")
    made = stored(embed(new, "text", make_embedder, dim, "vector").select("digest", "vector"), "new-vectors")
    n_new = made.count()
    if n_new:
        store.add(made)
    known = store.read(spark).join(asked.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    known = known.withColumnRenamed("vector", output)
    named = rows.withColumn("digest", digest)
    found = split_join(named.filter("digest IS NOT NULL"), known, "digest", asked.select("digest", "n"), key)
    nothing = named.filter("digest IS NULL").withColumn(output, F.lit(None).cast("array<float>"))
    columns = [*[c for c in rows.columns if c != output], output]
    return found.select(*columns).unionByName(nothing.select(*columns)), n_new
