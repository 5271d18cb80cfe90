"""From raw documents to packed training sequences, in five stages; each works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnsearch.llm import exact_dedup, lang_id, minhash, mixing, packing
from cairnsearch.llm.common import store, table


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, made longer until the documents have no column of that name."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; those that are rejected as too far from all languages go.

    The predicted language replaces a null one, given ones stay. Null, empty and letterless texts are rejected; repeated
    rows fare alike; rows with a null id are judged and teach nothing. Other columns are kept, whatever their names. An
    empty table stays empty.
    """
    model = lang_id.fit(docs.filter(~lang_id.held_out(F.col("doc_id"))))
    results = unused(docs, "lang_pred", "score", "rejected")
    found = lang_id.predict(docs, model, keep=docs.columns, results=results)
    predicted, _, rejected = results
    known = found.filter(~F.col(rejected)).withColumn("lang", F.coalesce("lang", predicted))
    return known.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays.

    Null texts are empty ones; of rows that share id and text one stays. Other columns are kept. An empty table stays empty.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in five-word shingles, the one with the smallest id stays.

    Texts without words and rows with a null id are linked with nothing and stay; rows of one id go or stay together. Other
    columns are kept, whatever their names. An empty table stays empty.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = found.filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources reach their target weights.

    Null sources are one source, the last; texts without words weigh nothing. Other columns are kept. An empty table stays
    empty.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence of at most 1,024 tokens.

    Null texts are empty ones, of one token; null ids stay null; repeated rows are packed each. An empty table gives none.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: n-gram centroids, MinHash components, hashed draws and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, "pipeline-stage")
    return docs
