"""Weighted text vectors and the inverted index kept over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnsearch.functions.ranking import WEIGHTS
from cairnsearch.functions.text import word_tokens
from cairnsearch.operators.ranges import folded_in_order, sorted_by_range, write_packed

TITLE_WEIGHT, CONTENT_WEIGHT = "A", "D"
DOCUMENTS_AT_ONCE = 256
#: Documents with consecutive ids whose largest share of a word is kept as one bound.
BLOCK_IDS = 256
BOUNDS_SCHEMA = "lexeme string, block long, share double"
POSTINGS_SCHEMA = (
    "lexeme string, id long, field string, weight string, positions array<int>, doc_length long"
)
#: Rows of an index, or of its bounds, that are sorted and stored together.
FILE_ROWS, FILE_BOUNDS = 500_000, 2_000_000


def tokenised(documents: DataFrame, weighted: bool, words: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """``(id, tokens, title_tokens)``: one document's words in order, in one array.

    Weighted vectors take the title's words first and count them in ``title_tokens``, so the
    content's positions follow the title's. Otherwise title and content are one plain text.
    ``words`` makes the array of words of a text.
    """
    title = F.coalesce("title", F.lit(""))
    content = F.coalesce("content", F.lit(""))
    if not weighted:
        joined = F.concat_ws(" ", title, content)
        return documents.select("id", words(joined).alias("tokens"), F.lit(0).alias("title_tokens"))
    return documents.select(
        "id", words(title).alias("title_words"), words(content).alias("content_words")
    ).select(
        "id",
        F.concat("title_words", "content_words").alias("tokens"),
        F.size("title_words").alias("title_tokens"),
    )


def build_postings(documents: DataFrame, words: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """The inverted index: one row per lexeme, document and field (``POSTINGS_SCHEMA``).

    All words of a document stand in one row, so position lists are finished within it: words are
    numbered batch by batch and sorted by document, word and field, and nothing is shuffled.
    """
    tokens = tokenised(documents, weighted=True, words=words)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                yield position_lists(batch.slice(start, DOCUMENTS_AT_ONCE))

    return tokens.select("id", "tokens", "title_tokens").mapInArrow(group, POSTINGS_SCHEMA)


def position_lists(documents: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of ``documents(id, tokens, title_tokens)``, in document order."""
    lists = documents.column("tokens")
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    of_document = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(of_document)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    in_content = position > np.repeat(documents.column("title_tokens").to_numpy(), lengths)
    code = words.indices.to_numpy().astype(np.int64)
    key = (of_document * max(1, len(words.dictionary)) + code) * 2 + in_content
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.nonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))[0] if len(key) else order
    chosen = order[first]
    content = pa.array(in_content[chosen])
    offsets = pa.array(np.append(first, len(order)), pa.int32())
    positions = pa.ListArray.from_arrays(offsets, pa.array(position[order], pa.int32()))
    return pa.RecordBatch.from_arrays(
        [
            words.dictionary.take(pa.array(code[chosen])),
            documents.column("id").take(pa.array(of_document[chosen])),
            pc.if_else(content, "content", "title"),
            pc.if_else(content, CONTENT_WEIGHT, TITLE_WEIGHT),
            positions,
            pa.array(lengths[of_document[chosen]]),
        ],
        names=[field.split()[0] for field in POSTINGS_SCHEMA.split(", ")],
    )


def block_of(identity: Column) -> Column:
    return F.floor(identity / BLOCK_IDS).cast("long")


def build_bounds(postings: DataFrame) -> DataFrame:
    """``(lexeme, block, share)``: the most that a word can add to the rank of a document in a range of ids.

    A document's share of a word is the sum of the weights of its positions over the logarithm of
    the document's length. Title and content have rows of their own, so the bound adds the largest
    share of each.
    """
    weights = F.when(F.col("weight") == TITLE_WEIGHT, WEIGHTS[TITLE_WEIGHT]).otherwise(WEIGHTS[CONTENT_WEIGHT])
    share = F.size("positions") * weights / F.log(F.col("doc_length") + 1.0)

    def largest(weight: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("weight") == weight, F.col("__share"))), F.lit(0.0))

    return (
        postings.select("lexeme", block_of(F.col("id")).alias("block"), "weight", share.alias("__share"))
        .groupBy("lexeme", "block")
        .agg((largest(TITLE_WEIGHT) + largest(CONTENT_WEIGHT)).alias("share"))
    )


def store_sorted(
    rows: DataFrame,
    path: str,
    mode: str,
    order: list[str],
    file_rows: int,
    partitions: int | None = None,
    some: DataFrame | None = None,
) -> None:
    """Store ``rows`` in ``order``, a word and a number, in files by range of about ``file_rows`` rows.

    Files get no larger with the input, so a task sorts its rows in memory, however many there are.
    """
    lists = [f"{f.name}.list.element" for f in rows.schema if f.dataType.simpleString() == "array<int>"]
    steps = [order[1], *lists]
    sorted_by_range(rows, order, file_rows, partitions, lambda ranged: write_packed(ranged, path, mode, steps), some=some)


def write_bounds(bounds: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Store bounds in (lexeme, block) order; those of a later part of the index may be appended or read beside."""
    kept = bounds.persist(StorageLevel.DISK_ONLY)
    try:
        store_sorted(kept, path, mode, ["lexeme", "block"], FILE_BOUNDS)
    finally:
        kept.unpersist()
    return read_bounds(bounds.sparkSession, path)


def shares_of(postings: DataFrame) -> DataFrame:
    """``(lexeme, block, title, content)``: what each of ``postings`` adds to the rank of its document."""
    titled = F.col("weight") == TITLE_WEIGHT
    weights = F.when(titled, WEIGHTS[TITLE_WEIGHT]).otherwise(WEIGHTS[CONTENT_WEIGHT])
    share = F.size("positions") * weights / F.log(F.col("doc_length") + 1.0)
    return postings.select("lexeme", block_of(F.col("id")).alias("block"), titled.alias("__titled"), share.alias("__share")).select(
        "lexeme",
        "block",
        F.when(F.col("__titled"), F.col("__share")).otherwise(0.0).alias("title"),
        F.when(F.col("__titled"), 0.0).otherwise(F.col("__share")).alias("content"),
    )


def write_largest_shares(shares: DataFrame, path: str) -> None:
    """The bounds of ``shares(lexeme, block, title, content)``, which may have any number of rows of a word and block,
    stored as ``write_bounds`` stores those of ``build_bounds``; shares are folded before they are shuffled."""
    order = ["lexeme", "block"]

    def store(ranged: DataFrame) -> None:
        once = ranged.mapInArrow(lambda batches: folded_in_order(batches, order), ranged.schema)
        write_packed(once.select(*order, (F.col("title") + F.col("content")).alias("share")), path, steps=order[1:])

    sorted_by_range(shares, order, FILE_BOUNDS, None, store, fold=True)


def read_bounds(spark, path: str) -> DataFrame:
    return spark.read.schema(BOUNDS_SCHEMA).parquet(path)


def missing_postings(
    documents: DataFrame, postings: DataFrame, words: Callable[[Column], Column] = word_tokens
) -> DataFrame:
    """Index rows for documents the index does not hold yet, ready to be appended.

    Every indexed document has exactly one posting with position 1, so its id need not be
    gathered from all its postings.
    """
    indexed = postings.filter(F.array_min("positions") == 1).select("id")
    return build_postings(documents.join(indexed, "id", "left_anti"), words)


def write_postings(
    postings: DataFrame,
    path: str,
    mode: str = "overwrite",
    partitions: int | None = None,
    some: DataFrame | None = None,
) -> DataFrame:
    """Store the index in (lexeme, id) order.

    Range partitioning by both columns splits a lexeme found everywhere over many files, and
    sorted files let the reader skip every row group that holds no asked-for lexeme. Without
    ``partitions`` there are as many as hold ``FILE_ROWS`` rows each. ``some`` postings, those of the documents
    that ``one_in`` leaves, spare making all of them once more to choose the ranges.
    """
    store_sorted(postings, path, mode, ["lexeme", "id"], FILE_ROWS, partitions, some)
    return read_postings(postings.sparkSession, path)


def read_postings(spark, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS_SCHEMA).parquet(path)

