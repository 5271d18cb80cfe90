"""Exact deduplication: a two-pass Bloom filter finds what may repeat, and only that is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnsearch.llm.common import bitmaps, filter_bits, join_hot, passes, slots


def with_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    First pass: every text's hash sets two bits, and the bits that more than one row sets are kept as
    bitmaps (a counting Bloom filter, cut down to "more than once"). Second pass: rows whose bits
    are both in it may repeat; these are grouped by SHA-256 of the text and joined to their group.
    All other rows certainly are single and pass through without a shuffle. The filter has
    at most 2**28 bits (32 MB broadcast): on more rows it lets more through, with the same result.

    Texts are equal if identical; a null text counts as empty. The row with the largest id of a group
    stays; null ids come last. Of rows that repeat both id and text one stays, by its place in the input,
    which must therefore be files or another input that reads the same twice. Other columns are kept, except
    those named like the four results, which these replace. An empty table gives an empty result.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    rows = docs.drop(*[c for c in added if c in docs.columns]).withColumn("__row", F.monotonically_increasing_id())
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = docs.count()
    bits = filter_bits(total)
    seen = docs.select(F.explode(F.array(*slots(text, bits))).alias("slot")).groupBy("slot").count()
    repeated = bitmaps(seen.filter(F.col("count") > 1), "slot")
    marked = passes(rows, repeated, slots(text, bits), "__maybe").withColumn("text_sha256", F.sha2(text, 256))
    maybe = marked.filter("__maybe").drop("__maybe")
    groups = maybe.groupBy("text_sha256").agg(
        F.max(F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("__top"), F.count("*").alias("group_size")
    )
    joined = join_hot(maybe, groups, ["text_sha256"], "group_size", total)
    grouped = joined.withColumn("keep_id", F.col("__top.id")).withColumn("kept", F.col("__row") == F.col("__top.row"))
    single = marked.filter("NOT __maybe").drop("__maybe").withColumns(
        {"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    )
    names = [c for c in rows.columns if c != "__row"] + added
    return grouped.select(*names).unionByName(single.select(*names))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns as they were."""
    own = {c: f"__own_{c}" for c in ("keep_id", "group_size", "kept", "text_sha256") if c in docs.columns}
    found = with_groups(docs.withColumnsRenamed(own), id_col=own.get(id_col, id_col), text_col=own.get(text_col, text_col))
    return found.filter("kept").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


SQL = """
WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)"""
