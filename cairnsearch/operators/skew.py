"""Joins in which a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in this many rows is heavy, so there are fewer heavy keys than this.
SHARE = 200


def heavy_keys(counts: DataFrame, key: str) -> DataFrame:
    """``(key, buckets)`` of the heavy keys in ``counts(key, n)``: fewer than ``SHARE`` rows, whatever the data.

    A bucket of a heavy key holds about as many rows as a key may have without being heavy.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.filter(F.col("n") * SHARE > F.lit(total))
    return heavy.select(key, F.ceil(F.col("n") * SHARE / F.lit(max(total, 1))).cast("int").alias("buckets"))


def split_join(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, spread: str) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` on ``key``, with the rows of a heavy key dealt over buckets by ``spread``.

    ``counts(key, n)`` says how many ``rows`` a key has. The lookup rows of a heavy key are copied once per bucket. Rows
    whose heavy key is not looked up at all stay where they are and are dropped there; other keys are joined as they are.
    """
    asked = lookup.select(key).distinct().withColumn("__asked", F.lit(True))
    # fewer than SHARE rows
    heavy = F.broadcast(heavy_keys(counts, key).join(asked, key, "left"))
    buckets = F.coalesce("buckets", F.lit(1))
    dealt = (
        rows.join(heavy, key, "left")
        .filter(F.col("buckets").isNull() | F.col("__asked"))
        .withColumn("__bucket", F.pmod(F.xxhash64(spread), buckets).cast("int"))
        .drop("buckets", "__asked")
    )
    copied = (
        lookup.join(heavy, key, "left")
        .withColumn("__bucket", F.explode(F.sequence(F.lit(0), buckets - 1)))
        .drop("buckets", "__asked")
    )
    return dealt.join(copied, [key, "__bucket"]).drop("__bucket")
