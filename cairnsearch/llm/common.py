"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnsearch.session import shared_folder

HOT_SHARE = 1000
MAX_BROADCAST_ROWS = 500_000
MAX_FILTER_BITS = 1 << 28
BITMAP_BITS = 32768


def per_worker(name: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a worker process and kept there under ``name``.

    Task functions travel by value, and with them their modules' own caches would be copies or be looked for in a
    package that a worker need not have; so what is kept lies in a module of its own.
    """
    kept = sys.modules.setdefault("training_data_worker", types.ModuleType("training_data_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, with no lineage to lose."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete a table of :func:`store` that nothing reads any more."""
    files = stored.inputFiles()
    if files:
        spark = stored.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def map_batches(df: DataFrame, function: Callable[..., pa.RecordBatch], schema: str, rows: int = 512) -> DataFrame:
    """``function`` over Arrow batches of at most ``rows`` rows, whatever size Spark sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield function(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join to ``right``, unique by ``keys``, whose column ``count`` says how many left rows a key has.

    Keys with more than one in ``HOT_SHARE`` of the ``total`` left rows number fewer than
    ``HOT_SHARE``: they are broadcast, and their rows stay where they are. The rest is
    shuffled, no key of it being large. Null keys match nothing. ``right`` is written down first, being used twice.
    """
    right = store(right, "join")
    hot = F.col(count) * HOT_SHARE > total
    values = [c for c in right.columns if c not in keys]
    warm = left.join(F.broadcast(right.filter(hot).withColumn("__hot", F.lit(True))), keys, "left")
    stay = warm.filter("__hot").drop("__hot")
    move = warm.filter("__hot IS NULL").drop("__hot", *values).join(right.filter(~hot), keys, "left")
    return stay.unionByName(move)


def slots(key: Column, bits: int, seeds: tuple[int, ...] = (1, 2)) -> list[Column]:
    """The bits of a Bloom filter that belong to ``key``, numbered from 1."""
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) + 1 for seed in seeds]


def filter_bits(rows: int, per_row: int = 16) -> int:
    """A power of two near ``per_row`` bits a row, from one bitmap to ``MAX_FILTER_BITS``."""
    return min(MAX_FILTER_BITS, 1 << max(15, (max(1, rows) * per_row - 1).bit_length()))


def bitmaps(numbers: DataFrame, slot: str) -> DataFrame:
    """Bits ``slot`` as ``(bucket, bits)`` of 32,768 bits each: a 4 KB row per bitmap."""
    return numbers.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )


def passes(df: DataFrame, filters: DataFrame, probes: list[Column], name: str) -> DataFrame:
    """``df`` with the boolean ``name``: are all bits set that ``probes`` ask for?

    The filter is broadcast; it has at most ``MAX_FILTER_BITS`` bits (32 MB) at any input size.
    """
    answer = F.lit(True)
    for i, slot in enumerate(probes):
        bucket, bits, place = f"__bucket{i}", f"__bits{i}", F.bitmap_bit_position(slot)
        side = F.broadcast(filters.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
        df = df.join(side, F.bitmap_bucket_number(slot) == F.col(bucket), "left")
        byte = F.conv(F.hex(F.substring(F.col(bits), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.floor(byte / F.pow(F.lit(2.0), place % 8)).cast("int") % 2
        answer = answer & F.coalesce(bit == 1, F.lit(False))
    out = df.withColumn(name, answer)
    return out.drop(*[f"__{kind}{i}" for kind in ("bucket", "bits") for i in range(len(probes))])


def only_members(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the first column of ``members``, and perhaps a few others.

    A Bloom filter of bounded size, so rows that are not asked for are left out before a shuffle.
    """
    return split_members(df, key, members)[1]


def split_members(df: DataFrame, key: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` is surely not in the first column of ``members``, and the others."""
    bits = filter_bits(members.count())
    numbers = members.select(F.explode(F.array(*slots(F.col(members.columns[0]), bits))).alias("slot"))
    known = passes(df, bitmaps(numbers, "slot"), slots(F.col(key), bits), "__member")
    return known.filter("NOT __member").drop("__member"), known.filter("__member").drop("__member")


def broadcast_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to be small, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
