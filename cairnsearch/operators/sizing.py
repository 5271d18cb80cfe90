"""Broadcast, or hold on the driver, only what has been measured to be small."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 200_000
MAX_BYTES = 64 * 1024 * 1024
MAX_LOCAL_ROWS = 4096
PUSHED_RANGES = 64


def row_bytes(df: DataFrame) -> Column:
    """Rough width of a row: exact for text, eight bytes for every other value."""

    def width(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.aggregate(
                F.coalesce(column, F.array().cast("array<string>")),
                F.lit(0).cast("long"),
                lambda total, x: total + F.coalesce(F.octet_length(x), F.lit(0)) + 8,
            )
        if isinstance(kind, T.ArrayType):
            return F.greatest(F.size(column), F.lit(0)).cast("long") * 8
        return F.lit(8).cast("long")

    total = F.lit(16).cast("long")
    for field in df.schema.fields:
        total = total + width(F.col(field.name), field.dataType)
    return total


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def within(self, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
        return self.rows <= max_rows and self.bytes <= max_bytes


def measure(df: DataFrame) -> Size:
    """Rows and bytes of ``df``, by one aggregation job."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    return Size(found["n"], found["b"] or 0)


def localise(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> tuple[DataFrame, Size]:
    """``df`` with its size; if small, computed now and held as a local relation.

    A search mentions its queries in several places of one plan. Held locally they are worked
    out once, and what only depends on them needs no job at all.
    """
    size = measure(df)
    if not size.within(max_rows):
        return df, size
    return df.sparkSession.createDataFrame(df.toArrow()), size


def small_files(df: DataFrame, max_bytes: int, max_files: int = 64) -> bool:
    """Whether ``df`` is read from a few files of no more than ``max_bytes`` together; no job is run."""
    files = df.inputFiles()
    if not files or len(files) > max_files:
        return False
    spark = df.sparkSession
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for file in files:
        total += path(file).getFileSystem(conf).getFileStatus(path(file)).getLen()
        if total > max_bytes:
            return False
    return True


def near_values(column: Column, values: list[int], width: int = 1) -> Column:
    """A filter a scan can prune by: at most ``PUSHED_RANGES`` ranges that cover ``values``, or with a ``width`` above 1
    the stretches of that many values that they number."""
    values = sorted(set(values))
    gaps = sorted(range(1, len(values)), key=lambda i: values[i - 1] - values[i])[: PUSHED_RANGES - 1]
    starts = [0, *sorted(gaps)]
    ranges = [
        column.between(values[start] * width, (values[end - 1] + 1) * width - 1)
        for start, end in zip(starts, [*starts[1:], len(values)])
    ]
    return reduce(Column.__or__, ranges)


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """With ``small`` unproven the join is left to the optimiser, which shuffles both sides; for keys that may hold much
    of the rows see ``skew``."""
    return F.broadcast(df) if small else df
