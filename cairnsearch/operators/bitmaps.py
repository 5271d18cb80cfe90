"""A filter of keys held as bitmaps, to leave rows out before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter is broadcast; 32 MB at most.
MAX_BITS = 1 << 28
BITS_PER_KEY = 16
SEEDS = (11, 12, 13)


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) + 1 for seed in SEEDS]


def rows_with_keys(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """The ``rows`` whose ``key`` is among the ``n`` rows of ``keys(key)``, and a few in a thousand of the others.

    The filter is made of ``keys`` in one pass and applied where the rows are read. Its size is bounded: beyond 16 million
    keys it lets more of the other rows through, which costs time and changes nothing.
    """
    bits = min(MAX_BITS, 1 << max(15, (max(n, 1) * BITS_PER_KEY - 1).bit_length()))
    set_bits = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("bit"))
    bitmaps = set_bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")
    )
    found = rows
    for i, bit in enumerate(_places(F.col(key), bits)):
        place = F.bitmap_bit_position(bit)
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"__bucket{i}"), F.col("map").alias(f"__map{i}")))
        byte = F.conv(F.hex(F.substring(F.col(f"__map{i}"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found.join(side, F.bitmap_bucket_number(bit) == F.col(f"__bucket{i}")).filter(
            F.floor(byte / F.pow(F.lit(2.0), place % 8)).cast("int") % 2 == 1
        )
    return found.select(*rows.columns)
