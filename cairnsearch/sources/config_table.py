"""The key/value configuration table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seed_if_absent(config: DataFrame, seeds: DataFrame) -> DataFrame:
    """``config`` plus those ``seeds`` whose key it lacks; stored values are never replaced."""
    absent = seeds.dropDuplicates(["key"]).join(config.select("key"), "key", "left_anti")
    return config.select("key", "value").unionByName(absent.select("key", "value"))


def lookup(config: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, value)`` for every row of ``keys``; the value of a missing key is null."""
    return keys.select("key").join(config.select("key", "value"), "key", "left")


def lookup_prefix(config: DataFrame, prefix: str) -> DataFrame:
    """Entries whose key starts with ``prefix``, in which ``%`` and ``_`` act as wildcards."""
    return config.filter(F.col("key").like(f"{prefix}%")).select("key", "value")
