"""Document ids for any number of writers: blocks of ids, claimed by creating files."""

from __future__ import annotations

import hashlib
import threading

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
_PART_BITS = 33
# A local file system looks for a file and then creates it; writers of one process take turns.
_turn = threading.Lock()


def claim_blocks(spark: SparkSession, folder: str, owner: str, n: int) -> list[int]:
    """``n`` block numbers that no other ``owner`` has; asked again, an owner gets those it had, and more if need be.

    A block is a file named by its number, created only if it is absent, which the file system
    decides for all writers. What an owner has is then written down under its name; blocks of a
    writer that died before that stay unused.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    blocks = path(f"{folder}/blocks")
    mine = path(f"{folder}/owners/{hashlib.sha256(owner.encode()).hexdigest()}")
    system = blocks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with _turn:
        system.mkdirs(blocks)
        own = _numbers(jvm, system, mine)
        if len(own) < n:
            taken = [int(status.getPath().getName()) for status in system.listStatus(blocks)]
            block = max(taken, default=-1) + 1
            while len(own) < n:
                if _created(system, path(f"{folder}/blocks/{block:012d}")):
                    own.append(block)
                block += 1
            stream = system.create(mine, True)
            stream.write(bytearray(",".join(map(str, own)).encode()))
            stream.close()
    return own[:n]


def _created(system, path) -> bool:
    try:
        system.create(path, False).close()
    except Py4JJavaError:
        if system.exists(path):
            return False
        raise
    return True


def _numbers(jvm, system, path) -> list[int]:
    if not system.exists(path):
        return []
    stream = system.open(path)
    try:
        text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    return [int(number) for number in text.split(",") if number]


def with_claimed_ids(rows: DataFrame, folder: str, owner: str) -> DataFrame:
    """``rows`` with a unique long ``id``, in blocks of ``BLOCK`` claimed in ``folder`` under the name ``owner``.

    Rows are numbered without gaps after counting those of each partition, so ``rows`` must
    arrive in the same partitions each time it is read, as files do; a partition that grew
    meanwhile fails the job. A writer that starts again under its old name reuses its ids.
    """
    spark = rows.sparkSession
    part = F.spark_partition_id()
    counts = rows.groupBy(part.alias("part")).count().collect()  # a row per partition
    starts, total = [], 0
    for row in sorted(counts, key=lambda row: row["part"]):
        starts.append((row["part"], total, row["count"]))
        total += row["count"]
    blocks = claim_blocks(spark, folder, owner, -(-total // BLOCK))
    start = spark.createDataFrame(starts, "__part int, __start long, __rows long")
    placed = rows.withColumns(
        {"__part": part, "__place": F.monotonically_increasing_id().bitwiseAND((1 << _PART_BITS) - 1)}
    ).join(F.broadcast(start), "__part", "left")
    fits = F.assert_true(F.col("__place") < F.col("__rows"), F.lit("a partition has more rows than were counted"))
    number = F.col("__start") + F.col("__place")
    block = F.array(*[F.lit(b).cast("long") for b in blocks])[F.floor(number / BLOCK).cast("int")]
    identity = F.when(fits.isNull(), block * BLOCK + F.pmod(number, F.lit(BLOCK)))
    return placed.select(identity.alias("id"), *[F.col(c) for c in rows.columns if c != "id"])
