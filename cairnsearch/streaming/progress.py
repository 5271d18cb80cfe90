"""Progress of an ingestion run, from its log: history and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnsearch.functions.text import status_label

# Fixed values.
HISTORY_SIZE = 120

IDLE, RUNNING, DONE, ERROR = "IDLE", "RUNNING", "DONE", "ERROR"


def run_history(run_log: DataFrame, keep: int = HISTORY_SIZE) -> DataFrame:
    """``(batch_id, at, rows_read, inserted)``, running totals of the last ``keep`` micro-batches.

    ``run_log(batch_id, at, rows_read, inserted)`` holds one row per batch. Older batches enter
    as one sum, so the window runs over ``keep + 1`` rows however long the log is.
    """
    columns = ["batch_id", "at", "rows_read", "inserted"]
    newest = run_log.select(*columns).orderBy(F.desc("batch_id")).limit(keep)
    older = (
        run_log.join(F.broadcast(newest.select("batch_id")), "batch_id", "left_anti")
        .agg(F.sum("rows_read").alias("rows_read"), F.sum("inserted").alias("inserted"))
        .select(
            F.lit(-1).cast("long").alias("batch_id"),
            F.lit(None).cast("timestamp").alias("at"),
            F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
            F.coalesce("inserted", F.lit(0)).alias("inserted"),
        )
    )
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = newest.unionByName(older).select(
        "batch_id",
        "at",
        F.sum("rows_read").over(so_far).alias("rows_read"),
        F.sum("inserted").over(so_far).alias("inserted"),
    )
    return totals.filter(F.col("batch_id") >= 0)


def run_status(run_log: DataFrame, started: bool, active: bool, error: str | None) -> DataFrame:
    """One row: ``status, label, rows_read, inserted, finished_at, error_message``.

    A failed run keeps its counts and has no finish time.
    """
    if not started:
        status = IDLE
    elif error is not None:
        status = ERROR
    else:
        status = RUNNING if active else DONE
    finished = F.max("at") if status == DONE else F.lit(None).cast("timestamp")
    return run_log.agg(
        F.lit(status).alias("status"),
        status_label(F.lit(status)).alias("label"),
        F.coalesce(F.sum("rows_read"), F.lit(0).cast("long")).alias("rows_read"),
        F.coalesce(F.sum("inserted"), F.lit(0).cast("long")).alias("inserted"),
        finished.alias("finished_at"),
        F.lit(error).alias("error_message"),
    )


def snapshot_time(millis: Column) -> Column:
    return F.timestamp_millis(millis)
