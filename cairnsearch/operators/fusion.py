"""Putting a vector result list and a text result list together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnsearch.operators.bitmaps import rows_with_keys
from cairnsearch.operators.sizing import MAX_ROWS, broadcast_if, measure, near_values
from cairnsearch.session import stored

PUSHED_HITS = 2_000


def merge_outer(vector_scores: DataFrame, text_scores: DataFrame) -> DataFrame:
    """Full-outer merge by (query_id, id): scores add up, a text-only hit gets distance 1.0.

    ``vector_scores(query_id, id, score, dist)``, ``text_scores(query_id, id, score)``. A union
    with one aggregation gives the outer join's rows with one exchange in place of two, and
    pre-aggregates before it.
    """
    scored = vector_scores.select("query_id", "id", "score", "dist").unionByName(
        text_scores.select("query_id", "id", "score", F.lit(None).cast("double").alias("dist"))
    )
    return merge_scored(scored)


def merge_scored(scored: DataFrame, *carried: str) -> DataFrame:
    """One row per hit from ``scored(query_id, id, score, dist, carried...)``.

    ``carried`` columns depend on ``query_id`` alone and are kept.
    """
    return scored.groupBy("query_id", "id").agg(
        F.sum("score").alias("total_score"),
        F.coalesce(F.max("dist"), F.lit(1.0)).alias("dist"),
        *[F.first(name).alias(name) for name in carried],
    )


def with_documents(hits: DataFrame, documents: DataFrame, most_hits: int) -> DataFrame:
    """Fetch the columns of ``documents(id, ...)`` for ranked hits, after the final cut.

    ``most_hits`` bounds their number (the sum of the queries' limits). The hits are worked out
    once. A short list is held, and the documents are then read by id range, so that a corpus
    stored in id order is not read as a whole for a page of results. A longer list is written
    down and broadcast. One too long for that, of any length, is made into a filter of ids that
    the documents pass as they are read, so that those without a hit are not shuffled.
    """
    found = documents
    if most_hits > PUSHED_HITS:
        held = stored(hits, "hits")
        size = measure(held)
        if size.rows > MAX_ROWS:
            found = rows_with_keys(found, "id", held.select("id"), size.rows)
        return found.join(broadcast_if(size.within(), held), "id")
    ranked = hits.toArrow()  # PUSHED_HITS rows of ids and scores at most
    local = documents.sparkSession.createDataFrame(ranked)
    if not ranked.num_rows:
        return local.join(found.limit(0), "id")
    ids = ranked.column("id").to_pylist()
    return found.filter(near_values(F.col("id"), ids)).join(F.broadcast(local), "id")
