"""Hybrid search: vector candidates and text candidates, scored, fused, cut, then fetched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnsearch.functions import scores
from cairnsearch.functions.text import snippet_hybrid, word_tokens
from cairnsearch.operators.cells import CellIndex, search_cells
from cairnsearch.operators.embed import Embedder, embed_asked
from cairnsearch.operators.fulltext import search_text
from cairnsearch.operators.fusion import merge_scored, with_documents
from cairnsearch.operators.nearest import nearest
from cairnsearch.operators.sizing import Size, broadcast_if, localise
from cairnsearch.operators.vector_store import VectorStore
from cairnsearch.plans.requests import (
    SINGLE_CANDIDATES,
    TEXT_ONLY,
    UNIFIED,
    UNIFIED_CANDIDATES,
    VECTOR_ONLY,
    prepare_requests,
)


def hybrid_search(
    documents: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    postings: DataFrame | None = None,
    cells: CellIndex | None = None,
    probes: int | None = None,
    text_score: str = "rank_value",
    rrf_k: int = scores.RRF_K,
    make_embedder: Callable[[], Embedder] | None = None,
    unified_candidates: int = UNIFIED_CANDIDATES,
    single_candidates: int = SINGLE_CANDIDATES,
    bounds: DataFrame | None = None,
    reuse: VectorStore | None = None,
    words: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """``(query_id, id, title, content_snippet, similarity_percent, total_score)`` for all queries.

    Each row of ``queries`` picks its own mode, weight and limit (``prepare_requests``). Text
    is read from ``postings`` if given (with ``bounds``, only where the best may be), else scanned. Vectors are searched through ``cells`` if
    given, exactly or with a number of ``probes`` in that many of them, else in
    ``vectors(id, embedding)`` if these are kept apart from ``documents``.

    A query with both sides fuses them: cosine score plus scaled reciprocal rank. ``text_score``
    sets how text-only search scores: ``rank_value`` puts the rank's value into the reciprocal
    (a better rank then scores lower), ``position`` uses its place.

    With ``make_embedder`` the queries need no ``query_vec``: each distinct text is embedded once, or
    with ``reuse`` taken from a store of vectors. ``words`` takes texts and queries apart; an index
    must have been built with the same function.
    """
    if make_embedder is not None:
        queries = embed_asked(queries, make_embedder, reuse=reuse)
    requests, size = localise(prepare_requests(queries, unified_candidates, single_candidates))
    asked = requests.agg(F.max("candidates").alias("most"), F.sum("max_hits").alias("hits")).first()
    hits = hybrid_scores(
        requests, size, asked["most"] or 1, documents, vectors, postings, cells, probes, text_score, rrf_k, bounds, words
    )
    most_hits = asked["hits"] or 0
    # cut before the join, so that whole contents are never shuffled
    shown = documents.select("id", "title", snippet_hybrid(F.col("content")).alias("content_snippet"))
    return with_documents(hits, shown, most_hits).select(
        "query_id", "id", "title", "content_snippet", "similarity_percent", "total_score"
    )


def hybrid_scores(
    requests: DataFrame,
    size: Size,
    candidates: int,
    documents: DataFrame,
    vectors: DataFrame | None = None,
    postings: DataFrame | None = None,
    cells: CellIndex | None = None,
    probes: int | None = None,
    text_score: str = "rank_value",
    rrf_k: int = scores.RRF_K,
    bounds: DataFrame | None = None,
    words: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """``(query_id, id, total_score, similarity_percent)``, at most ``max_hits`` rows per query.

    ``candidates`` is the largest number of candidates that a request asks for.
    """
    if text_score not in ("rank_value", "position"):
        raise ValueError(f"unknown text score: {text_score}")
    with_vector = requests.filter(F.col("kind") != TEXT_ONLY)
    if cells is None:
        near = nearest(documents if vectors is None else vectors, with_vector, candidates)
    else:
        near = search_cells(cells, with_vector, candidates, probes)
    with_text = requests.filter(F.col("kind") != VECTOR_ONLY)
    found = search_text(with_text, candidates, documents, postings, size, bounds, words)
    both = near.selectExpr(
        "query_id", "id", "r", "dist", "cast(NULL AS double) AS rank"
    ).unionByName(found.selectExpr("query_id", "id", "r", "cast(NULL AS double) AS dist", "rank"))

    unified = F.col("kind") == UNIFIED
    dist, semantic, keyword = F.col("dist"), F.col("semantic_weight"), F.col("keyword_weight")
    by_place = scores.reciprocal_rank_score(F.col("r"), keyword, rrf_k)
    score = (
        F.when(F.col("rank").isNull() & unified, scores.semantic_score(dist, semantic))
        .when(F.col("rank").isNull(), semantic * scores.cosine_score(dist))
        .when(unified | F.lit(text_score == "position"), by_place)
        .otherwise(scores.rank_value_score(F.col("rank"), keyword))
    )
    settings = requests.select(
        "query_id", "kind", "candidates", "max_hits", "keyword_weight", "semantic_weight"
    )
    scored = (
        both.join(broadcast_if(size.within(), settings), "query_id")
        .filter(F.col("r") <= F.col("candidates"))
        .withColumn("score", score)
    )
    fused = merge_scored(scored, "kind", "max_hits")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total_score"), "id"))
    return (
        fused.withColumn("place", place)
        .filter(F.col("place") <= F.col("max_hits"))
        .select(
            "query_id",
            "id",
            "total_score",
            F.when(unified, scores.score_percent(F.col("total_score")))
            .otherwise(scores.similarity_percent(dist))
            .alias("similarity_percent"),
        )
    )
