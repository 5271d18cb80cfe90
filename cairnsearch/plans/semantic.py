"""Semantic search: nearest documents, kept if the query's words occur and they are similar enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnsearch.functions.scores import similarity_percent
from cairnsearch.functions.text import lexically_confirmed, snippet_plain
from cairnsearch.operators.cells import CellIndex, search_cells
from cairnsearch.operators.embed import Embedder, embed_asked
from cairnsearch.operators.fusion import with_documents
from cairnsearch.operators.nearest import nearest
from cairnsearch.operators.signatures import may_hold
from cairnsearch.operators.sizing import broadcast_if, localise
from cairnsearch.operators.vector_store import VectorStore
from cairnsearch.plans.requests import prepare_requests
from cairnsearch.session import stored

MIN_SIMILARITY_PERCENT = 55.0


def semantic_search(
    documents: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    min_similarity: float = MIN_SIMILARITY_PERCENT,
    cells: CellIndex | None = None,
    probes: int | None = None,
    make_embedder: Callable[[], Embedder] | None = None,
    signatures: DataFrame | None = None,
    reuse: VectorStore | None = None,
) -> DataFrame:
    """``(query_id, id, title, content_snippet, similarity_percent)``.

    ``cells`` are searched exactly, or with a number of ``probes`` in that many of them.

    Both filters follow the limit, so a query may get fewer rows than it asked for. With
    ``make_embedder`` the queries need no ``query_vec``: each distinct text is embedded once, or
    with ``reuse`` taken from a store of vectors. With ``signatures`` (``build_signatures``) the
    contents are fetched only of documents that may hold a query's words.
    """
    if make_embedder is not None:
        # a search mentions its queries in several places
        queries = stored(embed_asked(queries, make_embedder, reuse=reuse), "asked")
    requests, size = localise(prepare_requests(queries))
    limits = requests.agg(F.max("max_hits").alias("largest"), F.sum("max_hits").alias("all")).first()
    k = limits["largest"] or 1
    if cells is None:
        near = nearest(documents if vectors is None else vectors, requests, k)
    else:
        near = search_cells(cells, requests, k, probes)
    asked = requests.select("query_id", "max_hits")
    percent = similarity_percent(F.col("dist"))
    similar = (
        near.join(broadcast_if(size.within(), asked), "query_id")
        .filter((F.col("r") <= F.col("max_hits")) & (percent >= min_similarity))
        .select("query_id", "id", percent.alias("similarity_percent"))
    )
    if signatures is not None:
        signed = with_documents(similar, signatures.select("id", "signature"), limits["all"] or 0)
        signed = signed.join(broadcast_if(size.within(), requests.select("query_id", "query_text")), "query_id")
        similar = signed.filter(may_hold(F.col("query_text"), F.col("signature"))).select(*similar.columns)
    asked = broadcast_if(size.within(), requests.select("query_id", "query_text"))
    wanted = documents.select("id", "title", "content")
    if size.within():
        found = with_documents(similar, wanted, limits["all"] or 0).join(asked, "query_id")
    else:  # the texts asked for travel to the hits, not contents to the texts, a copy for each hit
        found = with_documents(similar.join(asked, "query_id"), wanted, limits["all"] or 0)
    return (
        found
        .filter(lexically_confirmed(F.col("query_text"), F.col("title"), F.col("content")))
        .select(
            "query_id",
            "id",
            "title",
            snippet_plain(F.col("content")).alias("content_snippet"),
            "similarity_percent",
        )
    )
