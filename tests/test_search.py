"""Hybrid and semantic search over a small hand-made corpus."""

import pytest
from cairnsearch.operators.cells import build_cells
from cairnsearch.operators.embed import embed_asked
from cairnsearch.operators.postings import build_postings
from cairnsearch.plans.hybrid import hybrid_search
from cairnsearch.plans.requests import prepare_requests
from cairnsearch.plans.semantic import semantic_search
from pyspark.sql import functions as F

DOCS = [
    (1, "Tree", "a tall tree", [1.0, 0.0]),
    (2, "House", "tree and house", [0.8, 0.6]),
    (3, "Sea", "water", [0.0, 1.0]),
    (4, "Long", "tree " * 120, None),
    (5, "Far", "nothing", [-1.0, 0.0]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        DOCS, "id long, title string, content string, embedding array<float>"
    ).cache()


def ask(spark, rows, extra=""):
    return spark.createDataFrame(
        rows, "query_id long, query_text string, query_vec array<double>" + extra
    )


def results(df):
    rows = df.orderBy("query_id", df.total_score.desc(), "id").collect()
    return [(r["query_id"], r["id"], round(r["total_score"], 6)) for r in rows]


def test_requests_are_clamped_and_classified(spark):
    queries = ask(
        spark,
        [
            (1, " tree　", [1.0], 0, -1.0, "IVF", True),
            (2, "tree", [1.0], 500, 2.0, " ", None),
            (3, "tree", [1.0], None, None, "NONE", True),
            (4, "tree", None, 5, 0.3, "HNSW", True),
            (5, "tree", [1.0], 5, 0.3, None, False),
            (6, "　\t", [1.0], 5, 0.3, None, True),
            (7, "tree", [], 5, 0.3, None, True),
            (8, "tree", None, 5, 0.3, "NONE", False),
        ],
        ", max_hits int, keyword_weight double, vector_mode string, enable_text boolean",
    )
    found = {r["query_id"]: r for r in prepare_requests(queries).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    assert [found[i]["kind"] for i in (1, 2, 3, 4, 5)] == ["unified", "unified", "text", "text", "vector"]
    assert [found[i]["max_hits"] for i in (1, 2, 3)] == [1, 100, 20]
    assert [found[i]["keyword_weight"] for i in (1, 2, 3)] == [0.0, 1.0, 0.5]
    assert found[2]["semantic_weight"] == 0.0 and found[1]["query_text"] == "tree"


@pytest.mark.parametrize("stored", [False, True])
def test_unified_adds_cosine_and_reciprocal_rank(spark, docs, stored):
    options = {"postings": build_postings(docs)} if stored else {}
    found = hybrid_search(docs, ask(spark, [(1, "house tree", [1.0, 0.0])]), **options)
    # document 2 is the only text hit; cosines are 1, .8, 0, -1
    assert results(found) == [
        (1, 2, round(0.5 * 0.9 + 0.5, 6)),
        (1, 1, 0.5),
        (1, 3, 0.25),
        (1, 5, 0.0),
    ]
    assert found.filter("id = 2").first()["similarity_percent"] == pytest.approx(95.0)


def test_modes_in_one_job(spark, docs):
    queries = ask(
        spark,
        [
            (1, "tree", [1.0, 0.0], "NONE", True, 0.5),
            (2, "tree", [1.0, 0.0], "IVF", False, 0.25),
            (3, "tree", [1.0, 0.0], "IVF", False, 1.0),
            (4, "absent", [1.0, 0.0], "NONE", True, 0.5),
        ],
        ", vector_mode string, enable_text boolean, keyword_weight double",
    )
    found = hybrid_search(docs, queries)
    by_query = {}
    for query_id, doc_id, score in results(found):
        by_query.setdefault(query_id, []).append((doc_id, score))
    assert by_query[2] == [(1, 0.75), (2, 0.675), (3, 0.375), (5, 0.0)]
    assert by_query[3] == [(1, 0.0), (2, 0.0), (3, 0.0), (5, 0.0)]
    assert 4 not in by_query
    # the rank value goes into the reciprocal: the best text hit (4) comes last
    assert [doc_id for doc_id, _ in by_query[1]][-1] == 4
    percents = {r["similarity_percent"] for r in found.filter("query_id = 1").collect()}
    assert percents == {50.0}


def test_text_score_by_position(spark, docs):
    queries = ask(spark, [(1, "tree", [1.0, 0.0], "NONE")], ", vector_mode string")
    found = results(hybrid_search(docs, queries, text_score="position"))
    assert found[0] == (1, 4, 0.5)
    with pytest.raises(ValueError):
        hybrid_search(docs, queries, text_score="other")


def test_snippet_and_limit(spark, docs):
    queries = ask(spark, [(1, "tree", [1.0, 0.0], 1)], ", max_hits int")
    assert hybrid_search(docs, queries).count() == 1
    long = hybrid_search(docs, ask(spark, [(1, "tree", None)])).filter("id = 4").first()
    assert len(long["content_snippet"]) == 503


def test_hybrid_through_cells_equals_exact(spark, docs):
    queries = ask(spark, [(1, "tree", [1.0, 0.1])])
    cells = build_cells(docs, lists=2)
    pruned = hybrid_search(docs, queries, cells=cells, probes=2)
    assert results(pruned) == results(hybrid_search(docs, queries))


def test_semantic_search_filters_after_the_limit(spark, docs):
    queries = ask(
        spark,
        [
            (1, "tree", [1.0, 0.0], 3),
            (2, "x" * 51, [1.0, 0.0], 3),
            (3, "  ", [1.0, 0.0], 3),
            (4, "tree", None, 3),
            (5, "tree", [0.0, 1.0], 1),
        ],
        ", max_hits int",
    )
    found = semantic_search(docs, queries)
    rows = sorted((r["query_id"], r["id"], round(r["similarity_percent"], 3)) for r in found.collect())
    assert rows == [(1, 1, 100.0), (1, 2, 90.0), (2, 1, 100.0), (2, 2, 90.0)]
    everything = semantic_search(docs, queries, min_similarity=50.0).filter("query_id = 2")
    assert everything.count() == 3


def test_searches_embed_their_own_texts(spark, docs):
    def constant():
        return lambda texts: [[1.0, 0.0] for _ in texts]

    rows = [(1, "tree", "IVF"), (2, "tree", "NONE"), (3, "  ", "IVF"), (4, None, "IVF"), (5, "tree", None)]
    queries = spark.createDataFrame(rows, "query_id int, query_text string, vector_mode string")
    embedded = {r.query_id: r.query_vec for r in embed_asked(queries, constant).collect()}
    assert embedded == {1: [1.0, 0.0], 2: None, 5: [1.0, 0.0]}
    vector = F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
    given = queries.withColumn("query_vec", F.when(F.coalesce("vector_mode", F.lit("IVF")) != "NONE", vector))
    for search in (hybrid_search, semantic_search):
        own = sorted(map(str, search(docs, queries, make_embedder=constant).collect()))
        assert own == sorted(map(str, search(docs, given).collect()))


def test_contents_are_not_shuffled_to_the_texts_asked_for(spark, docs, monkeypatch):
    """With more queries than can be broadcast, their texts join the hits before contents are fetched."""
    from cairnsearch.operators import sizing
    from cairnsearch.plans import semantic

    asked = spark.createDataFrame([(i, "tall tree", [1.0, 0.1 * i]) for i in range(3)], "query_id long, query_text string, query_vec array<float>")
    plain = sorted(map(tuple, semantic.semantic_search(docs, asked).collect()))
    fetched, kept = [], semantic.with_documents

    def watching(hits, *args):
        fetched.append(hits.columns)
        return kept(hits, *args)

    monkeypatch.setattr(semantic, "with_documents", watching)
    monkeypatch.setattr(sizing.Size, "within", lambda self, *args: False)
    assert sorted(map(tuple, semantic.semantic_search(docs, asked).collect())) == plain
    assert "query_text" in fetched[-1]
