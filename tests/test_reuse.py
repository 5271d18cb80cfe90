"""Vectors reused between runs, hits fetched at any number, contents read only where words may be, choice of words."""

import sys
import uuid

import numpy as np
import pytest
from cairnsearch.functions.text import lexically_confirmed, space_tokens
from cairnsearch.operators import fusion, signatures, vector_store
from cairnsearch.operators.bitmaps import rows_with_keys
from cairnsearch.operators.embed import embed_asked
from cairnsearch.operators.fulltext import scan_hits, search_text
from cairnsearch.operators.postings import build_bounds, build_postings
from cairnsearch.plans import semantic
from cairnsearch.session import shared_folder
from cairnsearch.sources.corpus_table import read_corpus
from cairnsearch.streaming import ingest
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lengths():
    return lambda texts: [np.array([len(t), t.count("a")], np.float32) for t in texts]


def store_of(spark, model="m"):
    return vector_store.VectorStore(shared_folder(spark, "vectors"), model)


def test_only_new_texts_are_embedded(spark):
    store = store_of(spark)
    rows = [(i, f"text {i % 5}" if i % 3 else None) for i in range(40)] + [(100 + i, "hot") for i in range(400)]
    queries = spark.createDataFrame(rows, "id long, text string")
    first, n_first = vector_store.embed_reusing(queries, "text", store, lengths, 2)
    again, n_again = vector_store.embed_reusing(queries, "text", store, lengths, 2)
    more, n_more = vector_store.embed_reusing(queries.union(spark.createDataFrame([(900, "new")], queries.schema)), "text", store, lengths, 2)
    assert (n_first, n_again, n_more) == (6, 0, 1)
    want = sorted((i, None if t is None else [float(len(t)), float(t.count("a"))]) for i, t in rows)
    for found in (first, again):
        assert sorted((r["id"], r["embedding"]) for r in found.collect()) == want
    assert more.count() == len(rows) + 1
    other = vector_store.VectorStore(store.root, "another model")
    assert vector_store.embed_reusing(queries, "text", other, lengths, 2)[1] == 6


def test_texts_stored_twice_give_one_row(spark):
    """Two writers that did not see each other have stored the same text."""
    store, queries = store_of(spark), spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, text string")
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    for _ in range(2):
        store.add(queries.select(digest, F.array(F.lit(7.0), F.lit(8.0)).cast("array<float>").alias("vector")).distinct())
    found, n_new = vector_store.embed_reusing(queries, "text", store, lengths, 2)
    assert n_new == 0 and sorted((r["id"], r["embedding"][0]) for r in found.collect()) == [(1, 7.0), (2, 7.0), (3, 7.0)]
    empty, n_new = vector_store.embed_reusing(queries.limit(0), "text", store, lengths, 2)
    assert (empty.count(), n_new) == (0, 0)


def test_ingestion_and_search_share_a_store(spark):
    store, path = store_of(spark), shared_folder(spark, "corpus")
    rows = spark.createDataFrame([(i, f"t{i}", f"body {i % 2}", "n", "c") for i in range(6)], "id long, title string, text string, namespace string, contributors string")
    counted = ingest.ingest_batch(rows, path, lengths, 2, reuse=store)
    assert tuple(counted.first()) == (6, 6)
    assert store.read(spark).count() == 2 and read_corpus(spark, path).filter("embedding IS NOT NULL").count() == 6
    asked = spark.createDataFrame([(1, "body 1"), (2, "unseen")], "query_id long, query_text string")
    vectors = {r["query_id"]: r["query_vec"] for r in embed_asked(asked, lengths, 2, reuse=store).collect()}
    assert vectors == {1: [6.0, 0.0], 2: [6.0, 0.0]} and store.read(spark).count() == 3


def test_documents_without_a_hit_are_not_shuffled(spark, monkeypatch):
    docs = spark.range(20_000).select("id", F.concat(F.lit("title "), "id").alias("title"))
    hits = spark.range(60).select((F.col("id") % 7).alias("query_id"), (F.col("id") * 97).alias("id"))
    plain = sorted(map(tuple, hits.join(docs, "id").collect()))
    monkeypatch.setattr(fusion, "PUSHED_HITS", 1)
    assert sorted(map(tuple, fusion.with_documents(hits, docs, 60).select("id", "query_id", "title").collect())) == plain
    monkeypatch.setattr(fusion, "MAX_ROWS", 10)
    read, kept = [], fusion.rows_with_keys

    def counting(rows, *args):
        found = kept(rows, *args)
        read.append(found.count())
        return found

    monkeypatch.setattr(fusion, "rows_with_keys", counting)
    many = fusion.with_documents(hits, docs, 10**9)
    assert sorted(map(tuple, many.select("id", "query_id", "title").collect())) == plain
    assert 60 <= read[0] <= 60 + 20_000 // 50


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_id_filter_loses_nothing(spark, n):
    keys = spark.range(n).select((F.col("id") * 31 - 7).alias("id"))
    rows = spark.range(-100, 200_000)
    found = rows_with_keys(rows, "id", keys, n)
    assert found.join(keys, "id").count() == rows.join(keys, "id").count()
    assert found.count() <= n + 200_100 // 50


def test_signatures_rule_out_no_confirmed_document(spark):
    words = ["tree", "Baum", "日本語", "été", "x", "of", "longer words here", "ab"]
    rng = np.random.default_rng(5)
    docs = [(i, None if i % 9 == 0 else " ".join(rng.choice(words, 3)), " ".join(rng.choice(words, 12))) for i in range(60)]
    documents = spark.createDataFrame(docs, "id long, title string, content string")
    asked = [*words, "TREE baum", " été ", "nonsense phrase without matching anything", "q" * 60, "tree " * 8, "zebra topaz quartz rhubarb knife wool"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string")
    pairs = documents.join(signatures.build_signatures(documents), "id").join(F.broadcast(queries), F.lit(True))
    judged = pairs.select(
        lexically_confirmed(F.col("query_text"), F.coalesce("title", F.lit("")), F.col("content")).alias("held"),
        signatures.may_hold(F.col("query_text"), F.col("signature")).alias("may"),
    ).groupBy("held", "may").count().collect()
    counts = {(r["held"], r["may"]): r["count"] for r in judged}
    assert (True, False) not in counts
    # queries of one or two letters rule out nothing
    assert counts[False, False] > 0.7 * (counts[False, False] + counts.get((False, True), 0))


def test_contents_are_read_after_the_signatures(spark, monkeypatch):
    docs = [(i, f"t{i}", "the right words" if i % 10 == 0 else "something else") for i in range(50)]
    documents = spark.createDataFrame([(*d, [1.0, i / 100]) for i, d in enumerate(docs)], "id long, title string, content string, embedding array<float>")
    queries = spark.createDataFrame([(1, "right words", [1.0, 0.0], 50)], "query_id long, query_text string, query_vec array<double>, max_hits int")
    plain = sorted(map(tuple, semantic.semantic_search(documents, queries).collect()))
    asked, kept = [], semantic.with_documents

    def counting(hits, fetched, most):
        asked.append((sorted(fetched.columns), hits.count()))
        return kept(hits, fetched, most)

    monkeypatch.setattr(semantic, "with_documents", counting)
    signed = semantic.semantic_search(documents, queries, signatures=signatures.build_signatures(documents))
    assert sorted(map(tuple, signed.collect())) == plain and len(plain) == 5
    assert asked == [(["id", "signature"], 50), (["content", "id", "title"], 5)]


def test_words_as_spaces_part_them(spark):
    documents = spark.createDataFrame([(1, "C++ now", "c++ and C#"), (2, "c", "c c++, c# c"), (3, "", "c")], "id long, title string, content string")
    queries = spark.createDataFrame([(1, "C++"), (2, "c# C++")], "query_id long, query_text string")
    found = {(r["query_id"], r["id"]) for r in scan_hits(documents, queries, words=space_tokens).collect()}
    assert found == {(1, 1), (2, 1)}
    postings = build_postings(documents, space_tokens)
    for bounds in (None, build_bounds(postings)):
        ranked = search_text(queries, 5, postings=postings, bounds=bounds, words=space_tokens).collect()
        assert {(r["query_id"], r["id"]) for r in ranked} == found


def test_a_model_s_worker_holds_few_texts_at_a_time(spark):
    """Texts become Python objects as the model is given them, not a whole Arrow batch at once."""
    from cairnsearch.operators.embed import embed

    def counting():
        import gc

        def held(texts):
            return [[float(sum(isinstance(s, list) and len(s) > 100 and isinstance(s[0], str) and s[0].startswith("text ") for s in gc.get_objects()))] for _ in texts]

        return held

    rows = spark.range(400).repartition(1).selectExpr("id", "concat('text ', id) AS text")
    found = embed(rows, "text", counting, dim=1, batch_size=8).select("embedding").collect()
    assert len(found) == 400 and max(r["embedding"][0] for r in found) == 0


def test_texts_asked_for_are_embedded_once(spark, tmp_path):
    """However many times a search mentions its queries, and however many there are of them."""

    def counting():
        def embed_and_note(texts):
            (tmp_path / uuid.uuid4().hex).write_text("\n".join(texts))
            return [np.array([len(t), t.count("a") + 1], np.float32) for t in texts]

        return embed_and_note

    documents = spark.createDataFrame([(i, f"t{i}", "a" * i, [float(i), 1.0]) for i in range(9)], "id long, title string, content string, embedding array<float>")
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(4200)], "query_id long, query_text string")
    semantic.semantic_search(documents, queries, make_embedder=counting).count()
    noted = sorted(text for note in tmp_path.iterdir() for text in note.read_text().split("\n"))
    assert noted == sorted(f"q{i}" for i in range(4200))
