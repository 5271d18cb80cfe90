"""The corpus pipeline on odd and empty tables and on columns named like its results."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over lazy dogs while other animals watch them with great interest today and tomorrow".split()


def through(spark, docs):
    """The tables after each stage."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(WORDS, 60)), "en", f"s{i % 2}", 0) for i in range(60)]
    rows += [(100, rows[5][1], "en", "s0", 0), (101, rows[6][1] + " the dogs", None, "s1", 0)]
    rows += [(102, None, "en", "s0", 0), (103, "", None, None, 0), (None, " ".join(rng.choice(WORDS, 60)), "en", None, None), (104, "12 34", "en", "s0", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_stages_decide(spark, docs):
    known, distinct, apart, mixed, packed = through(spark, docs)
    assert {102, 103, 104} & {r["doc_id"] for r in known.collect()} == set()
    assert known.filter("lang IS NULL").count() == 0 and known.count() >= docs.count() - 3 - 2  # a hundredth of clean ones may go
    ids = {r["doc_id"] for r in distinct.collect()}
    assert 100 in ids and 5 not in ids
    ids = {r["doc_id"] for r in apart.collect()}
    assert 6 in ids and 101 not in ids and None in ids and len(ids) == distinct.count() - 1
    assert all(t.columns == docs.columns for t in (known, distinct, apart, mixed))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_dedup_stages_equal_plain_versions(spark):
    """On a given table: equal texts by a dictionary, similarity of all pairs by sets, components by merging."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = docs.filter("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 1000)
    near = docs.filter("doc_id between 30 and 60").withColumn("doc_id", F.col("doc_id") + 2000)
    near = near.withColumn("text", F.concat("text", F.lit(" one more")))
    docs = docs.unionByName(copies).unionByName(near)
    distinct = corpus_pipeline.drop_exact_copies(spark, docs, "")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    largest = {}
    for i, text in texts.items():
        largest[text] = max(i, largest.get(text, i))
    assert {r["doc_id"] for r in distinct.collect()} == set(largest.values())
    apart = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(distinct.collect(), distinct.schema), "")
    sets = {}
    for i in largest.values():
        words = re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]).encode().split()
        n = min(5, len(words))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if n else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert {r["doc_id"] for r in apart.collect()} == {i for i in ids if root(i) == i}


def test_columns_named_like_results_are_kept(spark, docs):
    extra = {"score": F.lit(7), "lang_pred": F.lit("x"), "rejected": F.lit(True), "kept": F.lit(False), "keep_id": F.lit("k"), "component_id": F.lit(1)}
    named = docs.withColumns(extra)
    plain, clashing = through(spark, docs), through(spark, named)
    for a, b in zip(plain[:4], clashing[:4]):
        assert b.columns == named.columns
        assert b.count() == a.count() == b.filter("score = 7 AND lang_pred = 'x' AND rejected AND NOT kept AND keep_id = 'k'").count()
    assert plain[4].count() == clashing[4].count()


def test_empty_table(spark, docs):
    assert [t.count() for t in through(spark, docs.limit(0))] == [0] * 5
