"""Ranks against a plain Python reading of the formulas, hits against a plain scan."""

import math
import random
import re

import numpy as np
import pytest
from cairnsearch.operators import postings as index
from cairnsearch.operators.fulltext import indexed_hits, query_terms, ranked, scan_hits, search_text
from cairnsearch.session import shared_folder
from pyspark.sql import functions as F

WEIGHT = {"title": 1.0, "content": 0.1}


def words(text):
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def placed(title, content, weighted):
    if not weighted:
        return [(i + 1, w, 0.1) for i, w in enumerate(words(title + " " + content))]
    first, rest = words(title), words(content)
    return [(i + 1, w, 1.0) for i, w in enumerate(first)] + [
        (i + 1 + len(first), w, 0.1) for i, w in enumerate(rest)
    ]


def frequency(hits, terms):
    if len(terms) == 1:
        weights = [w for _, _, w in hits]
        top = max(weights)
        at = weights.index(top) + 1
        decayed = sum(w / (j + 1) ** 2 for j, w in enumerate(weights))
        return (top + decayed - top / at**2) / 1.64493406685
    miss = 0.0
    for i, (p, t, w) in enumerate(hits):
        for q, u, v in hits[i + 1 :]:
            if t != u and p != q:
                d = abs(p - q)
                factor = 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30
                miss += math.log1p(-math.sqrt(w * v * factor))
    return -math.expm1(miss)


def cover_density(hits, terms, length):
    total, begin = 0.0, 0
    while True:
        seen, end = set(), None
        for e in range(begin, len(hits)):
            seen.add(hits[e][1])
            if len(seen) == len(terms):
                end = e
                break
        if end is None:
            return total / math.log(length + 1)
        seen = set()
        for s in range(end, begin - 1, -1):
            seen.add(hits[s][1])
            if len(seen) == len(terms):
                break
        n = end - s + 1
        noise = hits[end][0] - hits[s][0] - (n - 1)
        noise = (n - 1) // 2 if noise < 0 else noise
        total += n / sum(1 / w for _, _, w in hits[s : end + 1]) / (1 + noise)
        begin = s + 1


def expected(docs, queries, weighted):
    found = {}
    for query_id, query in queries:
        terms = set(words(query))
        for doc_id, title, content in docs:
            text = placed(title, content, weighted)
            hits = [h for h in text if h[1] in terms]
            if terms and {h[1] for h in hits} == terms:
                rank = cover_density(hits, terms, len(text)) if weighted else frequency(hits, terms)
                found[query_id, doc_id] = float(np.float32(rank))
    return found


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    vocabulary = ["the", "of", "tree", "river", "바다", "é", "rare"] + [f"w{i}" for i in range(40)]
    weights = [30, 20, 6, 4, 3, 2, 1] + [3] * 40
    docs = []
    for doc_id in range(60):
        content = " ".join(rng.choices(vocabulary, weights, k=rng.choice([5, 40, 400])))
        title = " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 4)))
        docs.append((doc_id, title.title(), content.replace(" of ", ", OF - ")))
    docs.append((60, "", "tree " + "x " * 150 + "river"))
    docs.append((61, "", "tree tree " + "x " * 150 + "river"))
    queries = [(1, "the of"), (2, "Tree"), (3, "river, TREE tree"), (4, "바다 the of"), (5, "rare é"),
               (6, "the"), (7, "nowhere the"), (8, " - "), (9, "tree river of the")]
    return docs, queries


@pytest.fixture(scope="module")
def tables(spark, data):
    docs, queries = data
    return (
        spark.createDataFrame(docs, "id long, title string, content string").repartition(3).cache(),
        spark.createDataFrame(queries, "query_id long, query_text string"),
    )


def ranks(df):
    return {(r["query_id"], r["id"]): r["rank"] for r in df.collect()}


def test_frequency_rank(data, tables):
    found = ranks(ranked(scan_hits(*tables), "frequency"))
    assert found == pytest.approx(expected(*data, weighted=False), rel=1e-6, abs=1e-30)
    assert 0 < found[3, 60] < found[3, 61] < 1e-14  # far pairs only


def test_cover_density_rank_scanned_and_indexed(spark, data, tables):
    want = pytest.approx(expected(*data, weighted=True), rel=1e-6)
    assert ranks(ranked(scan_hits(*tables, weighted=True), "cover_density")) == want
    stored = index.write_postings(index.build_postings(tables[0]), shared_folder(spark, "postings"))
    assert ranks(ranked(indexed_hits(stored, tables[1]), "cover_density")) == want


@pytest.mark.parametrize("few", [0, 16])
def test_pivot_choice_does_not_change_results(data, tables, monkeypatch, few):
    from cairnsearch.operators import fulltext

    monkeypatch.setattr(fulltext, "FEW_QUERIES", few)
    monkeypatch.setattr(fulltext, "PUSHED_LEXEMES", few)
    built = index.build_postings(tables[0])
    assert ranks(ranked(indexed_hits(built, tables[1]), "cover_density")) == pytest.approx(
        expected(*data, weighted=True), rel=1e-6
    )
    assert ranks(ranked(scan_hits(*tables), "frequency")) == pytest.approx(
        expected(*data, weighted=False), rel=1e-6, abs=1e-30
    )


def test_unmeasured_queries_are_shuffled_not_broadcast(data, tables, monkeypatch):
    from cairnsearch.operators import fulltext

    monkeypatch.setattr(fulltext, "_is_small", lambda size: False)
    built = index.build_postings(tables[0])
    hits = indexed_hits(built, tables[1])
    assert ranks(ranked(hits, "cover_density")) == pytest.approx(expected(*data, weighted=True), rel=1e-6)
    assert ranks(ranked(scan_hits(*tables), "frequency")) == pytest.approx(
        expected(*data, weighted=False), rel=1e-6, abs=1e-30
    )


def test_more_candidates_than_can_be_held(data, tables, monkeypatch):
    from cairnsearch.operators import fulltext

    monkeypatch.setattr(fulltext, "FEW_QUERIES", 0)
    monkeypatch.setattr(fulltext, "MAX_CANDIDATES", 5)
    hits = indexed_hits(index.build_postings(tables[0]), tables[1])
    assert ranks(ranked(hits, "cover_density")) == pytest.approx(expected(*data, weighted=True), rel=1e-6)


def test_top_k_breaks_ties_by_id(spark):
    docs = spark.createDataFrame([(i, "", "same words here") for i in range(9, -1, -1)], "id long, title string, content string")
    queries = spark.createDataFrame([(1, "words"), (2, "same here")], "query_id long, query_text string")
    found = search_text(queries, 3, documents=docs).orderBy("query_id", "r").collect()
    assert [(r["query_id"], r["id"], r["r"]) for r in found] == [(q, i, i + 1) for q in (1, 2) for i in range(3)]


def test_title_positions_precede_content(spark):
    docs = spark.createDataFrame([(1, "Big Tree", "tree, big tree"), (2, None, "tree")], "id long, title string, content string")
    rows = index.build_postings(docs).orderBy("id", "lexeme", "field").collect()
    assert [(r["id"], r["lexeme"], r["weight"], r["positions"], r["doc_length"]) for r in rows] == [
        (1, "big", "D", [4], 5),
        (1, "big", "A", [1], 5),
        (1, "tree", "D", [3, 5], 5),
        (1, "tree", "A", [2], 5),
        (2, "tree", "D", [1], 1),
    ]


def test_long_texts_keep_all_positions(spark):
    body = "a " * 400 + "b " * 16_500
    docs = spark.createDataFrame([(1, "a b", body)], "id long, title string, content string")
    rows = index.build_postings(docs).collect()
    kept = {(r["lexeme"], r["field"]): r["positions"] for r in rows}
    assert len(kept["a", "content"]) == 400 and kept["a", "title"] == [1]
    assert kept["b", "content"] == list(range(403, 16_903))
    assert {r["doc_length"] for r in rows} == {16_902}


def test_backfill_adds_only_missing_documents(spark, tables):
    docs = tables[0]
    path = shared_folder(spark, "postings")
    half = index.write_postings(index.build_postings(docs.filter("id < 30")), path)
    whole = index.write_postings(index.missing_postings(docs, half), path, mode="append")
    key = ["lexeme", "id", "field", "weight", "positions", "doc_length"]
    built = index.build_postings(docs).select(*key)
    assert whole.select(*key).exceptAll(built).count() == 0
    assert built.exceptAll(whole.select(*key)).count() == 0


def test_scan_tokenises_once_and_shuffles_nothing(tables):
    hits = scan_hits(*tables)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(lower(concat_ws") == 1
    assert "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_index_lookup_is_pushed_to_the_scan(spark, tables):
    stored = index.write_postings(index.build_postings(tables[0]), shared_folder(spark, "postings"))
    plan = indexed_hits(stored, tables[1])._jdf.queryExecution().toString()
    assert "In(lexeme" in plan


def stored_index(spark, documents):
    path = shared_folder(spark, "index")
    built = index.write_postings(index.build_postings(documents), f"{path}/postings")
    return built, index.write_bounds(index.build_bounds(built), f"{path}/bounds")


@pytest.mark.parametrize("span,seeds", [(1, 2), (7, 1), (256, 4)])
def test_bounded_search_equals_the_plain_one(spark, data, tables, monkeypatch, span, seeds):
    from cairnsearch.operators import fulltext

    for module in (fulltext, index):
        monkeypatch.setattr(module, "BLOCK_IDS", span)
    monkeypatch.setattr(fulltext, "SEED_RANGES", seeds)
    monkeypatch.setattr(fulltext, "FEW_RANGES", 0)
    monkeypatch.setattr(fulltext, "SMALL_BOUNDS", 0)
    postings, bounds = stored_index(spark, tables[0])
    for k in (1, 4, 50):
        plain = search_text(tables[1], k, postings=postings).collect()
        assert sorted(search_text(tables[1], k, postings=postings, bounds=bounds).collect()) == sorted(plain)
    monkeypatch.setattr(fulltext, "MAX_CANDIDATES", 3)  # ranges are written down instead of held
    assert sorted(search_text(tables[1], 4, postings=postings, bounds=bounds).collect()) == sorted(
        search_text(tables[1], 4, postings=postings).collect()
    )


def test_no_rank_is_above_its_bound(spark, data, tables):
    postings, _ = stored_index(spark, tables[0])
    share = postings.groupBy("lexeme", "id").agg(
        F.sum(F.size("positions") * F.when(F.col("weight") == "A", 1.0).otherwise(0.1) / F.log(F.col("doc_length") + 1.0)).alias("share")
    )
    terms = query_terms(tables[1]).select("query_id", F.explode("terms").alias("lexeme"))
    most = terms.join(share, "lexeme").groupBy("query_id", "id").agg(F.sum("share").alias("most"))
    rank = ranked(indexed_hits(postings, tables[1]), "cover_density")
    over = rank.join(most, ["query_id", "id"]).filter(F.col("rank") > F.col("most") * (1 + 1e-6))
    assert rank.count() > 0 and over.count() == 0


def test_ranges_that_cannot_reach_the_best_are_not_ranked(spark, monkeypatch):
    from cairnsearch.operators import fulltext

    monkeypatch.setattr(fulltext, "BLOCK_IDS", 10)
    monkeypatch.setattr(index, "BLOCK_IDS", 10)
    monkeypatch.setattr(fulltext, "SMALL_BOUNDS", 0)
    rows = [(i, None, "tree " * (30 if 40 <= i < 50 else 1) + "other words here " * 9) for i in range(2000)]
    postings, bounds = stored_index(spark, spark.createDataFrame(rows, "id long, title string, content string"))
    ranged, kept = [], fulltext._ranked_in

    def counting(asked, wanted, ranges, held):
        ranged.extend(r["block"] for r in ranges.collect())
        return kept(asked, wanted, ranges, held)

    monkeypatch.setattr(fulltext, "_ranked_in", counting)
    asked = spark.createDataFrame([(1, "tree")], "query_id long, query_text string")
    found = search_text(asked, 5, postings=postings, bounds=bounds).collect()
    assert sorted(r["id"] for r in found) == [40, 41, 42, 43, 44]
    assert len(ranged) == fulltext.SEED_RANGES and 4 in ranged


@pytest.mark.parametrize("by_index", [True, False])
def test_a_word_in_most_rows_is_dealt_over_tasks(spark, monkeypatch, by_index):
    """One word is in nine rows of ten; joined with too many queries to broadcast, no task gets most of the pairs."""
    from cairnsearch.operators import fulltext, skew

    monkeypatch.setattr(fulltext, "_is_small", lambda size: False)
    rows = [(i, None, f"rare{i % 50}" if i % 10 == 0 else f"common word{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, title string, content string").repartition(3)
    queries = spark.createDataFrame([(1, "common"), (2, "rare20"), (3, "common absent")], "query_id long, query_text string")
    shares, kept = [], skew.split_join

    def measuring(*args):
        joined = kept(*args)
        counts = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        shares.append(max(counts) / sum(counts) if sum(counts) > 1000 else 0)
        return joined

    monkeypatch.setattr(fulltext, "split_join", measuring)
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hits = indexed_hits(index.build_postings(docs), queries) if by_index else scan_hits(docs, queries)
        found = {r["query_id"]: r["n"] for r in hits.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == {1: 2700, 2: sum(i % 10 == 0 and i % 50 == 20 for i in range(3000))}
    assert len(shares) >= 2 and 0 < max(shares) < 0.3


def test_unknown_method(tables):
    with pytest.raises(ValueError):
        ranked(scan_hits(*tables), "bm25")
    with pytest.raises(ValueError):
        search_text(tables[1], 3)


def test_files_of_an_index_hold_a_bounded_number_of_rows(spark, tables, monkeypatch):
    """Their number follows the rows, not a setting, so that no task sorts more as the corpus grows."""
    monkeypatch.setattr(index, "FILE_ROWS", 300, raising=False)
    monkeypatch.setattr(index, "FILE_BOUNDS", 20, raising=False)
    postings, bounds = stored_index(spark, tables[0])
    for stored, most in ((postings, 300), (bounds, 20)):
        sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) > 2 and max(sizes) <= 2 * most


def test_hits_are_shuffled_as_position_lists(tables):
    """A position takes four bytes on the way, not a structure of three fields."""
    plan = indexed_hits(index.build_postings(tables[0]), tables[1])._jdf.queryExecution().executedPlan().toString()
    collected = [line for line in plan.splitlines() if "collect_list" in line]
    assert collected and "placed" not in plan and "parts" in plan
