"""Ids claimed by several writers, and indexes kept while documents arrive."""

import sys
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from cairnsearch.operators import ranges
from cairnsearch.operators.cells import search_cells
from cairnsearch.operators.fulltext import search_text
from cairnsearch.operators.nearest import nearest
from cairnsearch.operators.postings import (
    build_bounds,
    build_postings,
    read_bounds,
    shares_of,
    write_largest_shares,
    write_postings,
)
from cairnsearch.session import shared_folder
from cairnsearch.sources import id_blocks
from cairnsearch.sources.corpus_table import read_corpus
from cairnsearch.sources.documents import read_documents
from cairnsearch.streaming import ingest, upkeep
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW = "id long, title string, text string, namespace string, contributors string"


def letters():
    return lambda texts: [np.array([t.count(c) + 0.5 for c in "abc"], np.float32) for t in texts]


def rows_of(postings):
    return sorted((r["lexeme"], r["id"], r["field"], tuple(r["positions"]), r["doc_length"]) for r in postings.collect())


def arriving(spark, source, batch, schema=ROW):
    rows = [(100 * batch + i, f"title {i}", f"a{i} b c{batch} common", "n", None) for i in range(7)]
    columns = [f.split()[0] for f in schema.split(", ")]
    spark.createDataFrame(rows, ROW).select(*columns).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).parquet(source)


def whole_index(documents):
    return rows_of(build_postings(documents))


def test_a_stream_keeps_its_indexes(spark):
    """After every batch the index equals one built from all documents, whatever was merged or dropped meanwhile."""
    tables, source = ingest.StreamTables(shared_folder(spark, "stream")), shared_folder(spark, "arriving")
    index = tables.index(lists=3, fan=2)
    for batch in range(6):
        rows = arriving(spark, source, batch)
        ingest.start_stream(rows, tables, letters, dim=3, index=index).awaitTermination()
        stored = ingest.read_ingested(spark, tables)
        assert stored.count() == 7 * (batch + 1)
        assert rows_of(index.postings(spark)) == whole_index(stored)
        words = spark.createDataFrame([(1, "common c0"), (2, "b")], "query_id long, query_text string")
        plain = search_text(words, 5, postings=index.postings(spark))
        assert sorted(plain.collect()) == sorted(
            search_text(words, 5, postings=index.postings(spark), bounds=index.bounds(spark)).collect()
        )
        asked = spark.createDataFrame([(1, [1.0, 0.5, 3.0])], "query_id long, query_vec array<double>")
        found, exact = search_cells(index.cells(spark), asked, 9), nearest(stored, asked, 9)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))
    live = upkeep.live_segments(upkeep.stored_segments(spark, index.postings_root))
    assert live == [(0, 3), (4, 4), (5, 5)]
    assert index.drop_merged(spark) > 0
    assert upkeep.stored_segments(spark, index.postings_root) == live
    assert rows_of(index.postings(spark)) == whole_index(stored)


def test_a_batch_reads_its_own_rows_only(spark):
    """A segment is made from the rows just stored: nothing of the corpus is read again."""
    documents = spark.createDataFrame([(1, "t", "x y", [1.0])], "id long, title string, content string, embedding array<float>")
    index = upkeep.IndexUpkeep(shared_folder(spark, "index"))
    index.add(documents, 0)
    first = rows_of(index.postings(spark))
    index.add(documents.withColumn("id", F.col("id") + 1), 1)
    assert len(rows_of(index.postings(spark))) == 2 * len(first)
    index.add(documents.withColumn("id", F.col("id") + 1), 1)  # a replay
    assert len(rows_of(index.postings(spark))) == 2 * len(first)


def held_blocks(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()


def test_what_is_no_longer_read_leaves_the_disk(spark):
    """Storing an index leaves no shuffle files behind, and a merge, if nobody searches meanwhile, no hidden segments."""
    rows = [(i, f"title {i}", f"a{i % 7} b c{i % 3} common", [1.0, float(i)]) for i in range(600)]
    documents = spark.createDataFrame(rows, "id long, title string, content string, embedding array<float>")
    index = upkeep.IndexUpkeep(shared_folder(spark, "index"), fan=2, keep_merged=False)
    before = held_blocks(spark)
    for batch in range(4):
        index.add(documents.filter(F.col("id") % 4 == batch), batch)
    for _ in range(100):  # files go in the background
        if held_blocks(spark) <= before:
            break
        time.sleep(0.1)
    assert held_blocks(spark) <= before
    for root in (index.postings_root, index.bounds_root):
        assert upkeep.stored_segments(spark, root) == [(0, 1), (2, 2), (3, 3)]
    assert rows_of(index.postings(spark)) == whole_index(documents)


def test_bounds_of_segments_are_those_of_their_postings(spark):
    """Also of words in title and content, of repeated and null ids, and with ranges that end within a word."""
    rows = [(None if i % 9 == 0 else i // 2, f"b {i % 5}", f"a{i % 7} b b c{i % 3} common") for i in range(3000)]
    documents = spark.createDataFrame(rows, "id long, title string, content string").repartition(3)
    path = shared_folder(spark, "bounds")
    postings = write_postings(build_postings(documents), f"{path}/postings", partitions=7)
    write_largest_shares(shares_of(postings), f"{path}/bounds")
    assert sorted(map(str, read_bounds(spark, f"{path}/bounds").collect())) == sorted(map(str, build_bounds(postings).collect()))
    found = postings.groupBy(F.input_file_name().alias("file")).agg(F.min(F.struct("lexeme", "id")), F.max(F.struct("lexeme", "id")), F.count("*"))
    files = sorted([(*[(x[0], -1 if x[1] is None else x[1]) for x in ends], n) for _, *ends, n in found.collect()])
    assert len(files) == 7 and all(one[1] < two[0] for one, two in zip(files, files[1:]))
    assert max(n for _, _, n in files) < 4 * min(n for _, _, n in files)


def test_folded_rows_meet_across_batches():
    parts = [pa.record_batch({"word": w, "n": n, "x": x}) for w, n, x in ((["a", "a"], [1, 2], [3.0, 1.0]), (["a", "b"], [2, None], [5.0, 0.5]))]
    once = pa.Table.from_batches(ranges.folded_in_order(iter(parts), ["word", "n"]))
    assert once.to_pydict() == {"word": ["a", "a", "b"], "n": [1, 2, None], "x": [3.0, 5.0, 0.5]}


def test_segments_without_rows(spark):
    documents = spark.createDataFrame([], "id long, title string, content string, embedding array<float>")
    index = upkeep.IndexUpkeep(shared_folder(spark, "index"), lists=2)
    assert index.postings(spark).count() == 0
    index.add(documents, 0)
    assert index.postings(spark).count() == 0
    assert index.cells(spark).lists == 0
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query_vec array<double>")
    assert search_cells(index.cells(spark), asked, 3).count() == 0
    index.add(spark.createDataFrame([(1, "t", "x y", [1.0])], documents.schema), 1)
    assert [r["id"] for r in search_cells(index.cells(spark), asked, 3).collect()] == [1]


@pytest.mark.parametrize("segments,fan,before,due", [
    ([(0, 0), (1, 1)], 2, 2, (0, 1)),
    ([(0, 0), (1, 1)], 2, 1, None),
    ([(0, 1), (2, 2), (3, 3)], 2, 9, (2, 3)),
    ([(0, 1), (2, 3), (4, 4)], 2, 9, (0, 3)),
    ([(0, 0), (2, 2)], 2, 9, None),
    ([(0, 7), (8, 8), (9, 9)], 8, 99, None),
])
def test_tiers(segments, fan, before, due):
    assert upkeep.due_merge(segments, fan, before) == due


def test_unfinished_and_hidden_segments():
    assert upkeep.live_segments([(0, 0), (0, 3), (1, 1), (2, 2), (4, 4)]) == [(0, 3), (4, 4)]


def test_writers_never_share_ids(spark, monkeypatch):
    monkeypatch.setattr(id_blocks, "BLOCK", 10)
    folder = shared_folder(spark, "ids")
    claimed = {}

    def claim(owner):
        claimed[owner] = id_blocks.claim_blocks(spark, folder, owner, 5)

    threads = [threading.Thread(target=claim, args=(f"w{i}",)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len({b for blocks in claimed.values() for b in blocks}) == 30
    assert id_blocks.claim_blocks(spark, folder, "w3", 5) == sorted(claimed["w3"])
    rows = spark.range(95).repartition(4).withColumnRenamed("id", "value")
    numbered = id_blocks.with_claimed_ids(rows, folder, "rows")
    ids = [r["id"] for r in numbered.collect()]
    assert len(set(ids)) == 95 and not {i // 10 for i in ids} & {b for blocks in claimed.values() for b in blocks}
    assert sorted(r["value"] for r in numbered.collect()) == list(range(95))
    assert id_blocks.with_claimed_ids(rows.limit(0), folder, "none").count() == 0


def test_documents_without_ids_go_from_reading_to_storing(spark):
    source, path, ids = (shared_folder(spark, name) for name in ("raw", "corpus", "ids"))
    spark.createDataFrame([(f"t{i}", f"text {i}") for i in range(30)], "title string, text string").repartition(3).write.parquet(source)
    for _ in range(2):
        counted = ingest.ingest_batch(read_documents(spark, [source]), path, letters, dim=3, ids=ids)
        assert tuple(counted.first()) == (30, 30)
    stored = read_corpus(spark, path)
    assert stored.count() == stored.select("id").distinct().count() == 60


def test_a_replayed_batch_keeps_its_ids(spark):
    tables, source = ingest.StreamTables(shared_folder(spark, "stream")), shared_folder(spark, "arriving")
    schema = ROW.replace("id long, ", "")
    rows = arriving(spark, source, 0, schema)
    ingest.start_stream(rows, tables, letters, dim=3).awaitTermination()
    first = sorted(r["id"] for r in ingest.read_ingested(spark, tables).collect())
    rows = spark.read.schema(schema).parquet(source)
    replayed = id_blocks.with_claimed_ids(rows, tables.ids, "batch 0")
    assert sorted(r["id"] for r in replayed.collect()) == first
    rows = arriving(spark, source, 1, schema)
    ingest.start_stream(rows, tables, letters, dim=3).awaitTermination()
    assert ingest.read_ingested(spark, tables).select("id").distinct().count() == 14


def test_limit_takes_the_first_rows_of_the_first_files(spark):
    path = shared_folder(spark, "parts")
    for part in range(3):
        rows = [(f"{part}-{i}", "x") for i in range(4)]
        spark.createDataFrame(rows, "title string, text string").coalesce(1).write.parquet(f"{path}/{part}")
    paths = [f"{path}/{part}" for part in range(3)]
    for limit, expected in ((1, 1), (4, 4), (6, 6), (12, 12), (50, 12)):
        found = [r["title"] for r in read_documents(spark, paths, limit).collect()]
        assert sorted(found) == sorted(f"{i // 4}-{i % 4}" for i in range(expected))
    plan = read_documents(spark, paths, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan
