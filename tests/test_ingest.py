import math
import sys

import numpy as np
import pytest
from cairnsearch.operators.embed import check_dimension, embed, embed_distinct
from cairnsearch.session import shared_folder
from cairnsearch.sources import config_table, corpus_table, documents
from cairnsearch.streaming import ingest, progress
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lengths():
    return lambda texts: [np.array([len(t), len(texts)], np.float32) for t in texts]


def rows(spark, n):
    return spark.range(n).select(
        "id",
        F.concat(F.lit("title "), "id").alias("title"),
        F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"),
        F.lit("0").alias("namespace"),
        F.lit(None).cast("string").alias("contributors"),
    )


def test_embed_keeps_order_truncates_and_batches(spark):
    found = embed(rows(spark, 50).coalesce(1), "text", lengths, dim=2, max_length=4, batch_size=32)
    seen = found.collect()
    assert [r["embedding"][0] for r in seen] == [min(r["id"] % 7, 4) for r in seen]
    assert sorted({r["embedding"][1] for r in seen}) == [18.0, 32.0]
    assert embed(rows(spark, 0), "text", lengths).count() == 0


def test_wrong_count_or_dimension_fails(spark):
    short = lambda: lambda texts: [[1.0]] * (len(texts) - 1)
    with pytest.raises(Exception, match="vectors returned for"):
        embed(rows(spark, 3).coalesce(1), "text", short).collect()
    with pytest.raises(Exception, match="expected 3 dimensions"):
        embed(rows(spark, 3), "text", lengths, dim=3).collect()
    vectors = embed(rows(spark, 3), "text", lengths)
    assert check_dimension(vectors, 2).count() == 3
    with pytest.raises(Exception, match="expected 3 dimensions"):
        check_dimension(vectors, 3).collect()


def test_distinct_queries_embedded_once(spark, tmp_path):
    calls = str(tmp_path)

    def recording():
        def model(texts):
            import uuid

            for t in texts:
                open(f"{calls}/{t}-{uuid.uuid4().hex}", "w").close()
            return [[float(len(t))] for t in texts]

        return model

    queries = spark.range(1000).select(
        F.col("id").alias("query_id"),
        F.when(F.col("id") < 900, F.lit("hot")).otherwise(F.concat(F.lit("q"), "id")).alias("query_text"),
    )
    found = embed_distinct(queries, recording, dim=1, rows_per_salt=50).collect()
    assert len(found) == 1000
    assert all(r["query_vec"] == [float(len(r["query_text"]))] for r in found)
    import os

    assert len({name.split("-")[0] for name in os.listdir(calls)}) == 101


def test_normalise_fills_required_columns(spark):
    raw = spark.createDataFrame(
        [(None, None, None, None, 1), ("t", "x", 5, "c", 2)],
        "title string, text string, namespace int, contributors string, extra int",
    )
    assert [tuple(r) for r in documents.normalise(raw).collect()] == [
        ("", "", None, None),
        ("t", "x", "5", "c"),
    ]
    assert documents.normalise(raw.select("text")).columns == list(documents.SOURCE_COLUMNS)


def test_split_selection(spark):
    manifest = spark.createDataFrame(
        [(0, "a", "test"), (1, "b", "train"), (2, "c", "train")], "ordinal int, url string, split string"
    )
    assert documents.select_shards(manifest) == ["b", "c"]
    assert documents.select_shards(manifest, "train", first_only=True) == ["b"]
    with pytest.raises(ValueError):
        documents.select_shards(manifest, "validation")
    with pytest.raises(ValueError):
        documents.select_shards(manifest.limit(0))


def test_path_precedence(spark, tmp_path):
    (tmp_path / "d.parquet").touch()
    resolve = documents.resolve_paths
    whole = str(tmp_path / "d.parquet")
    assert resolve(spark, local_path=whole, commit="c", file_name="f") == [whole]
    assert resolve(spark, local_path="d.parquet", working_dir=str(tmp_path)) == [whole]
    with pytest.raises(FileNotFoundError):
        resolve(spark, local_path="e.parquet", working_dir=str(tmp_path))
    assert resolve(spark, repository="r/", commit="c", file_name="f") == ["r/c/f"]
    with pytest.raises(ValueError):
        resolve(spark)


@pytest.mark.parametrize("n", [0, 1, 5, 37, 99, 100, 500])
def test_first_rows_by_range_equals_top_n(spark, n):
    df = spark.range(100).select((F.col("id") * F.col("id") * 977 - 1000).alias("id"))
    want = sorted(r["id"] for r in df.collect())
    want = want[:n] if n else want
    assert sorted(r["id"] for r in documents.first_rows(df, n).collect()) == want


def test_first_rows_with_ties_and_null_keys(spark):
    keys = [None, 1, 2, 2, 2, -(2**60), 2**60, None]
    df = spark.createDataFrame([(k,) for k in keys], "id long")

    def first(n):
        found = [r["id"] for r in documents.first_rows(df, n).collect()]
        return sorted((k for k in found if k is not None)), found.count(None)

    assert first(1) == ([-(2**60)], 0)
    assert first(2) == ([-(2**60), 1], 0)
    assert first(3) == first(5) == ([-(2**60), 1, 2, 2, 2], 0)
    assert first(6) == ([-(2**60), 1, 2, 2, 2, 2**60], 0)
    assert first(7) == first(99) == ([-(2**60), 1, 2, 2, 2, 2**60], 2)
    assert documents.first_rows(df.limit(0), 3).count() == 0


def test_model_is_made_once_per_worker(spark, tmp_path):
    made = str(tmp_path)

    def recording():
        import os
        import uuid

        open(f"{made}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[float(len(t))] for t in texts]

    assert embed(rows(spark, 64).repartition(32), "text", recording, dim=1).filter("embedding[0] = id % 7").count() == 64
    import os

    workers = [name.split("-")[0] for name in os.listdir(made)]
    assert len(workers) == len(set(workers)) < 32


def test_append_duplicates_on_rerun(spark):
    path = shared_folder(spark, "corpus")
    docs = rows(spark, 5).withColumnRenamed("text", "content")
    docs = docs.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    assert corpus_table.append_documents(docs, path) == 5
    assert corpus_table.append_documents(docs, path) == 5
    assert corpus_table.append_documents(docs.limit(0), path) == 0
    stored = corpus_table.read_corpus(spark, path)
    assert corpus_table.count_documents(stored).first()[0] == 10
    assert stored.filter("created_at IS NULL").count() == 0
    assert corpus_table.next_id(stored) == 5
    fresh = corpus_table.with_generated_id(docs.drop("id").repartition(3), start=5)
    ids = [r["id"] for r in fresh.collect()]
    assert len(set(ids)) == 5 and min(ids) >= 5


def test_config_table(spark):
    config = spark.createDataFrame([("search2.a", "1"), ("searchX.b", "2")], "key string, value string")
    seeds = spark.createDataFrame([("search2.c", "3"), ("search2.a", "9")], "key string, value string")
    seeded = config_table.seed_if_absent(config, seeds)
    assert seeded.count() == 3
    keys = spark.createDataFrame([("search2.a",), ("missing",)], "key string")
    assert {r["key"]: r["value"] for r in config_table.lookup(seeded, keys).collect()} == {
        "search2.a": "1",
        "missing": None,
    }
    assert config_table.lookup_prefix(config, "search2.").count() == 1
    assert config_table.lookup_prefix(config, "search_.").count() == 2


def test_run_history_and_status(spark):
    log = spark.range(150).select(
        F.col("id").alias("batch_id"),
        progress.snapshot_time(F.col("id") * 1000).alias("at"),
        F.lit(10).cast("long").alias("rows_read"),
        F.lit(9).cast("long").alias("inserted"),
    )
    history = progress.run_history(log).orderBy("batch_id").collect()
    assert len(history) == 120
    assert (history[0]["rows_read"], history[-1]["rows_read"], history[-1]["inserted"]) == (310, 1500, 1350)
    done = progress.run_status(log, started=True, active=False, error=None).first()
    assert (done["status"], done["label"], done["rows_read"]) == ("DONE", "완료", 1500)
    assert done["finished_at"] is not None
    failed = progress.run_status(log, started=True, active=False, error="lost").first()
    assert (failed["status"], failed["inserted"], failed["finished_at"]) == ("ERROR", 1350, None)
    assert progress.run_status(log, True, True, None).first()["status"] == "RUNNING"
    idle = progress.run_status(log.limit(0), False, False, None).first()
    assert (idle["status"], idle["rows_read"]) == ("IDLE", 0)


def test_batch_ingest_counts(spark):
    path = shared_folder(spark, "corpus")
    counted = ingest.ingest_batch(rows(spark, 40), path, lengths, dim=2).first()
    assert tuple(counted) == (40, 40)
    assert corpus_table.read_corpus(spark, path).count() == 40


def test_failing_model_stores_nothing(spark):
    path = shared_folder(spark, "corpus")
    broken = lambda: lambda texts: []
    with pytest.raises(Exception, match="vectors returned for"):
        ingest.ingest_batch(rows(spark, 40), path, broken)
    assert not documents.path_exists(spark, path) or spark.read.schema(
        corpus_table.CORPUS_SCHEMA
    ).parquet(path).count() == 0


def test_stream_ingest_resumes_and_replays_without_duplicates(spark, tmp_path):
    source = str(tmp_path / "in")
    tables = ingest.StreamTables(shared_folder(spark, "stream"))
    assert ingest.read_log(spark, tables).count() == 0
    assert ingest.read_ingested(spark, tables).count() == 0
    assert ingest.stream_status(spark, tables, None).first()["status"] == "IDLE"
    rows(spark, 30).coalesce(1).write.parquet(source)

    def arriving():
        schema = rows(spark, 1).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    ingest.start_stream(arriving(), tables, lengths, dim=2).awaitTermination()
    rows(spark, 50).filter("id >= 30").coalesce(1).write.mode("append").parquet(source)
    ingest.start_stream(arriving(), tables, lengths, dim=2).awaitTermination()
    assert ingest.read_ingested(spark, tables).count() == 50
    history = progress.run_history(ingest.read_log(spark, tables)).orderBy("batch_id").collect()
    assert [(r["rows_read"], r["inserted"]) for r in history] == [(30, 30), (50, 50)]

    # a batch whose commit was lost is run again under the same id
    import glob
    import os

    last = max(glob.glob(f"{tables.checkpoint}/commits/*"), key=os.path.getmtime)
    for name in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(name):
            os.remove(name)
    ingest.start_stream(arriving(), tables, lengths, dim=2).awaitTermination()
    assert ingest.read_ingested(spark, tables).count() == 50
    assert math.isclose(ingest.read_log(spark, tables).agg(F.sum("rows_read")).first()[0], 50)


def test_shared_folder_uses_the_configured_root(spark):
    first, second = shared_folder(spark, "a"), shared_folder(spark, "a")
    assert first != second and first.startswith(spark.conf.get("spark.checkpoint.dir"))
