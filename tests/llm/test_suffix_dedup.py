"""Removal of repeated passages against a plain count of all passages."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnsearch.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string"


def plain(rows, length):
    """``(id, n_bytes, n_removed, n_spans, sha256)`` of every row, by a dictionary of all passages."""
    texts = [(text or "").encode() for _, text in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        n_spans = int((gone[1:] > gone[:-1]).sum() + gone[0]) if len(t) else 0
        out.append((doc_id, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def mixed_texts(seed, n=60):
    """Random texts with shared passages, near copies, runs of one letter and characters of several bytes."""
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "δέλτα", "e", "zeta ", "\n"]
    write = lambda k: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(k))
    passages = [write(rng.randrange(5, 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        text = write(rng.randrange(0, 30))
        for _ in range(rng.randrange(4)):
            text += rng.choice(passages) + write(rng.randrange(0, 8))
        texts.append(text)
    texts += [texts[3], texts[3][:50] + "x" + texts[3][51:], "a" * 500, "ab" * 300, passages[0], passages[0][3:], None, ""]
    return texts


@pytest.mark.parametrize("length,seed", [(40, 1), (41, 2), (100, 3), (8, 4)])
def test_equals_a_plain_count(spark, length, seed):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(mixed_texts(seed))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(sd.without_repeats(docs, length=length)) == plain(rows, length)


def test_buckets_and_chunks_of_any_size(spark, monkeypatch):
    rows = list(enumerate(mixed_texts(5)))
    monkeypatch.setattr(sd, "ROWS_PER_BUCKET", 9)
    monkeypatch.setattr(sd, "CHUNK", 256)
    monkeypatch.setattr(sd, "SMALL", 8)
    assert found(sd.without_repeats(spark.createDataFrame(rows, SCHEMA), length=40)) == plain(rows, 40)


def test_whole_length_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(sd.without_repeats(docs, with_kept=False)) == plain(rows, 400)


def test_kept_bytes_and_odd_rows(spark):
    """A repeated row loses all; extra columns named like results do not matter; an empty table has no rows."""
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    rows = [(1, long, True), (1, long, True), (2, "x" + long + "tail", None), (None, None, None), (3, "short", False)]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept boolean").withColumn("spans", F.lit(1)).withColumn("k1", F.lit(0))
    out = sorted((r["doc_id"] or 0, r["n_removed"], bytes(r["kept"])) for r in sd.without_repeats(docs).collect())
    n = len(long)
    assert out == [(0, 0, b""), (1, n, b""), (1, n, b""), (2, n, b"xtail"), (3, 0, b"short")]
    assert sd.without_repeats(docs.limit(0)).count() == 0


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(sd, "SMALL", 4)
    rng = np.random.default_rng(1)
    tokens = [rng.integers(-3, 3, 1000) for _ in range(3)]
    rows = list(zip(*[t.tolist() for t in tokens]))
    assert [rows[i] for i in sd.multikey_quicksort(tokens)] == sorted(rows)
