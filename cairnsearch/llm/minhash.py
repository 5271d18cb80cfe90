"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard on full word-shingle sets, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnsearch.llm.common import join_hot, only_members, store
from cairnsearch.llm.components import connected

WORDS = 5
BANDS = 32
ROWS = 4
CELLS = 64
SHIFT = np.uint32(0x9E3779B1)
STEP = 2048
MAX_WORDS_KEPT = 400_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: ``[^\\x20\\x09-\\x0D]+`` in UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for i in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[i : len(h) - width + 1 + i]
    return np.unique(out)


def _sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit universe: it breaks up whatever order shingles have."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates from two permutations: the second one, shifted k times, gives coordinate k.

    A shingle's place after the first permutation moves around the circle of 2**32 places by one
    fixed step a coordinate, and the second permutation ranks the place reached; the least rank stays.
    """
    out = np.full(size, np.iinfo(np.uint32).max, dtype=np.uint32)
    shifts = (np.arange(size, dtype=np.uint64) * np.uint64(SHIFT)).astype(np.uint32)[:, None]
    for start in range(0, len(shingles), STEP):
        place = _sigma((shingles[start : start + STEP] >> np.uint64(32)).astype(np.uint32))
        rank = place[None, :] + shifts
        rank *= np.uint32(0x85EBCA6B)
        rank ^= rank >> np.uint32(13)
        rank *= np.uint32(0xC2B2AE35)
        rank ^= rank >> np.uint32(16)
        np.minimum(out, rank.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """``(id, n_shingles, set_hi, set_lo, bands, sketch)``: a 128-bit name of the whole set, its band keys, and the
    lowest bit of each coordinate."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, names, keys, sketches = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_hashes(text, words, known)
                    sizes.append(len(s))
                    if len(s):
                        name = xxhash.xxh3_128_digest(s.tobytes())
                        names.append(np.frombuffer(name, dtype=np.int64).tolist())
                        key = salt.copy()
                        signature = circulant_signature(s, bands * rows)
                        for column in signature.reshape(bands, rows).T.astype(np.uint64):
                            key = (key ^ column) * np.uint64(0x9FB21C651E98DF25)
                            key ^= key >> np.uint64(28)
                        keys.append(key.view(np.int64).tolist())
                        bits = np.zeros(-(-len(signature) // 64) * 64, dtype=np.uint8)
                        bits[: len(signature)] = signature & np.uint32(1)
                        sketches.append(np.packbits(bits).view(np.int64).tolist())
                    else:
                        names.append([None, None])
                        keys.append(None)
                        sketches.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(sizes, pa.int64()),
                        pa.array([n[0] for n in names], pa.int64()),
                        pa.array([n[1] for n in names], pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(sketches, pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "set_hi", "set_lo", "bands", "sketch"],
                )

    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(sign, "id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sketch array<long>")


def verified(pairs: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``pairs (a, b)`` whose shingle sets, taken from both whole texts of ``wanted``, are similar enough.

    Both joins are plain and feed a per-row check, so Spark may split a hot ``a``.
    """
    right = pairs.join(wanted.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def shingles(text: str | None) -> frozenset:
        w = words_of(text)
        n = min(words, len(w))
        return frozenset(zip(*(w[i : len(w) - n + 1 + i] for i in range(n)))) if n else frozenset()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, frozenset()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yes = []
                for text_a, text_b in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist()):
                    if text_a != last:
                        last, kept = text_a, shingles(text_a)
                    other = shingles(text_b)
                    common = len(kept & other)
                    yes.append(100 * common >= percent * (len(kept) + len(other) - common) and common > 0)
                mask = pa.array(yes, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"]
                )

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def _open(placed: DataFrame, total: int) -> DataFrame:
    """The rows of bands whose members are not all in one component yet."""
    spans = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    found = join_hot(placed, spans.filter("low < high"), ["band"], "n", total).filter("low IS NOT NULL")
    return found.select(*placed.columns)


def useful_shingles(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``(id, useful)``: a document's shingles that another one of ``ids`` has too, counted in ``CELLS`` cells by hash.

    Two documents have no more shingles in common than the smaller count of each cell, summed over cells.
    """

    def each_text(emit, names, schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    found = [emit(shingle_hashes(t, words, known)) for t in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found)], names=names)

        return texts.join(ids, "id", "left_semi").mapInArrow(run, schema)

    def in_cells(shingles: np.ndarray) -> np.ndarray:
        return np.bincount((shingles % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int32)

    cells = each_text(in_cells, ["id", "cells"], "id long, cells array<int>")
    each = each_text(lambda x: x.view(np.int64), ["id", "shingles"], "id long, shingles array<long>")
    each = each.select("id", F.explode("shingles").alias("shingle"))
    holders = each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last")
    # a signed hash and an unsigned one fall into the same cell, CELLS being a power of two
    alone = holders.groupBy("id", F.pmod("shingle", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").cast("int").alias("n"))
    alone = alone.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("alone"))
    useful = F.transform("cells", lambda c, i: c - F.coalesce(F.try_element_at("alone", i), F.lit(0)))
    return cells.join(alone, "id", "left").select("id", useful.alias("useful"))


def most_differing_bits(coordinates: int, percent: int) -> int:
    """How many bits of two sketches may differ at the threshold: the mean and seven standard deviations.

    A coordinate differs with probability ``1 - percent / 100``, its lowest bit half as often.
    """
    share = (100 - percent) / 200
    return math.ceil(coordinates * share + 7 * math.sqrt(coordinates * share * (1 - share)))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``: near copies by exact Jaccard, joined to components.

    1. Equal shingle sets fall together by a 128-bit name; the smallest id speaks for them.
    2. Speakers that share a band are candidates. A band's members are first compared with its
       smallest id only, and the links found are joined to components.
    3. Where the others of a band still make several components, the pairs across them are compared, so no pair of
       a group that is already one component is ever made, and no link between components is missed.
       A pair at exactly the threshold shares no band with probability (1 - 0.8**4)**32 = 5e-8.
    4. Pairs are dropped before texts are read if sizes rule the similarity out. From step 3 on, shingles that
       occur in one document of the open bands only cannot be common, and no more than the smaller number of the
       others in each cell of :func:`useful_shingles` can. Pairs across components must also agree in most bits of
       their sketches: a pair at the threshold has too many differing bits with a probability near 1e-9
       (:func:`most_differing_bits`). All else is confirmed on full sets.

    Texts with fewer words are one shingle; null texts and texts without words have no shingle, link with
    nothing and are kept. Rows that share an id count as one document in links; each gets its own row. A
    row with a null id links with nothing, has a null component and is kept. Columns other than
    id and text are ignored, whatever their names. An empty table gives an empty result.
    """
    found = store(signatures(docs, id_col, text_col, words, bands, rows), "minhash-signatures")
    total = found.count()
    sets = ["set_hi", "set_lo", "n_shingles"]
    classes = (
        found.filter("n_shingles > 0 AND id IS NOT NULL").groupBy(*sets).agg(F.min("id").alias("speaker"), F.count("*").alias("members"))
    )
    classes = store(classes, "minhash-classes")
    # a speaker's own rows only, so a large group of copies adds one member to its bands
    speakers = found.filter("n_shingles > 0").join(
        classes.select(*sets, F.col("speaker").alias("id")), [*sets, "id"]
    )
    banded = speakers.select("id", "n_shingles", F.explode("bands").alias("band")).distinct()
    banded = store(banded, "minhash-bands")
    shared = banded.groupBy("band").agg(F.min(F.struct("id", "n_shingles")).alias("first"), F.count("*").alias("n"))
    shared = shared.filter("n > 1").select(
        "band", "n", F.col("first.id").alias("leader"), F.col("first.n_shingles").alias("leader_n")
    )
    rows_banded = total * bands
    members = store(join_hot(banded, shared, ["band"], "n", rows_banded).filter("leader IS NOT NULL"), "minhash-members")

    def close(x: str, y: str):
        return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)

    star = members.filter((F.col("id") != F.col("leader")) & close("n_shingles", "leader_n"))
    star = star.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    star = store(star, "minhash-star")
    # texts of documents that share no band are left out by a Bloom filter before anything is shuffled
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = store(only_members(texts, "id", members.select("id").distinct()), "minhash-texts")
    links = store(verified(star, wanted, words, percent), "minhash-links")
    component = connected(links)
    # a band's smallest id has met all members already
    placed = members.filter("id != leader").join(component, "id", "left")
    placed = placed.select("band", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    open_rows = store(_open(placed, rows_banded), "minhash-open")
    # a row per document from here on, its bands in an array, until they are set side by side
    sides = open_rows.groupBy("id").agg(
        F.first("component").alias("component"), F.collect_set("n_shingles").alias("sizes"), F.collect_set("band").alias("bands")
    )
    useful = useful_shingles(wanted, sides.select("id"), words).dropDuplicates(["id"])
    mass = F.aggregate("useful", F.lit(0).cast("long"), lambda total, x: total + x)
    facts = sides.join(useful.withColumn("mass", mass), "id")
    facts = facts.withColumn("sizes", F.filter("sizes", lambda n: F.col("mass") * 100 >= n * percent)).filter(F.size("sizes") > 0)
    facts = store(facts, "minhash-facts")
    still = facts.select(F.explode("bands").alias("band"), "id", "component")
    still = _open(still, rows_banded).groupBy("id").agg(F.collect_set("band").alias("bands"))  # at most all of a document
    facts = facts.drop("bands").withColumn("n_shingles", F.explode("sizes")).drop("sizes")
    met = members.groupBy("id").agg(F.collect_set("leader").alias("met"))  # at most one a band
    sketched = speakers.select("id", "sketch").dropDuplicates(["id"])
    open_docs = store(still.join(facts, "id").join(met, "id").join(sketched, "id"), "minhash-open")

    needed = (F.col("n_shingles_a") + F.col("n_shingles_b")) * percent
    smaller = F.zip_with("useful_a", "useful_b", lambda x, y: F.least(x, y))
    common = F.aggregate(smaller, F.lit(0).cast("long"), lambda total, x: total + x)
    differing = [F.bit_count(F.get("sketch_a", i).bitwiseXOR(F.get("sketch_b", i))) for i in range(-(-bands * rows // 64))]
    a, b = (
        open_docs.select(F.explode("bands").alias("band"), *[F.col(c).alias(f"{c}_{side}") for c in open_docs.columns])
        for side in "ab"
    )
    # a pair is made in the first of the bands it shares
    first_shared = F.array_min(F.array_intersect("bands_a", "bands_b"))
    # rows of one band go to all tasks, whichever join Spark picks
    b = b.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id_b")
    across = a.join(b, "band").filter(
        (F.col("id_a") < F.col("id_b"))
        & (F.col("component_a") != F.col("component_b"))
        & (F.least("mass_a", "mass_b") * (100 + percent) >= needed)
        & (reduce(add, differing) <= most_differing_bits(bands * rows, percent))
        & ~F.array_contains("met_b", F.col("id_a"))
        & (common * (100 + percent) >= needed)
        & (F.col("band") == first_shared)
    )
    across = across.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    more = store(verified(store(across, "minhash-across"), wanted, words, percent), "minhash-links")
    if not more.isEmpty():
        component = connected(component.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.join(component.withColumnRenamed("id", "speaker"), "speaker", "left").select(
        *sets, "members", F.coalesce("component", "speaker").alias("component_id")
    )
    out = join_hot(found.drop("bands", "sketch"), named, sets, "members", total)
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
