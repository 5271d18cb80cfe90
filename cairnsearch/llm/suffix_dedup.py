"""Removal of repeated passages: a distributed suffix array over bytes, cut off at the length of a passage.

A byte goes if a passage of ``length`` bytes that covers it also starts anywhere else, in the same document or another
one. Suffixes are range-partitioned by their leading tokens with sampled splitters, every bucket sorts its own by
multikey quicksort, and neighbours are compared, across the buckets' boundaries too.

The first array has a suffix for each *anchor*, about one position in ``length / 4``: the place of the least hash among
the substrings of half its length that a passage has, so equal passages have theirs at the same place. Consecutive
passages with one anchor are a *run*. An equal run elsewhere settles all its passages at once; if the string at the
anchor stands nowhere else, none of them is repeated. What stays open are runs with a neighbour that has the same string
at its anchor in another run, along with one or two of each group of equal runs, which passages of other runs may meet.
Only the stretches of text they cover go on to the next array, where the strings are longer and runs shorter, until the
last one has a suffix for every passage.

The first token of a suffix is its first eight bytes, in their order; the later ones are digests of the rest, down to the
depth that matters. Runs with equal tokens (64 bits for the string at the anchor, 96 for the run) are taken to be equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnsearch.llm.common import discard, only_members, split_members, store

LENGTH = 400
CHUNK = 1 << 18
PLACE_BITS = np.uint64(20)
ROWS_PER_BUCKET = 120_000
SMALL = 4096
#: An odd multiplier and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)

TOKENS = ["lead", "gram", "run_hi", "run_lo"]
KEY = ["k1", "k2", "start"]
STRETCHES = "k1 long, k2 int, start int, data binary"
RUNS = "k1 long, k2 int, start int, low int, high int, lead long, gram long, run_hi long, run_lo int"
SPANS = "array<struct<low:int,high:int>>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _byte_codes() -> np.ndarray:
    """A fixed 64-bit code for each byte."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)


def leading(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place, or the first ``depth`` if fewer, as a long in the order of the bytes."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = padded[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
    spare = np.uint64(8 * max(0, 8 - depth))
    words = words >> spare << spare
    return (words ^ np.uint64(1 << 63)).view(np.int64)


def digests(data: memoryview, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the digests of ``data[low:high]`` as a long and an int."""
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(data[a:b]) for a, b in zip(low.tolist(), high.tolist())])
    return np.frombuffer(found, dtype=np.int64)[::2], np.frombuffer(found, dtype=np.int32)[2::4]


class Winnower:
    """Runs of passages with one anchor, a place of ``gram`` bytes, over a buffer that holds several texts."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.codes = _byte_codes()
        self.up, self.down = _powers(STEP, CHUNK + length), _powers(BACK, CHUNK + length)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every substring of ``gram`` bytes."""
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def _least(self, h: np.ndarray) -> np.ndarray:
        """For each passage the place of the first of its least substring hashes."""
        width = self.length - self.gram + 1
        places = np.arange(len(h), dtype=np.uint64)
        keys = (h >> PLACE_BITS << PLACE_BITS) | places
        padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - width + 1
        least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
        return (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``(low, high, anchor, gram hash)`` by absolute place; ``high`` is the start of a run's last passage."""
        for start in range(0, len(data), CHUNK):
            part = data[start : start + CHUNK + self.length - 1]
            if len(part) < self.length:
                continue
            h = self.grams(part)
            anchor = self._least(h)
            turns = np.zeros(len(anchor) + 1, dtype=np.int64)
            first = np.clip(offsets[:-1] - start, 0, len(anchor))
            last = np.clip(offsets[1:] - self.length + 1 - start, 0, len(anchor))
            whole = first < last
            np.add.at(turns, first[whole], 1)
            np.add.at(turns, last[whole], -1)
            inside = np.cumsum(turns[:-1]) > 0
            new = inside.copy()
            new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
            low = np.nonzero(new)[0]
            if not len(low):
                continue
            ends = inside.copy()
            ends[:-1] &= ~inside[1:] | new[1:]
            high = np.nonzero(ends)[0]
            yield low + start, high + start, anchor[low] + start, h[anchor[low]]


def binary_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column without nulls, and its offsets from 0."""
    _, places, values = column.buffers()
    if not len(column) or places is None or values is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(places, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, k1, k2, data)``: rows of the same id and text share a key, and lose the same bytes."""
    parts = [F.col(id_col), F.col(text_col)]
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.lit(1), *parts).alias("k1"),
        F.shiftright(F.xxhash64(F.lit(2), *parts), 32).cast("int").alias("k2"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"),
    )


def anchored_runs(stretches: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of ``stretches(k1, k2, start, data)``; ``low`` and ``high``, where a run's first and last passage start,
    are places in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(length, gram)
        for batch in batches:
            data, offsets = binary_of(batch.column("data"))
            keys = [batch.column(k).to_numpy() for k in KEY]
            for low, high, anchor, grams in winnower.runs(data, offsets):
                stretch = np.searchsorted(offsets, low, side="right") - 1
                own = [key[stretch] for key in keys]
                shift = own[2] - offsets[stretch]
                places = [(low + shift).astype(np.int32), (high + shift).astype(np.int32)]
                tokens = [leading(data, anchor, gram), grams.view(np.int64), *digests(memoryview(data), low, high + length)]
                names = [field.split()[0] for field in RUNS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*own, *places, *tokens)], names=names)

    return stretches.filter(F.length("data") >= length).select(*KEY, "data").mapInArrow(run, RUNS)


def covered_stretches(rows: DataFrame, length: int) -> DataFrame:
    """The stretches of text that the ``runs`` of ``rows(k1, k2, start, data, runs)`` cover.

    Runs that overlap by half a passage share a stretch; the few passages between them are looked at again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in (*KEY, "data", "runs")]
            for k1, k2, start, data, runs in zip(*columns):
                view, begin = memoryview(data.as_buffer()), start.as_py()
                for low, high in joined_runs(sorted((r["low"], r["high"]) for r in runs.as_py()), length // 2):
                    out.append((k1.as_py(), k2.as_py(), low, view[low - begin : high + length - begin].tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*KEY, "data"])

    return rows.select(*KEY, "data", "runs").mapInArrow(run, STRETCHES)


def joined_runs(runs: list[tuple[int, int]], near: int) -> list[tuple[int, int]]:
    """Sorted runs, those that begin at most ``near`` after an earlier one's end made one."""
    out = runs[:1]
    for low, high in runs[1:]:
        if low <= out[-1][1] + near:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of strings given token by token: three-way partitions on one token, the next one only where it ties."""
    order = np.arange(len(tokens[0]))
    open_parts = [(0, len(order), 0)]
    while open_parts:
        low, high, depth = open_parts.pop()
        if high - low < 2 or depth == len(tokens):
            continue
        part = order[low:high]
        if high - low <= SMALL:
            order[low:high] = part[np.lexsort([t[part] for t in reversed(tokens[depth:])])]
            continue
        key = tokens[depth][part]
        sample = np.sort(key[:: max(1, len(key) // 63)])
        pivot = sample[len(sample) // 2]
        less, equal = key < pivot, key == pivot
        order[low:high] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        first = low + int(less.sum())
        second = first + int(equal.sum())
        open_parts += [(low, first, depth), (first, second, depth + 1), (second, high, depth)]
    return order


def with_neighbours(suffixes: DataFrame, tokens: list[str], near: int, ties: list[str]) -> DataFrame:
    """The ``suffixes`` that have a neighbour in the array with the same first ``near`` tokens.

    ``same``: a neighbour has all tokens the same; ``other``: a neighbour has the first ``near`` ones, not all. ``ties``
    tell equal suffixes apart, so that a string found everywhere is dealt over several buckets.
    """
    spark = suffixes.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // ROWS_PER_BUCKET))
    ranged = suffixes.repartitionByRange(buckets, *tokens, *ties)

    def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        found = pa.Table.from_batches(batches)
        found = found.take(multikey_quicksort([found.column(t).to_numpy() for t in tokens]))
        equal = np.ones(found.num_rows - 1, dtype=bool)
        for i, token in enumerate(tokens):
            values = found.column(token).to_numpy()
            equal &= values[1:] == values[:-1]
            if i + 1 == near:
                alike = equal.copy()
        same, other = np.zeros(found.num_rows, dtype=bool), np.zeros(found.num_rows, dtype=bool)
        for flag, pairs in ((same, equal), (other, alike & ~equal)):
            flag[1:] |= pairs
            flag[:-1] |= pairs
        edge = np.zeros(found.num_rows, dtype=np.int32)
        edge[0] += 1
        edge[-1] += 2
        bucket = np.full(found.num_rows, TaskContext.get().partitionId(), dtype=np.int32)
        for name, values in (("same", same), ("other", other), ("edge", edge), ("bucket", bucket)):
            found = found.append_column(name, pa.array(values))
        yield from found.filter(pa.array(same | other | (edge > 0))).combine_chunks().to_batches(65_536)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema.fields)
    marked = store(ranged.mapInArrow(sort_bucket, f"{schema}, same boolean, other boolean, edge int, bucket int"), "suffix-array")
    # the first and last suffix of every bucket, two rows each
    in_order = Window.orderBy("bucket", "edge")
    meets = [
        (F.col("edge").isin(1, 3), lambda c: F.lag(c).over(in_order)),
        (F.col("edge").isin(2, 3), lambda c: F.lead(c).over(in_order)),
    ]
    alike = equal = F.lit(False)
    for at_edge, neighbour in meets:
        agree = [F.col(t) == neighbour(t) for t in tokens]
        head = at_edge & F.coalesce(_all(agree[:near]), F.lit(False))
        both = head & F.coalesce(_all(agree), F.lit(False))
        equal, alike = equal | both, alike | (head & ~both)
    edges = marked.filter("edge > 0").withColumns({"equal": equal, "alike": alike})
    edges = edges.withColumns({"same": F.col("same") | F.col("equal"), "other": F.col("other") | F.col("alike")})
    flagged = marked.filter("edge = 0").unionByName(edges.drop("equal", "alike"))
    return flagged.filter("same OR other").drop("edge", "bucket")


def _all(conditions: list):
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(id, data, spans)``: each document's bytes with the sorted, disjoint spans ``(low, high)`` to be removed.

    Null texts count as empty; texts shorter than ``length`` only have empty lists. Rows of one id are documents of their
    own; of the same id and text too, and those repeat each other. Null ids are kept. Other columns are ignored, whatever
    their names. An empty table gives an empty result. ``length`` must be 8 at least.
    """
    rows = keyed(docs, id_col, text_col)
    covered = store(_covered(rows, length), "suffix-spans")
    # documents that lose nothing are not shuffled
    untouched, maybe = split_members(rows, "k1", covered)
    none = F.array().cast(SPANS)
    touched = maybe.join(covered, ["k1", "k2"], "left").select("id", "data", F.coalesce("spans", none).alias("spans"))
    return untouched.select("id", "data", none.alias("spans")).unionByName(touched)


def _covered(rows: DataFrame, length: int) -> DataFrame:
    """``(k1, k2, spans)`` of the ``rows(k1, k2, data)`` that lose anything."""
    stretches, spans = rows.select("k1", "k2", F.lit(0).alias("start"), "data"), None
    grams = [length // 2, 3 * length // 4, 7 * length // 8, length]
    for gram in grams:
        runs = store(anchored_runs(stretches, length, gram), "suffix-runs")
        found = with_neighbours(runs, TOKENS, 2, [*KEY, "low"])
        discard(runs)
        settled = found.filter("same").select("k1", "k2", "low", (F.col("high") + length).alias("high"))
        spans = settled if spans is None else spans.unionByName(settled)
        if gram < length:
            asked = found.filter("other").groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("runs"))
            asked = store(asked, "suffix-asked")
            if gram == grams[0]:
                # a document that stands in several rows has all its runs settled already; one of the rows is enough
                stretches = only_members(stretches, "k1", asked.select("k1")).join(asked, KEY).dropDuplicates(KEY)
                stretches = store(covered_stretches(stretches, length), "suffix-stretches")
            else:
                open_still = store(covered_stretches(stretches.join(asked, KEY), length), "suffix-stretches")
                discard(stretches)
                stretches = open_still
            discard(asked)
    collected = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for spans in batch.column("spans").to_pylist():
                merged.append([{"low": a, "high": b} for a, b in joined_runs(sorted((r["low"], r["high"]) for r in spans), 0)])
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(merged, kind)], names=["k1", "k2", "spans"]
            )

    return collected.mapInArrow(merge, f"k1 long, k2 int, spans {SPANS}")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = True
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)``: ``kept`` holds the remaining bytes, concatenated.

    They may begin or end within a character, so they are bytes; ``with_kept=False`` leaves them out. For odd input see
    :func:`repeated_spans`.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                removed, n_spans, hashes, kept = [], [], [], []
                for data, spans in zip(part.column("data"), part.column("spans").to_pylist()):
                    view, at, pieces = memoryview(data.as_buffer()), 0, []
                    for span in spans:
                        pieces.append(view[at : span["low"]])
                        at = span["high"]
                    rest = b"".join([*pieces, view[at:]])
                    removed.append(len(view) - len(rest))
                    n_spans.append(len(spans))
                    hashes.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest if with_kept else None)
                sizes = [len(d.as_buffer()) for d in part.column("data")]
                numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, n_spans)]
                arrays = [part.column("id"), *numbers, pa.array(hashes), pa.array(kept, pa.binary())]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = repeated_spans(docs, id_col, text_col, length)
    kind = found.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = found.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
    return out if with_kept else out.drop("kept")
