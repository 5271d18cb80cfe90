"""Rows stored in the order of a word and a number, shuffled as packed columns.

The rows of an index are many and small. As rows a shuffle holds them at several times the size of the files they end up
in; here a task sorts a chunk of them, cuts it by the ranges of the files, and hands on each piece as one compressed block
of columns. The ranges come from some of the rows, so that all need not be kept on disk meanwhile.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a task holds and packs together.
CHUNK_BYTES, CHUNK_ROWS = 20 * 1024 * 1024, 1 << 19
#: Of a chunk's rows one in so many, but some at least, stand for its keys when the ranges are chosen.
ROWS_PER_KEY, LEAST_KEYS = 10_000, 100
#: Ranges are chosen by the rows of one number in so many, by all rows if these are too few.
ONE_IN = 8
ROWS_AT_ONCE = 32_768
LEAST_NUMBER = np.iinfo(np.int64).min
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def sorted_by_range(
    rows: DataFrame,
    order: list[str],
    file_rows: int,
    partitions: int | None,
    store: Callable[[DataFrame], None],
    fold: bool = False,
    some: DataFrame | None = None,
) -> None:
    """``store`` gets ``rows`` by ranges of ``order``, a word and a number, of about ``file_rows`` rows, each in order.

    ``some`` are the rows that :func:`one_in` leaves, for callers that can make them without making all. With ``fold`` rows
    of one key in a chunk become one that holds the largest value of each other column. The shuffle's files go when the
    rows are stored.
    """
    n, keys = sampled_keys(one_in(rows, order[1]) if some is None else some, order, fold)
    n *= ONE_IN
    if n < ONE_IN * file_rows:
        n, keys = sampled_keys(rows, order, fold)
    files = partitions or max(1, math.ceil(n / file_rows))
    bounds = range_bounds(keys, files)
    schema, arrow_schema = rows.schema, to_arrow_schema(rows.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            for part, piece in pieces(folded(chunk, order) if fold else chunk, order, bounds):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([packed(piece)], pa.binary())], names=["part", "data"]
                )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                with pa.CompressedInputStream(pa.BufferReader(data.as_buffer()), "zstd") as whole:
                    table = pq.read_table(pa.BufferReader(whole.read()), use_threads=False)
                yield from table.cast(arrow_schema).to_batches(ROWS_AT_ONCE)

    blocks = rows.mapInArrow(pack, "part int, data binary").repartitionById(files, "part")
    conf = rows.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        store(blocks.mapInArrow(unpack, schema).sortWithinPartitions(*order))
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def one_in(rows: DataFrame, number: str) -> DataFrame:
    """The ``rows`` of about one ``number`` in ``ONE_IN``, to choose ranges by."""
    return rows.filter(F.pmod(F.xxhash64(number), F.lit(ONE_IN)) == 0)


def write_packed(rows: DataFrame, path: str, mode: str = "overwrite", steps: Sequence[str] = ()) -> None:
    """Store ``rows`` compressed, columns (by their Parquet paths) of numbers that go up in ``steps`` as differences."""
    found = rows.write.mode(mode).option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for column in steps:
        found = found.option(f"parquet.enable.dictionary#{column}", "false")
    found.parquet(path)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= CHUNK_ROWS or size >= CHUNK_BYTES:
            whole = pa.Table.from_batches(held).combine_chunks()
            held, n, size = [], 0, 0
            yield whole
            del whole
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def folded(table: pa.Table, order: list[str]) -> pa.Table:
    """One row for each key, in the order in which keys first come, with the largest value of each other column."""
    values = [name for name in table.column_names if name not in order]
    once = table.group_by(order, use_threads=False).aggregate([(name, "max") for name in values])
    return once.select([*order, *(f"{name}_max" for name in values)]).rename_columns([*order, *values]).select(table.column_names)


def folded_in_order(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.RecordBatch]:
    """:func:`folded` for rows in order, which may come in any number of batches."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        table = folded(table if last is None else pa.concat_tables([last, table]), order)
        yield from table.slice(0, table.num_rows - 1).combine_chunks().to_batches()
        last = table.slice(table.num_rows - 1).combine_chunks()
    if last is not None:
        yield from last.to_batches()


def numbers_of(column: pa.Array) -> np.ndarray:
    """Numbers as they are ordered: nulls first."""
    return pc.fill_null(column, LEAST_NUMBER).to_numpy(zero_copy_only=False)


def sampled_keys(rows: DataFrame, order: list[str], fold: bool) -> tuple[int, list[tuple[bytes, int, float]]]:
    """The number of ``rows``, and some keys with the number of rows that each stands for."""
    word, number = order

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            chunk = folded(chunk, order) if fold else chunk
            n = chunk.num_rows
            few = min(n, max(LEAST_KEYS, n // ROWS_PER_KEY))
            some = chunk.select(order).take(pa.array(np.sort(np.random.default_rng(n).choice(n, few, replace=False))))
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(word).combine_chunks(),
                    pa.array(numbers_of(some.column(number).combine_chunks())),
                    pa.array(np.full(few, n / few)),
                    pa.array([n] + [0] * (few - 1), pa.int64()),
                ],
                names=["word", "number", "weight", "n"],
            )

    found = rows.mapInArrow(sample, "word string, number long, weight double, n long").toArrow()  # one in ROWS_PER_KEY
    keys = zip(found.column("word").to_pylist(), found.column("number").to_pylist(), found.column("weight").to_pylist())
    return sum(found.column("n").to_pylist()), sorted((w.encode(), i, weight) for w, i, weight in keys)


def range_bounds(keys: list[tuple[bytes, int, float]], files: int) -> tuple[list[bytes], np.ndarray]:
    """The last keys of all files but one, as words and numbers."""
    share = np.cumsum([weight for _, _, weight in keys])
    chosen = sorted({keys[i][:2] for i in np.searchsorted(share, share[-1] * np.arange(1, files) / files)} if keys else ())
    return [word for word, _ in chosen], np.array([number for _, number in chosen], dtype=np.int64)


def pieces(chunk: pa.Table, order: list[str], bounds: tuple[list[bytes], np.ndarray]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of ``chunk`` in order, cut by range."""
    words = chunk.column(order[0]).combine_chunks().dictionary_encode()
    places = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(places), dtype=np.int64)
    rank[places] = np.arange(len(places))
    rank = rank[words.indices.to_numpy()]
    number = numbers_of(chunk.column(order[1]).combine_chunks())
    at = np.lexsort((number, rank))
    rank, number = rank[at], number[at]
    last_words, last_numbers = bounds
    part = np.zeros(len(at), dtype=np.int64)
    if last_words:
        distinct = [w.encode() for w in words.dictionary.take(pa.array(places)).to_pylist()]
        low = np.array([bisect_left(last_words, w) for w in distinct])
        high = np.array([bisect_right(last_words, w) for w in distinct])
        part = low[rank]
        for word in np.flatnonzero(high > low):  # words that ranges end in
            start, stop = np.searchsorted(rank, [word, word + 1])
            part[start:stop] += np.searchsorted(last_numbers[low[word] : high[word]], number[start:stop], side="left")
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)]
    ordered = chunk.take(pa.array(at))
    for start, stop in zip(edges, edges[1:]):
        yield int(part[start]), ordered.slice(start, stop - start)


def packed(piece: pa.Table) -> bytes:
    """``piece`` as one block; small ones are mostly names and sizes, so it is compressed as a whole."""
    numbers = [f.name for f in piece.schema if pa.types.is_integer(f.type)]
    lists = [f.name for f in piece.schema if pa.types.is_list(f.type) and pa.types.is_integer(f.type.value_type)]
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as whole:
        pq.write_table(
            piece,
            whole,
            compression="none",
            use_dictionary=[f.name for f in piece.schema if pa.types.is_string(f.type)],
            column_encoding={column: "DELTA_BINARY_PACKED" for column in [*numbers, *(f"{name}.list.element" for name in lists)]},
            write_statistics=False,
            store_schema=False,
        )
    return sink.getvalue().to_pybytes()
