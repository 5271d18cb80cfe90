"""Best-fit packing of tokenised documents into sequences of fixed length, by linear grouping."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnsearch.llm.common import per_worker, store

LENGTH = 1024
END = 2
GROUPS = 1024
SMALL_SHARE = 4
LONG_GAP = 4096
#: Fixed value: the characters of the property White_Space, as ``\s`` means them in the pattern below.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GAP = f"[{SPACES}]{{{LONG_GAP},}}"
#: Fixed value: the pre-tokenizer pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoding(path: str):
    return per_worker(f"encoding {path}", lambda: _read_encoding(path))


def _read_encoding(path: str):
    """The vocabulary and added tokens of a byte-level BPE ``tokenizer.json`` in the faster of two equal encoders."""
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    added = {t["content"]: t["id"] for t in stored.get("added_tokens") or []}
    ranks = {}
    for token, rank in stored["model"]["vocab"].items():
        if all(c in letters for c in token) and token not in added:
            ranks[bytes(letters[c] for c in token)] = rank
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def without_long_gaps(text: str, ends: tuple[str, ...] = ()) -> Iterator[tuple[str, bool]]:
    """``text`` in parts, each with whether it is one pre-token: runs of ``LONG_GAP`` or more white-space characters are
    cut out, since the pattern looks ahead from each of their characters and the matcher's memory is bounded.

    The pattern takes such a run as one pre-token, but leaves its last character to what follows, if anything does. The
    text ends for it where one of the added tokens ``ends`` begins.
    """
    begin = 0
    for gap in re.finditer(GAP, text):
        followed = gap.end() < len(text) and not text.startswith(ends, gap.end())
        stop = gap.end() - followed
        if gap.start() > begin:
            yield text[begin : gap.start()], False
        yield text[gap.start() : stop], True
        begin = stop
    if begin < len(text):
        yield text[begin:], False


def encoder(path: str, added: bool = False) -> Callable[[str | None], bytes]:
    """Whole text to ids, packed as little-endian unsigned 32-bit numbers; with ``added``, added tokens in it are one id each."""
    encoding, allowed = _encoding(path), "all" if added else set()
    ends = tuple(encoding.special_tokens_set) if added else ()

    def ids(text: str | None) -> bytes:
        found = array("I")
        for part, one_token in without_long_gaps(text or "", ends):
            if one_token:
                found.extend(encoding._encode_single_piece(part))
            else:
                found.extend(encoding.encode(part, allowed_special=allowed, disallowed_special=()))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    return ids


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, length: int, with_ids: bool) -> DataFrame:
    """A row per piece: where it starts, its length, CRC, and which of its length it is in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path, added=True), TaskContext.get().partitionId(), np.zeros(length + 1, dtype=np.int64)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                owner, piece, start, size, crc, nth, ids = [], [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    data = encode(text) + end
                    n = len(data) // 4
                    head = n % length or length
                    cuts = [0, *range(head, n + 1, length)]
                    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(i)
                        piece.append(k)
                        start.append(low)
                        size.append(high - low)
                        crc.append(zlib.crc32(memoryview(data)[4 * low : 4 * high]))
                        nth.append(int(seen[high - low]))
                        seen[high - low] += 1
                        if with_ids:
                            ids.append(np.frombuffer(data, dtype="<i4")[low:high])
                columns = [
                    part.column("id").take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([task] * len(owner), pa.int32()),
                    pa.array(nth, pa.int64()),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return rows.mapInArrow(cut, schema + ", ids array<int>" * with_ids)


class Plan:
    """Which document of which length goes to which sequence, as runs: document ``rank + i`` of length ``size``
    to sequence ``first + i`` at ``offset``. It is made from the counts of each length alone, so its
    size depends on the sequence length and not on the number of documents.
    """

    def __init__(self, length: int) -> None:
        self.length = length
        self.used: dict[int, int] = defaultdict(int)  # documents of a length placed so far
        self.runs: list[tuple[int, int, int, int]] = []  # size, rank, first sequence, offset
        self.sequences = 0
        self.room: dict[int, list[list[int]]] = defaultdict(list)  # free tokens -> [first sequence, count]
        self.sizes: list[int] = []  # the free sizes there are, sorted

    def place(self, size: int, count: int, first: int, offset: int) -> None:
        self.runs.append((size, self.used[size], first, offset))
        self.used[size] += count

    def free(self, first: int, count: int, room: int) -> None:
        if count and room:
            if not self.room[room]:
                insort(self.sizes, room)
            self.room[room].append([first, count])

    def best_fit(self, size: int, count: int) -> None:
        """Put ``count`` documents of ``size`` where the least room is left, else into new sequences."""
        while count:
            i = bisect_left(self.sizes, size)
            if i < len(self.sizes):
                room = self.sizes[i]
                first, there = self.room[room].pop()
                if not self.room[room]:
                    self.sizes.pop(i)
            else:
                room, first, there = self.length, self.sequences, -(-count // (self.length // size))
                self.sequences += there
            each = min(room // size, count)
            bins = min(there, count // each)
            for k in range(each):
                self.place(size, bins, first, self.length - room + k * size)
            count -= bins * each
            self.free(first, bins, room - each * size)
            if there > bins:
                self.free(first + bins, there - bins, room)


def _best_configuration(sizes: np.ndarray, counts: np.ndarray, length: int) -> list[int]:
    """Which sizes (descending; a place in ``sizes`` each) fill a sequence best, the largest one left being among them."""
    last = np.full(length + 1, -1)  # room taken -> the size that was put in last
    biggest = int(np.flatnonzero(counts)[0])
    last[sizes[biggest]] = biggest
    for i in np.flatnonzero(counts):
        size, new = int(sizes[i]), last >= 0
        for _ in range(int(min(counts[i] - (i == biggest), (length - sizes[biggest]) // size))):
            step = np.zeros(length + 1, dtype=bool)
            step[size:] = new[:-size] & (last[size:] < 0)
            if not step.any():
                break
            last[step] = i
            new = step
        if last[length] >= 0:
            break
    total, used = int(np.flatnonzero(last >= 0)[-1]), []
    while total:
        used.append(int(last[total]))
        total -= int(sizes[used[-1]])
    return used[::-1]


def plan(counts: dict[int, int], length: int, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> Plan:
    """Linear grouping over ``counts`` of documents by length.

    Full lengths fill a sequence each. Other lengths above ``length / small_share`` are large. Sorted, they are cut into ``groups`` groups of equally
    many documents and rounded up to their group's largest length. Over these few sizes, configurations are
    chosen that fill a sequence best around the largest size left, each used as often as its
    documents last. Then the documents themselves, longest first, take their group's places, which leaves
    the room that rounding took; that room, and new sequences, take the small ones by best fit.
    """
    out = Plan(length)
    out.best_fit(length, counts.get(length, 0))
    large = sorted((s for s in counts if length < s * small_share < length * small_share and counts[s]), reverse=True)
    total = sum(counts[s] for s in large)
    queues: list[list[list[int]]] = []  # of each group: [length, documents], longest first
    left, each = 0, max(1, -(-total // groups))
    for size in large:
        todo = counts[size]
        while todo:
            if not left:
                queues.append([])
                left = each
            take = min(todo, left)
            queues[-1].append([size, take])
            todo, left = todo - take, left - take
    # groups that were rounded to the same size are one
    merged: list[list[list[int]]] = []
    for queue in queues:
        if merged and merged[-1][0][0] == queue[0][0]:
            merged[-1] += queue
        else:
            merged.append(queue)
    sizes, number = np.array([q[0][0] for q in merged], dtype=int), np.array([sum(n for _, n in q) for q in merged], dtype=int)
    while number.any():
        need = Counter(_best_configuration(sizes, number, length))
        times = min(int(number[i]) // n for i, n in need.items())
        done = 0
        while done < times:
            # as many sequences as can take documents of the same lengths throughout
            run, picks = times - done, []
            for i, n in need.items():
                size, there = merged[i][0]
                if there >= n:
                    run = min(run, there // n)
                    picks += [(i, size, n)]
                else:
                    run = 1
                    rest = n
                    for size, there in merged[i]:
                        take = min(rest, there)
                        picks.append((i, size, take))
                        rest -= take
                        if not rest:
                            break
            first, offset = out.sequences, 0
            out.sequences += run
            for i, size, n in picks:
                for _ in range(n):
                    out.place(size, run, first, offset)
                    offset += size
                head = merged[i]
                head[0][1] -= run * n
                if not head[0][1]:
                    head.pop(0)
            out.free(first, run, length - offset)
            done += run
        for i, n in need.items():
            number[i] -= n * times
    for size in sorted((s for s in counts if s * small_share <= length), reverse=True):
        out.best_fit(size, counts[size])
    return out


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    length: int = LENGTH,
    groups: int = GROUPS,
    small_share: int = SMALL_SHARE,
    with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, and ``ids`` with ``with_ids``: a row per piece.

    Every whole text is tokenised as by `tokenizers` with ``add_special_tokens=False``, so a literal added token such as
    ``<|endoftext|>`` is one id. It is followed by the id 2 and only cut if longer than ``length``: the first
    piece takes what does not fill a sequence, the others are full. Pieces are written to the shared
    folder once. The driver gets the number of pieces of each length (at most ``length`` numbers) and
    makes the plan (see :func:`plan`); a piece finds its place by its rank among those of its length: its
    place within its task, counted while tokenising, behind the pieces of earlier tasks.

    A null or empty text is one piece holding the end id. Rows with null or repeated ids are packed
    like any others. Equal lengths are interchangeable, so ties change nothing but numbers. Other columns are
    left out; an empty table gives an empty result. ``tokenizer`` is a byte-level BPE ``tokenizer.json``.
    """
    path = tokenizer or tokenizer_path()
    pieces = store(tokenised_pieces(docs, id_col, text_col, path, length, with_ids), "packing-pieces")
    numbers = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in numbers.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(counts, length, groups, small_share)
    runs = np.array(sorted(made.runs), dtype=np.int64).reshape(-1, 4)
    before = numbers.select(
        F.col("task").alias("t"),
        F.col("length").alias("l"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("earlier"),
    )
    ranked = pieces.join(before, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l")))
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("nth")).drop("t", "l", "earlier", "task", "nth")
    # one sorted key for (length, rank): ranks stay below 2**50
    keys = runs[:, 0] * (1 << 50) + runs[:, 1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, size * (1 << 50) + rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(runs[at, 2] + rank - runs[at, 1], pa.int64()),
                    pa.array(runs[at, 3], pa.int64()),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(find, schema).withColumnRenamed("id", id_col)

