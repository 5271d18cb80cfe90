"""Repair of conversations: the cheapest edits after which roles alternate and no turn is blank or repeated.

Every way to edit is a path in a graph: a node is a place between two rows and the role that came last, an edge an edit.
An edge weighs one big integer. Its high digits are the cost; below them every edit has a digit of fixed width, in the
order of the edits, and zeros fill the end. So the integer minimum is the cheapest path, and of equally cheap ones the
one whose letters come first in ASCII.

Rows are range-partitioned in order. A conversation that lies within one bucket and one block is settled there. One that
does not, be it as long as the table, is cut into blocks; each becomes the least weights from every role before it to
every role after it, and those tables are multiplied in a tree. Two paths through the same rows that cost the same differ
before either ends, so the least weight of a block is the least one whatever follows it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnsearch.llm.common import join_hot, store

BLOCK_ROWS = 256
BLOCK_CHARS = 1 << 20
ROWS_PER_BUCKET = 250_000
FAN = 16

WHITE = " \t\n\x0b\x0c\r"
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
LEGAL = ("su", "ua", "au")
#: Roles that came last: none, system, user, assistant; after each the one that may be put next.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPS = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: What may still be inserted after the last row: cost and letters.
ENDS = {NONE: (0, ""), SYSTEM: (10, "II"), USER: (5, "I"), ASSISTANT: (0, "")}
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
DIGITS = {ord(letter): str(digit) for digit, letter in enumerate("DIKR", start=1)}
LETTERS = {ord(digit): chr(letter) for letter, digit in DIGITS.items()}
WIDTH = 3

SUMMARY = (
    "n_rows long, first_initial string, last_initial string, first_turn long, last_turn long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
)
RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def weight(cost: int, audit: str, length: int) -> int:
    """Cost above, then one octal digit a letter, then zeros up to ``length`` digits."""
    return (cost << WIDTH * length) | int("0" + audit.translate(DIGITS).ljust(length, "0"), 8)


def meaning(value: int, length: int) -> tuple[int, str]:
    """The cost and letters of a :func:`weight`."""
    digits = format(value & ((1 << WIDTH * length) - 1), "o").zfill(length)
    return value >> WIDTH * length, digits.rstrip("0").translate(LETTERS)


def edges_of(initial: str, fault: int) -> list[list[tuple[int, int, int, int]]]:
    """For each role before a row the edges over it, with up to two insertions first: ``(cost, digits, letters, role)``.

    Three insertions in one place are never cheapest: without two of them the roles that follow are the same.
    """
    out = []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {}

        def offer(role: int, cost: int, letters: str) -> None:
            best[role] = min(best.get(role, (cost, letters)), (cost, letters))

        role, cost, letters = before, 0, ""
        for _ in range(3):
            offer(role, cost + DELETE, letters + "D")
            if fault in (SOUND, TRUNCATED):
                stays = LEFT_TRUNCATED if fault == TRUNCATED else 0
                if (initial, role) in KEEPS:
                    offer(KEEPS[initial, role], cost + KEEP + stays, letters + "K")
                offer(NEXT[role], cost + REROLE + stays, letters + "R")
            role, cost, letters = NEXT[role], cost + INSERT, letters + "I"
        out.append([(c, int(s.translate(DIGITS), 8), len(s), r) for r, (c, s) in best.items()])
    return out


def settle(rows: list[list], least: list[int | None], length: int) -> list[int | None]:
    """The least weight from each role before ``rows`` to the end, given those after them, by one pass backwards."""
    shift = WIDTH * length
    mask = (1 << shift) - 1
    for edges in reversed(rows):
        after = [None if w is None else (w >> shift, w & mask) for w in least]
        least = [
            min(
                (
                    ((cost + after[role][0]) << shift) | (digits << (shift - WIDTH * n)) | (after[role][1] >> WIDTH * n)
                    for cost, digits, n, role in edges[before]
                    if after[role] is not None
                ),
                default=None,
            )
            for before in range(4)
        ]
    return least


class Rows:
    """Rows of one conversation in order, with what is told about them."""

    def __init__(self, known: dict):
        self.known = known
        self.roles, self.texts, self.faults, self.turns, self.chars = [], [], [], [], 0

    def add(self, turn, role, text, fault) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.turns.append(turn)
        self.chars += len(role) + len(text)

    def full(self) -> bool:
        return len(self.roles) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def edges(self) -> list[list]:
        found = []
        for role, fault in zip(self.roles, self.faults):
            kind = role[:1], fault
            if kind not in self.known:
                self.known[kind] = edges_of(*kind)
            found.append(self.known[kind])
        return found

    def cheapest(self) -> tuple[int, str]:
        """Cost and letters if these are all rows of the conversation."""
        length = 3 * len(self.roles) + 2
        ends = [weight(*ENDS[role], length) for role in range(4)]
        return meaning(settle(self.edges(), ends, length)[NONE], length)

    def table(self) -> tuple[list, list]:
        """Least cost and letters from each role before to each role after, 16 of both."""
        length, edges = 3 * len(self.roles) + 2, self.edges()
        columns = [settle(edges, [0 if r == after else None for r in range(4)], length) for after in range(4)]
        cells = [columns[after][before] for before in range(4) for after in range(4)]
        pairs = [(None, None) if w is None else meaning(w, length) for w in cells]
        return [cost for cost, _ in pairs], [audit for _, audit in pairs]

    def summary(self, with_table: bool) -> dict:
        initials = [role[:1] for role in self.roles]
        turns = [t for t in self.turns if t is not None]
        costs, audits = self.table() if with_table else (None, None)
        return {
            "n_rows": len(self.roles),
            "first_initial": initials[0],
            "last_initial": initials[-1],
            "first_turn": turns[0] if turns else None,
            "last_turn": turns[-1] if turns else None,
            "turns": len(set(turns)),
            "blank": self.faults.count(BLANK),
            "duplicate": self.faults.count(DUPLICATE),
            "truncated": self.faults.count(TRUNCATED),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "costs": costs,
            "audits": audits,
        }


def combined(a: dict | None, b: dict) -> dict:
    """The summary of neighbouring rows, ``a`` before ``b``."""
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in ("n_rows", "turns", "blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["first_initial"], out["last_initial"] = a["first_initial"], b["last_initial"]
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    longest = [max(len(s) for s in x["audits"] if s is not None) for x in (a, b)]
    length = sum(longest)
    pairs = []
    for before in range(4):
        for after in range(4):
            ways = [(4 * before + mid, 4 * mid + after) for mid in range(4)]
            found = [
                weight(a["costs"][i] + b["costs"][j], a["audits"][i] + b["audits"][j], length)
                for i, j in ways
                if a["costs"][i] is not None and b["costs"][j] is not None
            ]
            pairs.append(meaning(min(found), length) if found else (None, None))
    out["costs"], out["audits"] = [c for c, _ in pairs], [s for _, s in pairs]
    return out


def finished(summary: dict, cheapest: tuple[int, str] | None = None) -> dict:
    """The result columns but the digest; ``cheapest`` if the summary has no table."""
    if cheapest is None:
        length = max(len(s) for s in summary["audits"] if s is not None) + 2
        cells = zip(summary["costs"][:4], summary["audits"][:4], (ENDS[role] for role in range(4)))
        cheapest = meaning(min(weight(c + e, s + i, length) for c, s, (e, i) in cells if c is not None), length)
    first, last = summary["first_turn"], summary["last_turn"]
    out = {k: summary[k] for k in ("blank", "duplicate", "truncated", "illegal")}
    gaps = 0 if first is None else last - first + 1 - summary["turns"]
    return out | {"gaps": gaps, "cost": cheapest[0], "audit": cheapest[1]}


def repaired(roles: list, texts: list, edits: str, put: int, odd: bool) -> list[tuple[str, str]]:
    """The rows that ``edits`` make of these, ``put`` having come before.

    Roles alternate up to an assistant, so their number being ``odd`` says that a system row comes first.
    """
    rows, out = zip(roles, texts), []
    for letter in edits:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if (put + len(out) + odd) % 2 else "user"
        out.append((role, text))
    return out


def joined(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _faults(rows: DataFrame) -> DataFrame:
    """``rows(conv, turn, role, text, copy, place)`` with ``fault``, their first one, and ``d1``, a digest of the text."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumns(
        {
            "blank": trimmed == "",
            "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"),
            "d1": F.xxhash64(F.lit(1), "conv", "role", "text"),
            "d2": F.xxhash64(F.lit(2), "conv", "role", "text"),
        }
    )
    rows = store(rows, "conversation-rows")
    order = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0).cast("long")), "copy", "place")
    seen = rows.filter("NOT blank").groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(order)["place"].alias("first"))
    met = join_hot(rows, seen.filter("n > 1"), ["d1", "d2"], "n", rows.count())
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("first") != F.col("place"), DUPLICATE)
        .when(F.col("cut"), TRUNCATED)
        .otherwise(SOUND)
    )
    return met.select("conv", "turn", "role", "text", "copy", "place", "d1", fault.alias("fault"))


def _blocks(rows: DataFrame) -> DataFrame:
    """``(conv, bucket, seq, n, roles, texts, summary, cost, audit)``: a row per block.

    Settled conversations have cost and letters. Of the others, the last block in a bucket has the summary of all of the
    conversation's rows in that bucket.
    """
    spark = rows.sparkSession
    rows = store(rows, "conversation-faults")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_BUCKET))
    order = ["conv", "turn", "role", "d1", "copy", "place"]
    ranged = rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv"].dataType.simpleString()
    schema = (
        f"conv {kind}, bucket int, seq int, n long, roles array<string>, texts array<string>, "
        f"summary struct<{SUMMARY.replace(' long', ':long').replace(' string', ':string').replace(' array', ':array')}>, "
        "cost long, audit string"
    )
    arrow = pa.schema(_arrow_fields(spark, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known, seq, held, out = TaskContext.get().partitionId(), {}, 0, 0, []
        here: Rows | None = None
        conv, folded, first = None, None, True

        def block(summary: dict | None = None, cheapest: tuple = (None, None)) -> None:
            nonlocal seq, held
            out.append(
                {
                    "conv": conv,
                    "bucket": bucket,
                    "seq": seq,
                    "n": len(here.roles),
                    "roles": here.roles,
                    "texts": here.texts,
                    "summary": summary,
                    "cost": cheapest[0],
                    "audit": cheapest[1],
                }
            )
            seq += 1
            held += here.chars

        def close(last: bool) -> None:
            """Ends the conversation at hand; the first and the last one of a bucket may go on elsewhere."""
            if folded is None and not first and not last:
                block(here.summary(False), here.cheapest())
            else:
                block(combined(folded, here.summary(True)))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault")]
            for row_conv, turn, role, text, fault in zip(*columns):
                if here is None:
                    here, conv = Rows(known), row_conv
                elif row_conv != conv:
                    close(last=False)
                    here, conv, folded, first = Rows(known), row_conv, None, False
                elif here.full():
                    folded = combined(folded, here.summary(True))
                    block()
                    here = Rows(known)
                here.add(turn, role, text, fault)
                if len(out) >= 256 or held >= 8 * BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out.clear()
                    held = 0
        if here is not None:
            close(last=True)
            yield pa.RecordBatch.from_pylist(out, arrow)

    return store(ranged.select("conv", "turn", "role", "text", "fault").mapInArrow(run, schema), "conversation-blocks")


def _arrow_fields(spark, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(schema)))


def _unsettled(blocks: DataFrame) -> DataFrame:
    """``(conv, gaps, ..., cost, audit)`` of conversations in several blocks or buckets, by a tree of ``FAN`` branches."""
    spark = blocks.sparkSession
    fields = [f.split()[0] for f in SUMMARY.split(", ")]
    kind = blocks.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, bucket int, {SUMMARY}"
    arrow = pa.schema(_arrow_fields(spark, schema))
    parts = blocks.filter("cost IS NULL AND summary IS NOT NULL").select("conv", "bucket", *[f"summary.{f}" for f in fields])

    def fold(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: r["bucket"])
        whole = None
        for row in found:
            whole = combined(whole, {f: row[f] for f in fields})
        return pa.Table.from_pylist([{"conv": found[0]["conv"], "bucket": found[0]["bucket"] // FAN} | whole], arrow)

    last = parts.agg(F.max("bucket")).first()[0] or 0
    while True:
        branch = F.floor(F.col("bucket") / FAN).alias("branch")
        # a bucket has two such conversations at most, so the tree narrows
        folded = parts.groupBy("conv", branch).applyInArrow(fold, schema).coalesce(1 + last // FAN)
        parts = store(folded, "conversation-tree")
        if last < FAN:
            break
        last //= FAN

    results = [f"{f.split()[0]} {f.split()[1]}" for f in RESULT.split(", ")[:-1]]
    arrow_out = pa.schema(_arrow_fields(spark, f"conv {kind}, {', '.join(results)}"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [{"conv": r["conv"]} | finished({f: r[f] for f in fields}) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(done, arrow_out)

    return parts.mapInArrow(finish, f"conv {kind}, {', '.join(results)}")


def _pieces(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv, bucket, seq, edits, put, odd)``: the letters of ``found(conv, audit)`` that fall to each block."""
    kind = blocks.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, bucket int, seq int, edits string, put long, odd boolean"

    def split(sizes: pa.Table, audits: pa.Table) -> pa.Table:
        order = sorted(zip(*(sizes.column(c).to_pylist() for c in ("bucket", "seq", "n"))))
        audit = audits.column("audit")[0].as_py()
        ends = [i + 1 for i, letter in enumerate(audit) if letter != "I"]
        n_put = len(audit) - audit.count("D")
        edits, puts, at, taken, put = [], [], 0, 0, 0
        for i, (_, _, n) in enumerate(order):
            taken += n
            stop = len(audit) if i + 1 == len(order) else ends[taken - 1]
            edits.append(audit[at:stop])
            puts.append(put)
            put += stop - at - edits[-1].count("D")
            at = stop
        conv = sizes.column("conv")[0].as_py()
        return pa.table(
            {
                "conv": pa.array([conv] * len(order), sizes.schema.field("conv").type),
                "bucket": pa.array([o[0] for o in order], pa.int32()),
                "seq": pa.array([o[1] for o in order], pa.int32()),
                "edits": pa.array(edits, pa.string()),
                "put": pa.array(puts, pa.int64()),
                "odd": pa.array([bool(n_put % 2)] * len(order), pa.bool_()),
            }
        )

    sizes = blocks.filter("cost IS NULL").select("conv", "bucket", "seq", "n")
    return sizes.groupBy("conv").cogroup(found.select("conv", "audit").groupBy("conv")).applyInArrow(split, schema)


def _repaired_blocks(blocks: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, bucket, seq, roles, texts)`` after the edits, of settled conversations and of the others."""
    odd = F.pmod(F.length(F.translate("audit", "D", "")), F.lit(2)) == 1
    edits = [F.col("audit").alias("edits"), F.lit(0).cast("long").alias("put"), odd.alias("odd")]
    settled = blocks.filter("cost IS NOT NULL").select("conv", "bucket", "seq", "roles", "texts", *edits)
    # bucket and seq name a block
    pieces = _pieces(blocks, found).drop("conv")
    others = blocks.filter("cost IS NULL").select("conv", "bucket", "seq", "roles", "texts").join(pieces, ["bucket", "seq"])
    return _edited(settled), _edited(others)


def _edited(blocks: DataFrame) -> DataFrame:
    kind = blocks.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, bucket int, seq int, roles array<string>, texts array<string>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                columns = [part.column(c).to_pylist() for c in ("roles", "texts", "edits", "put", "odd")]
                done = [repaired(*row) for row in zip(*columns)]
                kept = [part.column(c) for c in ("conv", "bucket", "seq")]
                lists = [pa.array([[r[i] for r in rows] for rows in done], pa.list_(pa.string())) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*kept, *lists], names=["conv", "bucket", "seq", "roles", "texts"])

    return blocks.mapInArrow(apply, schema)


def _digests(settled: DataFrame, others: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)``. A conversation in several blocks is hashed by one task, a block at a time: the digest
    has to be taken in order, but nothing has to be held."""
    kind = settled.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, repaired_sha256 string"

    def blockwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("roles", "texts")))
            hashes = [hashlib.sha256(utf8(joined(zip(*row)))).hexdigest() for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(hashes, pa.string())], names=["conv", "repaired_sha256"])

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, started, begun = None, None, False, False
        for batch in batches:
            done = []
            for row_conv, text, some in zip(*(batch.column(c).to_pylist() for c in ("conv", "piece", "some"))):
                if not begun or row_conv != conv:
                    if begun:
                        done.append((conv, state.hexdigest()))
                    conv, state, started, begun = row_conv, hashlib.sha256(), False, True
                if some:
                    state.update(utf8(("\n" if started else "") + text))
                    started = True
            yield _named(done, batch.schema.field("conv").type)
            kept_type = batch.schema.field("conv").type
        if begun:
            yield _named([(conv, state.hexdigest())], kept_type)

    whole = settled.select("conv", "roles", "texts").mapInArrow(blockwise, schema)
    lines = F.zip_with("roles", "texts", lambda role, text: F.concat(role, F.lit(":"), text))
    pieces = others.select(
        "conv", "bucket", "seq", F.array_join(lines, "\n").alias("piece"), (F.size("roles") > 0).alias("some")
    )
    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "bucket", "seq").select("conv", "piece", "some")
    return whole.unionByName(ordered.mapInArrow(in_order, schema))


def _named(done: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())], names=["conv", "repaired_sha256"]
    )


def prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copy: Column | None = None) -> DataFrame:
    """``(conv, turn, role, text, copy, place)``; a null role or text becomes one space."""
    return rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        (F.lit(0) if copy is None else copy).alias("copy"),
        F.monotonically_increasing_id().alias("place"),
    )


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results and repaired turns of ``rows(conv, turn, role, text, copy, place)`` as :func:`prepared` gives them.

    Results are ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, turns are
    ``(conv, at, role, text)`` with ``at`` rising within a conversation. Rows are taken by turn, null turns first, rows of
    one turn by role, then by a digest of the text, then by ``copy`` and ``place``. Rows that are equal in all count as
    repeats of the first. A null conversation is one conversation. Roles are read by their first character; an empty role
    fits nowhere. A row of white space, as a null text becomes, is blank. Very long conversations are cut into blocks; only
    their letters and, block by block, their digest go through one task, both being one value of one row. An empty table
    gives empty results.
    """
    blocks = _blocks(_faults(rows))
    fields = [f.split()[0] for f in RESULT.split(", ")[:-1]]
    own = blocks.filter("cost IS NOT NULL").select(
        "conv",
        F.when(F.col("summary.turns") == 0, 0)
        .otherwise(F.expr("summary.last_turn - summary.first_turn + 1 - summary.turns"))
        .cast("long")
        .alias("gaps"),
        *[F.col(f"summary.{f}").alias(f) for f in fields[1:5]],
        "cost",
        "audit",
    )
    unsettled = _unsettled(blocks)
    done = _repaired_blocks(blocks, unsettled)
    found = own.unionByName(unsettled.select(*own.columns))
    digest = _digests(*done).withColumnRenamed("conv", "hashed")
    found = found.join(digest, F.col("conv").eqNullSafe(F.col("hashed"))).drop("hashed")
    at = (F.col("bucket").cast("long") * (1 << 40)) + F.col("seq").cast("long") * (1 << 20) + F.col("place")
    turns = done[0].unionByName(done[1]).select("conv", "bucket", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row"))
    return found, turns.select("conv", at.alias("at"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with the faults that a checksum of ``conv_id:turn`` chooses, as :func:`prepared` rows.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 sets the role to
    user. Nulls stand as one space in the checked string too.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("kind"),
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        copies.alias("copy"),
    )
    return prepared(rows, "conv_id", "turn", "role", "text", F.col("copy"))


def digest(conversations: DataFrame) -> DataFrame:
    """Every original ``conv_id``, damaged and repaired; one without rows left has zeros and the digest of nothing."""
    found, _ = repair(damaged(conversations))
    ids = conversations.select("conv_id").distinct()
    fields = [f.split() for f in RESULT.split(", ")]
    nothing = hashlib.sha256(b"").hexdigest()
    empty = {"audit": "", "repaired_sha256": nothing}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(F.col(f), F.lit(empty.get(f, 0)).cast(kind)).alias(f) for f, kind in fields]
    )
