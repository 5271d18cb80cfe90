"""Conversation repair against trying every way to edit, and a longer plain program for long conversations."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cairnsearch.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    """The damaged rows of a table, in table order."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, faults):
    """The least ``(cost, letters, roles)`` over all edits with up to two insertions in a place."""
    best = []

    def go(i, cost, letters, out):
        for k in range(3):
            put = out + [("?", "")] * k
            here, said = cost + 5 * k, letters + "I" * k
            if i == len(rows):
                finish(here, said, put)
                continue
            role, text = rows[i][2:]
            go(i + 1, here + 2, said + "D", put)
            if faults[i] in ("", "t"):
                extra = 5 * (faults[i] == "t")
                go(i + 1, here + extra, said + "K", put + [(role, text)])
                go(i + 1, here + extra + 1, said + "R", put + [("?", text)])

    def finish(cost, letters, out):
        for first in ("user", "system"):
            roles, want = [], None
            for j, (role, _) in enumerate(out):
                want = "user" if want != "user" else "assistant"
                if role == "?":
                    roles.append(want)
                elif j == 0 and role[:1] == "s":
                    roles.append(role)
                    want = None
                elif role[:1] == want[0]:
                    roles.append(role)
                else:
                    return
            if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in roles)):
                return
            best.append((cost, letters, [(r, t) for r, (_, t) in zip(roles, out)]))

    go(0, 0, "", [])
    return min(best, key=lambda b: b[:2])


def in_one_go(rows, faults):
    """The same by a memoised recursion over suffixes, for longer conversations: ``(cost, letters)``."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    best = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    for row, fault in zip(reversed(rows), reversed(faults)):
        now = {}
        for state in range(4):
            ways, s, cost, said = [], state, 0, ""
            for _ in range(3):
                steps = [(2, "D", s)]
                if fault in ("", "t"):
                    extra = 5 * (fault == "t")
                    steps.append((1 + extra, "R", after[s]))
                    if (row[2][:1], s) in keeps:
                        steps.append((extra, "K", keeps[row[2][:1], s]))
                ways += [(cost + c + best[n][0], said + letter + best[n][1]) for c, letter, n in steps]
                s, cost, said = after[s], cost + 5, said + "I"
            now[state] = min(ways)
        best = now
    return best[0]


def counts(rows, faults):
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs)


def expected(rows):
    """By conversation, of damaged rows of which those of one turn are equal."""
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append(row)
    out = {}
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        faults = faults_of(own)
        cost, letters, fixed = every_edit(own, faults)
        assert in_one_go(own, faults) == (cost, letters)
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv] = (*counts(own, faults), cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def some_rows(seed, n_conv, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Yes.", "no", "Why?", "", " \n", None, "ok!", "tail. ", "été"]
    rows = []
    for conv in range(n_conv):
        turn = rng.randrange(3)
        for i in range(rng.randrange(longest + 1)):
            role = rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0] if rng.random() < 0.5 else ("user", "assistant")[i % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"Words {rng.randrange(1000)}."
            rows.append((conv if conv else None, turn if turn else None, role, text))
            turn += rng.choice([1, 1, 1, 2, 4])
    rng.shuffle(rows)
    return rows


def test_equals_every_edit(spark):
    rows = some_rows(1, 80, 5)
    out = cr.digest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = dict.fromkeys({r[0] for r in rows}, nothing) | expected(damage(rows))
    assert got == want


def test_long_conversation_in_many_blocks(spark, monkeypatch):
    """Hundreds of rows over small blocks and buckets equal one pass over the whole, and the digest its text."""
    monkeypatch.setattr(cr, "BLOCK_ROWS", 4)
    monkeypatch.setattr(cr, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(cr, "FAN", 3)
    rng = random.Random(7)
    rows = [(c, t * 2 + (t > 50), rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", f"c{t}.", f"d{t}", ""]))
            for c, n in ((1, 300), (2, 1), (3, 40)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found, turns = cr.repair(cr.prepared(df, "conv_id", "turn", "role", "text"))
    said = {}
    for r in sorted(turns.collect(), key=lambda r: (r["conv"], r["at"])):
        said.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    for r in found.collect():
        own = [x for x in rows if x[0] == r["conv"]]
        faults = faults_of(own)
        assert (r["cost"], r["audit"]) == in_one_go(own, faults)
        assert tuple(r[c] for c in COLUMNS[:5]) == counts(own, faults)
        fixed = said.get(r["conv"], [])
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(fixed).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in fixed))
        kept = [f"{x[2]}:{x[3]}" for x, e in zip(own, r["audit"].replace("I", "")) if e == "K"]
        rest = iter(fixed)
        assert all(k in rest for k in kept)


def test_odd_rows_ties_and_empty_tables(spark):
    """Rows of one turn go by role and a digest; repeated rows are duplicates; extra columns do not matter."""
    rows = [(1, 0, "user", "Hi.", 1), (1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Yes.", 2), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", cost long").withColumns({"place": F.lit(1), "fault": F.lit("x")})
    out = {r["conv"]: r for r in cr.repair(cr.prepared(df, "conv_id", "turn", "role", "text"))[0].collect()}
    assert (out[1]["audit"], out[1]["cost"], out[1]["duplicate"]) == ("KDK", 2, 1)
    assert (out[None]["audit"], out[None]["cost"], out[None]["blank"]) == ("D", 2, 1)
    backwards = df.orderBy(F.desc("turn")).coalesce(1)
    again = {r["conv"]: r for r in cr.repair(cr.prepared(backwards, "conv_id", "turn", "role", "text"))[0].collect()}
    assert again == out
    assert cr.digest(df).count() == 2
    assert cr.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("cost,letters", [(0, ""), (3, "K"), (7, "DIKR"), (0, "DDD")])
def test_weights(cost, letters):
    assert cr.meaning(cr.weight(cost, letters, 9), 9) == (cost, letters)


def test_weights_order_like_cost_then_letters():
    pairs = [(c, s) for c in (0, 1, 9) for s in ("", "D", "DK", "DKI", "I", "K", "KD", "RRR")]
    assert sorted(pairs) == sorted(pairs, key=lambda p: cr.weight(*p, 5))
    assert functools.reduce(min, pairs) == (0, "")
