"""URL filter: many glob rules run at once as a bit-parallel automaton (Shift-And with gaps)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules by place: (verdict, host, path). A rule fits its host, all subdomains, and paths that start with its own.
PLACE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Globs over the canonical URL, for what no place rule fits: spam hosts and files that are not pages.
BLOCK_GLOBS = [
    "*cheap-pills*/**",
    "*casino*/**",
    "*free-download*/**",
    "*/**.exe",
    "*/**.zip",
    "*/**wp-login.php**",
    "*/**cgi-bin/**",
]


@dataclass(frozen=True)
class Automaton:
    """Globs packed side by side into 64-bit words.

    Bit ``s`` of a pattern says that its first ``s`` symbols match what was read. Reading a character
    shifts every bit by one and keeps those whose symbol is that character; a bit before ``**`` also
    stays where it is, and one before ``*`` stays on any character but ``/``. ``?`` is any one character.
    All patterns advance in the same few word operations.
    """

    alphabet: np.ndarray  # sorted code points that patterns name
    steps: np.ndarray  # (alphabet + 1, words): states that the character may enter
    loops: np.ndarray  # (alphabet + 1, words): states that stay on the character
    start: np.ndarray  # (words,)
    ends: tuple[tuple[int, int], ...]  # word and bit of each pattern's last state

    @classmethod
    def of(cls, globs: list[str]) -> Automaton:
        symbols, anywhere, inside, start, ends, size = [], [], [], [], [], 0
        for glob in globs:
            start.append(size)
            for part in re.findall(r"\*\*|(?s:.)", glob):
                if part == "**":
                    anywhere.append(size)
                elif part == "*":
                    inside.append(size)
                else:
                    size += 1
                    symbols.append((size, part))
            ends.append(divmod(size, 64))
            size += 1
        words = max(1, -(-size // 64))
        alphabet = np.array(sorted({ord("/")} | {ord(c) for _, c in symbols if c != "?"}), dtype=np.uint32)

        def mask(bits: list[int]) -> np.ndarray:
            out = np.zeros(words, dtype=np.uint64)
            for b in bits:
                out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
            return out

        rows = [mask([b for b, c in symbols if c == "?" or ord(c) == a]) for a in alphabet.tolist()]
        steps = np.stack([*rows, mask([b for b, c in symbols if c == "?"])])
        stay = [mask(anywhere) | (mask(inside) if a != ord("/") else np.uint64(0)) for a in [*alphabet.tolist(), None]]
        return cls(alphabet, steps, np.stack(stay), mask(start), tuple(ends))

    def matches(self, texts: list[str]) -> np.ndarray:
        """(texts, patterns) booleans. Texts advance together, a character at a time; ended ones drop out."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "replace"), dtype=np.uint32)
        found = np.searchsorted(self.alphabet, points)
        known = found < len(self.alphabet)
        known[known] = self.alphabet[found[known]] == points[known]
        codes = np.where(known, found, len(self.alphabet))
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(order) else lengths
        state = np.repeat(self.start[None, :], len(order), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        active = len(order)
        for place in range(int(lengths[0]) if len(order) else 0):
            active = int(np.searchsorted(-lengths, -place, side="left"))
            now = state[:active]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            read = codes[begins[:active] + place]
            state[:active] = (moved & self.steps[read]) | (now & self.loops[read])
        out = np.zeros((len(order), len(self.ends)), dtype=bool)
        for j, (word, bit) in enumerate(self.ends):
            out[order, j] = (state[:, word] >> np.uint64(bit)) & one
        return out


def canonical(url: Column) -> tuple[Column, Column]:
    """``(host, path)``: after the first ``://``, host A-Z lower-cased; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    no_query = F.coalesce(F.regexp_extract(rest, r"^([^?#]*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(no_query, r"^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(no_query, r"^[^/]*((?s).*)$", 1)


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = PLACE_RULES,
    globs: list[str] = BLOCK_GLOBS,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every URL: ``(id, host, path, rule, verdict)``, one row per input row.

    The longest fitting place rule (``host + path``) decides; of equally long ones the blocking, then the
    smaller. Where none fits, a URL that matches one of ``globs`` is blocked and any other allowed.
    Each place rule is run as two globs, ``host/path**`` and ``*.host/path**``, with the rest in one automaton.

    Null and empty URLs, and URLs without ``://``, have an empty host and path, no rule, and are allowed.
    Characters ``*`` and ``?`` of a URL are plain characters. Repeated rows are judged alike; other columns,
    whatever their names, are left out. Every URL is read whole. There is no shuffle.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    patterns = [p for _, host, path in ordered for p in (f"{host}{path}**", f"*.{host}{path}**")]
    automaton = Automaton.of(patterns + list(globs))
    names = [host + path for _, host, path in ordered]
    verdicts = [verdict for verdict, _, _ in ordered]

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        hit = automaton.matches([h + p for h, p in zip(host, path)])
        by_place = hit[:, : 2 * len(names)].reshape(len(host), len(names), 2).any(axis=2)
        spam = hit[:, 2 * len(names) :].any(axis=1)
        first = np.where(by_place.any(axis=1), by_place.argmax(axis=1), -1) if names else np.full(len(host), -1)
        rule = [names[i] if i >= 0 else None for i in first]
        verdict = [verdicts[i] if i >= 0 else "block" if s else "allow" for i, s in zip(first, spam)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
            names=[id_col, "host", "path", "rule", "verdict"],
        )

    host, path = canonical(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                yield judge(batch.slice(start, 2048))

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _regex(glob: str) -> str:
    parts = re.findall(r"\*\*|(?s:.)", glob)
    return "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p) or re.escape(p) for p in parts)


def _sql() -> str:
    """DuckDB SQL for the rows of :func:`filter_urls` over ``pages`` with the default rules."""
    ordered = sorted(PLACE_RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = {
        h + p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered
    }
    rule = " ".join(f"WHEN {fits[h + p]} THEN '{h + p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in ordered)
    spam = " OR ".join(f"regexp_full_match(host || path, '{_regex(g)}', 's')" for g in BLOCK_GLOBS)
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0
                 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
    split AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/]*') AS raw, coalesce(rest, '') AS rest FROM cut),
    parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     substr(rest, length(raw) + 1) AS path FROM split),
    ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN {spam} THEN 'block' ELSE 'allow' END END AS verdict
    FROM ruled"""


SQL = _sql()
