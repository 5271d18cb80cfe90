"""Personal data: exact patterns, and terms that reveal a protected entity by corpus co-occurrence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnsearch.llm.common import join_hot, store
from cairnsearch.llm.exact_dedup import deduplicate

KINDS = ("email", "ip", "card", "phone")
#: Documents' worth of prior belief that a term tells nothing.
SMOOTHING = 1.0
GENERALISE = 0.6
REMOVE = 0.8
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts within a run of digits, so looking at its start only keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TERM = regex.compile(r"\p{L}+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, found from their @: the local part reaches left to the last match or foreign character."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind, then start."""
    spans = [(0, s, e) for s, e in _emails(text)]
    if not DIGIT.search(text):
        return spans
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((3, *m.span()))
    return spans


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document: its base spans, a hash of its text, and if it has spans the entities and all terms outside them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        place = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                spans_of, entities_of, terms_of, copies = [], [], [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    terms, covered, at = [], sorted((s, e) for _, s, e in spans), 0
                    ends = list(accumulate((e for _, e in covered), max))
                    for m in TERM.finditer(text) if spans else ():
                        low, high = m.span()
                        while at < len(covered) and covered[at][0] < high:
                            at += 1
                        if not at or ends[at - 1] <= low:
                            terms.append({"term": m[0].lower(), "start": low, "end": high})
                    copies.append(_hash(text) if spans else 0)
                    spans_of.append([dict(zip(("kind", "start", "end"), x)) for x in spans])
                    entities_of.append(sorted({_hash(f"{kind}:{text[s:e].lower()}") for kind, s, e in spans}))
                    terms_of.append(terms)
                numbers = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                found = [(copies, pa.int64()), (spans_of, pa.list_(span)), (entities_of, pa.list_(pa.int64())), (terms_of, pa.list_(place))]
                yield pa.RecordBatch.from_arrays(
                    [numbers, part.column("id"), *[pa.array(x, kind) for x, kind in found]],
                    names=["row", "id", "copy", "spans", "entities", "places"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        find,
        f"row long, id {dict(rows.dtypes)['id']}, copy long, spans array<struct<kind:int,start:int,end:int>>, "
        "entities array<bigint>, places array<struct<term:string,start:int,end:int>>",
    )


def disclosing_terms(
    found: DataFrame, docs: DataFrame, id_col: str, text_col: str, generalise: float = GENERALISE, remove: float = REMOVE, smoothing: float = SMOOTHING
) -> DataFrame:
    """``(copy, term, disclosure, action)``: terms of a text that tell enough about an entity in it, whichever they tell most about.

    The information a term gives about an entity is their pointwise mutual information; as a share of all
    there is to know about the entity, it is ``PMI(t; e) / -log p(e) = 1 + log p(e | t) / -log p(e)``.
    All probabilities are shares of all different texts. ``p(e | t)`` is smoothed: ``smoothing`` texts with the term are
    added in which the entity is as rare as everywhere, so few texts are weaker evidence than many; none are too few.

    Terms too frequent to reach ``generalise`` with any entity, even if all its texts held them, are left out by
    their frequency before pairs are made. Entities that stand in the same texts tell the same, and one of them stands for
    all: two lists that share ten thousand addresses pair their terms once, not ten thousand times.
    """
    texts = deduplicate(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_col="id")
    total = float(max(docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).distinct().count(), 1))
    own = found.filter("size(entities) > 0")
    # one row of each group of equal texts; the row's number stands for the text
    first = own.groupBy("copy").agg(F.min("row").alias("row"))
    kept = own.select("copy", "row", "entities", F.array_distinct("places.term").alias("terms"))
    once = store(kept.join(first, ["copy", "row"], "left_semi").drop("row"), "pii-once")
    entities = once.select("copy", F.explode("entities").alias("entity"))
    who = [F.bit_xor(F.xxhash64("copy", F.lit(seed))).alias(f"who{seed}") for seed in (1, 2)]
    n_entity = entities.groupBy("entity").agg(F.count("*").alias("n_entity"), *who)
    known = join_hot(entities, n_entity, ["entity"], "n_entity", entities.count()).filter(F.col("n_entity") < total)
    # of an entity in all texts there is nothing to know; those that stand in the same texts are one
    stands = F.when(F.col("n_entity") > 1, F.struct("who1", "who2"))
    held = known.select("copy", stands.alias("entity"), "n_entity").distinct()
    held = store(held, "pii-entities")
    most = held.select("n_entity").distinct().select(
        F.max(_highest(F.col("n_entity"), total, generalise, smoothing)).alias("most")
    ).first()["most"]
    terms = once.select("copy", F.explode("terms").alias("term"))
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("n_word"))
    seen = terms.groupBy("term").agg(F.count("*").alias("n_seen"))
    # a term's texts with entities are among its texts
    n_term = seen.join(counts, "term", "left").select("term", "n_seen", F.greatest(F.coalesce("n_word", "n_seen"), "n_seen").alias("n_term"))
    rare = n_term.filter(F.col("n_term") <= (most if most is not None else 0.0))
    asked = join_hot(terms, rare, ["term"], "n_seen", terms.count()).filter("n_term IS NOT NULL").select("copy", "term", "n_term")
    pairs = store(asked.join(held, "copy"), "pii-pairs")
    single = pairs.filter("entity IS NULL").withColumn("n", F.lit(1).cast("long"))
    shared = pairs.filter("entity IS NOT NULL")
    together = shared.groupBy("entity", "term").agg(F.count("*").alias("n"))
    both = single.unionByName(join_hot(shared, together, ["entity", "term"], "n", shared.count()))
    chance = F.col("n_entity") / F.lit(total)
    given = (F.col("n") + smoothing * chance) / (F.col("n_term") + smoothing)
    scored = both.groupBy("copy", "term").agg(F.max(1 + F.log(given) / F.greatest(-F.log(chance), F.lit(1e-9))).alias("disclosure"))
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    return scored.filter(F.col("disclosure") >= generalise).select("copy", "term", "disclosure", action.alias("action"))


def _highest(n_entity: Column, total: float, generalise: float, smoothing: float) -> Column:
    """The largest number of texts of a term that reaches ``generalise`` where all texts of the entity hold it."""
    chance = n_entity / F.lit(total)
    return (n_entity + smoothing * chance) / F.pow(chance, F.lit(1 - generalise)) - smoothing + 1e-6


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """``(id, spans, terms)``: the base spans of every whole text, and the disclosing terms of :func:`disclosing_terms`.

    Base spans are the leftmost non-overlapping matches of each kind that pass its check. A term is a run of letters.
    Terms are marked wherever they stand in a text that holds an entity which they disclose, so a text without base
    spans has none. Null and empty texts have no spans. Rows with null or repeated ids are looked at like any others;
    equal texts count as one and are marked alike. Other columns are left out. An empty table gives an empty result.
    """
    found = store(scanned(docs, id_col, text_col), "pii-scan")
    telling = disclosing_terms(found, docs, id_col, text_col, **limits)
    # by text: equal texts have the same marks, which are made once
    marks = telling.groupBy("copy").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"))
    some = found.filter("size(entities) > 0")
    groups = some.groupBy("copy").agg(F.count("*").alias("n"))
    known = join_hot(some, groups.join(marks, "copy"), ["copy"], "n", some.count())
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    placed = F.transform("places", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at("actions", x["term"]).alias("action")))
    terms = F.coalesce(F.array_sort(F.array_distinct(F.filter(placed, lambda x: x["action"].isNotNull()))), none)
    marked = known.select("id", "spans", terms.alias("terms"))
    plain = found.filter("size(entities) = 0").select("id", "spans", none.alias("terms"))
    return marked.unionByName(plain).withColumnRenamed("id", id_col)


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """``docs`` with base spans replaced by their kind, disclosing terms by ``[term]``, or taken out.

    ``id_col`` must be unique and not null; rows with a null id keep their text.
    """
    found = find_personal_data(docs, id_col=id_col, text_col=text_col, **limits).filter("size(spans) > 0")
    found = found.select(F.col(id_col).alias("__id"), F.col("spans").alias("__spans"), F.col("terms").alias("__terms"))
    joined = docs.join(found, docs[id_col] == found["__id"], "left").withColumn("__found", F.to_json(F.struct("__spans", "__terms")))

    @F.pandas_udf("string")
    def clean(texts, marks):
        import json

        import pandas as pd

        out = []
        for text, mark in zip(texts, marks):
            spans = json.loads(mark)
            parts = [(s["start"], s["end"], f"[{KINDS[s['kind']]}]") for s in spans.get("__spans") or []]
            parts += [(t["start"], t["end"], "" if t["action"] == "remove" else "[term]") for t in spans.get("__terms") or []]
            done, pieces = 0, []
            for start, end, new in sorted(parts):
                if start >= done:
                    pieces += [text[done:start], new]
                    done = end
            out.append(text if text is None or not parts else "".join([*pieces, text[done:]]))
        return pd.Series(out, dtype=object)

    return joined.withColumn(text_col, clean(F.col(text_col), "__found")).select(*docs.columns)


def _of_kind(kind: int) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def digest(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    return found.select(
        "doc_id",
        *[F.size(_of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(named, F.array_distinct(terms)), ",").alias("spans"),
    )
