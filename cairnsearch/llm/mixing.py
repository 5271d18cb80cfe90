"""Mix sources to target weights by pivotal dependent rounding of copy numbers over a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnsearch.llm.common import broadcast_checked, store

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
FAN_IN = 100
STEPS = (10, 100)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size)`` with ``target``: shares of the whole by weight, at most ``max_copies`` times a source's size.

    Sources by code point, null last, take the weights in turn. With sources sorted by limit over weight,
    the limited ones come first: one is limited if its fair part of what the earlier ones leave reaches
    its limit. The table has a row per source, so these windows run over sources, never documents.
    """
    every = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    rows = rows.withColumn("limit", F.col("source_size") * float(max_copies)).withColumn(
        "whole", F.sum("source_size").over(every).cast("double")
    )
    by_limit = every.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("earlier", F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit"))
    rows = rows.withColumn("heavy", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("whole") - F.col("earlier")) / F.col("heavy")
    rows = rows.withColumn("level", level).withColumn("limited", F.col("limit") <= F.col("level") * F.col("weight"))
    fair = F.min(F.when(~F.col("limited"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every)
    rows = rows.withColumn("fair", fair["level"])
    target = F.when(F.col("limited"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("fair") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def _draw(*parts: Column) -> Column:
    """A repeatable number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pair_up(items: Column, seed: int, kind: str) -> Column:
    """Pivotal rounding along an array of ``(key, w, p)``: all but at most one item end up at 0 or 1.

    The one still open meets the next item. Words move from one to the other until one of them is
    at 0 or 1; which way is drawn so that both keep their expected copies. ``w * p`` summed over the two stays.
    """

    def meet(state: Column, item: Column) -> Column:
        c, e = state["open"], item
        up = F.least((1 - c["p"]) * c["w"], e["p"] * e["w"])  # words that c can take from e
        down = F.least(c["p"] * c["w"], (1 - e["p"]) * e["w"])  # words that e can take from c
        take = _draw(c["key"], e["key"], F.lit(seed)) * (up + down) < down
        c_full = (1 - c["p"]) * c["w"] <= e["p"] * e["w"]  # when taking: c reaches 1 first, else e reaches 0
        c_gone = c["p"] * c["w"] <= (1 - e["p"]) * e["w"]  # when giving: c reaches 0 first, else e reaches 1
        p_c = F.when(take, F.when(c_full, F.lit(1.0)).otherwise(c["p"] + up / c["w"])).otherwise(
            F.when(c_gone, F.lit(0.0)).otherwise(c["p"] - down / c["w"])
        )
        p_e = F.when(take, F.when(c_full, e["p"] - up / e["w"]).otherwise(F.lit(0.0))).otherwise(
            F.when(c_gone, e["p"] + down / e["w"]).otherwise(F.lit(1.0))
        )
        c_done = F.when(take, c_full).otherwise(c_gone)
        p_open = F.when(c_done, p_e).otherwise(p_c)
        key_open, w_open = F.when(c_done, e["key"]).otherwise(c["key"]), F.when(c_done, e["w"]).otherwise(c["w"])
        done = F.struct(
            F.when(c_done, c["key"]).otherwise(e["key"]).alias("key"),
            F.when(c_done, c["w"]).otherwise(e["w"]).alias("w"),
            F.when(c_done, p_c).otherwise(p_e).alias("p"),
        )
        still = F.struct(key_open.alias("key"), w_open.alias("w"), p_open.alias("p"))
        return F.when(
            c.isNull(), F.struct(e.alias("open"), state["done"].alias("done"))
        ).otherwise(F.struct(still.alias("open"), F.array_append(state["done"], done).alias("done")))

    empty = F.expr(f"named_struct('open', CAST(NULL AS {kind}), 'done', CAST(array() AS array<{kind}>))")
    return F.aggregate(items, empty, meet)


def _reduce(level: DataFrame, groups: int, fan_in: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """Pair up ``(source, place, item)`` level by level, at first in ``groups`` places a source at most.

    Returns the decided items, and for each source the last open one with its ``open`` probability, decided by draw.
    """
    kind = dict(level.dtypes)["item"]
    decided, depth = [], 0
    while True:
        grouped = level.groupBy("source", "place").agg(F.array_sort(F.collect_list("item")).alias("items"))
        paired = store(grouped.select("source", "place", _pair_up(F.col("items"), seed + depth, kind).alias("r")), "mixing-level")
        decided.append(paired.select(F.explode("r.done").alias("item")))
        level = paired.filter("r.open IS NOT NULL").select(
            "source", F.floor(F.col("place") / fan_in).alias("place"), F.col("r.open").alias("item")
        )
        if groups == 1:
            drawn = (_draw(F.col("item.key"), F.lit(seed)) < F.col("item.p")).cast("double")
            last = level.select("source", F.struct("item.key", "item.w", drawn.alias("p")).alias("item"), F.col("item.p").alias("open"))
            return [*decided, last.select("item")], last
        groups, depth = -(-groups // fan_in), depth + 1


def copy_numbers(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    fan_in: int = FAN_IN,
    steps: tuple[int, ...] = STEPS,
    seed: int = 1,
) -> DataFrame:
    """``(id, source, size, source_size, target, copies)``: how often the mix takes each document.

    A document of a source is to be taken ``target / source_size`` times on average: its whole part surely, and
    the fraction as a copy probability. Fractions are rounded in a reduction tree: documents of a source are
    dealt by hash into groups of about ``fan_in``, each group is rounded by :func:`_pair_up` and hands its one
    open document to the next level. The last one is drawn. Large documents go first, those above a tenth of
    their source, then above a hundredth (``steps``); what the last draw missed moves the probabilities of the
    smaller ones. So a source misses its target by about its smaller documents' size, and copies keep
    their expected numbers. Draws are hashes of ids and ``seed``: reruns agree.

    Null texts and texts without words have size 0 and no say: only the whole part is taken. A null source is
    a source, and comes last. Rows that repeat id, source and size are one item and are taken alike,
    as are rows with null ids of one source and size. No document is taken more than ``max_copies`` times.
    Other columns are left out, whatever their names. An empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = store(sized, "mixing-sizes")
    sources = store(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies), "mixing-targets"
    )
    rate = F.when(F.col("target") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    rated = broadcast_checked(
        sources.select(F.col("source").alias("s"), "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"))
    )
    rows = sized.join(rated, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    same = ["id", "source", "size"]
    items = rows.filter("size > 0 AND p > 0").groupBy(*same).agg(
        F.count("*").alias("n"), F.max("p").alias("p"), F.max("source_size").alias("source_size")
    )
    # the order within groups is by hash, so that neither ids nor sizes decide who meets whom
    key = F.struct(F.xxhash64(*same, F.lit(seed)).alias("turn"), *same)
    kind = F.lit(len(steps))
    for i in reversed(range(len(steps))):
        kind = F.when(F.col("size") * steps[i] > F.col("source_size"), i).otherwise(kind)
    items = store(
        items.select("source", key.alias("key"), (F.col("size") * F.col("n")).cast("double").alias("w"), "p", kind.alias("kind")), "mixing-items"
    )
    decided, owed = [], None
    for i in range(len(steps) + 1):
        part = items.filter(F.col("kind") == i).drop("kind")
        sums = part.groupBy("source").agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.col("p")).alias("full"), F.count("*").alias("m"))
        if owed is None:
            sums = sums.withColumn("owed", F.lit(0.0))
        else:
            # what the larger documents took too little or too much of, the smaller ones make up for
            late = owed.select(F.col("source").alias("o"), "owed")
            sums = sums.join(broadcast_checked(late), F.col("source").eqNullSafe(F.col("o")), "left").drop("o").fillna(0.0, ["owed"])
        sums = store(sums.select(F.col("source").alias("s"), "m", (F.col("owed") / F.col("all")).alias("shift"), "owed"), "mixing-sums")
        most = sums.agg(F.max("m")).first()[0]
        if not most:
            continue
        part = part.join(broadcast_checked(sums.drop("owed")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") + F.col("shift")))
        groups = F.ceil(F.col("m") / fan_in).cast("long")
        place = F.pmod(F.xxhash64("key.id", "key.size", F.lit(seed + 1)), groups)
        level = part.select("source", place.alias("place"), F.struct("key", "w", moved.alias("p")).alias("item"))
        done, last = _reduce(level, -(-most // fan_in), fan_in, seed + 100 * i)
        decided += done
        given = part.groupBy("source").agg(F.sum(F.col("w") * (moved - F.col("p"))).alias("given"))
        missed = last.select("source", (F.col("item.w") * (F.col("open") - F.col("item.p"))).alias("missed"))
        news = given.select("source", F.negative("given").alias("owed")).unionByName(missed.select("source", F.col("missed").alias("owed")))
        news = news.unionByName(sums.select(F.col("s").alias("source"), "owed"))
        if owed is not None:
            absent = owed.join(sums.select("s"), F.col("source").eqNullSafe(F.col("s")), "left_anti")
            news = news.unionByName(absent)
        owed = store(news.groupBy("source").agg(F.sum("owed").alias("owed")), "mixing-owed")
    taken = rows.withColumn("extra", F.lit(0))
    if decided:
        up = decided[0]
        for part in decided[1:]:
            up = up.unionByName(part)
        up = up.filter("item.p > 0.5").select(*[F.col(f"item.key.{c}").alias(f"__{c}") for c in same], F.lit(1).alias("one"))
        alike = F.lit(True)
        for c in same:
            alike = alike & F.col(c).eqNullSafe(F.col(f"__{c}"))
        taken = rows.join(up, alike, "left").withColumn("extra", F.coalesce("one", F.lit(0)))
    return taken.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("whole") + F.col("extra")).cast("int").alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs``, each row repeated as often as :func:`copy_numbers` says; all columns as they were."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    numbers = copy_numbers(docs, **options).filter("copies > 0").select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")
    ).distinct()
    same = (
        F.col(id_col).eqNullSafe(F.col("__id"))
        & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
        & (word_count(F.col(text_col)) == F.col("__size"))
    )
    return docs.join(numbers, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def taken_words(docs: DataFrame) -> DataFrame:
    numbers = copy_numbers(docs)
    return numbers.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
