"""Full-text search: documents holding all words of a query, ranked by where the words stand.

Two ways lead to the same hits. ``scan_hits`` tokenises the documents as it reads them and
shuffles nothing; ``indexed_hits`` reads the inverted index. Both start from each query's
*pivot*, the word found in the fewest documents, so a query pairs only with the documents
holding that word, however common its other words are. Where too many queries are asked for a
broadcast, the rows of common words are dealt over several tasks.

``top_indexed`` ranks without looking at most documents: the index keeps, for each word and range
of ids, the most that the word can add to a rank, and ranges that cannot reach the k best are not
read.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnsearch.functions.ranking import WEIGHTS, cover_density_rank, frequency_rank
from cairnsearch.functions.text import word_tokens
from cairnsearch.operators.nearest import top_k_per_query
from cairnsearch.operators.postings import BLOCK_IDS, CONTENT_WEIGHT, TITLE_WEIGHT, block_of, tokenised
from cairnsearch.operators.sizing import MAX_BYTES, Size, broadcast_if, localise, measure, near_values, small_files
from cairnsearch.operators.skew import split_join
from cairnsearch.session import stored

FEW_QUERIES = 16
PUSHED_LEXEMES = 500
MAX_CANDIDATES = 200_000
SEED_RANGES = 4
#: Ranges per query, and bytes of bounds, up to which all ranges are ranked at once.
FEW_RANGES = 64
SMALL_BOUNDS = 16 * 1024 * 1024
RANKED_SCHEMA = "query_id {}, id long, rank double, r int"
#: Ranks are single precision, bounds double.
ROUNDING = 1e-6
# A one-letter word takes two bytes of text and about nine as an array element.
BYTES_PER_TEXT_BYTE = 5


def query_terms(queries: DataFrame, words: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """``(query_id, terms)``: distinct words of each query; a query without words is dropped."""
    return queries.select(
        "query_id", F.array_distinct(words(F.col("query_text"))).alias("terms")
    ).filter(F.size("terms") > 0)


def _vocabulary(terms: DataFrame) -> DataFrame:
    return terms.select(F.explode("terms").alias("lexeme")).distinct()


def _longest_word(terms: DataFrame) -> DataFrame:
    """Pivot without counting: pairs are at most queries times documents, and queries are few."""
    ranked = F.array_sort(F.transform("terms", lambda t: F.struct(-F.length(t), t.alias("lexeme"))))
    return terms.select("query_id", "terms", F.element_at(ranked, 1)["lexeme"].alias("pivot"))


def _rarest_word(terms: DataFrame, frequencies: DataFrame, small: bool) -> DataFrame:
    """Pivot by document frequency; a query with a word no document holds drops out here."""
    counted = (
        terms.select("query_id", F.explode("terms").alias("lexeme"))
        .join(broadcast_if(small, frequencies), "lexeme")
        .groupBy("query_id")
        .agg(F.min(F.struct("df", "lexeme"))["lexeme"].alias("pivot"), F.count("*").alias("found"))
    )
    return (
        terms.join(broadcast_if(small, counted), "query_id")
        .filter(F.col("found") == F.size("terms"))
        .select("query_id", "terms", "pivot")
    )


def measure_texts(queries: DataFrame) -> Size:
    return measure(queries.select("query_id", "query_text"))


def _is_small(size: Size) -> bool:
    return size.within(max_bytes=MAX_BYTES // BYTES_PER_TEXT_BYTE)


def scan_hits(
    documents: DataFrame,
    queries: DataFrame,
    weighted: bool = False,
    size: Size | None = None,
    words: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """Hits by scanning: ``(query_id, id, n_terms, doc_length, hits)``.

    With the queries broadcast, tokenising, pairing on the pivot, checking all words and
    collecting positions happen within one stage on the document's own row.
    """
    terms = query_terms(queries, words)
    docs = tokenised(documents, weighted, words)
    spoken = F.explode_outer(F.array_distinct("tokens"))
    size = size or measure_texts(queries)
    small = _is_small(size)
    if small and size.rows <= FEW_QUERIES:
        pivots = _longest_word(terms)
    else:
        lexemes = docs.select(spoken.alias("lexeme"))
        if small:
            lexemes = lexemes.join(F.broadcast(_vocabulary(terms)), "lexeme", "left_semi")
        frequencies = lexemes.groupBy("lexeme").agg(F.count("*").alias("df"))
        if not small:
            frequencies = stored(frequencies, "word-counts")
        pivots = _rarest_word(terms, frequencies, small)
    holds_all = F.size(F.array_except("terms", "tokens")) == 0
    weight = f"{WEIGHTS[CONTENT_WEIGHT]}D"
    if weighted:
        weight = f"if(i <= title_tokens, {WEIGHTS[TITLE_WEIGHT]}D, {weight})"
    hits = F.expr(
        f"""transform(
              filter(sequence(1, size(tokens)), i -> array_contains(terms, tokens[i - 1])),
              i -> named_struct('pos', i,
                                'term', cast(array_position(terms, tokens[i - 1]) AS int),
                                'weight', {weight}))"""
    )
    if small:
        paired = docs.select("id", "tokens", "title_tokens", spoken.alias("pivot")).join(
            F.broadcast(pivots), "pivot"
        )
    else:
        # Shuffle bare (word, id) pairs; texts then meet their queries once per document.
        counts = frequencies.select(F.col("lexeme").alias("pivot"), F.col("df").alias("n"))
        pairs = split_join(
            docs.select("id", spoken.alias("pivot")), pivots.select("query_id", "pivot"), "pivot", counts, "id"
        ).select("query_id", "id")
        pairs = stored(pairs, "word-pairs")
        asked = split_join(pairs, terms, "query_id", pairs.groupBy("query_id").agg(F.count("*").alias("n")), "id")
        paired = docs.join(asked, "id")
    return paired.filter(holds_all).select(
        "query_id",
        "id",
        F.size("terms").alias("n_terms"),
        F.size("tokens").cast("long").alias("doc_length"),
        hits.alias("hits"),
    )


def indexed_hits(
    postings: DataFrame,
    queries: DataFrame,
    size: Size | None = None,
    words: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """Hits from the inverted index, same columns as ``scan_hits``.

    A short list of words is pushed into the scan, which skips the rest of a lexeme-sorted
    index. For a few queries all their postings are then grouped by document; for many, only
    those of documents holding a query's pivot.
    """
    terms = query_terms(queries, words)
    size = size or measure_texts(queries)
    small = _is_small(size)
    vocabulary = _vocabulary(terms)
    if small:
        asked = _asked_for(postings, vocabulary)
    else:
        held = stored(postings.groupBy("lexeme").agg(F.count("*").alias("n")), "word-counts")
        asked = stored(split_join(postings, vocabulary, "lexeme", held, "id"), "asked-postings")
    wanted = terms.select(
        "query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("at", "lexeme")
    )
    if small and size.rows <= FEW_QUERIES:
        found = asked.join(F.broadcast(wanted), "lexeme")
    else:
        frequencies = asked.groupBy("lexeme").agg(F.count("*").alias("df"))
        pivots = _rarest_word(terms, frequencies, small).select("query_id", "pivot")
        places = asked.select(F.col("lexeme").alias("pivot"), "id")
        if small:
            paired = places.join(F.broadcast(pivots), "pivot")
        else:
            counts = frequencies.select(F.col("lexeme").alias("pivot"), F.col("df").alias("n"))
            paired = split_join(places, pivots, "pivot", counts, "id")
        candidates = paired.select("query_id", "id").distinct()
        held = _held(candidates) if small else None
        if held is not None:
            in_candidates = asked.join(F.broadcast(held), "id")
            found = in_candidates.join(F.broadcast(wanted), ["query_id", "lexeme"])
        else:
            if small:
                pairs = candidates.join(F.broadcast(wanted), "query_id")
            else:
                candidates = stored(candidates, "word-pairs")
                counts = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
                pairs = split_join(candidates, wanted, "query_id", counts, "id")
            found = pairs.join(asked, ["lexeme", "id"])
    return _complete(found)


def _complete(found: DataFrame) -> DataFrame:
    """Hits from ``found(query_id, id, n_terms, at, weight, positions, doc_length)``, a row per word and field, of the
    documents that have all words of a query."""
    # positions are shuffled as they are stored; a hit of three fields takes ten times the room
    part = F.struct("at", "weight", "positions")
    weight = f"if(p.weight = '{TITLE_WEIGHT}', {WEIGHTS[TITLE_WEIGHT]}D, {WEIGHTS[CONTENT_WEIGHT]}D)"
    hits = F.expr(
        f"""sort_array(flatten(transform(parts, p -> transform(p.positions, x -> named_struct(
              'pos', x, 'term', p.at + 1, 'weight', {weight})))))"""
    )
    return (
        found.groupBy("query_id", "id")
        .agg(
            F.first("n_terms").alias("n_terms"),
            F.first("doc_length").alias("doc_length"),
            F.collect_list(part).alias("parts"),
        )
        .filter(F.size(F.array_distinct("parts.at")) == F.col("n_terms"))
        .select("query_id", "id", "n_terms", "doc_length", hits.alias("hits"))
    )


def _held(candidates: DataFrame) -> DataFrame | None:
    """Candidate pairs, computed now, if they are few enough to broadcast; else None.

    Knowing them, the index is read in place, where otherwise all postings of the words asked
    for would be shuffled to meet them.
    """
    pairs = candidates.limit(MAX_CANDIDATES + 1).toArrow()
    if pairs.num_rows > MAX_CANDIDATES:
        return None
    return candidates.sparkSession.createDataFrame(pairs)


def _asked_for(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The postings of the words in ``vocabulary``, which is known to be small."""
    words = vocabulary.limit(PUSHED_LEXEMES + 1).collect()
    if len(words) <= PUSHED_LEXEMES:
        return postings.filter(F.col("lexeme").isin([row["lexeme"] for row in words]))
    return postings.join(F.broadcast(vocabulary), "lexeme", "left_semi")


def ranked(hits: DataFrame, method: str) -> DataFrame:
    """``(query_id, id, rank)`` with ``method`` ``frequency`` or ``cover_density``."""
    if method == "frequency":
        rank = frequency_rank()
    elif method == "cover_density":
        rank = cover_density_rank()
    else:
        raise ValueError(f"unknown rank method: {method}")
    return hits.select("query_id", "id", rank.alias("rank"))


def top_indexed(
    postings: DataFrame,
    bounds: DataFrame,
    queries: DataFrame,
    k: int,
    words: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """``(query_id, id, rank, r)`` by cover density, for queries known to be few and small.

    A cover is worth at most the weight of the word it starts with: title words come first, so one
    that starts in the content has no title word. Hence a document's rank is at most the sum, over
    the query's words, of its share (``build_bounds``), and a range's best rank the sum of its
    largest shares. The ranges with the highest sums are ranked first; of the others, only those
    that may still reach the k-th rank found.
    """
    spark, terms = postings.sparkSession, query_terms(queries, words)
    lexemes = sorted({word for row in terms.collect() for word in row["terms"]})  # few and small, as the queries are
    asked, bounds = (df.filter(F.col("lexeme").isin(lexemes)) for df in (postings, bounds))
    wanted = terms.select(
        "query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("at", "lexeme")
    )

    def rank_all() -> DataFrame:
        found = asked.join(F.broadcast(wanted), "lexeme")
        return top_k_per_query(ranked(_complete(found), "cover_density"), k, F.desc("rank"), "id")

    if small_files(bounds, SMALL_BOUNDS):
        return rank_all()
    ranges = (
        bounds.groupBy("lexeme", "block")
        .agg(F.max("share").alias("share"))
        .join(F.broadcast(wanted), "lexeme")
        .groupBy("query_id", "block")
        .agg(F.count("*").alias("found"), F.first("n_terms").alias("n_terms"), F.sum("share").alias("most"))
        .filter(F.col("found") == F.col("n_terms"))
        .select("query_id", "block", "most")
    )
    held = ranges.limit(MAX_CANDIDATES + 1).toArrow()
    if held.num_rows > MAX_CANDIDATES:
        ranges = stored(ranges, "text-ranges")
        seeds = top_k_per_query(ranges, SEED_RANGES, F.desc("most"), "block").drop("r").toArrow()
    else:
        ranges, seeds = spark.createDataFrame(held, ranges.schema), _highest_ranges(held, SEED_RANGES)
    if held.num_rows <= FEW_RANGES * max(1, len(seeds)) // SEED_RANGES:
        # so few that ranking all of them takes no longer than finding out which to leave
        return rank_all()
    first = _ranked_in(asked, wanted, spark.createDataFrame(seeds, ranges.schema), seeds)
    best = spark.createDataFrame(top_k_per_query(first, k, F.desc("rank"), "id").toArrow(), RANKED_SCHEMA.format(_kind(queries)))
    reached = best.filter(F.col("r") == k).select("query_id", F.col("rank").alias("reached"))
    done = spark.createDataFrame(seeds, ranges.schema).select("query_id", "block")
    more = (
        ranges.join(F.broadcast(done), ["query_id", "block"], "left_anti")
        .join(F.broadcast(reached), "query_id", "left")
        .filter(F.col("reached").isNull() | (F.col("most") * (1 + ROUNDING) >= F.col("reached")))
        .select("query_id", "block", "most")
    )
    few = more.limit(MAX_CANDIDATES + 1).toArrow()
    if few.num_rows > MAX_CANDIDATES:
        rest = _ranked_in(asked, wanted, more, None)
    else:
        rest = _ranked_in(asked, wanted, spark.createDataFrame(few, ranges.schema), few)
    return top_k_per_query(best.drop("r").unionByName(rest), k, F.desc("rank"), "id")


def _kind(queries: DataFrame) -> str:
    return queries.schema["query_id"].dataType.simpleString()


def _highest_ranges(ranges: pa.Table, n: int) -> pa.Table:
    """The ``n`` rows of each query with the largest ``most``."""
    ordered = ranges.sort_by([("query_id", "ascending"), ("most", "descending"), ("block", "ascending")])
    taken, rows = {}, []
    for i, query in enumerate(ordered.column("query_id").to_pylist()):
        taken[query] = taken.get(query, 0) + 1
        if taken[query] <= n:
            rows.append(i)
    return ordered.take(rows)


def _ranked_in(asked: DataFrame, wanted: DataFrame, ranges: DataFrame, held: pa.Table | None) -> DataFrame:
    """``(query_id, id, rank)`` of the complete hits within ``ranges(query_id, block)``, reading only those.

    ``held`` are the same rows if they are few.
    """
    pairs = ranges.select("query_id", "block")
    if held is not None:
        blocks = held.column("block").to_pylist()
        asked = asked.filter(near_values(F.col("id"), blocks, BLOCK_IDS)) if blocks else asked.limit(0)
        pairs = F.broadcast(pairs)
    here = asked.withColumn("block", block_of(F.col("id")))
    found = here.join(F.broadcast(wanted), "lexeme").join(pairs, ["query_id", "block"])
    return ranked(_complete(found), "cover_density")


def search_text(
    queries: DataFrame,
    k: int,
    documents: DataFrame | None = None,
    postings: DataFrame | None = None,
    size: Size | None = None,
    bounds: DataFrame | None = None,
    words: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """``(query_id, id, rank, r)``: the k best documents holding all words of each query.

    With ``postings`` the stored weighted vectors are searched and ranked by cover density;
    without, ``documents`` are scanned as plain text and ranked by frequency and proximity.
    ``bounds`` of the postings spare a small set of queries most of them. ``size`` is that of
    ``queries`` if it has been measured already. ``words`` takes texts and queries apart (see
    ``word_tokens``, ``space_tokens``); an index must have been built with the same function.
    """
    if size is None:
        queries, size = localise(queries.select("query_id", "query_text"))
    if postings is not None and bounds is not None and _is_small(size) and size.rows <= FEW_QUERIES:
        return top_indexed(postings, bounds, queries, k, words)
    if postings is not None:
        scored = ranked(indexed_hits(postings, queries, size, words), "cover_density")
    elif documents is not None:
        scored = ranked(scan_hits(documents, queries, size=size, words=words), "frequency")
    else:
        raise ValueError("give documents to scan or postings to read")
    return top_k_per_query(scored, k, F.desc("rank"), "id")
