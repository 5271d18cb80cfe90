"""Scalar text functions: trimming, tokens, snippets and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
WHITESPACE = r"[\s\x1c-\x1f\p{Z}]"
BROWSER_WHITESPACE = r"[\s\x0b\p{Z}\x{FEFF}]"
WORD_BREAK = r"[^\p{L}\p{N}]+"

# Run status -> label shown to users.
STATUS_LABELS = {"IDLE": "대기", "RUNNING": "수집 중", "DONE": "완료", "ERROR": "오류"}

SNIPPET_LENGTH = 500


def unicode_trim(text: Column) -> Column:
    """Strip every Unicode space at both ends; Spark's own ``trim`` strips U+0020 only."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(unicode_trim(text) == "", F.lit(True))


def keyword_tokens(query: Column) -> Column:
    """Distinct whitespace-separated words in first-seen order, one leading ``#`` removed."""
    words = F.transform(
        F.split(unicode_trim(query), r"\s+"),
        lambda w: unicode_trim(F.regexp_replace(unicode_trim(w), "^#", "")),
    )
    return F.coalesce(
        F.array_distinct(F.filter(words, lambda w: w != "")), F.array().cast("array<string>")
    )


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def space_tokens(text: Column) -> Column:
    """Lower-cased words as spaces part them, punctuation kept, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), f"{WHITESPACE}+"), lambda w: w != "")


def snippet_plain(text: Column, length: int = SNIPPET_LENGTH) -> Column:
    """``...`` only when something was cut off."""
    return F.when(F.length(text) <= length, text).otherwise(
        F.concat(F.substring(text, 1, length), F.lit("..."))
    )


def snippet_hybrid(text: Column, length: int = SNIPPET_LENGTH) -> Column:
    """``...`` whenever the snippet is full, so a text of exactly ``length`` gets it too."""
    return F.when(F.length(text) < length, text).otherwise(
        F.concat(F.substring(text, 1, length), F.lit("..."))
    )


def truncate(text: Column, max_length: int) -> Column:
    """The first ``max_length`` characters a model is given; 0 or less means no limit."""
    return F.substring(text, 1, max_length) if max_length > 0 else text


def remove_token(query: Column, token: Column) -> Column:
    """Drop every literal occurrence of ``token`` with the spaces around it."""
    literal = F.concat(F.lit(r"\Q"), F.replace(token, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(BROWSER_WHITESPACE + "*"), literal, F.lit(BROWSER_WHITESPACE + "*"))
    single_spaced = F.regexp_replace(
        F.regexp_replace(query, pattern, F.lit(" ")), BROWSER_WHITESPACE + "+", " "
    )
    trimmed = F.regexp_replace(single_spaced, "^ | $", "")
    return F.when(F.coalesce(token, F.lit("")) == "", query).otherwise(trimmed)


def humanise_count(n: Column) -> Column:
    """1500000 -> 1.5M, 1000 -> 1.0k, 999 -> 999, halves rounded up."""
    n = n.cast("long")

    def one_decimal(unit: int) -> Column:
        tenths = F.floor((n + unit // 20) / F.lit(unit // 10)).cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))

    return (
        F.when(n >= 1_000_000, F.concat(one_decimal(1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(one_decimal(1_000), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def percent_display(percent: Column) -> Column:
    return F.when(percent.isNull() | F.isnan(percent), F.lit("0")).otherwise(
        F.format_number(percent, 1)
    )


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, status), status)


def lexically_confirmed(query: Column, title: Column, content: Column) -> Column:
    """Whether a vector hit also holds the query's words; the rule loosens as the query grows.

    Up to 30 characters the whole query must occur, up to 50 any word longer than one
    character must, and beyond 50 nothing is asked.
    """
    query = unicode_trim(query)
    lowered, title, content = F.lower(query), F.lower(title), F.lower(content)
    any_word = F.exists(
        F.split(lowered, r"\s+"),
        lambda w: (F.length(w) > 1) & (title.contains(w) | content.contains(w)),
    )
    return (
        F.when(F.length(query) > 50, F.lit(True))
        .when(F.length(lowered) <= 30, title.contains(lowered) | content.contains(lowered))
        .otherwise(any_word)
    )
