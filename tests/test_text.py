import pytest
from cairnsearch.functions import scores, text
from pyspark.sql import functions as F


def one(spark, expression, **columns):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expression).first()[0]


@pytest.mark.parametrize(
    "query, tokens",
    [
        ("  #a a ##b # b ", ["a", "#b", "b"]),
        ("바다 #산\t바다", ["바다", "산"]),
        ("　\t", []),
        (None, []),
    ],
)
def test_keyword_tokens(spark, query, tokens):
    assert one(spark, text.keyword_tokens(F.col("q")), q=query) == tokens


def test_trim_covers_unicode_spaces(spark):
    assert one(spark, text.unicode_trim(F.col("q")), q="　  x y \t") == "x y"
    assert one(spark, text.is_blank(F.col("q")), q="　\t") is True
    assert one(spark, text.is_blank(F.col("q")), q=None) is True


@pytest.mark.parametrize("length, plain, hybrid", [(499, 0, 0), (500, 0, 3), (501, 3, 3)])
def test_snippets_differ_at_exactly_full_length(spark, length, plain, hybrid):
    kept = min(length, 500)
    assert len(one(spark, text.snippet_plain(F.col("t")), t="x" * length)) == kept + plain
    assert len(one(spark, text.snippet_hybrid(F.col("t")), t="x" * length)) == kept + hybrid


@pytest.mark.parametrize(
    "n, shown", [(999, "999"), (1000, "1.0k"), (1_500_000, "1.5M"), (999_999, "1000.0k"), (1250, "1.3k")]
)
def test_humanise_count(spark, n, shown):
    assert one(spark, text.humanise_count(F.col("n")), n=n) == shown


@pytest.mark.parametrize(
    "query, token, left",
    [
        ("a c++ b", "c++", "a b"),
        ("  x  x y x", "x", "y"),
        (r"a \E b", r"\E", "a b"),
        ("a b", "", "a b"),
        ("$1 a", "a", "$1"),
    ],
)
def test_remove_token_is_literal(spark, query, token, left):
    assert one(spark, text.remove_token(F.col("q"), F.col("t")), q=query, t=token) == left


@pytest.mark.parametrize(
    "query, title, content, kept",
    [
        ("Tree", "a tree", "", True),
        ("tree house", "tree", "house", False),
        ("x" * 30, "", "y", False),
        ("a " + "x" * 29, "", "a", False),  # 31 long: one-letter words do not count
        ("no " + "match " * 5 + "tree", "", "big TREE", True),
        ("x" * 50, "", "y", False),
        ("x" * 51, "", "y", True),
    ],
)
def test_lexical_confirmation_loosens_with_length(spark, query, title, content, kept):
    found = text.lexically_confirmed(F.col("q"), F.col("t"), F.col("c"))
    assert one(spark, found, q=query, t=title, c=content) is kept


@pytest.mark.parametrize(
    "distance, percent",
    [(0.0, 100.0), (0.9, 55.0), (1.5, 25.0), (2.0, 0.0), (float("nan"), 0.0), (2.5, 0.0), (-1.0, 100.0)],
)
def test_similarity_percent(spark, distance, percent):
    assert one(spark, scores.similarity_percent(F.col("d")), d=distance) == pytest.approx(percent)


@pytest.mark.parametrize("total, percent", [(0.5, 50.0), (1.2, 100.0), (-0.1, 0.0), (float("nan"), 0.0)])
def test_score_percent(spark, total, percent):
    assert one(spark, scores.score_percent(F.col("s")), s=total) == pytest.approx(percent)


@pytest.mark.parametrize("place, score", [(1, 0.5), (62, 0.25)])
def test_reciprocal_rank(spark, place, score):
    found = scores.reciprocal_rank_score(F.col("r"), F.lit(0.5))
    assert one(spark, found, r=place) == pytest.approx(score)


def test_rank_value_score_falls_as_rank_rises(spark):
    low = one(spark, scores.rank_value_score(F.col("r"), F.lit(1.0)), r=0.1)
    high = one(spark, scores.rank_value_score(F.col("r"), F.lit(1.0)), r=0.9)
    assert high < low <= 61 / 60


def test_clamps(spark):
    assert [one(spark, scores.clamp_limit(F.col("n")), n=n) for n in (0, 20, 101)] == [1, 20, 100]
    weights = [one(spark, scores.clamp(F.col("w"), 0.0, 1.0), w=w) for w in (-1.0, 0.3, 2.0)]
    assert weights == [0.0, 0.3, 1.0]
    nan = one(spark, scores.clamp(F.col("w"), 0.0, 1.0), w=float("nan"))
    assert nan != nan


def test_cosine_distance(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])],
        "a array<float>, b array<float>",
    )
    found = [r[0] for r in rows.select(scores.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert found[:3] == pytest.approx([0.0, 1.0, 2.0])
    assert found[3] != found[3]


def test_display_helpers(spark):
    assert one(spark, text.percent_display(F.col("p")), p=72.34) == "72.3"
    assert one(spark, text.percent_display(F.col("p")), p=float("nan")) == "0"
    assert one(spark, text.status_label(F.col("s")), s="RUNNING") == "수집 중"
    assert one(spark, text.status_label(F.col("s")), s="other") == "other"
