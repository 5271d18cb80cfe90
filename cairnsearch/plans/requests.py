"""Search requests as rows: defaults, clamps and the choice of search mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnsearch.functions.scores import clamp, clamp_limit
from cairnsearch.functions.text import unicode_trim

# Fixed values.
DEFAULT_LIMIT = 20
DEFAULT_KEYWORD_WEIGHT = 0.5
DEFAULT_VECTOR_MODE = "IVF"
UNIFIED_CANDIDATES = 60
SINGLE_CANDIDATES = 50

UNIFIED, VECTOR_ONLY, TEXT_ONLY = "unified", "vector", "text"


def prepare_requests(
    queries: DataFrame, unified_candidates: int = UNIFIED_CANDIDATES, single_candidates: int = SINGLE_CANDIDATES
) -> DataFrame:
    """Complete ``queries(query_id, query_text, query_vec)`` and drop those that ask for nothing.

    Optional columns: ``max_hits`` (clamped to 1..100), ``keyword_weight`` (clamped to 0..1),
    ``vector_mode`` (``NONE`` turns vectors off; blank means the default) and ``enable_text``
    (null means on). A row without a vector searches text only; an empty vector finds nothing.
    ``candidates`` says how many hits each side of a query is asked for: as given for its kind,
    and never fewer than it may return.
    """
    given = set(queries.columns)

    def optional(name: str, default: str) -> str:
        return f"coalesce({name}, {default})" if name in given else default

    mode = optional("vector_mode", f"'{DEFAULT_VECTOR_MODE}'")
    weight = optional("keyword_weight", str(DEFAULT_KEYWORD_WEIGHT))
    shaped = queries.select(
        "query_id",
        unicode_trim(F.col("query_text")).alias("query_text"),
        "query_vec",
        clamp_limit(F.expr(f"cast({optional('max_hits', str(DEFAULT_LIMIT))} AS int)")).alias("max_hits"),
        clamp(F.expr(f"cast({weight} AS double)"), 0.0, 1.0).alias("keyword_weight"),
        F.expr(f"if(trim({mode}) = '', '{DEFAULT_VECTOR_MODE}', {mode})").alias("vector_mode"),
        F.expr(optional("enable_text", "true")).alias("enable_text"),
    ).filter("query_text <> ''")
    use_vector = "vector_mode <> 'NONE' AND query_vec IS NOT NULL"
    return (
        shaped.selectExpr(
            "*",
            "1D - keyword_weight AS semantic_weight",
            f"""CASE WHEN {use_vector} AND enable_text THEN '{UNIFIED}'
                     WHEN {use_vector} THEN '{VECTOR_ONLY}'
                     WHEN enable_text THEN '{TEXT_ONLY}' END AS kind""",
        )
        .filter(f"kind IS NOT NULL AND NOT ({use_vector} AND size(query_vec) = 0)")
        .selectExpr(
            "*",
            f"greatest(if(kind = '{UNIFIED}', {unified_candidates}, {single_candidates}), max_hits) AS candidates",
        )
    )
