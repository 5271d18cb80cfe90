"""Full-text ranks over one document's term hits, as SQL expressions.

They read the columns of one (query, document) row: ``hits``, an ``array<struct<pos int,
term int, weight double>>`` in position order where ``term`` is the 1-based index of the query
word found at ``pos``; ``n_terms``; and ``doc_length``. All that ranking needs is in the row,
so it takes no join and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Position weights and the constants of the rank formulas.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
INVERSE_SQUARE_SUM = 1.64493406685
NEAR = 100
FAR_CLOSENESS = 1e-15  # the square root of the distance factor beyond NEAR, 1e-30

# One term: each later occurrence is worth 1/j^2, but the first heaviest one counts in full.
_SINGLE_TERM = f"""
  transform(array(transform(hits, h -> h.weight)), weights ->
    transform(array(array_position(weights, array_max(weights))), top ->
      ( array_max(weights)
      + aggregate(transform(weights, (w, j) -> w / ((j + 1D) * (j + 1D))), 0D, (s, x) -> s + x)
      - array_max(weights) / (top * top * 1D)
      ) / {INVERSE_SQUARE_SUM}D)[0])[0]
"""

# Several terms: 1 - prod(1 - closeness) over all pairs of positions of different terms. Pairs
# up to NEAR words apart are walked, each hit against the hits still within reach. All other
# pairs share one closeness; their sum needs no walk, being the sum over all pairs less the
# near ones, which give theirs back as they are met. Same-position pairs count as neither.
_REACH = ", ".join(
    ["0D"] + [f"{(1.005 + 0.05 * math.exp(d / 1.5 - 2)) ** -0.5!r}D" for d in range(1, NEAR + 1)]
)
_ROOTED = "transform(hits, h -> named_struct('pos', h.pos, 'term', h.term, 'root', sqrt(h.weight)))"
_NEAR_PAIRS = f"""
  aggregate(
    rooted,
    named_struct('within', cast(array() AS array<struct<pos: int, term: int, root: double>>),
                 'total', 0D),
    (state, h) -> transform(
      array(filter(state.within, n -> h.pos - n.pos <= {NEAR})),
      within -> named_struct(
        'within', array_append(within, h),
        'total', aggregate(
          filter(within, n -> n.term <> h.term), state.total,
          (s, n) -> s + log1p(-h.root * n.root * array({_REACH})[h.pos - n.pos])
                      + h.root * n.root * {FAR_CLOSENESS}D)))[0],
    state -> state.total)
"""
_MASS = "aggregate({0}, 0D, (s, h) -> s + h.root)"
_ALL_PAIRS = f"""
  ( pow({_MASS.format('rooted')}, 2)
  - aggregate(transform(sequence(1, n_terms), t -> {_MASS.format('filter(rooted, h -> h.term = t)')}),
              0D, (s, m) -> s + m * m)
  ) / 2
"""
_PROXIMITY = f"""
  transform(array({_ROOTED}), rooted ->
    -expm1({_NEAR_PAIRS} - {FAR_CLOSENESS}D * {_ALL_PAIRS}))[0]
"""

# Cover density: the sum over the shortest spans that hold every term. One pass keeps, per
# term, the index of its latest hit. The least of these is where the shortest complete span
# ending at hit i begins; a span counts when that start is new.
_SPAN = """
  (i - first + 1) / aggregate(slice(hits, first, i - first + 1), 0D, (s, h) -> s + 1D / h.weight)
  / (1D + if(hits[i - 1].pos - hits[first - 1].pos < i - first, (i - first) div 2,
             hits[i - 1].pos - hits[first - 1].pos - (i - first)))
"""
_COVER_DENSITY = f"""
  aggregate(
    sequence(1, size(hits)),
    named_struct('latest', array_repeat(0, n_terms), 'start', 0, 'total', 0D),
    (state, i) -> transform(
      array(transform(state.latest, (seen, t) -> if(t + 1 = hits[i - 1].term, i, seen))),
      latest -> named_struct(
        'latest', latest,
        'start', greatest(state.start, array_min(latest)),
        'total', state.total + if(
          array_min(latest) > state.start, transform(array(array_min(latest)), first -> {_SPAN})[0], 0D)))[0],
    state -> state.total
  ) / ln(doc_length + 1D)
"""


# One term: every hit is a cover of its own, worth its weight.
_ONE_TERM_COVERS = "aggregate(hits, 0D, (s, h) -> s + h.weight) / ln(doc_length + 1D)"


def _float4(rank: str) -> Column:
    """Ranks are single precision; keeping that makes equal ranks tie exactly."""
    return F.expr(f"cast(cast({rank} AS float) AS double)")


def frequency_rank() -> Column:
    return _float4(f"if(n_terms = 1, {_SINGLE_TERM}, {_PROXIMITY})")


def cover_density_rank() -> Column:
    return _float4(f"if(n_terms = 1, {_ONE_TERM_COVERS}, {_COVER_DENSITY})")
