"""Similarity of times, of entity sets, and the distance built from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Similarity = Callable[[Column, Column], Column]

# Fixed value: hours after which two texts have nothing to do with each other.
DECAY_HOURS = 72.0
MICROS_PER_HOUR = 3.6e9
DIGITS = 9


def hours(ts: Column) -> Column:
    """Fractional hours since the epoch, in the session's time zone (UTC is expected)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(MICROS_PER_HOUR)


def time_similarity(hours_apart: Column, time_decay: str = "hours") -> Column:
    """1 at the same time, falling to 0 at 72 hours; ``'off'`` is 1 throughout."""
    if time_decay == "off":
        return F.lit(1.0)
    if time_decay != "hours":
        raise ValueError("time_decay must be 'hours' or 'off'")
    return 1.0 - F.least(F.abs(hours_apart) / DECAY_HOURS, F.lit(1.0))


def any_resource(a: Column, b: Column) -> Column:
    """The same for every two resources: 1."""
    return F.lit(1.0)


def shared_links(a: Column, b: Column) -> Column:
    """Share of incoming links that two resources have in common."""
    union = F.size(F.array_union(a["in_links"], b["in_links"]))
    both = F.size(F.array_intersect(a["in_links"], b["in_links"]))
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def best_match(element: Column, others: Column, similarity: Similarity) -> Column:
    """Highest similarity of an element to a set, at least 0."""
    return F.greatest(
        F.lit(0.0),
        F.coalesce(F.array_max(F.transform(others, lambda o: similarity(element, o))), F.lit(0.0)),
    )


def _best_matches(a: Column, b: Column, similarity: Similarity) -> Column:
    return F.transform(a, lambda x: best_match(x, b, similarity))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def set_similarity(a: Column, b: Column, similarity: Similarity = any_resource) -> Column:
    """Mean best match over the smaller set; of both directions for sets of one size. Null when
    the set to average over is empty."""
    forth = _mean(_best_matches(a, b, similarity))
    back = _mean(_best_matches(b, a, similarity))
    return (
        F.when(F.size(a) < F.size(b), forth)
        .when(F.size(a) > F.size(b), back)
        .otherwise((forth + back) / 2)
    )


def set_similarity_max(a: Column, b: Column, similarity: Similarity = any_resource) -> Column:
    """Highest best match over both sets."""
    matches = F.concat(_best_matches(a, b, similarity), _best_matches(b, a, similarity))
    return F.coalesce(F.array_max(matches), F.lit(0.0))


def semantic_similarity(a: Column, b: Column, similarity: Similarity = any_resource) -> Column:
    """1 if either set is empty, else ``set_similarity``."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(1.0)).otherwise(
        set_similarity(a, b, similarity)
    )


def text_distance(time: Column, cos: Column, semantic: Column) -> Column:
    """``1 - time * (cos + semantic) / 2``, rounded so that the order of sums does not show."""
    return F.round(1.0 - time * ((cos + semantic) / 2.0), DIGITS)


def may_be_close(cos: Column, eps: float) -> Column:
    """False only where no time and no entities could bring the distance to ``eps``."""
    return F.round(1.0 - cos, DIGITS) <= 2 * eps
