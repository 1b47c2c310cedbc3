"""Score expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.config import SimilarityThresholds
from faultline.functions.text import let

def micros(c: Column) -> Column:
    return F.unix_micros(c)


def lag_score(lag_us: Column, max_us: int | Column) -> Column:
    """1 at no lag, 0 at ``max_us`` and outside of 0..max."""
    limit = F.lit(max_us) if isinstance(max_us, int) else max_us
    ok = (lag_us >= 0) & (lag_us <= limit) & (limit > 0)
    return F.when(ok, 1.0 - lag_us.cast("double") / limit).otherwise(F.lit(0.0))


def classify_similarity(score: Column, t: SimilarityThresholds = SimilarityThresholds()) -> Column:
    return (
        F.when(score >= t.high, "HIGH_CONFIDENCE").when(score >= t.possible, "POSSIBLE_MATCH").otherwise("NO_MATCH")
    )


def total(weights: Column) -> Column:
    """Sum of an array<double>, left to right."""
    return F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two string arrays without regard to case; 0 if one is empty."""
    x, y = (F.array_distinct(F.transform(F.filter(c, lambda s: s != ""), F.lower)) for c in (a, b))
    both_filled = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(both_filled, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def map_norm(m: Column) -> Column:
    """Length of a token -> weight map."""
    return F.sqrt(total(F.transform(F.map_values(m), lambda v: v * v)))


def map_cosine(a: Column, b: Column, norms: tuple[Column, Column] | None = None) -> Column:
    """Cosine of two token -> weight maps, rounded to four digits.

    ``norms`` are their lengths where the maps lack tokens that they do not share.
    """

    def cosine(p: Column) -> Column:
        x, y = p["x"], p["y"]
        dot = total(F.transform(F.map_keys(x), lambda k: F.coalesce(F.try_element_at(x, k) * F.try_element_at(y, k), F.lit(0.0))))
        nx, ny = norms or (map_norm(x), map_norm(y))
        return F.when(F.arrays_overlap(F.map_keys(x), F.map_keys(y)), F.round(dot / (nx * ny), 4)).otherwise(0.0)

    return let(F.struct(a.alias("x"), b.alias("y")), cosine)


def z_score(x: Column, mean: Column, sd: Column, floor: float = 1e-9) -> Column:
    return (x - mean) / F.greatest(sd, F.lit(floor))


def pct_change(x: Column, previous: Column) -> Column:
    return F.when(previous != 0, (x - previous) / F.abs(previous) * 100.0)


def pct_rank(x: Column, history: Column) -> Column:
    """Mid-rank of ``x`` among ``history`` and itself, 0..100."""
    below = F.size(F.filter(history, lambda v: v < x))
    equal = F.size(F.filter(history, lambda v: v == x))
    return F.when(F.size(history) > 0, (below + equal / 2.0) / F.size(history) * 100.0).otherwise(F.lit(50.0))


def is_error(category: Column, severity: Column) -> Column:
    return (category == "error") | (
        (category == "log") & F.coalesce(severity.isin("HIGH", "CRITICAL"), F.lit(False))
    )


def is_anomaly(category: Column, severity: Column) -> Column:
    """Any metric, or severity of at least MEDIUM."""
    return (category == "metric") | F.coalesce(severity.isin("MEDIUM", "HIGH", "CRITICAL"), F.lit(False))


def is_resolved(category: Column, status: Column) -> Column:
    return (category == "alert") & F.coalesce(F.upper(status) == "RESOLVED", F.lit(False))
