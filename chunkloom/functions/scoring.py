"""Vector and ranking scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIMENSIONS = 65_536


def dot(a: Column, b: Column) -> Column:
    return F.reduce(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.reduce(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, null for different lengths."""
    both = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None)).when(both == 0, 0.0).otherwise(dot(a, b) / both)


def valid_vector(v: Column) -> Column:
    """Non-empty, not too long, all values finite numbers of 32 bits."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= 3.4028234663852886e38))
    return F.coalesce((F.size(v) > 0) & (F.size(v) <= MAX_DIMENSIONS) & fine, F.lit(False))


def gain(relevance: Column, rank: Column) -> Column:
    """Discounted gain of a result at 1-based rank."""
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)


def recall(hits: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / total))


def price(tokens: Column, usd_per_million: float | None) -> Column:
    """An unknown price stays null."""
    return F.lit(None).cast("double") if usd_per_million is None else tokens * usd_per_million / 1e6
