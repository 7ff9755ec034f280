"""Numbers as the scoring stages need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_cost(i: Column, j: Column, sigma: float = 0.01) -> Column:
    """Gaussian cost of a distance in positions: 0 at the same place, towards 1 far away."""
    return 1 - F.exp(F.lit(-sigma) * F.pow((i - j).cast("double"), F.lit(2.0)))


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in doubles; NULL if one is NULL or has no length."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p as double) * cast(q as double)), 0D, (s, v) -> s + v)"
    return F.expr(f"{dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0D)")


def semantic_cost(cos: Column) -> Column:
    """1 - |cos|: opposite directions count as the same."""
    return 1 - F.abs(cos)


def agreement_cost(gen_talks: Column, ref_talks: Column) -> Column:
    """0 if both talk or both are silent, else 1."""
    return F.when(gen_talks == ref_talks, F.lit(0.0)).otherwise(F.lit(1.0))


def judge_points(score: Column) -> Column:
    """A judge's 0..5 as 0..100, clamped; NaN gives 100, NULL stays NULL."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(5.0), score)) * 20)


def chunk_count(seconds: Column, chunk: int) -> Column:
    """How many chunks cover so many seconds; 0 for NULL or nothing."""
    return F.when(seconds > 0, F.ceil(seconds / F.lit(chunk))).otherwise(F.lit(0)).cast("int")


def tail_seconds(key: Column, low: int = 10, high: int = 15, seed: int = 0, text: bool = False) -> Column:
    """Trailing seconds between low and high, fixed by key and seed; a NULL key draws as 0. Text keys draw by their hash."""
    draw = F.xxhash64(key, F.lit(seed)) if text else F.coalesce(key, F.lit(0)) * 7 + seed
    return F.lit(low) + F.pmod(draw, F.lit(high - low + 1)).cast("int")


def mean_1(x: Column) -> Column:
    """A mean to one decimal: scaled, rounded half to even, scaled back."""
    return F.rint(x * 10) / 10
