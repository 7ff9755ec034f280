"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are first grouped by (key, value): that grouping spreads a hot key over as many partitions as it
has values, and map-side combining shrinks it before the shuffle. Everything per key is then derived
from (key, value, weight) rows. Results that need an order of values (percentiles) are found in two
steps over value bins, so that no task holds all values of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weights(df: DataFrame, key: str, values: list[str], weight: str = "weight") -> DataFrame:
    """One row per distinct (key, values) with its number of rows. Nulls are values of their own."""
    return df.groupBy(key, *values).agg(F.count(F.lit(1)).alias(weight))


def per_key(w: DataFrame, key: str, *, sums: dict[str, Column], mins: dict[str, Column] | None = None,
            maxs: dict[str, Column] | None = None, weight: str = "weight") -> DataFrame:
    """Counts, conditional counts and bounds per key, from weighted values.

    `sums` maps an output name to a boolean column: its weight where true. A NULL key forms its own group;
    an empty input gives no rows.
    """
    aggs = [F.sum(F.when(c, F.col(weight)).otherwise(F.lit(0))).alias(n) for n, c in sums.items()]
    aggs += [F.min(c).alias(n) for n, c in (mins or {}).items()]
    aggs += [F.max(c).alias(n) for n, c in (maxs or {}).items()]
    return w.groupBy(key).agg(*aggs)


def distinct_and_mode(w: DataFrame, key: str, value: str, weight: str = "weight") -> DataFrame:
    """Exact distinct count and mode of a value per key; NULL values count for neither, ties go to the smaller."""
    one = w.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(weight).alias("w"))
    best = F.min(F.struct((-F.col("w")).alias("w"), F.col(value).alias("v")))
    return (one.groupBy(key).agg(F.count(F.lit(1)).alias("n_distinct"), best.alias("b"))
            .select(key, "n_distinct", F.col("b.v").alias("mode"), (-F.col("b.w")).alias("mode_rows")))


def percentile(w: DataFrame, key: str, value: str, p: float, bin_width: float, weight: str = "weight") -> DataFrame:
    """Exact lower percentile per key: the smallest value whose cumulative weight reaches p of the key's rows.

    Weights are summed per (key, value bin) first; the bin that holds the rank is found from those sums and
    only its values are looked at. `bin_width` bounds the values that one (key, bin) holds; the bins of a key
    number its value range over the width. NULL values do not count.
    """
    if not 0 < p <= 1 or bin_width <= 0:
        raise ValueError("0 < p <= 1 and bin_width > 0")
    one = (w.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(weight).alias("w"))
           .withColumn("bin", F.floor(F.col(value) / F.lit(bin_width))))
    bins = one.groupBy(key, "bin").agg(F.sum("w").alias("bw"))
    by_key = Window.partitionBy(key)
    ahead = by_key.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (bins.withColumn("upto", F.sum("bw").over(ahead))
           .withColumn("rank", F.ceil(F.sum("bw").over(by_key) * F.lit(p)))
           .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("bw") < F.col("rank")))
           .select(F.col(key).alias("_k"), F.col("bin").alias("_b"), (F.col("rank") - F.col("upto") + F.col("bw")).alias("left")))
    inside = Window.partitionBy(key, "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (one.join(hit, F.col(key).eqNullSafe(F.col("_k")) & (F.col("bin") == F.col("_b")))
             .withColumn("c", F.sum("w").over(inside)).where(F.col("c") >= F.col("left")))
    return found.groupBy(key).agg(F.min(value).alias("value"))


def heavy_keys(per: DataFrame, key: str, rows: str, total: DataFrame, num: int = 1, den: int = 20) -> DataFrame:
    """Keys that hold at least num/den of all rows; `total` is a one-row DataFrame with the number of rows."""
    return per.where(F.col(key).isNotNull() & (F.col(rows) * F.lit(den) >= total.scalar() * F.lit(num))).select(key)
