"""Aggregates over matches and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numbers import mean_1

_METRICS = ("soft_precision", "soft_recall", "soft_f1", "hard_precision", "hard_recall", "hard_f1", "jaccard", "missing_rate",
            "redundant_rate", "semantic_score", "time_diff", "n_matched", "n_mismatched", "n_missed", "n_redundant")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(match: DataFrame, key: str, fps: float = 1.0, hit: float = 0.5) -> DataFrame:
    """Per key, from rows of kind matched / missed / redundant (score, gen_ts, ref_ts): soft and hard precision, recall and
    F1, jaccard, rates, mean score of the hits, mean time difference and counts. A hit scores above `hit`; the mean score
    takes those at `hit` too. Empty denominators give 0."""
    m, x, r = (F.count_if(F.col("kind") == k) for k in ("matched", "missed", "redundant"))
    hits = F.count_if((F.col("kind") == "matched") & (F.col("score") > hit))
    a = match.groupBy(key).agg(
        m.alias("m"), x.alias("x"), r.alias("r"), hits.alias("h"),
        F.coalesce(F.sum(F.when(F.col("kind") == "matched", F.col("score"))), F.lit(0.0)).alias("s"),
        F.coalesce(F.avg(F.when((F.col("kind") == "matched") & (F.col("score") >= hit), F.col("score"))), F.lit(0.0)).alias("semantic_score"),
        F.coalesce(F.avg(F.when((F.col("kind") == "matched") & (F.col("score") > hit), F.abs(F.col("gen_ts") - F.col("ref_ts")) / fps)), F.lit(0.0)).alias("time_diff"))
    for name, top in (("soft", "s"), ("hard", "h")):
        a = (a.withColumn(f"{name}_precision", _ratio(F.col(top), F.col("m") + F.col("r"))).withColumn(f"{name}_recall", _ratio(F.col(top), F.col("m") + F.col("x")))
             .withColumn(f"{name}_f1", _ratio(2 * F.col(f"{name}_precision") * F.col(f"{name}_recall"), F.col(f"{name}_precision") + F.col(f"{name}_recall"))))
    a = (a.withColumn("jaccard", _ratio(F.col("h"), F.col("m") + F.col("x") + F.col("r")))
         .withColumn("missing_rate", _ratio(F.col("x"), F.col("m") + F.col("x"))).withColumn("redundant_rate", _ratio(F.col("r"), F.col("m") + F.col("r")))
         .withColumn("n_mismatched", F.col("m") - F.col("h"))
         .withColumnsRenamed({"h": "n_matched", "x": "n_missed", "r": "n_redundant"}))
    return a.select(key, *_METRICS)


def macro(per_key: DataFrame, *by: str) -> DataFrame:
    """One row (or one for each of `by`): the mean over keys of every metric; NULLs for no keys."""
    return per_key.groupBy(*by).agg(*[F.avg(n).alias(f"avg_{n}") for n in _METRICS], F.count(F.lit(1)).alias("n_keys"))


def distribution(events: DataFrame, *by: str) -> DataFrame:
    """Share (percent) and mean score of each category, over everything and for each value of `by` (subset `all`, else the value).

    Only grouped sums go through the window, so its input is a few rows."""
    scene = F.col(by[0]) if by else None
    sets = events.groupBy("category", *by).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    whole = sets.groupBy("category").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("subset", F.lit("all"))
    parts = sets.withColumn("subset", scene).select("category", "n", "s", "subset") if by else whole.limit(0)
    both = whole.unionByName(parts)
    of = Window.partitionBy("subset")
    return both.select("subset", "category", "n", (F.col("n") * 100.0 / F.sum("n").over(of)).alias("percent"), (F.col("s") / F.col("n")).alias("mean_score"))


def final_score(events: DataFrame, *by: str) -> DataFrame:
    """Micro mean of the scores over all rows (or for each of `by`), with the number of rows."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.avg("score").alias("mean_score"), mean_1(F.avg("score")).alias("final_score"))


def usage(df: DataFrame, *by: str) -> DataFrame:
    """Sums of the token counters; a NULL struct or counter adds 0."""
    names = ("input_tokens", "output_tokens", "total_tokens", "api_calls")
    return df.groupBy(*by).agg(*[F.sum(F.coalesce(f"gen_args.{n}", F.lit(0))).alias(n) for n in names], F.count(F.lit(1)).alias("n_rows"))
