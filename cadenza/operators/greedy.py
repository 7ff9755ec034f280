"""Band joins in time, and greedy nearest-first matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.once import computed


def band_pairs(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """(key, i, j, dt) of rows of one key at most `width` apart, both ends included.

    left has key, i, ts and right key, j, ts. The join is an equi-join on (key, bucket of time): the right side goes
    into its own bucket and both neighbours, so that a key of any size is spread over its buckets. Width 0 joins on
    the time itself. NULL keys and times match nothing.
    """
    if width <= 0:
        return left.join(right.withColumnRenamed("ts", "ts_r"), (left["key"] == right["key"]) & (F.col("ts") == F.col("ts_r"))).select(
            left["key"], "i", "j", F.lit(0.0).alias("dt"))
    at = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    r = (right.select(F.col("key").alias("key_r"), "j", F.col("ts").alias("ts_r"))
         .withColumn("b", F.explode(F.sequence(at("ts_r") - 1, at("ts_r") + 1))))
    le = left.withColumn("b_l", at("ts"))
    dt = F.abs(F.col("ts") - F.col("ts_r"))
    return le.join(r, (F.col("key") == F.col("key_r")) & (F.col("b_l") == F.col("b")) & (dt <= width)).select("key", "i", "j", dt.alias("dt"))


def candidates(frames: str, width: float) -> Column:
    """Within a row: ARRAY<STRUCT<dt, i, j>> of talking preds i and talking references j in the band, nearest first."""
    return _pairs(f"filter({frames}, x -> not x.pred_silent)", f"filter({frames}, x -> not x.gt_silent)", width)


def _pairs(preds: str, refs: str, width: float) -> Column:
    return F.expr(f"""array_sort(flatten(transform({preds}, p ->
        transform(filter({refs}, g -> abs(p.ts - g.ts) <= {float(width)!r}D),
                  g -> named_struct('dt', abs(p.ts - g.ts), 'i', p.i, 'j', g.i)))))""")


def with_candidates(df: DataFrame, frames: str, width: float, name: str = "cand") -> DataFrame:
    """Adds the candidates of a row's frames. The talking frames of both sides are picked out once, so the work is the product of
    their numbers, whatever the number of silent seconds."""
    short = lambda keep: F.expr(f"transform(filter({frames}, x -> not x.{keep}), x -> named_struct('ts', x.ts, 'i', x.i))")
    d = computed(computed(df, "_preds", short("pred_silent")), "_refs", short("gt_silent"))
    return computed(d, name, _pairs("_preds", "_refs", width)).drop("_preds", "_refs")


def matched(cand: str) -> Column:
    """Within a row: the pairs that greedy nearest-first matching takes from sorted candidates; each i and j at most once."""
    return F.expr(f"""aggregate({cand}, cast(array() as array<struct<dt: double, i: int, j: int>>),
        (a, x) -> if(exists(a, y -> y.i = x.i or y.j = x.j), a, array_append(a, x)))""")
