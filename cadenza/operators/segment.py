"""Cutting a stream at the midpoints between its talking references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.turns import aligned_frames, computed


def segmented(df: DataFrame, key: str) -> DataFrame:
    """One row per frame: key, seg, pos (from 0 within the segment), ts, gen, ref.

    The borders are the midpoints of neighbouring talking references; a frame on a border goes right. Without
    references there is one segment; references of one time share a segment. seg is the number of borders at or before
    the frame. Borders are found within the row; positions take one exchange, on key and segment, so that a long
    session is spread over its segments, and what joins on those keys later needs no further one.
    """
    f = computed(df.select(key, "conversations"), "f", aligned_frames()).select(key, "f")
    f = computed(f, "r", F.expr("transform(filter(f, x -> x.ref <> ''), x -> x.ts)"))
    mids = "if(size(r) > 1, zip_with(slice(r, 2, size(r)), slice(r, 1, size(r) - 1), (a, b) -> (a + b) / 2), cast(array() as array<double>))"
    f = computed(f, "mids", F.expr(mids))
    e = f.select(key, "mids", F.explode("f").alias("x")).select(
        key, F.expr("size(filter(mids, m -> m <= x.ts))").alias("seg"), "x.ts", "x.ord", "x.gen", "x.ref")
    order = Window.partitionBy(key, "seg").orderBy("ts", "ord")
    return e.withColumn("pos", F.row_number().over(order) - 1).select(key, "seg", "pos", "ts", "gen", "ref")
