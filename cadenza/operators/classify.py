"""Events of a judged stream: correct silence, missed response, false alarm, partly correct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numbers import judge_points
from cadenza.functions.silence import PLACEHOLDERS_STREAM
from cadenza.operators import greedy
from cadenza.operators.turns import computed, question, stream_frames


def events(df: DataFrame, key: str, width: float = 2.0, placeholders: tuple[str, ...] = PLACEHOLDERS_STREAM,
           judge=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per event: key, carried columns, scene_type, question, i, timestamp, answer, response, category, score, explanation.

    A talking pred that greedy matching pairs with a talking reference within the band is PartlyCorrect, judged
    against that reference (without a judge: `Error (no LLM)`, score 0). An unpaired one with a talking reference in
    the band gives no row, else it is a FalseAlarm. A silent pred at a silent reference is CorrectSilent; at a talking
    one it gives no row if that reference is paired, else NoResponse. `judge` maps (question, response, answer)
    columns to a struct of score 0..5 and explanation. NULL conversations give no rows; a NULL type is `unknown`.
    """
    d = computed(df.select(key, *carry, "type", "conversations"), "f", stream_frames(placeholders)).select(
        F.col(key), *carry, F.coalesce("type", F.lit("unknown")).alias("scene_type"), F.coalesce(question(), F.lit("")).alias("question"), "f")
    d = computed(greedy.with_candidates(d, "f", width), "m", greedy.matched("cand"))
    d = (d.withColumn("of_pred", F.expr("map_from_entries(transform(m, x -> struct(x.i, x.j)))"))
         .withColumn("in_band", F.expr("array_distinct(transform(cand, x -> x.i))"))
         .withColumn("answered", F.expr("transform(m, x -> x.j)")))
    e = d.select(key, *carry, "scene_type", "question", "f", "of_pred", "in_band", "answered", F.explode("f").alias("x")).select(
        key, *carry, "scene_type", "question", F.col("x.i").alias("i"), F.col("x.ts").alias("timestamp"), F.col("x.pred").alias("response"),
        F.col("x.gt").alias("gt"), F.col("x.pred_silent").alias("ps"), F.col("x.gt_silent").alias("gs"),
        F.expr("f[of_pred[x.i]].gt").alias("paired"), F.expr("map_contains_key(of_pred, x.i)").alias("is_paired"),
        F.expr("array_contains(in_band, x.i)").alias("near"), F.expr("array_contains(answered, x.i)").alias("met"))
    category: Column = (F.when(~F.col("ps") & F.col("is_paired"), F.lit("PartlyCorrect" if judge else "Error (no LLM)"))
                        .when(~F.col("ps") & ~F.col("near"), F.lit("FalseAlarm"))
                        .when(F.col("ps") & F.col("gs"), F.lit("CorrectSilent"))
                        .when(F.col("ps") & ~F.col("met"), F.lit("NoResponse")))
    e = (e.withColumn("category", category).where("category is not null")
         .withColumn("answer", F.when(F.col("is_paired") & ~F.col("ps"), F.col("paired")).otherwise(F.col("gt"))))
    # only what is judged reaches the judge: a NULL response asks nothing
    asked = lambda c: F.when(F.col("category") == "PartlyCorrect", F.col(c))
    verdict = judge(asked("question"), asked("response"), asked("answer")) if judge else F.lit(None).cast("struct<score:double,explanation:string>")
    e = e.withColumn("v", F.when(F.col("category") == "PartlyCorrect", verdict))
    score = F.when(F.col("category") == "CorrectSilent", F.lit(100.0)).when(F.col("category") == "PartlyCorrect", judge_points(F.col("v.score"))).otherwise(F.lit(0.0))
    return e.select(key, *carry, "scene_type", "question", "i", "timestamp", "answer", "response", "category", score.alias("score"),
                    F.coalesce("v.explanation", F.lit("")).alias("explanation"))


def length_judge(asked: Column, response: Column, answer: Column) -> Column:
    """A judge for tests and offline runs: 5 for the same text up to case, else 5 times the shorter length over the longer."""
    a, b = F.lower(response), F.lower(F.coalesce(answer, F.lit("")))
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.struct(F.when(a == b, F.lit(5.0)).otherwise(F.floor(short * 5 / long).cast("double")).alias("score"),
                    F.concat(F.lit("lengths "), F.length(a).cast("string"), F.lit(" and "), F.length(b).cast("string")).alias("explanation"))
