"""Replies of a judge, as JSON that may be wrapped or broken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def judge_reply(reply: Column) -> Column:
    """STRUCT<score DOUBLE, explanation STRING>: score 0..5 from the object in the reply, quoted numbers too.

    Fences and text around the object are dropped. What has no score that is a number gives score 0 and an error text.
    """
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    body = F.regexp_replace(F.regexp_replace(body, r",\s*([}\]])", "$1"), "[“”]", '"')
    score = F.get_json_object(body, "$.score").try_cast("double")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(5.0), score))
    return F.struct(F.when(score.isNotNull(), clamped).otherwise(F.lit(0.0)).alias("score"),
                    F.when(score.isNull(), F.lit("unreadable reply")).otherwise(F.coalesce(F.get_json_object(body, "$.explanation"), F.lit(""))).alias("explanation"))
