"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row.

    A plain column may be copied into every place that uses it, lambdas included, and be evaluated for each element there;
    a generator of one element stands in the way of that.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
