"""Approximate distinct counts that add up (A7, opt-in).

The exact count stays the default.  Where a distinct count is asked again and
again over ranges of days, or over departments together, a sketch for each is
stored once; those of any range are merged, and the data isn't read again.
Sketches are Spark's HyperLogLog ones; with ``LG_K`` = 14 their standard error
is 0.8%.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14


def distinct_sketches(df: DataFrame, by: list[Column | str], value: str, lg_k: int = LG_K) -> DataFrame:
    """One row for each group with the sketch of ``value`` (NULLs don't
    count); a group's rows are combined before any shuffle."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[Column | str] = ()) -> DataFrame:
    """Sketches of larger groups, to be stored or merged again."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketches: DataFrame, alias: str = "nb") -> DataFrame:
    return sketches.withColumn(alias, F.hll_sketch_estimate("sketch")).drop("sketch")
