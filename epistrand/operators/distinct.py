"""Numbers of distinct values, exact or from sketches that are stored and merged.

An exact count must look at all values again whenever a part of the table changes. A sketch
of each part (HyperLogLog) is a few kilobytes whatever the part's size; the sketches of parts,
days or partitions add up to that of their union. The standard error is ``1.04 / sqrt(2 ** lg)``
(DataSketches states less for its estimator), 1.6% for the default of 12.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG = 12


def error_bound(lg: int = LG, deviations: float = 3.0) -> float:
    """How far an estimate may be off, relative to the count, in so many standard errors."""
    return deviations * 1.04 / 2 ** (lg / 2)


def count_distinct(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """``by, n``: the exact number of distinct values, NULL not counted.

    Values are made distinct map-side and by (group, value) first, so that a group may hold
    any share of the rows. Groups whose values are all NULL have 0.
    """
    pairs = df.select(*by, column).distinct()
    return pairs.groupBy(*by).agg(F.count(column).alias("n"))


def sketch_distinct(df: DataFrame, parts: list[str], column: str, lg: int = LG) -> DataFrame:
    """``parts, sketch``: one sketch of the values per part, made map-side. To be stored and added to."""
    return df.groupBy(*parts).agg(F.hll_sketch_agg(F.col(column), F.lit(lg)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by, sketch``: the sketches of the parts of each group as one."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by, estimate``: the number of distinct values in the parts of each group."""
    return merge_sketches(sketches, by).select(*by, F.hll_sketch_estimate("sketch").alias("estimate"))
