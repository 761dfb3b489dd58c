"""Set and duplicate operators on tables and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their counts."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): missing from the found, or unexpected among them."""
    missing = expected.select(key).distinct().join(found.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    unexpected = found.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(unexpected)


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays without repeats hold the same values."""
    distinct = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return distinct & (F.array_sort(a) == F.array_sort(b))


def missing(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0
