"""Integrity checks; each gives the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and names no parent."""
    own = parent.select(F.col(parent_key).alias("_parent")).where("_parent is not null")
    return child.where(F.col(key).isNotNull()).join(own, F.col(key) == F.col("_parent"), "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with their number as n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def too_long(df: DataFrame, column: str, size: int) -> DataFrame:
    """Texts of more than size bytes."""
    return df.where(F.octet_length(column) > size)


def outside(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where((F.col(column) < low) | (F.col(column) > high))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """rule and broken, the number of rows that break it, for each check."""
    each = [df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, each)
