"""Places of rows in an order, without a task that holds all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a column of numbers is cut into.
RANGES = 256


def quantile_bucket(df: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """Adds _bucket: the range of a number between approximate quantiles; null lies in the first."""
    at = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    splits = df.agg(F.array_distinct(F.percentile_approx(column, at, 1000)).alias("_splits"))
    one = df.crossJoin(F.broadcast(splits))  # one row
    below = F.size(F.filter("_splits", lambda s: s < F.col(column)))
    return one.withColumn("_bucket", F.coalesce(below, F.lit(0))).drop("_splits")


def place(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`, the 0-based place of every row in the order of its group, and `name`_of, the rows of the group.

    df has _bucket, which never falls along the order and has so few values that a row for each fits a broadcast. Rows
    are ranked inside their bucket, and counts of the buckets before it do the rest. A null group is a group.
    """
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "_bucket"]
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    starts = counts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), start, F.sum("_n").over(whole).alias(f"{name}_of"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    inside = Window.partitionBy(*keys).orderBy(*order)
    out = df.join(F.broadcast(starts), same).withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
    return out.drop("_start", "_bucket", *(f"_of_{k}" for k in keys))
