"""Seeded, exactly stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import place


def _placed(df: DataFrame, seed: int, label: str, row_id: str) -> DataFrame:
    """df with _place and _place_of: places of rows in a digest order of their class."""
    digest = F.md5(F.concat_ws("-", F.lit(seed), F.col(row_id).cast("string")).cast("binary"))
    keyed = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 3))  # 4096 buckets
    return place(keyed, [label], [F.col("_digest"), F.col(row_id)], "_place").drop("_digest")


def stratified_split(
    df: DataFrame, test_size: float = 0.25, seed: int = 42, label: str = "label", row_id: str = "row_id"
) -> DataFrame:
    """Adds is_test: the first round(test_size * n) rows of every class in a digest order."""
    placed = _placed(df, seed, label, row_id)
    return placed.withColumn("is_test", F.col("_place") < F.round(F.col("_place_of") * test_size)).drop("_place", "_place_of")


def kfold(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", row_id: str = "row_id") -> DataFrame:
    """Adds fold, 0 to k-1, dealt in turn along the same order."""
    placed = _placed(df, seed, label, row_id)
    return placed.withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place", "_place_of")
