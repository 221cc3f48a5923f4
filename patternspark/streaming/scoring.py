"""Stateless scoring of a stream of binary rows with a fixed rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mine


def score_stream(stream: DataFrame, rules: list[mine.Rule]) -> DataFrame:
    """Adds pred: the label of the first firing rule, else that of the first rule. Works on batches and streams."""
    pred = F.lit(rules[0].label)
    for r in reversed(rules):
        pred = F.when(F.col("bits").bitwiseAND(F.lit(r.mask)) == r.vals, r.label).otherwise(pred)
    return stream.withColumn("pred", pred)
