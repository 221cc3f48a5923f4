"""Aggregates over binary patterns: LAD score, consistency, conflicts, mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WORD = 62


def masked(rows: DataFrame, mask: int | None = None) -> Column:
    """The bits of a mask, or all: a number, or an array of words where cuts don't fit one word."""
    if "words" not in rows.columns:
        return F.col("bits") if mask is None else F.col("bits").bitwiseAND(F.lit(mask))
    if mask is None:
        return F.col("words")
    parts = [mask >> a & (1 << WORD) - 1 for a in range(0, max(mask.bit_length(), 1), WORD)]
    return F.array(*(F.get("words", F.lit(k)).bitwiseAND(F.lit(m)) for k, m in enumerate(parts)))


def pattern_table(rows: DataFrame, mask: int | None = None) -> DataFrame:
    """bits (or words), n0, n1, first0, first1 of every distinct pattern (of the masked bits)."""
    one, name = F.col("label") == 1, "words" if "words" in rows.columns else "bits"
    counts = (F.count_if(~one).alias("n0"), F.count_if(one).alias("n1"))
    first = (F.min(F.when(~one, F.col("row_id"))).alias("first0"), F.min(F.when(one, F.col("row_id"))).alias("first1"))
    return rows.groupBy(masked(rows, mask).alias(name)).agg(*counts, *first)


def lad_score(patterns: DataFrame, class_weight: float = 1.0) -> DataFrame:
    boost = F.when(F.col("n1") > F.col("n0"), class_weight).otherwise(1.0)
    score = F.sum(boost * F.greatest("n0", "n1")) / F.sum(boost * (F.col("n0") + F.col("n1")))
    return patterns.agg(
        F.round(F.coalesce(score, F.lit(0.0)), 9).alias("score"),
        F.count("*").alias("patterns"),
        (F.coalesce(F.max(F.least("n0", "n1")), F.lit(0)) == 0).alias("consistent"),
    )


def inconsistent(patterns: DataFrame) -> DataFrame:
    return patterns.where("n0 > 0 and n1 > 0").select("bits", "n0", "n1")


def majority() -> Column:
    """Larger class of a pattern; a tie goes to the label met first."""
    return F.when(F.col("n1") > F.col("n0"), 1).when(F.col("n0") > F.col("n1"), 0).otherwise(
        F.when(F.col("first1") < F.col("first0"), 1).otherwise(0)
    )


def remove_conflicts(rows: DataFrame, mask: int | None = None) -> DataFrame:
    """Rows whose label is their pattern's majority."""
    patterns = pattern_table(rows, mask)
    keep = patterns.select(F.col(patterns.columns[0]).alias("_bits"), majority().alias("_label"))
    return rows.join(keep, (masked(rows, mask) == F.col("_bits")) & (F.col("label") == F.col("_label")), "left_semi")


def mutual_information(patterns: DataFrame, n_cuts: int) -> DataFrame:
    """cut_id, mi (nats) of every bit with the label."""
    bit = f"get(words, i div {WORD}), i % {WORD}" if "words" in patterns.columns else "bits, i"
    values = F.expr(f"transform(sequence(0, {n_cuts - 1}), i -> shiftright({bit}) & 1)")
    one = patterns.select("n0", "n1", F.posexplode(values).alias("cut_id", "v"))
    t = one.groupBy("cut_id").agg(
        *(F.sum(F.when(F.col("v") == v, F.col(f"n{c}")).otherwise(0)).alias(f"n{v}{c}") for v in (0, 1) for c in (0, 1))
    )
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")

    def term(v: int, c: int) -> Column:
        own, row, col = F.col(f"n{v}{c}"), F.col(f"n{v}0") + F.col(f"n{v}1"), F.col(f"n0{c}") + F.col(f"n1{c}")
        return F.when(own > 0, own / n * F.ln(own * n / (row * col).cast("double"))).otherwise(0.0)

    return t.select("cut_id", F.round(term(0, 0) + term(0, 1) + term(1, 0) + term(1, 1), 9).alias("mi"))


def balanced_weights(rows: DataFrame) -> DataFrame:
    """label, weight = n / (classes * rows of the class)."""
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    # one row
    return n.crossJoin(F.broadcast(whole)).select(
        "label", F.round(F.col("total") / (F.col("classes") * F.col("n")), 9).alias("weight")
    )
