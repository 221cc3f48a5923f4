"""Instance-based lazy rules by one rollup.

All rows prune in the same order, so the groups ever asked for are the prefixes of the features by falling weight: their
class counts are one rollup of the distinct training patterns, and a row takes the deepest prefix of its pattern that is
large and pure enough. Rows themselves are only joined to the answer of their pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .score import pattern_table

FALLBACK = "<majority class fallback>"


def weights(patterns: DataFrame, n_cuts: int, min_support: int = 3) -> DataFrame:
    """cut_id, weight: the best purity of its two values with enough support."""
    bits = F.expr(f"transform(sequence(0, {n_cuts - 1}), i -> shiftright(bits, i) & 1)")
    one = patterns.select("n0", "n1", F.posexplode(bits).alias("cut_id", "v"))
    t = one.groupBy("cut_id", "v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = F.col("n0") + F.col("n1")
    purity = F.when(n >= min_support, F.greatest("n0", "n1") / n).otherwise(0.0)
    return t.groupBy("cut_id").agg(F.round(F.max(purity), 9).alias("weight"))


def _rule(order: list[int], names: list[str], found: Column) -> Column:
    """The conditions of a prefix, by cut, as the row meets them."""
    prefixes = F.array(*(F.array(*map(F.lit, sorted(order[: k + 1]))) for k in range(len(order))))
    said = F.array(*map(F.lit, names))
    own = F.get(prefixes, F.col("level") - 1)
    met = lambda i: F.get(F.expr("transform(sequence(0, 61), i -> shiftright(bits, i) & 1)"), i) == 1
    parts = F.transform(own, lambda i: F.when(met(i), F.get(said, i)).otherwise(F.concat(F.lit("NOT "), F.get(said, i))))
    return F.when(found, F.array_join(parts, " AND ")).otherwise(FALLBACK)


def predict(
    train: DataFrame, test: DataFrame, order: list[int], purity: float = 0.75, min_support: int = 3, names: list[str] = ()
) -> DataFrame:
    """row_id, label, pred, purity, support, stage of every test row; `order`: cut ids by falling weight.

    With names, what cut i means, also rule: the conditions that decided.
    """
    masks = [sum(1 << i for i in order[: k + 1]) for k in range(len(order))]
    level = (F.struct(F.lit(k + 1).alias("level"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks))
    levels = F.inline(F.array(*level))
    patterns = pattern_table(train)
    counts = patterns.select("n0", "n1", levels).groupBy("level", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = F.col("n0") + F.col("n1")
    good = counts.where((n >= min_support) & (F.greatest("n0", "n1") / n >= purity))
    hits = test.select("bits").distinct().select("bits", levels).join(good, ["level", "key"])
    hits = hits.groupBy("bits").agg(F.max_by(F.struct("n0", "n1"), "level").alias("c"), F.max("level").alias("level"))
    whole = [F.coalesce(F.sum(x), F.lit(0)) for x in ("n0", "n1")]
    base = patterns.agg(whole[0].alias("b0"), whole[1].alias("b1"))
    out = test.select("row_id", "label", "bits").join(hits, "bits", "left").crossJoin(F.broadcast(base))  # one row
    found = F.col("level").isNotNull()
    total = F.when(found, F.col("c.n0") + F.col("c.n1")).otherwise(F.col("b0") + F.col("b1"))
    pred = F.when(found, F.col("c.n1") > F.col("c.n0")).otherwise(F.col("b1") > F.col("b0")).cast("int")
    sure = F.round(F.when(found, F.greatest("c.n0", "c.n1") / total).otherwise(0.5), 9)
    stage = F.when(~found, "fallback").when(F.col("level") == len(order), "exact").otherwise("pruned")
    said = [_rule(order, list(names), found).alias("rule")] if names else []
    return out.select(
        "row_id",
        "label",
        pred.alias("pred"),
        sure.alias("purity"),
        total.cast("long").alias("support"),
        stage.alias("stage"),
        *said,
    )
