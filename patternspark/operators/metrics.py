"""Evaluation as aggregates.

Predictions are rows with pred and label; `n` names a column that says how many rows each stands for, so predictions of
distinct patterns are evaluated as those of all rows. `by` names columns whose groups are evaluated apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binarize import prefix_sums

#: Ranges that distinct scores are cut into for running sums.
RANGES = 64


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _count(what: Column, n: str | None) -> Column:
    return F.count_if(what) if n is None else F.coalesce(F.sum(F.when(what, F.col(n))), F.lit(0))


def confusion(preds: DataFrame, n: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    one = lambda p, y: _count((F.col("pred") == p) & (F.col("label") == y), n)
    return preds.groupBy(*by).agg(one(0, 0).alias("tn"), one(1, 0).alias("fp"), one(0, 1).alias("fn"), one(1, 1).alias("tp"))


def metrics(preds: DataFrame, n: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    c = {k: F.col(k) for k in ("tn", "fp", "fn", "tp")}
    precision, recall = _ratio(c["tp"], c["tp"] + c["fp"]), _ratio(c["tp"], c["tp"] + c["fn"])
    special = _ratio(c["tn"], c["tn"] + c["fp"])
    f1 = _ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])
    total = c["tn"] + c["fp"] + c["fn"] + c["tp"]
    named = {"accuracy": _ratio(c["tp"] + c["tn"], total), "balanced_accuracy": (recall + special) / 2}
    named |= {"precision": precision, "recall": recall, "f1": f1}
    return confusion(preds, n, by).select(*by, *c, *(F.round(v, 9).alias(k) for k, v in named.items()))


def roc_auc(preds: DataFrame, score: str = "conf", n: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact area by mean ranks over distinct scores, cut into ranges; null when a class is missing."""
    group = [*by, "_all"]
    counts = (_count(F.col("label") == k, n).alias(f"n{k}") for k in (0, 1))
    h = preds.withColumn("_all", F.lit(0)).groupBy(*group, F.col(score).alias("x")).agg(*counts)
    run = prefix_sums(h, group, ["n0"], RANGES)
    twice = F.col("n1") * (2 * (F.col("l_n0") - F.col("n0")) + F.col("n0"))
    t = run.groupBy(*group).agg(F.sum(twice).alias("u2"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    area = F.when((F.col("n0") > 0) & (F.col("n1") > 0), F.col("u2") / (2 * F.col("n0") * F.col("n1")))
    if by:
        return t.select(*by, F.round(area, 9).alias("auc"))
    return t.agg(F.round(F.max(area), 9).alias("auc"))  # a row for an empty table too


def run_statistics(preds: DataFrame, seconds: float | None = None) -> DataFrame:
    """Share of rows that an exact rule decided, and the mean confidence; of a timed run also milliseconds a row."""
    exact = F.avg(F.col("is_exact").cast("double"))
    out = preds.agg(
        F.count("*").alias("n"), F.round(exact, 9).alias("coverage"), F.round(F.avg("conf"), 9).alias("mean_confidence")
    )
    return out if seconds is None else out.withColumn("ms_a_row", F.lit(seconds * 1000) / F.greatest("n", F.lit(1)))


def overfit_gap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Accuracies, their difference and whether it is over a tenth either way."""
    acc = lambda df, name: df.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias(name))
    both = acc(train, "train_acc").crossJoin(F.broadcast(acc(test, "test_acc")))  # one row each
    gap = F.col("train_acc") - F.col("test_acc")
    flagged = F.abs(F.round(gap, 9)) > 0.1
    return both.select(
        *(F.round(x, 9).alias(x) for x in ("train_acc", "test_acc")), F.round(gap, 9).alias("gap"), flagged.alias("flagged")
    )


def stage_report(lazy_preds: DataFrame) -> DataFrame:
    """stage, n, share, accuracy, mean purity and support of lazy predictions; hint where over 30 % fell back."""
    mean = lambda x: F.round(F.avg(x), 9)
    right = (F.col("pred") == F.col("label")).cast("double")
    facts = {"accuracy": mean(right), "mean_purity": mean("purity"), "mean_support": mean("support")}
    s = lazy_preds.groupBy("stage").agg(F.count("*").alias("n"), *(v.alias(k) for k, v in facts.items()))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 9)  # three rows
    return s.withColumn("share", share).withColumn("hint", (F.col("stage") == "fallback") & (F.col("share") > 0.3))


def breakdown(preds: DataFrame, n: int = 50) -> DataFrame:
    """The first n rows by id, and whether each is right: a report, so limited."""
    return preds.orderBy("row_id").limit(n).withColumn("right", F.col("pred") == F.col("label"))
