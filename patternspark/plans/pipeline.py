"""Binarize, select, mine, classify, evaluate; cross-validation and tuning."""

from __future__ import annotations

import datetime
import statistics
import time
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binarize, lazy, metrics, mine, predict, score, select, split
from ..sources import store


@dataclass
class Config:
    numeric: tuple = ()
    categoric: tuple = ()
    mode: str = "greedy"
    top_k: int = 8
    min_support: int = 5
    fraction: float = 0.02
    max_group: int = 3
    tree: dict | None = None
    selector: str = "mutualinfo_astar"
    h_weight: float = 5.0
    expansions: int | None = None  # None: the selector's own budget
    miner: str = "maxpatterns"
    purity: float = 0.95
    threshold: int = 3
    class_weight: float = 1.0
    miner_args: dict = field(default_factory=dict)
    min_coverage: int | None = None  # support of the overlapping rules that the other classifiers vote with
    vote_threshold: float = 0.5  # share of the weight that label 1 needs in the soft vote
    partial_mode: str = "overlap_times_weight"  # of the best match where no rule fires
    min_weight: float = predict.MIN_WEIGHT  # of rules that may match in part
    lazy_purity: float = 0.75
    lazy_support: int = 3


@dataclass
class Model:
    cuts: list
    subset: list
    rules: list
    order: list
    train: DataFrame | None
    voting: list = field(default_factory=list)
    config: Config = field(default_factory=Config)

    def selected(self) -> list:
        return [self.cuts[i] for i in self.subset]

    def apply(self, df: DataFrame) -> DataFrame:
        return binarize.transform(df, self.selected())

    def names(self) -> list[str]:
        return [c.readable() for c in self.selected()]


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """The selected cuts, the rules and the voting rules of a model, as tables in a folder."""
    store.save(binarize.cuts_frame(spark, model.selected()), f"{path}/cuts")
    store.save(mine.rules_frame(spark, model.rules), f"{path}/rules")
    store.save(mine.rules_frame(spark, model.voting), f"{path}/voting")


def load_model(spark: SparkSession, path: str, config: Config | None = None) -> Model:
    """A stored model, ready to be applied to raw rows."""
    cuts = sorted(binarize.cuts_of(store.load(spark, f"{path}/cuts")), key=lambda c: c.cut_id)
    rules, voting = (mine.rules_of(store.load(spark, f"{path}/{x}")) for x in ("rules", "voting"))
    return Model(cuts, list(range(len(cuts))), rules, [], None, voting, config or Config())


def choose_features(rows: DataFrame, n: int, c: Config) -> list[int]:
    p = select.Patterns(rows, c.class_weight)
    if c.selector == "greedy":
        return select.greedy(p, n)
    if c.selector == "astar":
        return select.astar(p, n, c.h_weight, c.expansions)
    mi = {r["cut_id"]: r["mi"] for r in score.mutual_information(score.pattern_table(rows), n).collect()}
    order = select.mi_order(mi, n)
    if c.selector == "mutualinfo":
        return select.mi_greedy(p, order)
    if c.selector == "mutualinfo_astar":
        return select.astar(p, n, c.h_weight, c.expansions, order=order)
    raise ValueError(f"unknown selector {c.selector}")


def fit(train: DataFrame, c: Config, reuse: dict | None = None) -> Model:
    """reuse: cuts and subsets of the last configuration, taken where this one agrees with it up to that stage."""
    reuse = {} if reuse is None else reuse

    def stage(name: str, key: tuple, make):
        if reuse.get(name, (None,))[0] != key:
            reuse[name] = (key, make())
        return reuse[name][1]

    first = repr((c.numeric, c.categoric, c.mode, c.top_k, c.min_support, c.fraction, c.max_group, c.tree))
    rest = (c.mode, c.top_k, c.min_support, c.fraction, c.max_group)
    cuts = stage("cuts", (first,), lambda: binarize.fit(train, list(c.numeric), list(c.categoric), *rest, tree=c.tree))
    if not cuts:
        raise RuntimeError("no feature tells the classes apart")
    second = (first, c.selector, c.h_weight, c.expansions, c.class_weight)
    bits = stage("bits", (first,), lambda: store.cut(binarize.transform(train, cuts)))
    subset = stage("subset", second, lambda: choose_features(bits, len(cuts), c))
    if len(subset) > score.WORD:
        raise ValueError(f"{len(subset)} cuts were selected, and rules are over at most {score.WORD}: set a smaller budget")
    clean = stage(
        "clean", second, lambda: store.cut(score.remove_conflicts(binarize.transform(train, [cuts[i] for i in subset])))
    )
    if c.miner == "lazy":
        w = {r["cut_id"]: r["weight"] for r in lazy.weights(score.pattern_table(clean), len(subset), c.lazy_support).collect()}
        return Model(cuts, subset, [], sorted(w, key=lambda i: (-w[i], -i)), clean, config=c)
    table = stage("table", second, lambda: mine.Table.of(clean, len(subset)))
    rules = mine.miner(c.miner, **{"purity": c.purity, "threshold": c.threshold, **c.miner_args})(table)
    voting = [] if c.min_coverage is None else mine.voting_rules(table, c.purity, c.threshold, c.min_coverage)
    return Model(cuts, subset, rules, [], clean, voting, c)


def _rule_tables(model: Model, spark: SparkSession) -> tuple[DataFrame, DataFrame | None]:
    if not model.rules:
        raise RuntimeError("no rules")
    return mine.rules_frame(spark, model.rules), mine.rules_frame(spark, model.voting) if model.voting else None


def predict_with(model: Model, df: DataFrame, classifier: str = "best_match") -> DataFrame:
    """Predictions of rows by one classifier, with the model's settings."""
    rows, c = model.apply(df), model.config
    if classifier == "lazy":
        return lazy.predict(model.train, rows, model.order, c.lazy_purity, c.lazy_support, model.names())
    if classifier not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {classifier}")
    rules, voting = _rule_tables(model, df.sparkSession)
    if classifier == "best_match":
        return predict.best_match(rows, rules, c.partial_mode, c.min_weight)
    votes = rules if voting is None else voting
    if classifier == "soft_vote":
        return predict.soft_vote(rows, votes, c.vote_threshold, c.min_weight)
    return predict.assume(rows, votes, int(classifier == "assume_sick"))


CLASSIFIERS = predict.CLASSIFIERS


def classified(model: Model, df: DataFrame) -> DataFrame:
    """bits, label, n, classifier, pred, conf: all four classifiers on the distinct patterns of rows.

    Predictions depend on the pattern alone, so what rules are matched against doesn't grow with the rows.
    """
    c, (rules, voting) = model.config, _rule_tables(model, df.sparkSession)
    patterns = model.apply(df).groupBy("bits", "label").agg(F.count("*").alias("n"))
    return predict.classify(patterns, rules, voting, c.vote_threshold, c.partial_mode, c.min_weight)


def compare(model: Model, df: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Metrics and area of the four rule classifiers, one row each; with train also its accuracy and the gap.

    The last three vote with the overlapping rules where the model has them.
    """
    preds, by = store.cut(classified(model, df)), ("classifier",)
    out = metrics.metrics(preds, "n", by).join(metrics.roc_auc(preds, n="n", by=by), "classifier")  # four rows
    if train is None:
        return out
    told = metrics.metrics(classified(model, train), "n", by).select("classifier", F.col("accuracy").alias("train_acc"))
    gap = F.round(F.col("train_acc") - F.col("accuracy"), 9)
    return out.join(told, "classifier").withColumns({"gap": gap, "flagged": F.abs(gap) > 0.1})


def cross_validate(df: DataFrame, c: Config, k: int = 5) -> list[dict]:
    """Metrics of every fold whose model has rules; each model is fitted on the other folds."""
    folds, out = store.cut(split.kfold(df, k)), []
    for i in range(k):
        kind = "lazy" if c.miner == "lazy" else "best_match"
        model = fit(folds.where(F.col("fold") != i), c)
        if model.rules or kind == "lazy":
            out.append(
                {"fold": i, **metrics.metrics(predict_with(model, folds.where(F.col("fold") == i), kind)).first().asDict()}
            )
    return out


def summary(folds: list[dict]) -> dict:
    """Mean and population standard deviation of accuracy and F1 over folds; None without folds."""
    out: dict = {"folds": len(folds)}
    for k in ("accuracy", "f1"):
        x = [f[k] for f in folds]
        out[f"{k}_mean"] = statistics.fmean(x) if x else None
        out[f"{k}_std"] = statistics.pstdev(x) if x else None
    return out


def tune_h_weight(rows: DataFrame, n: int, candidates: list[float], expansions: int = 10_000) -> float:
    """The weight with which A* finds the smallest consistent subset; without any, the best score. Ties: the first."""
    p = select.Patterns(rows)
    best = None
    for w in candidates:
        subset = select.astar(p, n, w, expansions)
        score_, good = p.score(select.mask_of(subset))
        key = (good, -len(subset) if good else score_)
        if best is None or key > best[0]:
            best = (key, w)
    return best[1]


def tune_purity(
    rows: DataFrame, n: int, candidates: list[float], miner: str = "maxpatterns", threshold: int = 0, k: int = 5
) -> tuple[float, float]:
    """(purity, mean accuracy over k folds), the lowest purity of the best; a fold without rules counts 0.

    rows: row_id, label, bits of n selected cuts.
    """
    folds = store.cut(split.kfold(rows, k))
    tables = [mine.Table.of(folds.where(F.col("fold") != i), n) for i in range(k)]
    best = None
    for purity in candidates:
        scores = []
        for i, t in enumerate(tables):
            rules = mine.miner(miner, purity=purity, threshold=threshold)(t)
            scores.append(
                metrics.metrics(
                    predict.best_match(folds.where(F.col("fold") == i), mine.rules_frame(rows.sparkSession, rules))
                ).first()["accuracy"]
                if rules else 0.0
            )
        if best is None or statistics.fmean(scores) > best[1]:
            best = (purity, statistics.fmean(scores))
    return best


class Timeout(Exception):
    pass


def within(spark, seconds: float, tag: str, f):
    """f(), or Timeout after so many seconds: its Spark jobs, tagged for its thread, are then cancelled."""
    box: dict = {}

    def work() -> None:
        spark.addTag(tag)
        try:
            box["value"] = f()
        except Exception as e:
            box["error"] = e
        finally:
            spark.removeTag(tag)

    thread = InheritableThread(target=work, session=spark)
    thread.daemon = True
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.interruptTag(tag)
        raise Timeout(f"over {seconds} s")
    if "error" in box:
        raise box["error"]
    return box["value"]


def grid(binarizers: list[dict], selectors: list[dict], miners: list[dict], **fixed) -> list[Config]:
    """Every combination, so ordered that neighbours share their cuts and their selection."""
    return [Config(**{**fixed, **b, **s, **m}) for b in binarizers for s in selectors for m in miners]


def trial(train: DataFrame, test: DataFrame, c: Config, reuse: dict) -> tuple:
    """One configuration: counts, metrics of its four classifiers, and the gap; reuse holds the last stages' results."""
    model = fit(train, c, reuse)
    sizes = (len(model.cuts), len(model.subset), len(model.rules))
    if c.miner == "lazy":
        kinds = ("lazy",)
        m = {"lazy": metrics.metrics(predict_with(model, test, "lazy")).first()}
        train_acc = metrics.metrics(predict_with(model, train, "lazy")).first()["accuracy"]
    else:
        kinds = CLASSIFIERS
        m = {r["classifier"]: r for r in compare(model, test, train).collect()}
        train_acc = m[kinds[0]]["train_acc"]
    first = m[kinds[0]]
    others = tuple(m[k]["accuracy"] if k in m else None for k in CLASSIFIERS[1:])
    counts = (first["tp"], first["fp"], first["fn"], first["tn"])
    return (*sizes, first["accuracy"], first["f1"], train_acc, train_acc - first["accuracy"], *counts, *others)


def tune(df: DataFrame, configs: list[Config], path: str, most_seconds: float = 600) -> DataFrame:
    """Run every configuration that the log doesn't hold yet; errors and timeouts are logged, not raised."""
    spark = df.sparkSession
    marked = store.cut(split.stratified_split(df))
    train, test = marked.where("not is_test"), marked.where("is_test")
    done = {
        r["config_hash"] for r in store.trials(spark, path).select("config_hash").collect()
    } if store.exists(spark, path) else set()
    reuse: dict = {}
    for c in configs:
        key = store.config_hash(vars(c))
        if key in done:
            continue
        began, row = time.time(), (0, 0, 0, *(None,) * 11)
        status, error = "ok", ""
        try:
            row = within(spark, most_seconds, f"trial-{key}", lambda c=c, reuse=reuse: trial(train, test, c, reuse))
        except Timeout as e:
            status, error, reuse = "timeout", str(e), {}  # the late thread may still write to the old one
        except Exception as e:
            status, error = "error", str(e)[:300]
        store.log_trials(spark, path, [(key, str(vars(c)), *row, time.time() - began, status, error, datetime.datetime.now())])
    return store.leaderboard(store.trials(spark, path))
