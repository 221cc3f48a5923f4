"""Binarization, tuning and storage against plain restatements."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternspark.functions import features, places
from patternspark.operators import binarize as B
from patternspark.operators import metrics, mine, predict, select, split
from patternspark.plans import pipeline as P
from patternspark.sources import store
from patternspark.streaming import scoring


def plain_walk(cuts, gap):
    kept = []
    for t, g in cuts:
        if not kept or not t - kept[-1][0] < gap:
            kept.append((t, g))
        elif g > kept[-1][1]:
            kept[-1] = (t, g)
    return kept


def test_distance_walk_matches_a_plain_walk(spark):
    rng, rows, want = random.Random(3), [], {}
    for f in range(20):
        ts = sorted(rng.sample([i / 10 for i in range(1, 1000)], rng.randint(1, 150)))
        cuts = [(t, rng.choice([rng.random(), rng.randint(1, 4) / 4, abs(50 - t) / 50])) for t in ts]
        rows += [(f"f{f}", t, g, 0.0, 100.0) for t, g in cuts]
        want[f"f{f}"] = plain_walk(cuts, 6.25)
    got = {f: [] for f in want}
    for r in B.distance_prune(
        spark.createDataFrame(rows, "feature string, t double, gain double, lo double, hi double"), 0.0625
    ).collect():
        got[r["feature"]].append((r["t"], r["gain"]))
    assert {f: sorted(c) for f, c in got.items()} == want


def test_running_sums_cross_ranges(spark):
    rng = random.Random(4)
    rows = [("a", float(x), rng.randint(1, 5)) for x in rng.sample(range(10_000), 700)] + [("b", 1.0, 3)]
    got = B.prefix_sums(
        spark.createDataFrame(rows, "feature string, x double, n long"), ["feature"], ["n"]
    ).orderBy("feature", "x").collect()
    total = 0
    xs = sorted(x for f, x, _ in rows if f == "a")
    for r, x, after in zip(got, xs, [*xs[1:], None], strict=False):
        total += r["n"]
        assert (r["x"], r["next_x"], r["l_n"], r["lo"], r["hi"]) == (x, after, total, xs[0], xs[-1])
    assert (got[-1]["next_x"], got[-1]["l_n"], got[-1]["t_n"]) == (None, 3, 3)


def plain_tree(pts, depth, leaf, w):
    """Thresholds of a one-column tree on (x, label) with class weights w."""
    if depth == 0:
        return set()
    impure = lambda p: (lambda a, b: a * b / (a + b) if a + b else 0.0)(sum(w[1] for _, y in p if y), sum(w[0] for _, y in p if not y))
    xs, best = sorted({x for x, _ in pts}), None
    for a, b in zip(xs, xs[1:], strict=False):
        t = (a + b) / 2
        left, right = [p for p in pts if p[0] <= t], [p for p in pts if p[0] > t]
        fall = impure(pts) - impure(left) - impure(right)
        if min(len(left), len(right)) >= leaf and fall > 1e-9 and (best is None or fall > best[0] + 1e-12):
            best = (fall, t, left, right)
    return {round(best[1], 10)} | plain_tree(best[2], depth - 1, leaf, w) | plain_tree(
        best[3], depth - 1, leaf, w
    ) if best else set()


def test_tree_matches_a_plain_tree(spark):
    rng = random.Random(5)
    pts = [(float(x), int(rng.random() < (0.8 if 20 < x < 50 else 0.2))) for x in (rng.randint(0, 80) for _ in range(150))]
    ones = sum(y for _, y in pts)
    w = {1: (len(pts) / (2 * ones)) ** 2, 0: (len(pts) / (2 * (len(pts) - ones))) ** 2}
    df = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(pts)], "row_id long, label int, x double")
    hist = B.histogram(df, ["x"])
    got = {r["t"] for r in B.tree_thresholds(hist, 3, 5).collect()}
    assert got == plain_tree(pts, 3, 5, w)
    two = sorted(r["t"] for r in B.tree_cuts(hist, "two", 3, 5).collect())
    assert two == [min(got), max(got)]
    assert len(B.tree_cuts(hist, "two", 3, 5, apart=1.0).collect()) == 1
    assert all(4 < r["t"] < 76 for r in B.tree_cuts(hist, "all", 3, 5, edge=0.05).collect())


def test_equal_columns_keep_the_first(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "row_id long, label int, x double")
    cuts = [B.Cut(0, "x", 5.0), B.Cut(1, "x", 5.5), B.Cut(2, "x", 7.0), B.Cut(3, "x", 99.0)]
    assert [c.threshold for c in B.distinct_cuts(df, cuts)] == [5.0, 7.0, 99.0]
    assert len(B.distinct_cuts(df.limit(0), cuts)) == 1


def test_voting_rules_need_support(spark):
    df = spark.createDataFrame([(i, int(i < 6), 1 if i < 6 else 0) for i in range(8)], "row_id long, label int, bits long")
    table = mine.Table.of(df, 1)
    assert {r.label for r in mine.voting_rules(table, 0.9, 0, 3)} == {1}
    assert {r.label for r in mine.voting_rules(table, 0.9, 0, 2)} == {0, 1}


def test_argmax_vote_tie_goes_to_the_first_rule(spark):
    rules = mine.rules_frame(spark, [mine.Rule(0, 1, 1, 1, 3, 0.5), mine.Rule(1, 2, 2, 1, 3, 0.5)])
    rows = spark.createDataFrame([(1, 1, 3), (2, 1, 2)], "row_id long, label int, bits long")
    assert {r["row_id"]: r["pred"] for r in predict.soft_vote_argmax(rows, rules).collect()} == {1: 0, 2: 1}


def test_late_work_is_given_up(spark):
    assert P.within(spark, 30, "quick", lambda: 7) == 7
    with pytest.raises(ZeroDivisionError):
        P.within(spark, 30, "wrong", lambda: 1 // 0)
    with pytest.raises(P.Timeout):
        P.within(spark, 0.2, "late", lambda: time.sleep(3))


def test_tuning_logs_and_resumes(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, int(x > 5), float(x), rng.random()) for i, x in enumerate(rng.randint(0, 10) for _ in range(80))]
    df = spark.createDataFrame(rows, "row_id long, label int, x double, z double")
    configs = P.grid(
        [{"top_k": 2}], [{"selector": "mutualinfo"}], [{"purity": 0.9}, {"miner": "nobody"}], numeric=("x", "z"), threshold=1
    )
    path = f"file://{tmp_path}/trials"
    best = P.tune(df, configs, path).collect()
    assert len(best) == 1 and best[0]["accuracy"] == 1.0 and best[0]["tp"] + best[0]["tn"] == 20
    assert {r["status"]: r["n"] for r in store.status_counts(store.trials(spark, path)).collect()} == {"ok": 1, "error": 1}
    P.tune(df, configs, path)
    assert spark.read.parquet(path).count() == 2
    assert '"accuracy":1.0' in store.top_configs(store.trials(spark, path)).first()["json"]
    assert store.stored_bytes(spark, path) > 0


def test_stage_report_hints(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 0.9, 5, "exact"), (2, 0, 1, 0.5, 9, "fallback")],
        "row_id long, label int, pred int, purity double, support long, stage string",
    )
    assert {r["stage"]: (r["accuracy"], r["hint"]) for r in metrics.stage_report(df).collect()} == {
        "exact": (1.0, False), "fallback": (0.0, True)
    }


def test_places_need_no_task_that_holds_all(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 500)) for i in range(700)]
    df = spark.createDataFrame(rows, "row_id long, g string, x long")
    got = places.place(places.quantile_bucket(df, "x", 8), ["g"], [F.col("x"), F.col("row_id")], "at").collect()
    for g in ("a", "b", None):
        own = sorted((r["x"], r["row_id"], r["at"], r["at_of"]) for r in got if r["g"] == g)
        assert [(k, n) for _, _, k, n in own] == [(k, len(own)) for k in range(len(own))]


def test_codes_follow_first_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, None), (4, "c"), (5, "a")], "row_id long, s string")
    assert {r["row_id"]: r["s_code"] for r in features.factorize(df, "s").collect()} == {1: 0, 2: -1, 3: 1, 4: 0, 5: 2}


def test_unmapped_labels_fail(spark):
    df = spark.createDataFrame([("Cad",), ("Normal",)], "s string")
    label = features.map_target(F.col("s"), {"Cad": 1, "Normal": 0}).alias("y")
    assert [r["y"] for r in df.select(label).collect()] == [1, 0]
    for other in ("Other", None):
        with pytest.raises(Exception, match="label is not mapped"):
            spark.createDataFrame([(other,)], "s string").select(label).collect()


def test_pairs_are_encoded_and_others_stay(spark):
    df = spark.createDataFrame(
        [("Yes", "Male", "Yes", None), (None, "Female", "x", None)], "a string, b string, c string, d string"
    )
    assert [tuple(r) for r in features.binary_encode(df, ["a", "b", "c", "d"]).collect()] == [
        (1, 1, "Yes", None), (None, 0, "x", None)
    ]
    fixed = features.replace_cells(
        spark.createDataFrame([("Fmale", "Fmale ", 1)], "a string, b string, c int"), {"Fmale": "Female"}
    )
    assert tuple(fixed.first()) == ("Female", "Fmale ", 1)


def test_csv_types_are_inferred_and_the_last_column_is_the_label(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    store.write_csv(spark.createDataFrame([(1.5, "x", 1), (2.0, "y", 0)], "a double, b string, target int"), path)
    df, names = features.positional(store.read_csv(spark, path))
    assert names == ["a", "b"] and df.dtypes == [("a", "double"), ("b", "string"), ("label", "int")] and df.count() == 2


def test_a_stored_model_predicts_as_before(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, int(x > 5), float(x), rng.choice("pqr")) for i, x in enumerate(rng.randint(0, 10) for _ in range(80))]
    df = spark.createDataFrame(rows, "row_id long, label int, x double, z string")
    config = P.Config(
        numeric=("x",),
        categoric=("z",),
        selector="greedy",
        purity=0.9,
        threshold=1,
        min_coverage=2,
        vote_threshold=0.3,
        partial_mode="overlap_only",
    )
    model = P.fit(df, config)
    P.save_model(spark, model, f"file://{tmp_path}/model")
    again = P.load_model(spark, f"file://{tmp_path}/model", config)
    for kind in P.CLASSIFIERS:
        one, two = (sorted(map(tuple, P.predict_with(m, df, kind).collect())) for m in (model, again))
        assert one == two and len(one) == 80
    for r in P.compare(again, df, df).collect():
        alone = metrics.metrics(P.predict_with(model, df, r["classifier"])).first()
        assert all(r[k] == alone[k] for k in alone.asDict()) and r["gap"] == 0
        assert r["auc"] == metrics.roc_auc(P.predict_with(model, df, r["classifier"])).first()["auc"]
    assert store.stored_bytes(spark, f"file://{tmp_path}/model") > 0
    with pytest.raises(ValueError):
        P.predict_with(model, df, "nobody")


def test_lazy_models_use_their_settings(spark):
    rows = [(i, int(i % 10 < 5), float(i % 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, label int, x double")
    model = P.fit(df, P.Config(numeric=("x",), miner="lazy", selector="greedy", lazy_support=1))
    got = P.predict_with(model, df, "lazy").collect()
    assert all(r["pred"] == r["label"] for r in got) and all(r["rule"] for r in got)


def test_a_stream_gets_the_batch_predictions(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, i % 8) for i in range(40)], "row_id long, label int, bits long")
    df.write.parquet(f"{tmp_path}/in")
    rules = [mine.Rule(1, 1, 1, 1.0, 5, 0.9), mine.Rule(0, 6, 4, 1.0, 5, 0.5)]
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = scoring.score_stream(stream, rules).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    want = {i: 1 if i % 8 & 1 else 0 if i % 8 & 6 == 4 else 1 for i in range(40)}
    assert {r["row_id"]: r["pred"] for r in spark.table("scored").collect()} == want == {
        r["row_id"]: r["pred"] for r in scoring.score_stream(df, rules).collect()
    }


def test_tuned_weight_is_the_first_of_the_best(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, rng.randint(0, 1), rng.randint(0, 63)) for i in range(200)], "row_id long, label int, bits long")
    p, best = select.Patterns(rows), None
    for w in (0.5, 5.0, 20.0):
        subset = select.astar(p, 6, w, 10)
        worth, good = p.score(select.mask_of(subset))
        key = (1, -len(subset)) if good else (0, worth)
        if best is None or key > best[0]:
            best = (key, w)
    assert P.tune_h_weight(rows, 6, [0.5, 5.0, 20.0], 10) == best[1]


def test_tuned_purity_is_the_lowest_of_the_best(spark):
    rng = random.Random(7)
    rows = [(i, int((b & 3 == 3) != (rng.random() < 0.1)), b) for i, b in enumerate(rng.randint(0, 31) for _ in range(240))]
    df = spark.createDataFrame(rows, "row_id long, label int, bits long")
    folds = {r["row_id"]: r["fold"] for r in split.kfold(df, 3).collect()}
    want = []
    for purity in (0.6, 0.9, 1.1):
        scores = []
        for k in range(3):
            counts = {}
            for i, y, b in rows:
                if folds[i] != k:
                    counts.setdefault(b, [0, 0])[y] += 1
            bits = sorted(counts)
            rules = mine.max_patterns(mine.Table(np.array(bits), np.array([counts[b] for b in bits]), 5), purity)
            own = [(y, b) for i, y, b in rows if folds[i] == k]
            right = 0
            for y, b in own if rules else []:
                fired = [r.label for r in rules if b & r.mask == r.vals]
                over = lambda r, b=b: 1 - ((b ^ r.vals) & r.mask).bit_count() / r.mask.bit_count()
                near = max((r for r in rules if r.weight >= 0.05), key=lambda r: round(over(r) * round(r.weight, 9), 12), default=rules[0])
                right += (fired[0] if fired else near.label) == y
            scores.append(round(right / len(own), 9))
        want.append(sum(scores) / 3)
    got = P.tune_purity(df, 5, [0.6, 0.9, 1.1], k=3)
    assert got == ([0.6, 0.9, 1.1][want.index(max(want))], pytest.approx(max(want)))


def test_folds_without_rules_are_left_out(spark):
    rows = [(i, int(i % 10 < 5), float(i % 10)) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, label int, x double")
    config = P.Config(numeric=("x",), selector="greedy", purity=0.9, threshold=1)
    folds = P.cross_validate(df, config, 3)
    assert [f["fold"] for f in folds] == [0, 1, 2] and all(f["accuracy"] == 1.0 for f in folds)
    assert sum(f["tp"] + f["tn"] for f in folds) == 90
    assert P.summary([{"accuracy": 0.5, "f1": 0.2}, {"accuracy": 1.0, "f1": 0.4}]) == {"folds": 2, "accuracy_mean": 0.75, "accuracy_std": 0.25, "f1_mean": pytest.approx(0.3), "f1_std": pytest.approx(0.1)}
    assert P.cross_validate(df, P.Config(numeric=("x",), selector="greedy", purity=1.1), 3) == []
    assert P.summary([])["accuracy_mean"] is None
