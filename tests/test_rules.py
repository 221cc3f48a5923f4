import heapq
import inspect
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternspark.operators import binarize, lazy, metrics, mine, predict, score, select, split
from patternspark.plans import pipeline as P
from patternspark.plans import registry


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, label int, bits long")


def table(*rows):
    a = np.array(rows, np.int64)
    return mine.Table(a[:, 0], a[:, 1:], 3)


def test_lad_tie_counts_as_label_zero(spark):
    p = score.pattern_table(frame(spark, [(1, 0, 0), (2, 1, 0), (3, 1, 1)]))
    assert score.lad_score(p, 2.0).first()["score"] == pytest.approx((1 + 2) / (2 + 2), abs=1e-9)


def test_conflict_tie_keeps_first_label(spark):
    kept = score.remove_conflicts(frame(spark, [(5, 1, 7), (6, 0, 7), (7, 0, 3)]))
    assert {r["row_id"] for r in kept.collect()} == {5, 7}


def test_distance_walk_drops_and_replaces(spark):
    c = spark.createDataFrame(
        [("f", 1.0, 0.1, 0.0, 100.0), ("f", 1.5, 0.3, 0.0, 100.0), ("f", 1.9, 0.2, 0.0, 100.0), ("f", 9.0, 0.1, 0.0, 100.0)],
        "feature string, t double, gain double, lo double, hi double",
    )
    assert sorted(r["t"] for r in binarize.distance_prune(c, 0.02).collect()) == [1.5, 9.0]


def test_nulls_and_unseen_values_are_bit_zero(spark):
    df = spark.createDataFrame(
        [(1, 0, None, "a"), (2, 1, float("nan"), "z"), (3, 1, 1.0, None)], "row_id long, label int, x double, c string"
    )
    got = binarize.transform(df, [binarize.Cut(0, "x", 2.0), binarize.Cut(1, "c", None, ("a", "b"))])
    assert {r["row_id"]: r["bits"] for r in got.collect()} == {1: 2, 2: 0, 3: 1}


def test_value_subsets_of_more_than_twenty_values(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.random() < (0.9 if i % 23 < 5 else 0.3)), f"v{i % 23:02d}") for i in range(460)]
    df = spark.createDataFrame(rows, "row_id long, label int, c string")
    got = {r["members"]: (r["nl"], r["gain"]) for r in binarize.categorical(df, "c", 3).collect()}
    y, v = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = {}
    for size in (1, 2, 3):
        for combo in combinations(sorted(set(v)), size):
            on = np.isin(v, combo)
            pl, nl, pr, nr = (int(x) for x in (y[on].sum(), on.sum(), y[~on].sum(), (~on).sum()))
            if pl * nr != pr * nl:
                want[",".join(combo)] = (nl, pytest.approx((pl * nr - pr * nl) ** 2 / (460**2 * nl * nr)))
    assert got == want and any(m.count(",") == 2 for m in got)
    assert all(c.members for c in binarize.fit(df, ["row_id"], ["c"], top_k=3) if c.feature == "c")


def test_more_cuts_than_a_word_after_equal_ones_go(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(200)], "row_id long, label int, x double")
    cuts = [binarize.Cut(j, "x", float(t)) for j, t in enumerate([*range(40), *range(40), *range(35, 60)])]
    assert [c.threshold for c in binarize.distinct_cuts(df, cuts)] == [float(t) for t in range(60)]
    cuts = binarize.fit(df, ["x"], mode="all", min_support=1, fraction=0)
    assert len(cuts) > 62
    words = {r["row_id"]: r["words"] for r in binarize.transform(df, cuts).collect()}
    assert all(words[i][k // 62] >> k % 62 & 1 == int(i <= c.threshold) for i in range(200) for k, c in enumerate(cuts))


def test_split_is_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "row_id long, label int")
    got = split.stratified_split(df).groupBy("label", "is_test").count().collect()
    assert {(r["label"], r["is_test"]): r["count"] for r in got} == {(0, True): 15, (0, False): 45, (1, True): 5, (1, False): 15}


def test_early_exit_finds_a_consistent_subset(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(b & 1 and b & 4), int(b)) for i, b in enumerate(rng.integers(0, 32, 60)) for b in [int(b)]]
    rows = [(i, int(bool(y)), b) for i, y, b in rows]
    p = select.Patterns(frame(spark, rows))
    assert p.score(select.mask_of(select.astar(p, 5)))[1]
    assert p.score(select.mask_of(select.greedy(p, 5)))[1]


def plain_astar(score, n, h_weight, most, order):
    heap, seen, best, best_subset = [(0.0, [])], set(), -1, []
    for _ in range(most):
        if not heap:
            break
        _, subset = heapq.heappop(heap)
        key = tuple(sorted(subset))
        if key in seen:
            continue
        seen.add(key)
        s, good = score(key)
        if good:
            return subset
        if s > best:
            best, best_subset = s, subset
        for i in order or range(n):
            if i not in subset and tuple(sorted([*subset, i])) not in seen:
                heapq.heappush(
                    heap,
                    (
                        (len(subset) + 1) / n + h_weight * float(1 - s) + (order.index(i) / n * 0.1 if order else 0.0),
                        [*subset, i],
                    ),
                )
    return best_subset


def test_astar_pops_as_a_heap_of_all_children(spark):
    rng = np.random.default_rng(4)
    rows = [
        (i, int(y), int(b)) for i, (y, b) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 1 << 9, 300), strict=True))
    ]
    p = select.Patterns(frame(spark, rows), 1.5)

    def plain(key):
        groups = {}
        for _, y, b in rows:
            groups.setdefault(tuple(b >> i & 1 for i in key), [0, 0])[y] += 1
        w = [Fraction(3, 2) if b > a else Fraction(1) for a, b in groups.values()]
        s = sum(w * max(g) for w, g in zip(w, groups.values(), strict=True)) / sum(
            w * sum(g) for w, g in zip(w, groups.values(), strict=True)
        )
        return (s if key else Fraction(0)), bool(key) and all(min(g) == 0 for g in groups.values())

    for order in (None, [3, 1, 4, 0, 5, 8, 2, 6, 7]):
        for most in (1, 7, 40, 300):
            assert select.astar(p, 9, 5.0, most, order=order) == plain_astar(plain, 9, 5.0, most, order)
    assert all(p.score(m) == plain(tuple(i for i in range(9) if m >> i & 1)) for m in range(512))


def test_searches_have_the_references_budgets(spark, monkeypatch):
    class Endless(select.Patterns):
        asked = 0

        def score(self, mask):
            Endless.asked += 1
            if Endless.asked > 20_000:
                raise StopIteration
            return Fraction(mask.bit_count(), 100), False

    monkeypatch.setattr(select, "Patterns", Endless)
    rows = frame(spark, [(1, 0, 0), (2, 1, 1), (3, 1, 2)])
    P.choose_features(rows, 40, P.Config(selector="mutualinfo_astar"))
    assert 5_000 < Endless.asked <= 10_000
    Endless.asked = 0
    with pytest.raises(StopIteration):
        P.choose_features(rows, 40, P.Config(selector="astar"))
    assert select.EXPANSIONS == 1_110_999 and select.MI_EXPANSIONS == 10_000
    assert [inspect.signature(mine.genetic).parameters[k].default for k in ("generations", "size")] == [300, 200]


def test_flagship_searches_by_the_default_budget(spark, monkeypatch):
    got = []
    monkeypatch.setattr(registry.P, "fit", lambda rows, c: got.append(c))
    monkeypatch.setattr(registry.P, "compare", lambda *a: None)
    monkeypatch.setattr(registry.split, "stratified_split", lambda rows: spark.createDataFrame([], "is_test boolean"))
    monkeypatch.setattr(registry, "_docs", lambda *a: None)
    registry.flagship(spark, "")
    assert got[0].expansions is None


def test_max_patterns_drops_last_on_ties():
    rules = mine.max_patterns(table((0b111, 0, 5), (0b000, 5, 0)), purity=0.9)
    assert {(r.label, r.mask) for r in rules} == {(1, 1), (0, 1)}


def test_eager_takes_the_lexicographically_first():
    first = mine.eager(table((0b111, 0, 5), (0b000, 5, 0)), purity=0.9)[0]
    assert first.mask == 1 and first.repet == 5


def test_eager_tries_conjunctions_of_all_sizes():
    # label 1 just if the number of ones is odd: any five of six attributes leave both classes alike
    rows = np.array([(b, 5 * (1 - b.bit_count() % 2), 5 * (b.bit_count() % 2)) for b in range(64)], np.int64)
    t = mine.Table(rows[:, 0], rows[:, 1:], 6)
    rules = mine.eager(t, purity=0.9)
    assert any(r.mask == 63 for r in rules) and all(r.purity == 1 for r in rules)
    assert not len(t.without(rules).bits)
    assert not mine.eager(t, purity=0.9, max_size=5)


def test_redundancy_only_counts_kept_rules():
    t = table((1, 0, 5), (2, 0, 1), (4, 5, 0))
    rules = [mine.Rule(1, 4, 0, 1, 6, 0.9), mine.Rule(1, 5, 1, 1, 5, 0.8), mine.Rule(0, 4, 4, 1, 5, 0.7)]
    assert [r.mask for r in mine.prune_redundant(t, rules, 2)] == [4, 4]


def test_unknown_miner_is_refused():
    with pytest.raises(ValueError):
        mine.miner("nobody")
    with pytest.raises(ValueError):
        mine.genetic(table((1, 0, 5)), sharing="other")


def random_rows(width, n=300, seed=11):
    rng = np.random.default_rng(seed)
    return [
        (i, int(rng.random() < (0.85 if b & 5 == 5 or b & 24 == 8 else 0.2)), int(b))
        for i, b in enumerate(rng.integers(0, 1 << width, n))
    ]


def plain_maximal(rows, width, purity):
    """Every pattern on its own, by lists of rows."""
    cover = lambda attrs, bits: [y for _, y, b in rows if all((b ^ bits) >> a & 1 == 0 for a in attrs)]
    pure = lambda y: max(sum(y), len(y) - sum(y)) / len(y)
    found = {}
    for bits in sorted({b for _, _, b in rows}):
        attrs = list(range(width))
        p = pure(cover(attrs, bits))
        while len(attrs) > 1 and p >= purity:
            best = None
            for a in attrs:
                q = pure(cover([x for x in attrs if x != a], bits))
                if q >= purity and q >= (p if best is None else best[0]):
                    best = (q, a)
            if best is None:
                break
            p = best[0]
            attrs.remove(best[1])
        y = cover(attrs, bits)
        if pure(y) >= purity:
            mask = sum(1 << a for a in attrs)
            found.setdefault((int(2 * sum(y) > len(y)), mask, bits & mask), (len(y), pure(y)))
    return found


def test_miners_match_on_arrays_and_in_spark(spark):
    rows = random_rows(6)
    df = frame(spark, rows)
    local = mine.Table.of(df, 6)
    far = mine.Frame(score.pattern_table(df).select("bits", "n0", "n1"), 6)
    assert local.totals() == far.totals() and local.counts([(5, 5), (24, 8), (0, 0)]) == far.counts([(5, 5), (24, 8), (0, 0)])
    told = lambda rules: [(r.label, r.mask, r.vals, round(r.purity, 9), r.repet, round(r.weight, 9)) for r in rules]
    for p in (0.6, 0.8):
        got = mine.max_patterns(local, p)
        assert {(r.label, r.mask, r.vals): (r.repet, r.purity) for r in got} == plain_maximal(rows, 6, p)
        assert told(got) == told(mine.max_patterns(far, p))
    assert told(mine.max_patterns(local, 0.7, 1, 5)) == told(mine.max_patterns(far, 0.7, 1, 5))
    assert told(mine.eager(local, 0.9, cap=4)) == told(mine.eager(far, 0.9, cap=4))


def test_large_tables_stay_in_spark(spark, monkeypatch):
    monkeypatch.setattr(mine, "MOST_PATTERNS", 10)
    t = mine.Table.of(frame(spark, random_rows(5)), 5)
    assert isinstance(t, mine.Frame) and mine.max_patterns(t, 0.7)


def test_genetic_rules_are_what_they_say():
    rows = random_rows(6)
    groups = {}
    for _, y, b in rows:
        groups.setdefault(b, [0, 0])[y] += 1
    t = mine.Table(np.array(list(groups)), np.array(list(groups.values())), 6)
    for args in ({}, {"sharing": "fixed"}, {"strict_swap": True}):
        rules = mine.genetic(t, 0.7, 2, generations=15, size=40, **args)
        assert rules == mine.genetic(t, 0.7, 2, generations=15, size=40, **args) and rules
        for r in rules:
            y = [y for _, y, b in rows if b & r.mask == r.vals]
            right = sum(v == r.label for v in y)
            assert r.repet == len(y) > 2 and r.purity == pytest.approx(right / len(y)) and r.purity >= 0.7
            assert r.weight == pytest.approx(right / sum(v == r.label for _, v, _ in rows)) and r.mask.bit_count() <= 3


def test_children_of_genetic_parents_share_out_their_attributes():
    p = mine._People(table((0b111, 0, 5), (0b000, 5, 0)), 0.6, 0, np.random.default_rng(3), 3)
    for _ in range(50):
        one, two = p.children([[0, 1], [1, 0], 1], [[1, 2], [1, 1], 0], 1.0)
        assert one[0] + two[0] == [0, 1, 2] and one[1] + two[1] == [1, 0, 1]
        x = p.mutate(one, 1.0, True)
        assert x[0] == sorted(set(x[0])) and len(x[0]) == len(x[1]) and x[2] in (0, 1)


def test_selection_over_more_cuts_than_a_word(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(x > 50), int(x)) for i, x in enumerate(rng.integers(0, 100, 300))]
    df = spark.createDataFrame(rows, "row_id long, label int, x long").withColumn("x", F.col("x").cast("double"))
    cuts = [binarize.Cut(j, "x", float(j) + 0.5) for j in range(90)]
    wide = binarize.transform(df, cuts)
    p = select.Patterns(wide)
    assert select.greedy(p, 90) == [50] and p.score(1 << 50) == (1, True)
    mi = {r["cut_id"]: r["mi"] for r in score.mutual_information(score.pattern_table(wide), 90).collect()}
    assert max(mi, key=mi.get) == 50 and len(mi) == 90
    assert p.score((1 << 90) - 1)[1] and p.score((1 << 40) - 1)[0] < 1
    monkey = select.Patterns(wide)
    monkey.words = None  # as for tables that stay in Spark
    for mask in (1 << 50, (1 << 20) | (1 << 70), (1 << 90) - 1):
        assert monkey.score(mask) == p.score(mask)
    assert score.remove_conflicts(wide, 1 << 70).count() < 300 == score.remove_conflicts(wide, 1 << 50).count()


def test_classifiers_of_one_projection_agree_with_each_alone(spark):
    rng = np.random.default_rng(8)
    rules = [
        mine.Rule(int(rng.integers(2)), int(m := rng.integers(1, 64)), int(m) & int(rng.integers(64)), 0.9, 5, float(w))
        for w in rng.random(9)
    ]
    rules = mine.rules_frame(spark, mine.ranked(rules))
    rows = frame(spark, [(i, i % 2, i % 64) for i in range(128)])
    for mode in predict.MODES:
        got = {
            (r["row_id"], r["classifier"]): (r["pred"], r["conf"])
            for r in predict.classify(rows, rules, None, 0.4, mode, 0.3).collect()
        }
        alone = {
            "best_match": predict.best_match(rows, rules, mode, 0.3),
            "soft_vote": predict.soft_vote(rows, rules, 0.4, 0.3),
            "assume_healthy": predict.assume(rows, rules, 0),
            "assume_sick": predict.assume(rows, rules, 1),
        }
        assert got == {(r["row_id"], k): (r["pred"], r["conf"]) for k, df in alone.items() for r in df.collect()}
    again = rows.unionByName(rows)  # ids that repeat stay rows of their own
    assert predict.soft_vote(again, rules).count() == 256
    with pytest.raises(ValueError):
        predict.facts(rows, rules, "other")


def test_lazy_stages(spark):
    train = frame(spark, [(i, 1, 3) for i in range(4)] + [(9 + i, 0, 0) for i in range(5)])
    got = {
        r["row_id"]: (r["stage"], r["pred"])
        for r in lazy.predict(train, frame(spark, [(1, 1, 3), (2, 1, 1), (3, 0, 2)]), [0, 1]).collect()
    }
    assert got == {1: ("exact", 1), 2: ("pruned", 1), 3: ("pruned", 0)}


def test_lazy_rules_name_their_conditions(spark):
    train = frame(spark, [(i, 1, 3) for i in range(4)] + [(9 + i, 0, 0) for i in range(5)])
    got = lazy.predict(
        train, frame(spark, [(1, 1, 3), (2, 1, 1), (3, 0, 2), (4, 0, 7), (4, 0, 7)]), [1, 0], 0.99, 3, ["a", "b", "c"]
    )
    assert sorted((r["row_id"], r["stage"], r["rule"]) for r in got.collect()) == [
        (1, "exact", "a AND b"), (2, "pruned", "NOT b"), (3, "pruned", "b"), (4, "exact", "a AND b"), (4, "exact", "a AND b")
    ]
    none = lazy.predict(train, frame(spark, [(1, 1, 2)]), [0], 1.1, 3, ["a"]).first()
    assert (none["stage"], none["rule"], none["pred"], none["purity"], none["support"]) == ("fallback", lazy.FALLBACK, 0, 0.5, 9)


def test_soft_vote_reaches_its_threshold(spark):
    rules = mine.rules_frame(spark, [mine.Rule(1, 1, 1, 1, 3, 0.5), mine.Rule(0, 2, 2, 1, 3, 0.5)])
    rows = frame(spark, [(1, 1, 3), (2, 0, 2), (3, 0, 0)])
    assert {r["row_id"]: r["pred"] for r in predict.soft_vote(rows, rules).collect()} == {1: 1, 2: 0, 3: 1}


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.9), (0, 0.1)], "label int, conf double")
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(0.875)
    assert metrics.roc_auc(df.where("label = 1")).first()["auc"] is None
