"""Cutpoints of numeric and categorical features, and their application.

All candidates of all features come from one histogram (feature, x, n, pos) and a running sum, so the cost is one
aggregate of the data however many candidates there are. Gains are compared by the fraction
(pl*nr - pr*nl)^2 / (n^2 nl nr) whose numerator is exactly zero when a split tells nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import cut

MODES = ("one", "two", "all", "dense", "greedy")
#: Ranges into which the values of a feature are cut for running sums, at least and at most, and values for one more.
RANGES, MOST_RANGES, RANGE_VALUES = 16, 4096, 50_000
#: Cuts whose bits fit a word.
WORD = 62


@dataclass(frozen=True)
class Cut:
    """x <= threshold, or x in members."""

    cut_id: int
    feature: str
    threshold: float | None = None
    members: tuple = ()
    gain: float | None = None

    def test(self) -> Column:
        x = F.col(self.feature)
        hit = x.isin(*self.members) if self.members else (x <= self.threshold) & ~F.isnan(x.cast("double"))
        return F.coalesce(hit, F.lit(False))

    def readable(self) -> str:
        if not self.members:
            return f"{self.feature} <= {self.threshold:.4f}"
        if len(self.members) == 1:
            return f"{self.feature} == {self.members[0]}"
        return f"{self.feature} IN {{{', '.join(map(str, self.members))}}}"


def histogram(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """feature, x, n, pos for every distinct value; nulls and NaN take no part in fits."""
    pairs = F.explode(
        F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))
    ).alias("p")
    long = df.select(label, pairs).select("p.feature", "p.x", label).where("x is not null and not isnan(x)")
    return long.groupBy("feature", "x").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def gain(pl: Column, nl: Column, pr: Column, nr: Column) -> Column:
    n = (nl + nr).cast("double")
    diff = (pl * nr - pr * nl).cast("double")
    return diff * diff / (n * n * nl * nr)


def ranges_for(values: int) -> int:
    """Ranges for a histogram of so many rows, so that no range grows with it."""
    return min(MOST_RANGES, max(RANGES, values // RANGE_VALUES))


def prefix_sums(hist: DataFrame, by: list[str], sums: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds next_x, the following value of x, lo and hi, its range, and for every column in sums l_<column>, its sum up
    to x, and t_<column>.

    The values of a group are cut into ranges at approximate quantiles; running sums inside a range and the sums of
    the ranges before it are exact wherever the cuts fall, so no task holds all values of a group.
    """
    quantiles = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    # a row a group
    splits = hist.groupBy(*by).agg(F.array_distinct(F.percentile_approx("x", quantiles, max(1000, 10 * ranges))).alias("_splits"))
    at = F.size(F.filter("_splits", lambda s: s < F.col("x")))
    placed = hist.join(F.broadcast(splits), by).withColumn("_range", at).drop("_splits")
    ends = (F.min("x").alias("_first"), F.max("x").alias("_last"))
    parts = placed.groupBy(*by, "_range").agg(*ends, *(F.sum(c).alias(f"_{c}") for c in sums))
    w = Window.partitionBy(*by)
    order = w.orderBy("_range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = [F.lead("_first").over(order).alias("_next"), F.min("_first").over(w).alias("lo"), F.max("_last").over(w).alias("hi")]
    own += [F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums]
    own += [F.sum(f"_{c}").over(w).alias(f"t_{c}") for c in sums]
    starts = parts.select(*by, "_range", *own)
    inside = Window.partitionBy(*by, "_range").orderBy("x")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # `ranges` rows a group
    out = placed.join(F.broadcast(starts), [*by, "_range"]).withColumn("next_x", F.coalesce(F.lead("x").over(inside), "_next"))
    out = out.withColumns({f"l_{c}": F.sum(c).over(upto) + F.col(f"_b_{c}") for c in sums})
    return out.drop("_range", "_next", *(f"_b_{c}" for c in sums))


def candidates(hist: DataFrame, min_support: int = 5) -> DataFrame:
    """feature, t, nl, nr, gain: midpoints of neighbouring values with support on both sides and a gain."""
    # written once: the plan below reads it three times
    hist = cut(hist)
    c = prefix_sums(hist, ["feature"], ["n", "pos"], ranges_for(hist.count())).where("next_x is not null")
    c = c.select(
        "feature",
        ((F.col("x") + F.col("next_x")) / 2).alias("t"),
        F.col("l_n").alias("nl"),
        (F.col("t_n") - F.col("l_n")).alias("nr"),
        F.col("l_pos").alias("pl"),
        (F.col("t_pos") - F.col("l_pos")).alias("pr"),
        "lo",
        "hi",
    )
    c = c.withColumn("gain", gain(F.col("pl"), F.col("nl"), F.col("pr"), F.col("nr")))
    return c.where((F.col("nl") >= min_support) & (F.col("nr") >= min_support) & (F.col("gain") > 0)).select(
        "feature", "t", "nl", "nr", "gain", "lo", "hi"
    )


def distance_prune(cands: DataFrame, fraction: float = 0.02) -> DataFrame:
    """Walk the thresholds upwards; one within fraction*range of the last kept replaces it if its gain is larger.

    The walk itself is one fold per feature. Before it, every cell of half a gap keeps only the thresholds with more
    gain than all before them or at least that of all after them in the cell: the others can't change the walk. They
    lie within a gap of each other, so the first that the walk accepts is followed up to the cell's later maximum.
    """
    if fraction <= 0:
        return cands.select("feature", "t", "gain")
    cell = Window.partitionBy("feature", F.floor((F.col("t") - F.col("lo")) / ((F.col("hi") - F.col("lo")) * fraction / 2)))
    # growing frames both ways: Spark works off a frame that shrinks from the front in quadratic time
    before = F.max("gain").over(cell.orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    after = F.max("gain").over(cell.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1))
    told = cands.withColumn("_before", before).withColumn("_after", after).where(
        "_before is null or _after is null or gain > _before or gain >= _after"
    )
    kept = "array<struct<t:double,gain:double>>"
    walk = f"""aggregate(cuts, cast(array() as {kept}), (acc, c) -> CASE
        WHEN size(acc) = 0 OR NOT (c.t - element_at(acc, -1).t < gap) THEN concat(acc, array(c))
        WHEN c.gain > element_at(acc, -1).gain THEN concat(slice(acc, 1, size(acc) - 1), array(c))
        ELSE acc END)"""
    grouped = told.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("t", "gain"))).alias("cuts"), ((F.max("hi") - F.max("lo")) * fraction).alias("gap")
    )
    return grouped.select("feature", F.explode(F.expr(walk)).alias("c")).select("feature", "c.t", "c.gain")


def choose(cuts: DataFrame, mode: str = "greedy", top_k: int = 20, apart: DataFrame | None = None) -> DataFrame:
    """The mode's cuts: best one, outer two, all, or the top k by gain (ties: the higher threshold).

    apart: feature, gap. Mode two falls back to the best one where the outer two lie closer than the gap.
    """
    assert mode in MODES, mode
    w = Window.partitionBy("feature")
    if mode in ("all", "dense"):
        return cuts
    best = F.row_number().over(w.orderBy(F.desc("gain"), F.asc("t")))
    if mode == "two":
        gaps = cuts.select("feature").distinct().withColumn("gap", F.lit(0.0)) if apart is None else apart
        c = cuts.join(F.broadcast(gaps), "feature").withColumn("a", F.min("t").over(w)).withColumn(
            "b", F.max("t").over(w)
        ).withColumn("r", best)
        return c.where(
            F.when(F.col("b") - F.col("a") < F.col("gap"), F.col("r") == 1).otherwise(
                (F.col("t") == F.col("a")) | (F.col("t") == F.col("b"))
            )
        ).drop("a", "b", "gap", "r")
    if mode == "greedy":
        best = F.row_number().over(w.orderBy(F.desc("gain"), F.desc("t")))
    return cuts.withColumn("r", best).where(F.col("r") <= (1 if mode == "one" else top_k)).drop("r")


def choose_members(cuts: DataFrame, mode: str = "greedy", top_k: int = 20) -> DataFrame:
    """The mode's value subsets: best one, least and most gain, all, or the top k. Ties: fewer members, then in order."""
    assert mode in MODES, mode
    if mode in ("all", "dense"):
        return cuts
    made = [F.size(F.split("members", ",")), F.col("members")]
    if mode == "two":
        ends = cuts.agg(F.min_by("members", F.struct("gain", *made)).alias("lo"), F.max("gain").alias("top"))
        high = cuts.orderBy(F.desc("gain"), *made).limit(1)
        low = cuts.join(F.broadcast(ends.select("lo")), F.col("members") == F.col("lo")).drop("lo")  # one row
        return low.unionByName(high).distinct()
    return cuts.orderBy(F.desc("gain"), *made).limit(1 if mode == "one" else top_k)


def categorical(df: DataFrame, feature: str, max_group: int = 3, min_support: int = 5, label: str = "label") -> DataFrame:
    """members, gain of value subsets of size 1 to max_group, the full set left out."""
    values = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("string").alias("v")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    # one row: every value of the feature with its counts; written once, as every size of subsets reads it
    packed = cut(
        values.agg(
            F.array_sort(F.collect_list(F.struct("v", "n", "pos"))).alias("vs"), F.sum("n").alias("n"), F.sum("pos").alias("p")
        )
    )
    each = packed.select(F.posexplode("vs").alias("i", "value"))
    made = size = each.select(F.col("i").alias("last"), F.array("value").alias("own"))
    for _ in range(1, max_group):
        # subsets grow by a value after their last
        size = size.join(F.broadcast(each), F.col("i") > F.col("last")).select(
            F.col("i").alias("last"), F.concat("own", F.array("value")).alias("own")
        )
        made = made.unionByName(size)
    whole = F.broadcast(packed.select(F.size("vs").alias("k"), "n", "p"))  # one row
    own = made.crossJoin(whole).where(F.size("own") < F.col("k"))
    add = lambda f: F.aggregate("own", F.lit(0).cast("long"), lambda a, v: a + v[f])
    out = own.withColumn("nl", add("n")).withColumn("pl", add("pos"))
    out = out.withColumn("gain", gain(F.col("pl"), F.col("nl"), F.col("p") - F.col("pl"), F.col("n") - F.col("nl")))
    held = out.where((F.col("nl") >= min_support) & (F.col("n") - F.col("nl") >= min_support) & (F.col("gain") > 0))
    return held.select(F.array_join(F.transform("own", lambda v: v["v"]), ",").alias("members"), "nl", "gain")


def tree_thresholds(
    hist: DataFrame, max_depth: int = 4, min_leaf: int = 5, least_fall: float = 0.0, places: int = 10
) -> DataFrame:
    """feature, t: thresholds of a one-column tree with balanced classes, grown level by level by prefix sums.

    A node is an interval of values; each level splits every interval at its best weighted Gini gain. Sums are of whole
    numbers and weighed at the end, so equal splits tie exactly. places: decimals that thresholds are rounded to.
    """
    hist = cut(hist)
    ranges = ranges_for(hist.count())
    totals = hist.groupBy("feature").agg(F.sum("n").alias("tn"), F.sum("pos").alias("tp"))
    twice = lambda n: F.col("tn") / (2 * n)  # noqa: E731  each class weighs this squared
    squared = lambda n: F.when(n > 0, twice(n) * twice(n)).otherwise(0.0)
    totals = totals.select(
        "feature", squared(F.col("tp")).alias("w1"), squared(F.col("tn") - F.col("tp")).alias("w0"), "tn", "tp"
    )
    nodes = hist.select("feature", "x", "n", "pos", F.lit(1).cast("long").alias("node"))
    found = None

    def impurity(n: Column, pos: Column) -> Column:
        a, b = pos * F.col("w1"), (n - pos) * F.col("w0")
        return F.when(a + b > 0, a * b / (a + b)).otherwise(0.0)

    left, whole = (F.col("l_n"), F.col("l_pos")), (F.col("t_n"), F.col("t_pos"))
    right = (whole[0] - left[0], whole[1] - left[1])
    least = F.greatest(F.lit(1e-9), least_fall * (F.col("tp") * F.col("w1") + (F.col("tn") - F.col("tp")) * F.col("w0")) / 2)
    for _ in range(max_depth):
        c = prefix_sums(nodes, ["feature", "node"], ["n", "pos"], ranges).join(F.broadcast(totals), "feature")  # a row a feature
        c = c.withColumn("fall", impurity(*whole) - impurity(*left) - impurity(*right))
        c = c.withColumn("t", (F.col("x") + F.col("next_x")) / 2).where("t is not null")
        ok = c.where((left[0] >= min_leaf) & (right[0] >= min_leaf) & (F.col("fall") > 1e-9) & (F.col("fall") >= least))
        best = cut(ok.groupBy("feature", "node").agg(F.max_by("t", F.struct("fall", -F.col("t"))).alias("t")))
        # at most 2^depth rows a feature
        lower = F.col("node") * 2 + (F.col("x") > F.col("t")).cast("long")
        nodes = cut(nodes.join(F.broadcast(best), ["feature", "node"]).withColumn("node", lower).drop("t"))
        found = best.select("feature", "t") if found is None else found.unionByName(best.select("feature", "t"))
    return found.select("feature", F.round("t", places).alias("t")).distinct()


def measure(hist: DataFrame, thresholds: DataFrame) -> DataFrame:
    """feature, t, nl, nr, gain (times n; 0 with fewer than two rows on a side), lo, hi of given thresholds."""
    lists = thresholds.groupBy("feature").agg(F.array_sort(F.collect_set("t")).alias("ts"))  # at most 2^depth a feature
    at = hist.join(F.broadcast(lists), "feature").withColumn("k", F.size(F.filter("ts", lambda t: t < F.col("x"))))
    parts = at.groupBy("feature", "k").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    w = Window.partitionBy("feature")
    upto = w.orderBy("k")
    # every threshold lies between two values, so every k from 0 to their number has rows
    c = parts.join(F.broadcast(lists), "feature").select(
        "feature",
        F.expr("get(ts, k)").alias("t"),
        F.sum("n").over(upto).alias("nl"),
        F.sum("pos").over(upto).alias("pl"),
        F.sum("n").over(w).alias("n"),
        F.sum("pos").over(w).alias("p"),
        F.min("lo").over(w).alias("lo"),
        F.max("hi").over(w).alias("hi"),
    ).where("t is not null")
    c = c.withColumn("nr", F.col("n") - F.col("nl")).withColumn(
        "gain",
        F.when((F.col("nl") < 2) | (F.col("nr") < 2), 0.0).otherwise(
            F.col("n") * gain(F.col("pl"), F.col("nl"), F.col("p") - F.col("pl"), F.col("nr"))
        ),
    )
    return c.select("feature", "t", "nl", "nr", "gain", "lo", "hi")


def tree_cuts(
    hist: DataFrame, mode: str = "dense", max_depth: int = 8, min_leaf: int = 5, min_support: int = 5, top_k: int = 20,
    apart: float = 0.02, edge: float = 0.0, least_fall: float = 0.0, places: int = 10,
) -> DataFrame:
    """feature, t, nl, nr, gain, lo, hi of a tree's thresholds with support on both sides, by mode.

    edge: thresholds within this share of the range of either end go (the first variant of the operator takes
    mode two, depth 5, leaves and support of 15, edge 0.05, apart 0.12, least_fall 0.005 and 8 places).
    """
    c = measure(hist, tree_thresholds(hist, max_depth, min_leaf, least_fall, places)).where(
        (F.col("nl") >= min_support) & (F.col("nr") >= min_support)
    )
    if edge > 0:
        margin = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)) * edge
        c = c.where((F.col("t") > F.col("lo") + margin) & (F.col("t") < F.col("hi") - margin))
    gaps = hist.groupBy("feature").agg(((F.max("x") - F.min("x")) * apart).alias("gap"))
    return choose(c, mode, top_k, gaps)


def distinct_cuts(df: DataFrame, cuts: list[Cut]) -> list[Cut]:
    """Cuts renumbered, of those with equal columns the first.

    Bit j of the OR over all patterns of (bits XOR column i repeated in every bit) is 0 just if columns i and j agree
    on every row, so one aggregate compares all columns exactly.
    """
    if not cuts:
        return []
    words = range((len(cuts) + WORD - 1) // WORD)
    rows = df.select(*(_word(cuts[k * WORD : (k + 1) * WORD]).alias(f"w{k}") for k in words))
    repeated = lambda i: -F.shiftright(f"w{i // WORD}", i % WORD).bitwiseAND(F.lit(1)).cast("long")
    apart = rows.agg(
        *(
            F.bit_or(F.col(f"w{k}").bitwiseXOR(repeated(i))).alias(f"c{i}_{k}") for i in range(len(cuts)) for k in words
            if k >= i // WORD
        )
    ).first()
    kept = [c for j, c in enumerate(cuts) if all((apart[f"c{i}_{j // WORD}"] or 0) >> j % WORD & 1 for i in range(j))]
    return [Cut(i, c.feature, c.threshold, c.members, c.gain) for i, c in enumerate(kept)]


def fit(
    df: DataFrame, numeric: list[str], categoric: list[str] = (), mode: str = "greedy", top_k: int = 20, min_support: int = 5,
    fraction: float = 0.02, max_group: int = 3, tree: dict | None = None,
) -> list[Cut]:
    """Cuts in id order: numeric features, then categorical ones; equal columns keep the lowest id.

    tree: arguments of tree_cuts, whose thresholds then replace the candidates of all midpoints.
    """
    hist = histogram(df, numeric)
    if tree is None:
        gaps = hist.groupBy("feature").agg(((F.max("x") - F.min("x")) * fraction).alias("gap"))
        chosen = choose(distance_prune(candidates(hist, min_support), fraction), mode, top_k, gaps)
    else:
        chosen = tree_cuts(hist, mode, top_k=top_k, **{"min_support": min_support, **tree})
    got = chosen.collect()  # pruned: at most 1/fraction, 2^depth or top_k a feature
    place = {f: i for i, f in enumerate(numeric)}
    cuts = [(r["feature"], r["t"], (), r["gain"]) for r in sorted(got, key=lambda r: (place[r["feature"]], r["t"]))]
    for f in categoric:
        best = choose_members(categorical(df, f, max_group, min_support), mode, top_k).collect()
        made = sorted(best, key=lambda r: (r["gain"], r["members"]))
        cuts += [(f, None, tuple(r["members"].split(",")), r["gain"]) for r in made]
    return distinct_cuts(df, [Cut(i, f, t, m, g) for i, (f, t, m, g) in enumerate(cuts)])


def _word(cuts: list[Cut]) -> Column:
    bits = F.lit(0).cast("long")
    for i, c in enumerate(cuts):
        bits = bits + F.when(c.test(), F.lit(1 << i)).otherwise(0)
    return bits.cast("long")


def words(cuts: list[Cut]) -> Column:
    """The bits of any number of cuts, WORD of them in a word."""
    return F.array(*(_word(cuts[a : a + WORD]) for a in range(0, max(len(cuts), 1), WORD)))


def transform(df: DataFrame, cuts: list[Cut]) -> DataFrame:
    """row_id, label and one bit for each cut, never null: as `bits`, or as `words` where they don't fit one word."""
    packed = _word(cuts).alias("bits") if len(cuts) <= WORD else words(cuts).alias("words")
    return df.select("row_id", "label", packed)


CUTS = "cut_id int, feature string, kind string, threshold double, members array<string>, gain double, readable string"


def cuts_frame(spark: SparkSession, cuts: list[Cut]) -> DataFrame:
    """Cuts as a table, which store.save() keeps and cuts_of() reads."""
    kind = lambda c: "categorical" if c.members else "numeric"
    rows = [(c.cut_id, c.feature, kind(c), c.threshold, list(c.members) or None, c.gain, c.readable()) for c in cuts]
    return spark.createDataFrame(rows, CUTS)


def cuts_of(frame: DataFrame) -> list[Cut]:
    rows = sorted(frame.collect(), key=lambda r: r["cut_id"])  # a model's cuts
    return [Cut(r["cut_id"], r["feature"], r["threshold"], tuple(r["members"] or ()), r["gain"]) for r in rows]
