"""Rule miners over a pattern table: pattern -> (n0, n1).

Mining depends on the distinct patterns only. Up to a bound they are collected, and a miner works on arrays; beyond it the
table stays in Spark, and every step of a miner is an aggregate over it. Both kinds answer the same questions, so a miner
is written once: counts of conjunctions, the purest conjunction of a size, maximal conjunctions of all patterns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import cut
from . import score as S

MOST_PATTERNS = 200_000
#: Masks whose groupings a collected table remembers, and masks that one job of a table in Spark works off.
MEMO = 512
MASKS_A_JOB = 2048
RULES = "rule_rank int, label int, mask long, vals long, purity double, repet long, weight double, source string"


@dataclass
class Rule:
    label: int
    mask: int
    vals: int
    purity: float
    repet: int
    weight: float = 0.0
    source: str = ""


def _attrs(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


class Table:
    """Distinct patterns as arrays."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, width: int):
        self.bits, self.n, self.width, self.memo = bits, n, width, {}

    @classmethod
    def of(cls, rows: DataFrame, width: int) -> Table | Frame:
        """The pattern table of rows, as arrays up to MOST_PATTERNS patterns."""
        if width > S.WORD:
            raise ValueError(f"rules are over at most {S.WORD} cuts: select fewer")
        patterns = S.pattern_table(rows).select("bits", "n0", "n1")
        got = patterns.orderBy("bits").limit(MOST_PATTERNS + 1).collect()
        if len(got) > MOST_PATTERNS:
            return Frame(cut(patterns), width)
        a = np.array([tuple(r) for r in got], np.int64).reshape(-1, 3)
        return cls(a[:, 0], a[:, 1:], width)

    def totals(self) -> tuple[int, int]:
        return int(self.n[:, 0].sum()), int(self.n[:, 1].sum())

    def counts(self, asked: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Class counts of conjunctions (mask, values)."""
        out = []
        for mask, vals in asked:
            c = self.n[(self.bits & mask) == vals].sum(0)
            out.append((int(c[0]), int(c[1])))
        return out

    def _grouped(self, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values under a mask, their class counts, and each pattern's place among them."""
        if mask not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.pop(next(iter(self.memo)))
            vals, back = np.unique(self.bits & mask, return_inverse=True)
            c = np.stack([np.bincount(back, self.n[:, k], len(vals)) for k in (0, 1)], 1).astype(np.int64)
            self.memo[mask] = (vals, c, back)
        return self.memo[mask]

    def best(self, size: int, purity: float, threshold: int, least: int) -> Rule | None:
        """Of the pure conjunctions of a size the purest, then the largest, then the first by attributes and values."""
        found = None
        for attrs in combinations(range(self.width), size):
            mask = sum(1 << a for a in attrs)
            vals, c, _ = self._grouped(mask)
            total = c.sum(1)
            pure = c.max(1) / total
            for i in np.flatnonzero((total >= least) & (total > threshold) & (pure >= purity)).tolist():
                said = tuple(int(vals[i]) >> a & 1 for a in attrs)
                key = (-pure[i], -total[i], attrs, said)
                if found is None or key < found[0]:
                    found = (key, Rule(int(c[i, 1] > c[i, 0]), mask, int(vals[i]), float(pure[i]), int(total[i])))
        return found and found[1]

    def maximal(self, purity: float, threshold: int) -> Iterator[Rule]:
        """From every pattern, drop attributes while purity stays (ties: the last tried); equal ends once, by pattern.

        Patterns that stand at the same mask try the same masks, so a grouping serves all of them.
        """
        full, k = (1 << self.width) - 1, len(self.bits)
        mask = np.full(k, full, np.int64)
        p = self.n.max(1) / self.n.sum(1) if k else np.zeros(0)
        open_ = (p >= purity) & (self.width > 1)
        while open_.any():
            best, drop = np.where(open_, p, -1.0), np.full(k, -1)
            for m in np.unique(mask[open_]).tolist():
                at = np.flatnonzero(open_ & (mask == m))
                for a in _attrs(m):
                    _, c, back = self._grouped(m & ~(1 << a))
                    own = c[back[at]]
                    q = own.max(1) / own.sum(1)
                    take = (q >= purity) & (q >= best[at])
                    best[at[take]], drop[at[take]] = q[take], a
            open_ = drop >= 0
            p[open_] = best[open_]
            mask[open_] &= ~(np.int64(1) << drop[open_])
            open_ &= np.bitwise_count(mask) > 1
        seen: set[tuple[int, int]] = set()
        for m, bits in zip(mask.tolist(), self.bits.tolist(), strict=True):
            if (m, bits & m) in seen:
                continue
            seen.add((m, bits & m))
            n0, n1 = self.counts([(m, bits & m)])[0]
            if max(n0, n1) / (n0 + n1) >= purity and n0 + n1 > threshold:
                yield Rule(int(n1 > n0), m, bits & m, max(n0, n1) / (n0 + n1), n0 + n1)

    def without(self, rules: list[Rule]) -> Table:
        """The patterns that no rule takes."""
        left = np.ones(len(self.bits), bool)
        for r in rules:
            left &= (self.bits & r.mask) != r.vals
        return Table(self.bits[left], self.n[left], self.width)


class Frame:
    """Distinct patterns as a DataFrame (bits, n0, n1) that is written; every answer is an aggregate."""

    def __init__(self, patterns: DataFrame, width: int):
        self.patterns, self.width = patterns, width

    def totals(self) -> tuple[int, int]:
        r = self.patterns.agg(F.sum("n0"), F.sum("n1")).first()
        return r[0] or 0, r[1] or 0

    def _grouped(self, masks: list[int]) -> DataFrame:
        """mask, vals, n0, n1 of all groups of some masks, pre-aggregated on the way."""
        each = F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))
        keyed = self.patterns.select("bits", "n0", "n1", each.alias("mask"))
        by = keyed.groupBy("mask", F.col("bits").bitwiseAND(F.col("mask")).alias("vals"))
        return by.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def counts(self, asked: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for a in range(0, len(asked), MASKS_A_JOB // 2):
            part = asked[a : a + MASKS_A_JOB // 2]
            fires = [F.col("bits").bitwiseAND(F.lit(m)) == F.lit(v) for m, v in part]
            sums = [F.sum(F.when(f, F.col(c)).otherwise(0)) for f in fires for c in ("n0", "n1")]
            r = self.patterns.agg(F.array(*sums).alias("c")).first()["c"]
            out += [(r[2 * i] or 0, r[2 * i + 1] or 0) for i in range(len(part))]
        return out

    def best(self, size: int, purity: float, threshold: int, least: int) -> Rule | None:
        found = None
        masks = (sum(1 << a for a in attrs) for attrs in combinations(range(self.width), size))
        n = F.col("n0") + F.col("n1")
        pure = F.greatest("n0", "n1") / n
        attrs = F.expr(f"filter(sequence(0, {self.width - 1}), i -> shiftright(mask, i) & 1 = 1)")
        said = F.transform(attrs, lambda i: F.get(F.expr("transform(sequence(0, 61), i -> shiftright(vals, i) & 1)"), i))
        while part := [m for _, m in zip(range(MASKS_A_JOB), masks, strict=False)]:
            ok = self._grouped(part).where((n >= least) & (n > threshold) & (pure >= purity))
            order = (pure.desc(), n.desc(), attrs, said)
            r = ok.select(
                "mask", "vals", "n0", "n1", pure.alias("p"), attrs.alias("attrs"), said.alias("said")
            ).orderBy(*order).first()
            if r is not None:
                total = r["n0"] + r["n1"]
                key = (-r["p"], -total, r["attrs"], r["said"])
                if found is None or key < found[0]:
                    found = (key, Rule(int(r["n1"] > r["n0"]), r["mask"], r["vals"], r["p"], total))
        return found and found[1]

    def _sums(self, masks: DataFrame) -> DataFrame:
        """mask, vals, n0, n1 of all groups of the distinct masks of a table, which go out in slices of a bounded size."""
        own, out = cut(masks.distinct()), None
        slices = -(-own.count() // MASKS_A_JOB) or 1
        for k in range(slices):
            part = own.where(F.pmod(F.xxhash64("mask"), F.lit(slices)) == k)  # about MASKS_A_JOB rows
            keyed = self.patterns.join(F.broadcast(part)).groupBy("mask", F.col("bits").bitwiseAND(F.col("mask")).alias("vals"))
            one = cut(keyed.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
            out = one if out is None else out.unionByName(one)
        return out

    def maximal(self, purity: float, threshold: int) -> Iterator[Rule]:
        """Rounds of DataFrames: a round drops one attribute of every pattern that can lose one."""
        n = F.col("n0") + F.col("n1")
        own = self.patterns.select(
            F.col("bits").alias("pid"), F.lit((1 << self.width) - 1).cast("long").alias("mask"), "n0", "n1"
        )
        state = cut(own.select("pid", "mask", (F.greatest("n0", "n1") / n).alias("p"), F.lit(True).alias("open")))
        for _ in range(self.width - 1):
            open_ = state.where(F.col("open") & (F.bit_count("mask") > 1) & (F.col("p") >= purity))
            tries = open_.withColumn(
                "a", F.explode(F.expr(f"filter(sequence(0, {self.width - 1}), i -> shiftright(mask, i) & 1 = 1)"))
            )
            tries = cut(tries.withColumn("less", F.expr("mask & ~shiftleft(1L, a)")))
            if tries.isEmpty():
                break
            sums = self._sums(tries.select(F.col("less").alias("mask")))
            told = sums.select(F.col("mask").alias("less"), "vals", (F.greatest("n0", "n1") / n).alias("q"))
            q = tries.join(
                told, (tries["less"] == told["less"]) & (F.col("pid").bitwiseAND(tries["less"]) == told["vals"])
            ).drop(told["less"])
            best = q.where((F.col("q") >= purity) & (F.col("q") >= F.col("p"))).groupBy("pid")
            best = best.agg(F.max_by(F.struct("less", "q"), F.struct("q", "a")).alias("to"))
            moved = state.join(best, "pid", "left").select(
                "pid", F.coalesce("to.less", "mask").alias("mask"), F.coalesce("to.q", "p").alias("p"), F.col("to").isNotNull().alias("open")
            )
            state = cut(moved)
        ends = state.select("pid", "mask", F.col("pid").bitwiseAND(F.col("mask")).alias("vals"))
        ends = ends.groupBy("mask", "vals").agg(F.min("pid").alias("pid")).join(
            self._sums(state.select("mask")), ["mask", "vals"]
        )
        kept = ends.where((F.greatest("n0", "n1") / n >= purity) & (n > threshold)).orderBy("pid")
        for r in kept.toLocalIterator():
            yield Rule(
                int(r["n1"] > r["n0"]), r["mask"], r["vals"], max(r["n0"], r["n1"]) / (r["n0"] + r["n1"]), r["n0"] + r["n1"]
            )

    def without(self, rules: list[Rule]) -> Frame:
        left = self.patterns
        for r in rules:
            left = left.where(F.col("bits").bitwiseAND(F.lit(r.mask)) != r.vals)
        return Frame(cut(left), self.width)


def ranked(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-r.weight, -r.purity, r.label))


def _weigh(rules: list[Rule], totals: tuple[int, int]) -> list[Rule]:
    return ranked([replace(r, weight=min(1.0, r.repet / max(1, totals[r.label]))) for r in rules])


def max_patterns(t: Table | Frame, purity: float = 0.6, threshold: int = 0, min_unique: int = 0) -> list[Rule]:
    """Maximal patterns, weighed by support, without those that add too little."""
    found = [replace(r, source="maxpatterns") for r in t.maximal(purity, threshold)]
    return prune_redundant(t, _weigh(found, t.totals()), min_unique)


def voting_rules(t: Table | Frame, purity: float = 0.6, threshold: int = 0, least: int = 3) -> list[Rule]:
    """Overlapping maximal patterns for votes: no redundancy pruning, and a support of `least` on the whole table."""
    return [r for r in max_patterns(t, purity, threshold, 0) if r.repet >= least]


def prune_redundant(t: Table | Frame, rules: list[Rule], min_unique: int) -> list[Rule]:
    """Keep a rule, by rank, if enough of its rows are new; only kept rules cover."""
    if min_unique <= 0:
        return rules
    kept, left = [], t
    for r in rules:
        if sum(left.counts([(r.mask, r.vals)])[0]) >= min_unique:
            kept.append(r)
            left = left.without([r])
    return kept


def eager(
    t: Table | Frame, purity: float = 0.75, threshold: int = 0, min_support: int = 3, cap: int = 200, max_size: int | None = None,
) -> list[Rule]:
    """Sequential covering: the shortest, purest, largest conjunction of the rows left, again and again.

    Conjunctions of all sizes are tried, or up to max_size: 2^width attribute sets for a rule where none is pure enough.
    """
    left, rules = t, []
    most = t.width if max_size is None else min(t.width, max_size)
    while len(rules) < cap and (n := sum(left.totals())) >= min_support and n:
        found = next((r for size in range(1, most + 1) if (r := left.best(size, purity, threshold, min_support))), None)
        if found is None:
            break
        rules.append(replace(found, source="eager"))
        left = left.without([found])
    return _weigh(rules, t.totals())


def hybrid(t: Table | Frame, primary, secondary, least: int = 3) -> list[Rule]:
    """The secondary miner takes the rows that the primary leaves, with their class counts."""
    first = primary(t)
    left = t.without(first)
    return ranked(first + (secondary(left) if sum(left.totals()) >= least else []))


class _People:
    """Individuals are [attributes, values, label]; fitness is purity times the share of the class they get right."""

    def __init__(self, t: Table | Frame, purity: float, threshold: int, rng, most: int):
        self.t, self.purity, self.threshold, self.rng, self.most = t, purity, threshold, rng, most
        self.classes, self.known = [max(1, x) for x in t.totals()], {}

    @staticmethod
    def key(x: list) -> tuple[int, int]:
        return sum(1 << a for a in x[0]), sum(1 << a for a, v in zip(x[0], x[1], strict=True) if v)

    def counts(self, people: list[list]) -> list[tuple[int, int]]:
        new = list(dict.fromkeys(k for x in people if (k := self.key(x)) not in self.known))
        self.known.update(zip(new, self.t.counts(new), strict=True))
        return [self.known[self.key(x)] for x in people]

    def fitness(self, people: list[list]) -> np.ndarray:
        out = np.zeros(len(people))
        for i, (x, c) in enumerate(zip(people, self.counts(people), strict=True)):
            total, right = sum(c), c[x[2]]
            if x[0] and total > self.threshold and right / total >= self.purity:
                out[i] = right / total * right / self.classes[x[2]]
        return out

    def fresh(self) -> list:
        attrs = sorted(self.rng.choice(self.t.width, self.rng.integers(1, self.most + 1), replace=False).tolist())
        return [attrs, self.rng.integers(0, 2, len(attrs)).tolist(), int(self.rng.integers(2))]

    def children(self, a: list, b: list, rate: float) -> list[list]:
        """The parents' attributes in order, cut once: each child has one side, with the first parent's values."""
        union = sorted({*a[0], *b[0]})
        if self.rng.random() > rate or len(union) < 2:
            return [[*map(list, x[:2]), x[2]] for x in (a, b)]
        value = {**dict(zip(*b[:2], strict=True)), **dict(zip(*a[:2], strict=True))}
        at = int(self.rng.integers(1, len(union)))
        labels = [x[2] if self.rng.random() < 0.5 else y[2] for x, y in ((a, b), (b, a))]
        return [[side, [value[i] for i in side], label] for side, label in zip((union[:at], union[at:]), labels, strict=True)]

    def mutate(self, x: list, rate: float, strict_swap: bool) -> list:
        attrs, values, label = x
        rng, hit = self.rng, lambda: self.rng.random() < rate
        values = [1 - v if hit() else v for v in values]
        unused = lambda: [i for i in range(self.t.width) if i not in attrs]
        if hit() and unused():
            k = int(rng.integers(len(attrs)))
            swapped = [int(rng.choice(unused())) if i == k else a for i, a in enumerate(attrs)]
            if strict_swap:  # values go with their attributes
                values = [v for _, v in sorted(zip(swapped, values, strict=True))]
            attrs = sorted(swapped)
        if hit():
            if len(attrs) > 1 and rng.random() < 0.5:
                k = int(rng.integers(len(attrs)))
                attrs, values = attrs[:k] + attrs[k + 1 :], values[:k] + values[k + 1 :]
            elif len(attrs) < self.most and unused():
                both = sorted([*zip(attrs, values, strict=True), (int(rng.choice(unused())), int(rng.integers(2)))])
                attrs, values = ([y[i] for y in both] for i in (0, 1))
        return [attrs, values, 1 - label if hit() else label]


def _shared(people: list[list], fit: np.ndarray, sigma: float) -> np.ndarray:
    """Fitness over the crowding by individuals whose attributes are nearer than sigma (one less their Jaccard index)."""
    sets, out = [set(x[0]) for x in people], fit.copy()
    some = np.flatnonzero(fit)
    for i in some.tolist():
        apart = [1 - len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in some.tolist()]
        out[i] = fit[i] / max(1.0, sum(1 - d / sigma for d in apart if d < sigma))
    return out


def genetic(
    t: Table | Frame, purity: float = 0.6, threshold: int = 0, generations: int = 300, size: int = 200, seed: int = 42,
    crossover: float = 0.7, mutation: float = 0.15, elite: float = 0.1, tournament: int = 5, most_attrs: int | None = None,
    sharing: str | None = None, sigma: float = 0.3, strict_swap: bool = False,
) -> list[Rule]:
    """Evolved conjunctions with a label.

    sharing: None leaves fitness as it is (what the usual formula, with its sign, comes to); "fixed" divides it by the
    crowding. strict_swap: a swapped attribute takes its value along; else values stay in their places when attributes
    are put in order.
    """
    if sharing not in (None, "fixed"):
        raise ValueError(f"unknown sharing {sharing}")
    rng = np.random.default_rng(seed)
    p = _People(t, purity, threshold, rng, most_attrs or max(1, t.width // 2))
    people = [p.fresh() for _ in range(size)]
    raw = p.fitness(people)
    for _ in range(generations):
        worth = _shared(people, raw, sigma) if sharing and sigma > 0 else raw
        nxt = [people[i] for i in np.argsort(-raw, kind="stable")[: max(1, int(elite * size))]]
        pick = lambda: people[max(rng.choice(size, min(tournament, size), replace=False).tolist(), key=lambda i: worth[i])]  # noqa: B023, E731
        while len(nxt) < size:
            nxt += [p.mutate(x, mutation, strict_swap) for x in p.children(pick(), pick(), crossover)]
        people = nxt[:size]
        raw = p.fitness(people)
    out: dict[tuple[int, int, int], Rule] = {}
    for x, c, good in zip(people, p.counts(people), raw, strict=True):
        if good > 0:
            mask, vals = p.key(x)
            right, total = c[x[2]], sum(c)
            out[x[2], mask, vals] = Rule(x[2], mask, vals, right / total, total, right / p.classes[x[2]], "genetic")
    return ranked(list(out.values()))


def miner(name: str, **kw):
    """A miner by name; ValueError for others."""
    simple = {"maxpatterns": max_patterns, "eager": eager, "genetic": genetic}
    if name in simple:
        return lambda t: simple[name](t, **kw)
    if name == "hybrid_mp_eager":
        return lambda t: hybrid(t, lambda x: max_patterns(x, **kw), lambda x: eager(x, **kw))
    if name == "hybrid_eager_mp":
        return lambda t: hybrid(t, lambda x: eager(x, **kw), lambda x: max_patterns(x, **kw))
    raise ValueError(f"unknown miner {name}")


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [
        (i, r.label, r.mask, r.vals, round(float(r.purity), 9), r.repet, round(float(r.weight), 9), r.source)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULES)


def rules_of(frame: DataFrame) -> list[Rule]:
    """The rules of a stored table, by rank."""
    rows = sorted(frame.collect(), key=lambda r: r["rule_rank"])  # a model's rules
    return [Rule(*(r[c] for c in ("label", "mask", "vals", "purity", "repet", "weight", "source"))) for r in rows]
