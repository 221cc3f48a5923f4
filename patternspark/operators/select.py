"""Feature selectors over a pattern table.

Selection needs only the distinct patterns and their class counts. They are collected when no more than a bound
(a search pops thousands of subsets, each a tiny aggregate); beyond it every score is a Spark aggregate. Scores are
exact ratios of integers, so ties never depend on the order of a sum.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from . import score as S

MOST_PATTERNS = 200_000
#: Subsets that A* pops at most, without and with an order of mutual information.
EXPANSIONS, MI_EXPANSIONS = 1_110_999, 10_000
#: Up to so many cuts, groups are counted in an array with a place for every pattern.
DIRECT = 16


class Patterns:
    """(score, consistent) of masks, with a memo."""

    def __init__(self, rows: DataFrame, class_weight: float = 1.0):
        self.rows, self.weight, self.memo = rows, Fraction(class_weight).limit_denominator(1000), {}
        key = "words" if "words" in rows.columns else "bits"
        got = S.pattern_table(rows).select(key, "n0", "n1").limit(MOST_PATTERNS + 1).collect()
        self.words = None
        if len(got) <= MOST_PATTERNS:
            self.words = np.array([r[0] if key == "words" else [r[0]] for r in got], np.int64).reshape(len(got), -1)
            self.n = np.array([tuple(r)[1:] for r in got], np.int64).reshape(-1, 2)
        self.columns: dict[int, np.ndarray] = {}

    def _column(self, i: int) -> np.ndarray:
        if i not in self.columns:
            self.columns[i] = self.words[:, i // S.WORD] >> i % S.WORD & 1
        return self.columns[i]

    def _groups(self, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """Class counts of the patterns that the cuts of a mask make."""
        group = np.zeros(len(self.n), np.int64)
        for j, i in enumerate(i for i in range(mask.bit_length()) if mask >> i & 1):
            if j and j % DIRECT == 0:  # few enough groups again
                group = np.unique(group, return_inverse=True)[1] << DIRECT
            group += self._column(i) << j % DIRECT
        if mask.bit_count() > DIRECT:
            group = np.unique(group, return_inverse=True)[1]
        out = np.zeros((2, int(group.max(initial=0)) + 1), np.int64)
        for k, n in enumerate(self.n.T):
            # sums of integers in doubles are exact below 2^53, which counts of rows don't reach
            out[k] = np.bincount(group, n, out.shape[1])
        return out[0], out[1]

    def score(self, mask: int) -> tuple[Fraction, bool]:
        if mask not in self.memo:
            if self.words is None:
                # of equal counts one row: as many as there are different counts
                rows = S.pattern_table(self.rows, mask).groupBy("n0", "n1").count()
                rows = rows.selectExpr("n0 * count as n0", "n1 * count as n1").collect()
                n0, n1 = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2).T
            else:
                n0, n1 = self._groups(mask)
            one = n1 > n0
            top = self.weight * int(n1[one].sum()) + int(n0[~one].sum())
            total = self.weight * int((n0 + n1)[one].sum()) + int((n0 + n1)[~one].sum())
            good = bool(mask) and not np.minimum(n0, n1).any()
            self.memo[mask] = (top / total if mask and total else Fraction(0), good)
        return self.memo[mask]


def mask_of(subset: list[int]) -> int:
    return sum(1 << i for i in subset)


def greedy(p: Patterns, n: int) -> list[int]:
    """Add the feature with the strictly best score while there is one; the first consistent best prefix wins."""
    subset, best, found = [], Fraction(0), None
    while len(subset) < n:
        top = max(((p.score(mask_of([*subset, i]))[0], -i) for i in range(n) if i not in subset))
        if top[0] <= best:
            break
        best = top[0]
        subset.append(-top[1])
        if p.score(mask_of(subset))[1]:
            found = list(subset)
            break
    return found or subset


def mi_order(mi: dict[int, float], n: int) -> list[int]:
    return sorted(range(n), key=lambda i: (-mi[i], -i))


def mi_greedy(p: Patterns, order: list[int]) -> list[int]:
    """Walk the features by mutual information, keeping one that doesn't lower the score, up to consistency."""
    subset, best = [], Fraction(0)
    for i in order:
        s, good = p.score(mask_of([*subset, i]))
        if s >= best:
            subset, best = [*subset, i], s
            if good:
                return subset
    return subset


def astar(
    p: Patterns,
    n: int,
    h_weight: float = 5.0,
    most: int | None = None,
    most_features: int | None = None,
    order: list[int] | None = None,
) -> list[int]:
    """Best-first search over subsets; f = size/n + h_weight*(1 - the parent's score), and with an order of mutual
    information a tenth of the last feature's rank. The first consistent subset popped is final: its score is 1,
    and nothing later can be better. Without any, the best subset of the budget (EXPANSIONS or MI_EXPANSIONS).

    Children of a subset are popped in the order of their features, so the heap holds one of each subset at a time.
    """
    if most is None:
        most = MI_EXPANSIONS if order else EXPANSIONS
    walk = list(order or range(n))
    heap: list[tuple[float, list[int], float, int, int]] = [(0.0, [], 0.0, n, 0)]
    seen: set[int] = set()
    best, best_subset = Fraction(-1), []

    def push(parent: list[int], base: float, at: int, open_: int) -> None:
        """The first child from a place of the walk on."""
        while at < n and not open_ >> walk[at] & 1:
            at += 1
        if at < n:
            heapq.heappush(heap, (base + (at / n * 0.1 if order else 0.0), [*parent, walk[at]], base, at, open_))

    for _ in range(most):
        if not heap:
            break
        _, subset, base, at, open_ = heapq.heappop(heap)
        push(subset[:-1], base, at + 1, open_)
        mask = mask_of(subset)
        if mask in seen:
            continue
        seen.add(mask)
        s, good = p.score(mask)
        if good:
            return subset
        if s > best:
            best, best_subset = s, subset
        if most_features and len(subset) >= most_features:
            continue
        new = sum(1 << i for i in walk if not mask >> i & 1 and mask | 1 << i not in seen)
        push(subset, (len(subset) + 1) / n + h_weight * float(1 - s), 0, new)
    return best_subset
