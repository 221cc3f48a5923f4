"""Registered queries of trees, selectors and miners, and the SQL that restates them.

The searches and miners are restated as recursive SQL over six fixed cuts: every subset of them has its score or its
groups in a table, and the recursion walks as the operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binarize as B
from ..operators import mine, score
from . import pipeline as P
from . import registry as R

N = len(R.CUTS)
FULL = (1 << N) - 1
_IDX = f"idx AS (SELECT unnest(range(0, {N}))::INT AS i)"
_MASK = f"m AS (SELECT unnest(range(0, {FULL + 1}))::BIGINT AS mask)"


# trees


def _tree(depth: int, leaf: int, least: float = 0.0, places: int = 10) -> str:
    """CTEs up to th(feature, t): a level is a window over the values of every node."""
    twice = lambda n: f"(tn / (2 * {n})::DOUBLE)"
    w = lambda n: f"CASE WHEN {n} > 0 THEN {twice(n)} * {twice(n)} ELSE 0.0 END"
    impure = lambda n, p: f"CASE WHEN {p} * w1 + ({n} - {p}) * w0 > 0 THEN ({p} * w1) * (({n} - {p}) * w0) / ({p} * w1 + ({n} - {p}) * w0) ELSE 0.0 END"
    out = [
        R._DOC, R._LONG, R._HIST,
        "tot AS (SELECT feature, sum(n)::BIGINT AS tn, sum(pos)::BIGINT AS tp FROM hist GROUP BY feature)",
        f"wt AS (SELECT feature, tn, tp, {w('tp')} AS w1, {w('(tn - tp)')} AS w0 FROM tot)",
        "node0 AS (SELECT feature, x, n, pos, 1::BIGINT AS node FROM hist)",
    ]
    for k in range(depth):
        out.append(f"""run{k} AS (SELECT feature, node, (x + lead(x) OVER o) / 2 AS t, (sum(n) OVER r)::BIGINT AS ln, (sum(pos) OVER r)::BIGINT AS lp,
  (sum(n) OVER a)::BIGINT AS n, (sum(pos) OVER a)::BIGINT AS p FROM node{k}
  WINDOW o AS (PARTITION BY feature, node ORDER BY x), r AS (PARTITION BY feature, node ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature, node))""")
        fall = f"{impure('n', 'p')} - {impure('ln', 'lp')} - {impure('(n - ln)', '(p - lp)')}"
        out.append(
            f"fall{k} AS (SELECT feature, node, t, {fall} AS fall, {least} * (tp * w1 + (tn - tp) * w0) / 2 AS least FROM run{k} JOIN wt USING (feature) WHERE t IS NOT NULL AND ln >= {leaf} AND n - ln >= {leaf})"
        )
        out.append(
            f"best{k} AS (SELECT feature, node, t FROM (SELECT *, row_number() OVER (PARTITION BY feature, node ORDER BY fall DESC, t) AS r FROM fall{k} WHERE fall > 1e-9 AND fall >= least) WHERE r = 1)"
        )
        out.append(
            f"node{k + 1} AS (SELECT feature, x, n, pos, node * 2 + (x > t)::BIGINT AS node FROM node{k} JOIN best{k} USING (feature, node))"
        )
    both = " UNION ".join(f"SELECT feature, round(t, {places}) AS t FROM best{k}" for k in range(depth))
    return ", ".join([*out, f"th AS ({both})"])


_GAINS = """side AS (SELECT feature, t, sum(n) FILTER (x <= t)::BIGINT AS nl, sum(n) FILTER (x > t)::BIGINT AS nr, sum(pos) FILTER (x <= t)::BIGINT AS pl, sum(pos) FILTER (x > t)::BIGINT AS pr,
  sum(n)::DOUBLE AS n, min(x) AS lo, max(x) AS hi FROM hist JOIN th USING (feature) GROUP BY feature, t),
gains AS (SELECT feature, t, nl, nr, lo, hi, CASE WHEN nl < 2 OR nr < 2 THEN 0.0 ELSE n * ((pl * nr - pr * nl)::DOUBLE * (pl * nr - pr * nl)::DOUBLE / (n * n * nl * nr)) END AS gain FROM side)"""


@R._query(f"WITH {_tree(4, 5)} SELECT * FROM th")
def tree_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return B.tree_thresholds(B.histogram(R._docs(spark, sf), R.NUMERIC))


@R._query(
    f"WITH {_tree(4, 10)}, {_GAINS} SELECT feature, t, round(gain, 7) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, t DESC) AS r FROM gains WHERE nl >= 5 AND nr >= 5) WHERE r <= 3"
)
def tree_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return B.tree_cuts(B.histogram(R._docs(spark, sf), R.NUMERIC), "greedy", 4, 10, top_k=3).select(
        "feature", "t", F.round("gain", 7).alias("gain")
    )


@R._query(f"""WITH {_tree(5, 15, 0.005, 8)}, {_GAINS}, kept AS (SELECT *, min(t) OVER w AS a, max(t) OVER w AS b, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, t) AS r FROM gains
  WHERE nl >= 15 AND nr >= 15 AND t > lo + greatest(hi - lo, 1e-8) * 0.05 AND t < hi - greatest(hi - lo, 1e-8) * 0.05 WINDOW w AS (PARTITION BY feature))
SELECT feature, t, round(gain, 7) AS gain FROM kept WHERE CASE WHEN b - a < (hi - lo) * 0.12 THEN r = 1 ELSE t = a OR t = b END""")
def tree_cuts_edges(spark: SparkSession, sf: str) -> DataFrame:
    hist = B.histogram(R._docs(spark, sf), R.NUMERIC)
    cuts = B.tree_cuts(hist, "two", 5, 15, 15, apart=0.12, edge=0.05, least_fall=0.005, places=8)
    return cuts.select("feature", "t", F.round("gain", 7).alias("gain"))


@R._query(f"WITH {_tree(8, 5)}, {_GAINS} SELECT feature, t, round(gain, 7) AS gain FROM gains WHERE nl >= 5 AND nr >= 5")
def tree_cuts_dense(spark: SparkSession, sf: str) -> DataFrame:
    return B.tree_cuts(B.histogram(R._docs(spark, sf), R.NUMERIC)).select("feature", "t", F.round("gain", 7).alias("gain"))


# selectors

_SCORED = f"""{R._PAT}, {_IDX}, {_MASK}, part AS (SELECT mask, bits & mask AS vals, sum(n0)::BIGINT AS n0, sum(n1)::BIGINT AS n1 FROM pat, m GROUP BY mask, bits & mask),
sc AS (SELECT mask, CASE WHEN mask = 0 THEN 0 ELSE sum(greatest(n0, n1))::BIGINT END AS g, mask > 0 AND max(least(n0, n1)) = 0 AS ok, sum(n0 + n1)::BIGINT AS n, count(*) AS patterns, max(least(n0, n1)) = 0 AS consistent FROM part GROUP BY mask)"""
_MI = f"""one AS (SELECT i, (bits >> i) & 1 AS v, label FROM bit, idx), c2 AS (SELECT i, v, label, count(*) AS n FROM one GROUP BY i, v, label),
c3 AS (SELECT i, n, sum(n) OVER (PARTITION BY i) AS t, sum(n) OVER (PARTITION BY i, v) AS r, sum(n) OVER (PARTITION BY i, label) AS k FROM c2),
mi AS (SELECT i, round(sum(n / t * ln(n * t / (r * k)::DOUBLE)), 9) AS mi FROM c3 GROUP BY i),
ord AS (SELECT i, row_number() OVER (ORDER BY mi DESC, i DESC) - 1 AS place FROM mi)"""
_TOLD = "SELECT round(g / n, 9) AS score, patterns, consistent, array_to_string(lst, ',') AS subset FROM found JOIN sc ON sc.mask = found.mask"
_GREEDY = f"""WITH RECURSIVE {_SCORED},
walk AS (SELECT 0 AS k, 0::BIGINT AS mask, []::INT[] AS lst, 0::BIGINT AS best, true AS go
  UNION ALL SELECT k + 1, to_, list_append(lst, i), g, NOT ok FROM (SELECT w.k, w.lst, w.best, i, sc.mask AS to_, g, ok, row_number() OVER (ORDER BY g DESC, i) AS r
    FROM walk w, idx JOIN sc ON sc.mask = (w.mask | (1::BIGINT << i)) WHERE w.go AND (w.mask >> i) & 1 = 0) WHERE r = 1 AND g > best),
found AS (SELECT mask, lst FROM walk WHERE k = (SELECT max(k) FROM walk)) {_TOLD}"""
_MI_GREEDY = f"""WITH RECURSIVE {_SCORED}, {_MI},
walk AS (SELECT 0 AS k, 0::BIGINT AS mask, []::INT[] AS lst, 0::BIGINT AS best, true AS go
  UNION ALL SELECT w.k + 1, CASE WHEN g >= best THEN sc.mask ELSE w.mask END, CASE WHEN g >= best THEN list_append(lst, i) ELSE lst END, greatest(g, best), NOT (g >= best AND ok)
  FROM walk w JOIN ord ON ord.place = w.k JOIN sc ON sc.mask = (w.mask | (1::BIGINT << i)) WHERE w.go),
found AS (SELECT mask, lst FROM walk WHERE k = (SELECT max(k) FROM walk)) {_TOLD}"""


def _astar(extra: str, more: str = "") -> str:
    """One row holds the heap; every step pops its least entry, by f and then by the subset."""
    return f"""WITH RECURSIVE {_SCORED}{more},
told AS (SELECT list(g ORDER BY mask) AS gl, list(ok ORDER BY mask) AS ol, max(n) AS n FROM sc), pen AS (SELECT {extra} AS pl),
st AS (SELECT 0 AS it, [{{'f': 0.0::DOUBLE, 's': []::INT[]}}] AS heap, []::BIGINT[] AS seen, (-1)::BIGINT AS bg, []::INT[] AS bs, false AS done
  UNION ALL SELECT it + 1, CASE WHEN old THEN rest ELSE list_concat(rest, list_transform(list_filter(range(0, {N}), lambda i: (mask >> i::INT) & 1 = 0), lambda i: {{'f': (len(s) + 1) / {N}::DOUBLE + 5.0::DOUBLE * ((n - g) / n) + pl[i + 1], 's': list_append(s, i::INT)}})) END,
    CASE WHEN old THEN seen ELSE list_append(seen, mask) END, CASE WHEN NOT old AND g > bg THEN g ELSE bg END, CASE WHEN NOT old AND (ok OR g > bg) THEN s ELSE bs END, NOT old AND ok
  FROM (SELECT *, list_contains(seen, mask) AS old, gl[mask + 1] AS g, ol[mask + 1] AS ok FROM (SELECT *, coalesce(list_sum(list_transform(s, lambda i: 1::BIGINT << i)), 0)::BIGINT AS mask
    FROM (SELECT it, list_filter(heap, lambda z: z <> top) AS rest, seen, bg, bs, top.s AS s FROM (SELECT *, list_min(heap) AS top FROM st WHERE NOT done AND len(heap) > 0)), told, pen))),
last AS (SELECT bs FROM st WHERE it = (SELECT max(it) FROM st)),
found AS (SELECT coalesce(list_sum(list_transform(bs, lambda i: 1::BIGINT << i)), 0)::BIGINT AS mask, bs AS lst FROM last) {_TOLD}"""


_ASTAR = _astar("[" + ", ".join(["0.0::DOUBLE"] * N) + "]")
_MI_ASTAR = _astar(f"(SELECT list(place / {N}::DOUBLE * 0.1::DOUBLE ORDER BY i) FROM ord)", f", {_MI}")


def _selected(name: str, oracle: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = R._bits(spark, sf)
        subset = P.choose_features(rows, N, P.Config(selector=name))
        s = score.lad_score(score.pattern_table(rows, sum(1 << i for i in subset)))
        return s.withColumn("subset", F.lit(",".join(map(str, subset))))

    run.__name__ = f"select_{name}"
    R._query(oracle)(run)


for _name, _sql in (("greedy", _GREEDY), ("astar", _ASTAR), ("mutualinfo", _MI_GREEDY), ("mutualinfo_astar", _MI_ASTAR)):
    _selected(_name, _sql)


# miners

_CLEAN = f"""{R._PAT}, {_IDX}, {_MASK}, mj AS (SELECT *, CASE WHEN n1 > n0 THEN 1 WHEN n0 > n1 THEN 0 WHEN first1 < first0 THEN 1 ELSE 0 END AS k FROM pat),
cp AS (SELECT bits, CASE WHEN k = 0 THEN n0 ELSE 0 END::BIGINT AS n0, CASE WHEN k = 1 THEN n1 ELSE 0 END::BIGINT AS n1 FROM mj)"""
_RULE = "label, mask, vals, purity, repet, weight, source, made"


def _maximal(x: str, src: str, purity: float, threshold: int = 0) -> str:
    """CTEs up to <x>r: maximal patterns of a table src(bits, n0, n1)."""
    pure = "greatest(g.n0, g.n1) / (g.n0 + g.n1)"
    return f"""{x}g AS (SELECT mask, bits & mask AS vals, sum(n0)::BIGINT AS n0, sum(n1)::BIGINT AS n1 FROM {src}, m GROUP BY mask, bits & mask),
{x}w AS (SELECT bits AS pid, {FULL}::BIGINT AS mask, greatest(n0, n1) / (n0 + n1) AS p, 0 AS k FROM {src}
  UNION ALL SELECT pid, less, q, k + 1 FROM (SELECT pid, k, less, q, row_number() OVER (PARTITION BY pid ORDER BY q DESC, i DESC) AS r
    FROM (SELECT w.pid, w.k, w.p, i, g.mask AS less, {pure} AS q FROM {x}w w, idx JOIN {x}g g ON g.mask = (w.mask & ~(1::BIGINT << i)) AND g.vals = (w.pid & w.mask & ~(1::BIGINT << i))
      WHERE (w.mask >> i) & 1 = 1 AND bit_count(w.mask) > 1 AND w.p >= {purity}) WHERE q >= {purity} AND q >= p) WHERE r = 1),
{x}e AS (SELECT pid, mask FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY k DESC) AS r FROM {x}w) WHERE r = 1),
{x}f AS (SELECT min(e.pid) AS made, g.mask, g.vals, any_value(g.n0) AS n0, any_value(g.n1) AS n1 FROM {x}e e JOIN {x}g g ON g.mask = e.mask AND g.vals = (e.pid & e.mask)
  WHERE {pure} >= {purity} AND g.n0 + g.n1 > {threshold} GROUP BY g.mask, g.vals),
{x}t AS (SELECT sum(n0)::BIGINT AS t0, sum(n1)::BIGINT AS t1 FROM {src}),
{x}r AS (SELECT (n1 > n0)::INT AS label, mask, vals, greatest(n0, n1) / (n0 + n1) AS purity, n0 + n1 AS repet, least(1.0::DOUBLE, (n0 + n1) / greatest(1, CASE WHEN n1 > n0 THEN t1 ELSE t0 END)) AS weight, 'maxpatterns' AS source, made FROM {x}f, {x}t)"""


def _eager(x: str, src: str, purity: float) -> str:
    """CTEs up to <x>r: sequential covering of a table src(bits, n0, n1)."""
    attrs = f"list_filter(range(0, {N}), lambda i: (mask >> i::INT) & 1 = 1)"
    return f"""{x}a AS (SELECT 0 AS made, (SELECT list(bits) FROM {src}) AS act, 0::BIGINT AS mask, 0::BIGINT AS vals, 0 AS label, 0.0::DOUBLE AS purity, 0::BIGINT AS repet
  UNION ALL SELECT made + 1, list_filter(act, lambda b: (b & mask) <> vals), mask, vals, label, purity, repet
  FROM (SELECT *, row_number() OVER (ORDER BY bit_count(mask), purity DESC, repet DESC, attrs, list_transform(attrs, lambda i: (vals >> i::INT) & 1)) AS r
    FROM (SELECT made, act, mask, vals, (n1 > n0)::INT AS label, greatest(n0, n1) / (n0 + n1) AS purity, n0 + n1 AS repet, {attrs} AS attrs
      FROM (SELECT a.made, a.act, m.mask, s.bits & m.mask AS vals, sum(s.n0)::BIGINT AS n0, sum(s.n1)::BIGINT AS n1 FROM {x}a a, m, {src} s
        WHERE m.mask > 0 AND a.made < 200 AND list_contains(a.act, s.bits) GROUP BY a.made, a.act, m.mask, s.bits & m.mask)) WHERE repet >= 3 AND purity >= {purity}) WHERE r = 1),
{x}t AS (SELECT sum(n0)::BIGINT AS t0, sum(n1)::BIGINT AS t1 FROM {src}),
{x}r AS (SELECT label, mask, vals, purity, repet, least(1.0::DOUBLE, repet / greatest(1, CASE WHEN label = 1 THEN t1 ELSE t0 END)) AS weight, 'eager' AS source, made FROM {x}a, {x}t WHERE made > 0)"""


def _ranked(rules: str) -> str:
    """The rules of a table in their order; `turn` and made tell what came first."""
    return f"""SELECT (row_number() OVER (ORDER BY weight DESC, purity DESC, label, turn, made) - 1)::INT AS rule_rank, label, mask, vals, round(purity, 9) AS purity, repet::BIGINT AS repet, round(weight, 9) AS weight, source FROM ({rules})"""


def _left(x: str, rules: str) -> str:
    """What rules leave of cp; nothing where it is under three rows."""
    return f"""{x}0 AS (SELECT * FROM cp WHERE NOT EXISTS (SELECT 1 FROM {rules} r WHERE (cp.bits & r.mask) = r.vals)), {x} AS (SELECT * FROM {x}0 WHERE (SELECT sum(n0 + n1) FROM {x}0) >= 3)"""


_MINED = {
    "maxpatterns": f"WITH RECURSIVE {_CLEAN}, {_maximal('x', 'cp', 0.8)} " + _ranked("SELECT *, 0 AS turn FROM xr"),
    "eager": f"WITH RECURSIVE {_CLEAN}, {_eager('x', 'cp', 0.8)} " + _ranked("SELECT *, 0 AS turn FROM xr"),
    "hybrid_mp_eager": f"WITH RECURSIVE {_CLEAN}, {_maximal('x', 'cp', 0.8)}, {_left('rest', 'xr')}, {_eager('y', 'rest', 0.8)} " + _ranked(f"SELECT {_RULE}, 0 AS turn FROM xr UNION ALL SELECT {_RULE}, 1 AS turn FROM yr"),
    "hybrid_eager_mp": f"WITH RECURSIVE {_CLEAN}, {_eager('x', 'cp', 0.8)}, {_left('rest', 'xr')}, {_maximal('y', 'rest', 0.8)} " + _ranked(f"SELECT {_RULE}, 0 AS turn FROM xr UNION ALL SELECT {_RULE}, 1 AS turn FROM yr"),
    "genetic": None,
}


def _table(spark: SparkSession, sf: str) -> mine.Table | mine.Frame:
    return mine.Table.of(score.remove_conflicts(R._bits(spark, sf)), N)


def _mined(name: str, oracle: str | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return mine.rules_frame(spark, mine.miner(name, purity=0.8)(_table(spark, sf)))

    run.__name__ = f"mine_{name}"
    R._query(oracle)(run)


for _name, _sql in _MINED.items():
    _mined(_name, _sql)


@R._query(f"WITH RECURSIVE {_CLEAN}, {_maximal('x', 'cp', 0.8, 1)} " + _ranked("SELECT *, 0 AS turn FROM xr WHERE repet >= 3"))
def voting_rules(spark: SparkSession, sf: str) -> DataFrame:
    return mine.rules_frame(spark, mine.voting_rules(_table(spark, sf), 0.8, 1, 3))


_BEFORE = _ranked("SELECT *, 0 AS turn FROM xr").replace("round(purity, 9)", "purity").replace("round(weight, 9)", "weight")


@R._query(f"""WITH RECURSIVE {_CLEAN}, {_maximal('x', 'cp', 0.6)}, rk AS ({_BEFORE}),
walk AS (SELECT -1 AS k, (SELECT list(bits) FROM cp) AS act, false AS kept
  UNION ALL SELECT k + 1, CASE WHEN new >= 4 THEN list_filter(act, lambda b: (b & mask) <> vals) ELSE act END, new >= 4
  FROM (SELECT w.k, w.act, r.mask, r.vals, coalesce((SELECT sum(n0 + n1) FROM cp WHERE list_contains(w.act, cp.bits) AND (cp.bits & r.mask) = r.vals), 0) AS new FROM walk w JOIN rk r ON r.rule_rank = w.k + 1)),
kept AS (SELECT *, 0 AS turn, rule_rank AS made FROM rk JOIN walk ON walk.k = rk.rule_rank WHERE walk.kept) {_ranked("SELECT * FROM kept")}""")
def pruned_rules(spark: SparkSession, sf: str) -> DataFrame:
    return mine.rules_frame(spark, mine.max_patterns(_table(spark, sf), 0.6, 0, 4))
