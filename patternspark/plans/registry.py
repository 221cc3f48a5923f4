"""Registered queries of the rule-learning operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..operators import binarize as B
from ..operators import lazy, metrics, mine, predict, score, split
from ..sources import store
from . import pipeline as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUMERIC = list(X.DOC_NUMERIC)
LINE_NUMERIC = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
#: Fixed cuts and rules, so that every step can be checked on its own: (feature, threshold) is bit i.
CUTS = (
    ("letter_ratio", 0.9),
    ("punct_ratio", 0.02),
    ("n_words", 150.0),
    ("n_lines", 8.0),
    ("digit_ratio", 0.001),
    ("n_chars", 2000.0),
)
RULES = (
    (1, 0b000001, 0b000000, 0.99, 200, 0.9),
    (0, 0b000011, 0b000001, 0.9, 30, 0.7),
    (1, 0b010100, 0b010000, 0.85, 60, 0.6),
    (0, 0b101001, 0b100001, 0.8, 12, 0.3),
    (1, 0b001000, 0b001000, 0.7, 20, 0.04),
)


def _cuts() -> list[B.Cut]:
    return [B.Cut(i, f, t) for i, (f, t) in enumerate(CUTS)]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return X.doc_features(spark, sf)


def _bits(spark: SparkSession, sf: str) -> DataFrame:
    return B.transform(_docs(spark, sf), _cuts())


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r, "fixed") for i, r in enumerate(RULES)], mine.RULES)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        (F.col("l_extendedprice") > 40000).cast("int").alias("label"), *LINE_NUMERIC
    )


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_DOC = """doc AS (SELECT d.doc_id AS row_id, l.quality AS label,
  round(length(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) / greatest(length(text), 1), 6) AS letter_ratio,
  round(length(regexp_replace(text, '[^.!?]', '', 'g')) / greatest(length(text), 1), 6) AS punct_ratio,
  round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 6) AS digit_ratio,
  (length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS n_words,
  (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS n_lines, n_chars::DOUBLE AS n_chars, lang
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_BIT = _DOC + ", bit AS (SELECT row_id, label, (" + " + ".join(
    f"CASE WHEN {f} <= {t} THEN {1 << i} ELSE 0 END" for i, (f, t) in enumerate(CUTS)
) + ")::BIGINT AS bits FROM doc)"
_PAT = _BIT + """, pat AS (SELECT bits, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1,
  min(row_id) FILTER (label = 0) AS first0, min(row_id) FILTER (label = 1) AS first1 FROM bit GROUP BY bits)"""
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, label FROM doc" for f in NUMERIC) + ")"
_HIST = "hist AS (SELECT feature, x, count(*) AS n, sum(label)::BIGINT AS pos FROM long GROUP BY feature, x)"
_CAND = """run AS (SELECT feature, (x + lead(x) OVER w) / 2 AS t, sum(n) OVER r AS nl, sum(pos) OVER r AS pl, sum(n) OVER a AS n, sum(pos) OVER a AS p,
  min(x) OVER a AS lo, max(x) OVER a AS hi FROM hist
  WINDOW w AS (PARTITION BY feature ORDER BY x), r AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature)),
cand AS (SELECT feature, t, nl::BIGINT AS nl, (n - nl)::BIGINT AS nr, power((pl * (n - nl) - (p - pl) * nl)::DOUBLE, 2) / (n::DOUBLE * n * nl * (n - nl)) AS gain, lo, hi
  FROM run WHERE t IS NOT NULL AND nl >= 5 AND n - nl >= 5 AND pl * (n - nl) <> (p - pl) * nl)"""
_FIT = f"{_DOC}, {_LONG}, {_HIST}, {_CAND}"
_LINE = f"line AS (SELECT (l_extendedprice > 40000)::INT AS label, {', '.join(LINE_NUMERIC)} FROM lineitem)"
_LINES = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, label FROM line" for f in LINE_NUMERIC) + ")"
_RULE = "rule(rule_rank, label, mask, vals, weight) AS (VALUES " + ", ".join(
    f"({i}, {r[0]}, {r[1]}::BIGINT, {r[2]}::BIGINT, {r[5]}::DOUBLE)" for i, r in enumerate(RULES)
) + ")"
_FIRE = _BIT + f""", {_RULE}, pair AS (SELECT row_id, bit.label, rule_rank, rule.label AS rl, weight, (bits & mask) = vals AS fires,
  round(1 - bit_count(xor(bits, vals) & mask) / bit_count(mask), 12) AS overlap, round((1 - bit_count(xor(bits, vals) & mask) / bit_count(mask)) * weight, 12) AS worth FROM bit, rule)"""


def _best(score: str) -> str:
    return f"""best AS (SELECT row_id, label, coalesce(min_by(rl, rule_rank) FILTER (fires), max_by(rl, (({score}) * 1000000 - rule_rank)) FILTER (weight >= 0.05)) AS pred,
  CASE WHEN bool_or(fires) THEN 1.0 ELSE max({score}) FILTER (weight >= 0.05) END AS conf, bool_or(fires) AS is_exact FROM pair GROUP BY row_id, label)"""


_SOFT = """vote AS (SELECT row_id, label, coalesce(sum(weight) FILTER (fires), 0) AS w, coalesce(sum(weight) FILTER (fires AND rl = 1), 0) AS w1 FROM pair GROUP BY row_id, label),
soft AS (SELECT vote.row_id, vote.label, CASE WHEN w > 0 THEN (round(w1 / w, 12) >= 0.5)::INT ELSE best.pred END AS pred,
  round(CASE WHEN w > 0 THEN greatest(w1 / w, 1 - w1 / w) ELSE best.conf END, 9) AS conf FROM vote JOIN best USING (row_id))"""


_PROFILE = "3 AS n_columns, 'doc_id, quality, toxic' AS columns"


@_query(
    f"SELECT quality AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, sum(count(*)) OVER ()::BIGINT AS n_rows, {_PROFILE} FROM labels GROUP BY quality"
)
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return X.profile(spark.read.parquet(f"{sf}/labels.parquet"), "quality")


@_query(f"WITH {_DOC} SELECT * FROM doc")
def doc_features(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf)


@_query("""WITH v AS (SELECT doc_id, trim(source) AS source, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 ELSE -1 END AS lang_map FROM documents),
c AS (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS code FROM v GROUP BY source)
SELECT doc_id AS row_id, source, lang_map, coalesce(code, -1)::INT AS source_code FROM v LEFT JOIN c USING (source)""")
def clean_encode(spark: SparkSession, sf: str) -> DataFrame:
    d = X.trim_all(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "lang", "source"))
    return X.factorize(d.withColumn("lang_map", X.map_values(F.col("lang"), {"en": 1, "de": 0}, F.lit(-1))), "source").select(
        "row_id", "source", "lang_map", "source_code"
    )


_ORDERED = "row_number() OVER (PARTITION BY quality ORDER BY md5('42-' || doc_id), doc_id)"


@_query(
    f"SELECT doc_id AS row_id, quality AS label, {_ORDERED} <= round(count(*) OVER (PARTITION BY quality) * 0.25) AS is_test FROM labels"
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(
        spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    )


@_query(f"SELECT doc_id AS row_id, quality AS label, (({_ORDERED} - 1) % 5)::INT AS fold FROM labels")
def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return split.kfold(
        spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    )


@_query(f"WITH {_FIT} SELECT feature, t, nl, nr, round(gain, 9) AS gain FROM cand")
def gini_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return B.candidates(B.histogram(_docs(spark, sf), NUMERIC)).select(
        "feature", "t", "nl", "nr", F.round("gain", 9).alias("gain")
    )


@_query(f"WITH {_LINE}, {_LINES}, {_HIST}, {_CAND} SELECT feature, round(t, 6) AS t, nl, nr, round(gain, 9) AS gain FROM cand")
def gini_candidates_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = B.candidates(B.histogram(_lines(spark, sf), LINE_NUMERIC))
    return c.select("feature", F.round("t", 6).alias("t"), "nl", "nr", F.round("gain", 9).alias("gain"))


@_query(
    f"WITH {_FIT} SELECT feature, t, round(gain, 9) AS gain FROM cand QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, t DESC) <= 5"
)
def topk_cuts(spark: SparkSession, sf: str) -> DataFrame:
    c = B.choose(B.candidates(B.histogram(_docs(spark, sf), NUMERIC)), "greedy", 5)
    return c.select("feature", "t", F.round("gain", 9).alias("gain"))


@_query(
    f"WITH {_FIT} SELECT feature, t, round(gain, 9) AS gain FROM cand QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, t) = 1"
)
def mode_one_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return B.choose(B.candidates(B.histogram(_docs(spark, sf), NUMERIC)), "one").select(
        "feature", "t", F.round("gain", 9).alias("gain")
    )


@_query(
    f"WITH {_FIT} SELECT feature, t FROM cand QUALIFY t = min(t) OVER (PARTITION BY feature) OR t = max(t) OVER (PARTITION BY feature)"
)
def mode_two_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return B.choose(B.candidates(B.histogram(_docs(spark, sf), NUMERIC)), "two").select("feature", "t")


@_query(f"""WITH RECURSIVE {_FIT}, num AS (SELECT feature, t, gain, row_number() OVER (PARTITION BY feature ORDER BY t) AS i, (max(hi) OVER (PARTITION BY feature) - min(lo) OVER (PARTITION BY feature)) * 0.02 AS gap FROM cand),
walk AS (SELECT feature, i, t AS last, gain AS g, i AS slot, gap FROM num WHERE i = 1
  UNION ALL SELECT n.feature, n.i, CASE WHEN n.t - w.last < w.gap AND NOT n.gain > w.g THEN w.last ELSE n.t END, CASE WHEN n.t - w.last < w.gap AND NOT n.gain > w.g THEN w.g ELSE n.gain END,
    CASE WHEN n.t - w.last < w.gap THEN w.slot ELSE n.i END, w.gap FROM walk w JOIN num n ON n.feature = w.feature AND n.i = w.i + 1)
SELECT feature, max_by(last, i) AS t, round(max_by(g, i), 9) AS gain FROM walk GROUP BY feature, slot""")
def distance_prune(spark: SparkSession, sf: str) -> DataFrame:
    return B.distance_prune(B.candidates(B.histogram(_docs(spark, sf), NUMERIC))).select(
        "feature", "t", F.round("gain", 9).alias("gain")
    )


@_query(f"""WITH {_DOC}, v AS (SELECT lang AS v, count(*) AS n, sum(label) AS pos, row_number() OVER (ORDER BY lang) - 1 AS i FROM doc GROUP BY lang),
m AS (SELECT unnest(range(1, (1 << (SELECT count(*)::INT FROM v)) - 1)) AS mask),
s AS (SELECT mask, string_agg(v, ',' ORDER BY v) AS members, sum(n) AS nl, sum(pos) AS pl FROM m, v WHERE (mask >> i::INT) & 1 = 1 AND bit_count(mask) <= 3 GROUP BY mask),
t AS (SELECT sum(n) AS n, sum(pos) AS p FROM v)
SELECT members, nl::BIGINT AS nl, round(power((pl * (n - nl) - (p - pl) * nl)::DOUBLE, 2) / (n::DOUBLE * n * nl * (n - nl)), 9) AS gain FROM s, t WHERE nl >= 5 AND n - nl >= 5 AND pl * (n - nl) <> (p - pl) * nl""")
def categorical_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return B.categorical(_docs(spark, sf), "lang").select("members", "nl", F.round("gain", 9).alias("gain"))


@_query(f"WITH {_BIT} SELECT * FROM bit")
def binarize_bits(spark: SparkSession, sf: str) -> DataFrame:
    return _bits(spark, sf)


@_query(f"WITH {_PAT} SELECT * FROM pat")
def pattern_table(spark: SparkSession, sf: str) -> DataFrame:
    return score.pattern_table(_bits(spark, sf))


def _lad(cw: float) -> str:
    boost = f"CASE WHEN n1 > n0 THEN {cw} ELSE 1.0 END"
    return f"WITH {_PAT} SELECT round(sum({boost} * greatest(n0, n1))::DOUBLE / sum({boost} * (n0 + n1))::DOUBLE, 9) AS score, count(*) AS patterns, max(least(n0, n1)) = 0 AS consistent FROM pat"


@_query(_lad(1.0))
def lad_score(spark: SparkSession, sf: str) -> DataFrame:
    return score.lad_score(score.pattern_table(_bits(spark, sf)))


@_query(_lad(1.5))
def lad_score_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return score.lad_score(score.pattern_table(_bits(spark, sf)), 1.5)


@_query(f"WITH {_PAT} SELECT bits, n0, n1 FROM pat WHERE n0 > 0 AND n1 > 0")
def inconsistent_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return score.inconsistent(score.pattern_table(_bits(spark, sf)))


@_query(
    f"WITH {_PAT} SELECT bit.row_id, bit.label, bit.bits FROM bit JOIN pat USING (bits) WHERE bit.label = CASE WHEN n1 > n0 THEN 1 WHEN n0 > n1 THEN 0 WHEN first1 < first0 THEN 1 ELSE 0 END"
)
def remove_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return score.remove_conflicts(_bits(spark, sf))


@_query(f"""WITH {_BIT}, one AS (SELECT i AS cut_id, (bits >> i) & 1 AS v, label FROM bit, (SELECT unnest(range(0, {len(CUTS)}))::INT AS i)),
c AS (SELECT cut_id, v, label, count(*) AS n FROM one GROUP BY ALL),
m AS (SELECT cut_id, n, sum(n) OVER (PARTITION BY cut_id) AS t, sum(n) OVER (PARTITION BY cut_id, v) AS r, sum(n) OVER (PARTITION BY cut_id, label) AS k FROM c)
SELECT cut_id, round(sum(n / t * ln(n * t / (r * k)::DOUBLE)), 9) AS mi FROM m GROUP BY cut_id""")
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    return score.mutual_information(score.pattern_table(_bits(spark, sf)), len(CUTS))


@_query(f"WITH {_FIRE}, {_best('worth')} SELECT row_id, label, pred, round(conf, 9) AS conf, is_exact FROM best")
def best_match(spark: SparkSession, sf: str) -> DataFrame:
    return predict.best_match(_bits(spark, sf), _rules(spark))


@_query(f"WITH {_FIRE}, {_best('overlap')} SELECT row_id, label, pred, round(conf, 9) AS conf, is_exact FROM best")
def best_match_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return predict.best_match(_bits(spark, sf), _rules(spark), "overlap_only")


@_query(f"WITH {_FIRE}, {_best('worth')}, {_SOFT} SELECT * FROM soft")
def soft_vote(spark: SparkSession, sf: str) -> DataFrame:
    return predict.soft_vote(_bits(spark, sf), _rules(spark))


def _assume(d: int) -> str:
    return f"WITH {_FIRE} SELECT row_id, label, CASE WHEN bool_or(fires AND rl = {1 - d}) THEN {1 - d} ELSE {d} END AS pred, coalesce(min_by(weight, rule_rank) FILTER (fires AND rl = {1 - d}), 1.0) AS conf FROM pair GROUP BY row_id, label"


@_query(_assume(0))
def assume_healthy(spark: SparkSession, sf: str) -> DataFrame:
    return predict.assume(_bits(spark, sf), _rules(spark), 0)


@_query(_assume(1))
def assume_sick(spark: SparkSession, sf: str) -> DataFrame:
    return predict.assume(_bits(spark, sf), _rules(spark), 1)


@_query(f"""WITH {_FIRE}, {_best('worth')}, c AS (SELECT count(*) FILTER (pred = 0 AND label = 0) AS tn, count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 1 AND label = 1) AS tp FROM best)
SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""")
def metrics_suite(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metrics(best_match(spark, sf))


@_query(f"""WITH {_FIRE}, {_best('worth')}, {_SOFT}, r AS (SELECT label, rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2 AS r FROM soft)
SELECT round((sum(r) FILTER (label = 1) - (count(*) FILTER (label = 1)) * ((count(*) FILTER (label = 1)) + 1) / 2) / ((count(*) FILTER (label = 1)) * (count(*) FILTER (label = 0))), 9) AS auc FROM r""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_auc(soft_vote(spark, sf))


@_query(f"""WITH {_BIT}, one AS (SELECT i AS cut_id, (bits >> i) & 1 AS v, label FROM bit, (SELECT unnest(range(0, {len(CUTS)}))::INT AS i)),
c AS (SELECT cut_id, v, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM one GROUP BY ALL)
SELECT cut_id, round(max(CASE WHEN n0 + n1 >= 3 THEN greatest(n0, n1) / (n0 + n1) ELSE 0 END), 9) AS weight FROM c GROUP BY cut_id""")
def lazy_weights(spark: SparkSession, sf: str) -> DataFrame:
    return lazy.weights(score.pattern_table(_bits(spark, sf)), len(CUTS))


_LEVELS = ", ".join(f"({k + 1}, {(1 << (k + 1)) - 1}::BIGINT)" for k in range(len(CUTS)))


@_query(f"""WITH {_BIT}, lev(level, mask) AS (VALUES {_LEVELS}), tr AS (SELECT * FROM bit WHERE row_id % 4 <> 0), te AS (SELECT * FROM bit WHERE row_id % 4 = 0),
g AS (SELECT level, bits & mask AS key, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM tr, lev GROUP BY ALL HAVING count(*) >= 3 AND greatest(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) / count(*) >= 0.75),
h AS (SELECT row_id, max(lev.level) AS level, max_by(n0, lev.level) AS n0, max_by(n1, lev.level) AS n1 FROM te, lev JOIN g ON g.level = lev.level AND g.key = bits & mask GROUP BY row_id),
b AS (SELECT count(*) FILTER (label = 0) AS b0, count(*) FILTER (label = 1) AS b1 FROM tr)
SELECT te.row_id, te.label, CASE WHEN level IS NULL THEN (b1 > b0)::INT ELSE (n1 > n0)::INT END AS pred, round(CASE WHEN level IS NULL THEN 0.5 ELSE greatest(n0, n1) / (n0 + n1) END, 9) AS purity,
  CASE WHEN level IS NULL THEN b0 + b1 ELSE n0 + n1 END AS support, CASE WHEN level IS NULL THEN 'fallback' WHEN level = {len(CUTS)} THEN 'exact' ELSE 'pruned' END AS stage,
  CASE WHEN level IS NULL THEN '<majority class fallback>' ELSE array_to_string([{", ".join(f"CASE WHEN level > {i} THEN CASE WHEN (bits >> {i}) & 1 = 1 THEN '' ELSE 'NOT ' END || '{f} <= {t:.4f}' END" for i, (f, t) in enumerate(CUTS))}], ' AND ') END AS rule FROM te LEFT JOIN h USING (row_id), b""")
def lazy_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bits(spark, sf)
    return lazy.predict(
        rows.where("row_id % 4 <> 0"), rows.where("row_id % 4 = 0"), list(range(len(CUTS))), names=[c.readable() for c in _cuts()]
    )


@_query(
    "SELECT quality AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM labels GROUP BY quality"
)
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    return score.balanced_weights(spark.read.parquet(f"{sf}/labels.parquet").select(F.col("quality").alias("label")))


@_query("SELECT event_id AS row_id, coalesce(try_cast(substr(props, 7, 2) AS DOUBLE), 0.0) AS x FROM events")
def safe_numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("row_id"), F.substring("props", 7, 2).alias("k")
    )
    return e.select("row_id", X.to_number("k").alias("x"))


@_query(
    f"WITH {_FIT}, a AS (SELECT feature, t, gain, max(hi - lo) OVER w * 0.3 AS gap, min(t) OVER w AS t0, max(t) OVER w AS t1, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, t) AS r FROM cand WINDOW w AS (PARTITION BY feature)) SELECT feature, t FROM a WHERE CASE WHEN t1 - t0 < gap THEN r = 1 ELSE t = t0 OR t = t1 END"
)
def mode_two_apart(spark: SparkSession, sf: str) -> DataFrame:
    hist = B.histogram(_docs(spark, sf), NUMERIC)
    gaps = hist.groupBy("feature").agg(((F.max("x") - F.min("x")) * 0.3).alias("gap"))
    return B.choose(B.candidates(hist), "two", apart=gaps).select("feature", "t")


_THRESHOLDS = "th(feature, t) AS (VALUES " + ", ".join(f"('{f}', {t}::DOUBLE)" for f, t in CUTS) + ")"


@_query(f"""WITH {_DOC}, {_LONG}, {_THRESHOLDS}, s AS (SELECT feature, t, count(*) FILTER (x <= t) AS nl, count(*) FILTER (x > t) AS nr, sum(label) FILTER (x <= t) AS pl, sum(label) FILTER (x > t) AS pr, count(*) AS n FROM long JOIN th USING (feature) GROUP BY feature, t)
SELECT feature, t, nl, nr, round(CASE WHEN nl < 2 OR nr < 2 THEN 0 ELSE power((pl * nr - pr * nl)::DOUBLE, 2) / (n::DOUBLE * nl * nr) END, 7) AS gain FROM s""")
def threshold_gains(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame(list(CUTS), "feature string, t double")
    return B.measure(B.histogram(_docs(spark, sf), NUMERIC), fixed).select(
        "feature", "t", "nl", "nr", F.round("gain", 7).alias("gain")
    )


_MEMBERS = ORACLES["categorical_cuts"].replace("SELECT members, nl::BIGINT", ", c AS (SELECT members, nl::BIGINT", 1) + ")"
_MADE = "len(string_split(members, ',')), members"


@_query(f"""{_MEMBERS}, r AS (SELECT members, gain, row_number() OVER (ORDER BY gain DESC, {_MADE}) AS top, row_number() OVER (ORDER BY gain, {_MADE}) AS low FROM c)
SELECT 'one' AS mode, members, gain FROM r WHERE top = 1 UNION ALL SELECT 'two', members, gain FROM r WHERE top = 1 OR low = 1 UNION ALL SELECT 'greedy', members, gain FROM r WHERE top <= 5 UNION ALL SELECT 'all', members, gain FROM r""")
def categorical_modes(spark: SparkSession, sf: str) -> DataFrame:
    cuts, out = B.categorical(_docs(spark, sf), "lang").withColumn("gain", F.round("gain", 9)), None
    for mode in ("one", "two", "greedy", "all"):
        one = B.choose_members(cuts, mode, 5).select(F.lit(mode).alias("mode"), "members", "gain")
        out = one if out is None else out.unionByName(one)
    return out


#: Cuts of which some give equal columns on every table.
TWINS = (*CUTS, ("n_words", 150.25), ("n_words", 150.75), ("n_chars", 2000.5), ("letter_ratio", 2.0), ("punct_ratio", 2.0))


@_query(f"""WITH {_DOC}, b AS (SELECT row_id, unnest([{", ".join(f"{{'i': {i}, 'v': coalesce({f} <= {t}, false)}}" for i, (f, t) in enumerate(TWINS))}]) AS c FROM doc), o AS (SELECT row_id, c.i AS i, c.v AS v FROM b),
twin AS (SELECT y.i FROM o x JOIN o y ON x.row_id = y.row_id AND x.i < y.i GROUP BY x.i, y.i HAVING bool_and(x.v = y.v)),
t(i, feature, threshold) AS (VALUES {", ".join(f"({i}, '{f}', {t}::DOUBLE)" for i, (f, t) in enumerate(TWINS))})
SELECT (row_number() OVER (ORDER BY i) - 1)::INT AS cut_id, feature, threshold FROM t WHERE i NOT IN (SELECT i FROM twin)""")
def duplicate_columns(spark: SparkSession, sf: str) -> DataFrame:
    kept = B.distinct_cuts(_docs(spark, sf), [B.Cut(i, f, t) for i, (f, t) in enumerate(TWINS)])
    return spark.createDataFrame(
        [(c.cut_id, c.feature, c.threshold) for c in kept], "cut_id int, feature string, threshold double"
    )


@_query(f"""WITH {_FIRE}, {_best('overlap')}, v AS (SELECT row_id, label, round(coalesce(sum(weight) FILTER (fires AND rl = 1), 0), 12) AS w1, round(coalesce(sum(weight) FILTER (fires AND rl = 0), 0), 12) AS w0, min_by(rl, rule_rank) FILTER (fires) AS one FROM pair GROUP BY row_id, label)
SELECT v.row_id, v.label, CASE WHEN one IS NULL THEN best.pred WHEN w1 > w0 THEN 1 WHEN w0 > w1 THEN 0 ELSE one END AS pred,
  round(CASE WHEN one IS NULL THEN best.conf WHEN w0 + w1 > 0 THEN greatest(w0, w1) / (w0 + w1) ELSE 0 END, 9) AS conf FROM v JOIN best USING (row_id)""")
def soft_vote_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return predict.soft_vote_argmax(_bits(spark, sf), _rules(spark))


@_query(f"""WITH {_FIRE}, {_best('worth')}, raw AS (SELECT row_id, CASE WHEN bool_or(fires) THEN 1.0 ELSE max_by(overlap, worth * 1000000 - rule_rank) FILTER (weight >= 0.05) END AS score FROM pair GROUP BY row_id),
why AS (SELECT pair.row_id, min(rule_rank) FILTER (rl = pred AND overlap = score) AS k FROM pair JOIN best USING (row_id) JOIN raw USING (row_id) GROUP BY pair.row_id)
SELECT best.row_id, best.label, pred, round(score, 9) AS score, is_exact, pair.rule_rank, round(overlap, 9) AS overlap, round(pair.weight, 9) AS weight
FROM best JOIN raw USING (row_id) JOIN why USING (row_id) JOIN pair ON pair.row_id = best.row_id AND pair.rule_rank = coalesce(k, 0)""")
def justified_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predict.justify(_bits(spark, sf), _rules(spark))


@_query(f"""WITH r(rule_rank, label, mask, vals, purity, repet, weight) AS (VALUES {", ".join(f"({i}, {r[0]}, {r[1]}, {r[2]}, {r[3]}, {r[4]}, {r[5]})" for i, r in enumerate(RULES))}),
n(i, name) AS (VALUES {", ".join(f"({i}, '{f} <= {t:.4f}')" for i, (f, t) in enumerate(CUTS))})
SELECT rule_rank, 'IF ' || string_agg(CASE WHEN (vals >> i) & 1 = 1 THEN name ELSE 'NOT (' || name || ')' END, ' AND ' ORDER BY i) || ' THEN class = ' || label AS text,
  printf('purity=%.3f support=%d weight=%.3f', purity::DOUBLE, repet, weight::DOUBLE) AS facts FROM r JOIN n ON (mask >> i) & 1 = 1 GROUP BY rule_rank, label, purity, repet, weight""")
def rule_texts(spark: SparkSession, sf: str) -> DataFrame:
    return predict.rule_text(_rules(spark), [c.readable() for c in _cuts()])


@_query(f"""WITH {_FIRE} SELECT rule_rank, count(*) FILTER (fires) AS support, round(coalesce(greatest(count(*) FILTER (fires AND label = 0), count(*) FILTER (fires AND label = 1)) / nullif(count(*) FILTER (fires), 0), 0), 9) AS purity,
  (count(*) FILTER (fires AND label = 1) > count(*) FILTER (fires AND label = 0))::INT AS majority FROM pair GROUP BY rule_rank""")
def rule_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return predict.rule_statistics(score.pattern_table(_bits(spark, sf)), _rules(spark))


@_query(
    f"WITH {_FIRE}, {_best('worth')}, a AS (SELECT avg((pred = label)::INT) FILTER (row_id % 4 <> 0) AS x, avg((pred = label)::INT) FILTER (row_id % 4 = 0) AS y FROM best) SELECT round(x, 9) AS train_acc, round(y, 9) AS test_acc, round(x - y, 9) AS gap, abs(round(x - y, 9)) > 0.1 AS flagged FROM a"
)
def overfit_gap(spark: SparkSession, sf: str) -> DataFrame:
    p = best_match(spark, sf)
    return metrics.overfit_gap(p.where("row_id % 4 <> 0"), p.where("row_id % 4 = 0"))


@_query(
    f"WITH {_FIRE}, {_best('worth')} SELECT count(*) AS n, round(avg(is_exact::INT), 9) AS coverage, round(avg(round(conf, 9)), 9) AS mean_confidence FROM best"
)
def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.run_statistics(best_match(spark, sf))


@_query(
    f"WITH z AS ({ORACLES['lazy_predict']}), s AS (SELECT stage, count(*) AS n, round(avg((pred = label)::INT), 9) AS accuracy, round(avg(purity), 9) AS mean_purity, round(avg(support), 9) AS mean_support FROM z GROUP BY stage) SELECT *, round(n / sum(n) OVER (), 9) AS share, stage = 'fallback' AND round(n / sum(n) OVER (), 9) > 0.3 AS hint FROM s"
)
def lazy_stages(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stage_report(lazy_predict(spark, sf))


@_query(f'SELECT *, pred = label AS "right" FROM ({ORACLES["best_match"]}) ORDER BY row_id LIMIT 50')
def first_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.breakdown(best_match(spark, sf))


#: Trials as (hash, accuracy, F1, status, minute); the second row of a hash replaces the first.
LOG = (
    ("a", 0.9, 0.8, "ok", 0),
    ("b", 0.9, 0.85, "ok", 1),
    ("c", 0.5, 0.1, "error", 2),
    ("a", 0.7, 0.6, "ok", 3),
    ("d", 0.9, 0.85, "ok", 4),
    ("e", 0.2, 0.2, "timeout", 5),
)
_LOG = "lg(config_hash, accuracy, f1, status, ts) AS (VALUES " + ", ".join(
    f"('{h}', {a}::DOUBLE, {f}::DOUBLE, '{s}', {m})" for h, a, f, s, m in LOG
) + "), last AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY config_hash ORDER BY ts DESC) = 1)"


def _log(spark: SparkSession) -> DataFrame:
    return store.latest(spark.createDataFrame(list(LOG), "config_hash string, accuracy double, f1 double, status string, ts int"))


@_query(
    f"WITH {_LOG} SELECT config_hash, accuracy, f1 FROM last WHERE status = 'ok' ORDER BY accuracy DESC, f1 DESC, config_hash LIMIT 20"
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return store.leaderboard(_log(spark)).select("config_hash", "accuracy", "f1")


@_query(f"WITH {_LOG} SELECT status, count(*) AS n FROM last GROUP BY status")
def trial_status(spark: SparkSession, sf: str) -> DataFrame:
    return store.status_counts(_log(spark))


@_query()
def tuned_h_weight(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(float(P.tune_h_weight(_bits(spark, sf), len(CUTS), [1.0, 5.0, 20.0])),)], "h_weight double")


@_query()
def tuned_purity(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(
        [P.tune_purity(_bits(spark, sf), len(CUTS), [0.7, 0.85, 0.95], k=3)], "purity double, accuracy double"
    )


@_query()
def cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    folds = P.cross_validate(
        _docs(spark, sf),
        P.Config(numeric=tuple(NUMERIC), categoric=("lang",), top_k=4, selector="mutualinfo", purity=0.9, threshold=1),
        k=3,
    )
    s = P.summary(folds)
    return spark.createDataFrame(
        [tuple(s.values())], "folds int, accuracy_mean double, accuracy_std double, f1_mean double, f1_std double"
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Split, binarize, select, mine and compare the four classifiers on the documents' quality."""
    rows = store.cut(split.stratified_split(_docs(spark, sf)))  # features without texts, read by every step of a fit
    model = P.fit(rows.where("not is_test"), P.Config(numeric=tuple(NUMERIC), categoric=("lang",), purity=0.9, threshold=1))
    return P.compare(model, rows.where("is_test"))


QUERIES["rule_pipeline"] = flagship
