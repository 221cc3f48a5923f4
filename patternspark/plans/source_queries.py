"""Registered queries of scans, encoding, wide tables, settings and evaluation, and the SQL that restates them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..operators import binarize as B
from ..operators import metrics, mine, predict, score
from ..sources import store
from ..streaming import scoring
from . import registry as R


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# scans and encoding


@R._query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as CSV and read again with inferred types."""
    path = f"{store.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    store.write_csv(_read(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return store.read_csv(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double")


@R._query("SELECT doc_id, quality, toxic AS label FROM labels")
def positional_label(spark: SparkSession, sf: str) -> DataFrame:
    return X.positional(_read(spark, sf, "labels"))[0]


@R._query(
    "SELECT c_custkey, c_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSE' WHEN 'MACHINERY' THEN 'TOOLS' ELSE c_mktsegment END AS c_mktsegment FROM customer"
)
def replaced_cells(spark: SparkSession, sf: str) -> DataFrame:
    return X.replace_cells(
        _read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"BUILDING": "HOUSE", "MACHINERY": "TOOLS"}
    )


@R._query(
    "SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 0 END AS label FROM orders"
)
def mapped_target(spark: SparkSession, sf: str) -> DataFrame:
    label = X.map_target(F.col("o_orderstatus"), {"F": 1, "O": 0, "P": 0})
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), label.alias("label"))


@R._query("""SELECT c_custkey AS row_id, (c_acctbal > 0)::INT AS yes, (c_nationkey % 2 = 0)::INT AS male,
  CASE WHEN c_nationkey < 5 THEN 'Yes' ELSE 'Maybe' END AS other FROM customer""")
def encoded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    yes = F.when(F.col("c_acctbal") > 0, "Yes").otherwise("No")
    male = F.when(F.col("c_nationkey") % 2 == 0, "Male").otherwise("Female")
    other = F.when(F.col("c_nationkey") < 5, "Yes").otherwise("Maybe")
    said = _read(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), yes.alias("yes"), male.alias("male"), other.alias("other")
    )
    return X.binary_encode(said, ["yes", "male", "other"])


CONFIG = {"binarizer": {"top_k": 8}, "miner": "eager", "purity": 0.95}


@R._query("""SELECT substr(md5('{"binarizer": {"top_k": 8}, "miner": "eager", "purity": 0.95}'), 1, 20) AS config_hash""")
def config_hash(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(store.config_hash(CONFIG),)], "config_hash string")


@R._query(f"""WITH {R._LOG}, best AS (SELECT * FROM last WHERE status = 'ok' ORDER BY accuracy DESC, f1 DESC, config_hash LIMIT 2)
SELECT row_number() OVER (ORDER BY accuracy DESC, f1 DESC, config_hash)::INT AS rank, '{{"config_hash":"' || config_hash || '","accuracy":' || accuracy || ',"f1":' || f1 || ',"status":"' || status || '"}}' AS json FROM best""")
def top_configs(spark: SparkSession, sf: str) -> DataFrame:
    return store.top_configs(R._log(spark), 2)


# cuts

MEMBERS = (("lang", ("de", "en")), ("lang", ("fr",)), ("source", ("src0", "src1", "src10")))
_MEMBER_BITS = " + ".join(
    f"CASE WHEN {f} IN ({', '.join(repr(v) for v in vs)}) THEN {1 << i} ELSE 0 END" for i, (f, vs) in enumerate(MEMBERS)
)


def _members() -> list[B.Cut]:
    return [B.Cut(i, f, None, vs, 0.5) for i, (f, vs) in enumerate(MEMBERS)]


@R._query(
    f"SELECT d.doc_id AS row_id, quality AS label, ({_MEMBER_BITS})::BIGINT AS bits FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
)
def member_bits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "documents").join(_read(spark, sf, "labels"), "doc_id")
    return B.transform(
        rows.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), "lang", "source"), _members()
    )


def _listed(c: B.Cut) -> str:
    text = f"{c.feature} == {c.members[0]}" if len(c.members) == 1 else f"{c.feature} IN {{{', '.join(c.members)}}}"
    return text if c.members else f"{c.feature} <= {c.threshold:.4f}"


_ALL_CUTS = [*R._cuts(), *(B.Cut(len(R.CUTS) + c.cut_id, c.feature, None, c.members, c.gain) for c in _members())]


@R._query(
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({c.cut_id}, '{c.feature}', '{'categorical' if c.members else 'numeric'}', {'NULL' if c.threshold is None else c.threshold}::DOUBLE, '{_listed(c)}')"
        for c in _ALL_CUTS
    )
    + ") t(cut_id, feature, kind, threshold, readable)"
)
def cut_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table of cuts, read again."""
    path = f"{store.shared_folder(spark)}/cuts-{uuid.uuid4().hex}"
    store.save(B.cuts_frame(spark, _ALL_CUTS), path)
    return B.cuts_frame(spark, B.cuts_of(store.load(spark, path))).drop("members", "gain")


#: More cuts than fit a word.
WIDE = [*R.CUTS, *(("n_words", 10.0 * i + 5) for i in range(40)), *(("n_chars", 60.0 * i + 30) for i in range(34))]
_W = B.WORD


def _wide_word(k: int) -> str:
    return " + ".join(f"CASE WHEN {f} <= {t} THEN {1 << i} ELSE 0 END" for i, (f, t) in enumerate(WIDE[k * _W : (k + 1) * _W]))


_WIDE = f"{R._DOC}, wide AS (SELECT row_id, label, ({_wide_word(0)})::BIGINT AS w0, ({_wide_word(1)})::BIGINT AS w1 FROM doc)"


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return B.transform(R._docs(spark, sf), [B.Cut(i, f, t) for i, (f, t) in enumerate(WIDE)])


@R._query(f"WITH {_WIDE} SELECT * FROM wide")
def wide_bits(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf).select("row_id", "label", F.get("words", F.lit(0)).alias("w0"), F.get("words", F.lit(1)).alias("w1"))


@R._query(f"""WITH {_WIDE}, pat AS (SELECT w0, w1, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM wide GROUP BY w0, w1)
SELECT round(sum(greatest(n0, n1)) / sum(n0 + n1), 9) AS score, count(*) AS patterns, max(least(n0, n1)) = 0 AS consistent FROM pat""")
def wide_lad_score(spark: SparkSession, sf: str) -> DataFrame:
    return score.lad_score(score.pattern_table(_wide(spark, sf)))


@R._query(f"""WITH {_WIDE}, one AS (SELECT i AS cut_id, CASE WHEN i < {_W} THEN (w0 >> i) & 1 ELSE (w1 >> (i - {_W})) & 1 END AS v, label FROM wide, (SELECT unnest(range(0, {len(WIDE)}))::INT AS i)),
c AS (SELECT cut_id, v, label, count(*) AS n FROM one GROUP BY ALL),
k AS (SELECT cut_id, n, sum(n) OVER (PARTITION BY cut_id) AS t, sum(n) OVER (PARTITION BY cut_id, v) AS r, sum(n) OVER (PARTITION BY cut_id, label) AS q FROM c)
SELECT cut_id, round(sum(n / t * ln(n * t / (r * q)::DOUBLE)), 9) AS mi FROM k GROUP BY cut_id""")
def wide_information(spark: SparkSession, sf: str) -> DataFrame:
    return score.mutual_information(score.pattern_table(_wide(spark, sf)), len(WIDE))


@R._query("""WITH v AS (SELECT p_brand AS v, count(*) AS n, sum((p_size > 25)::INT) AS pos FROM part GROUP BY p_brand), t AS (SELECT sum(n) AS n, sum(pos) AS p FROM v),
s AS (SELECT v AS members, n AS nl, pos AS pl FROM v UNION ALL SELECT a.v || ',' || b.v, a.n + b.n, a.pos + b.pos FROM v a JOIN v b ON a.v < b.v
  UNION ALL SELECT a.v || ',' || b.v || ',' || c.v, a.n + b.n + c.n, a.pos + b.pos + c.pos FROM v a JOIN v b ON a.v < b.v JOIN v c ON b.v < c.v)
SELECT members, nl::BIGINT AS nl, round(power((pl * (n - nl) - (p - pl) * nl)::DOUBLE, 2) / (n::DOUBLE * n * nl * (n - nl)), 9) AS gain FROM s, t WHERE nl >= 5 AND n - nl >= 5 AND pl * (n - nl) <> (p - pl) * nl""")
def brand_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Value subsets of a feature with 25 values."""
    rows = _read(spark, sf, "part").select((F.col("p_size") > 25).cast("int").alias("label"), "p_brand")
    return B.categorical(rows, "p_brand").select("members", "nl", F.round("gain", 9).alias("gain"))


# settings and evaluation

_HEAVY = R._best("worth").replace("weight >= 0.05", "weight >= 0.5")


@R._query(f"WITH {R._FIRE}, {_HEAVY} SELECT row_id, label, pred, round(conf, 9) AS conf, is_exact FROM best")
def best_match_heavy(spark: SparkSession, sf: str) -> DataFrame:
    """Rules under a weight of 0.5 don't match in part."""
    return predict.best_match(R._bits(spark, sf), R._rules(spark), min_weight=0.5)


_THIRD = R._SOFT.replace(">= 0.5", ">= 0.3").replace(
    "greatest(w1 / w, 1 - w1 / w)", "CASE WHEN round(w1 / w, 12) >= 0.3 THEN w1 / w ELSE 1 - w1 / w END"
)


@R._query(f"WITH {R._FIRE}, {R._best('worth')}, {_THIRD} SELECT * FROM soft")
def soft_vote_third(spark: SparkSession, sf: str) -> DataFrame:
    """Label 1 needs three tenths of the weight."""
    return predict.soft_vote(R._bits(spark, sf), R._rules(spark), threshold=0.3)


def _assumed(d: int) -> str:
    hit = f"fires AND rl = {1 - d}"
    return f"SELECT row_id, label, CASE WHEN bool_or({hit}) THEN {1 - d} ELSE {d} END AS pred, round(coalesce(min_by(weight, rule_rank) FILTER ({hit}), 1.0), 9) AS conf FROM pair GROUP BY row_id, label"


_FOUR = f"""WITH {R._FIRE}, {R._best('worth')}, {_THIRD},
each AS (SELECT 'best_match' AS classifier, label, pred, round(conf, 9) AS conf FROM best UNION ALL SELECT 'soft_vote', label, pred, conf FROM soft
  UNION ALL SELECT 'assume_healthy', label, pred, conf FROM ({_assumed(0)}) UNION ALL SELECT 'assume_sick', label, pred, conf FROM ({_assumed(1)})),
c AS (SELECT classifier, count(*) FILTER (pred = 0 AND label = 0) AS tn, count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 1 AND label = 1) AS tp FROM each GROUP BY classifier),
r AS (SELECT classifier, label, rank() OVER (PARTITION BY classifier ORDER BY conf) + (count(*) OVER (PARTITION BY classifier, conf) - 1) / 2 AS r FROM each),
a AS (SELECT classifier, (sum(r) FILTER (label = 1) - (count(*) FILTER (label = 1)) * ((count(*) FILTER (label = 1)) + 1) / 2) / ((count(*) FILTER (label = 1)) * (count(*) FILTER (label = 0))) AS auc FROM r GROUP BY classifier)
SELECT classifier, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(auc, 9) AS auc FROM c JOIN a USING (classifier)"""


@R._query(_FOUR)
def four_classifiers(spark: SparkSession, sf: str) -> DataFrame:
    """All four classifiers on distinct patterns, evaluated as on all rows."""
    patterns = R._bits(spark, sf).groupBy("bits", "label").agg(F.count("*").alias("n"))
    preds, by = predict.classify(patterns, R._rules(spark), threshold=0.3), ("classifier",)
    return metrics.metrics(preds, "n", by).join(metrics.roc_auc(preds, n="n", by=by), "classifier")


_STREAM = f"WITH {R._FIRE} SELECT row_id, label, coalesce(min_by(rl, rule_rank) FILTER (fires), min_by(rl, rule_rank)) AS pred FROM pair GROUP BY row_id, label"


@R._query(_STREAM)
def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream of rows would get, on a table."""
    rules = [mine.Rule(*r[:6]) for r in R.RULES]
    return scoring.score_stream(R._bits(spark, sf), rules).select("row_id", "label", "pred")
