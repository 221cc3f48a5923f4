"""Classifiers: rows against a small table of rules, in one projection.

All rules travel in one row, so nothing is shuffled, and every classifier reads the same facts about a row: the rules that
fire, and the rule with the best overlap. A row may as well be a distinct pattern with the number of rows it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are few by construction (caps of the miners); the bound is checked before they are broadcast.
MOST_RULES = 20_000
MIN_WEIGHT = 0.05
MODES = ("overlap_times_weight", "overlap_only")
CLASSIFIERS = ("best_match", "soft_vote", "assume_healthy", "assume_sick")

OVERLAP = "(1 - bit_count((bits ^ r.vals) & r.mask) / bit_count(r.mask))"
FIRES = "(bits & r.mask) = r.vals"


def match(rows: DataFrame, rules: DataFrame, name: str = "rules") -> DataFrame:
    """rows with an array of all rules, by rank."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    one = F.struct("rule_rank", F.col("label").alias("rule_label"), "mask", "vals", "weight")
    packed = rules.agg(F.array_sort(F.collect_list(one)).alias(name))
    return rows.crossJoin(F.broadcast(packed))  # one row that holds all rules


def facts(
    rows: DataFrame, rules: DataFrame, mode: str = "overlap_times_weight", min_weight: float = MIN_WEIGHT, name: str = "rules"
) -> DataFrame:
    """rows with what classifiers ask for: <name>, <name>_fired, and <name>_part, the best overlap.

    A part holds s, the mode's score, k, the rank below zero, l, the label, and o, the raw overlap.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    worth = OVERLAP + (" * r.weight" if mode == "overlap_times_weight" else "")
    heavy = f"filter({name}, r -> r.weight >= {min_weight})"
    part = f"struct(round({worth}, 12) as s, -r.rule_rank as k, r.rule_label as l, round({OVERLAP}, 12) as o)"
    m = match(rows, rules, name).withColumn(f"{name}_fired", F.expr(f"filter({name}, r -> {FIRES})"))
    return m.withColumn(f"{name}_part", F.expr(f"array_max(transform({heavy}, r -> {part}))"))


def _best(name: str) -> tuple[Column, Column, Column]:
    """pred, conf, is_exact: the first firing rule, else the best overlap, else the first rule."""
    first = F.get(f"{name}_fired", F.lit(0))
    exact, part = F.size(f"{name}_fired") > 0, F.col(f"{name}_part")
    pred = F.when(exact, first["rule_label"]).otherwise(F.coalesce(part["l"], F.get(name, F.lit(0))["rule_label"]))
    return pred, F.round(F.when(exact, 1.0).otherwise(F.coalesce(part["s"], F.lit(0.0))), 9), exact


def _weight(name: str, label: int | None = None) -> Column:
    kind = "true" if label is None else f"r.rule_label = {label}"
    return F.expr(f"aggregate({name}_fired, 0D, (a, r) -> a + if({kind}, r.weight, 0D))")


def _soft(name: str, threshold: float) -> tuple[Column, Column]:
    """1 if the firing rules of label 1 hold at least `threshold` of the weight; without firing rules the best match."""
    other, conf, some = _best(name)
    whole = _weight(name)
    share = F.when(whole > 0, _weight(name, 1) / whole).otherwise(0.0)
    one = F.round(share, 12) >= threshold
    sure = F.round(F.when(one, share).otherwise(1 - share), 9)
    return F.when(some, one.cast("int")).otherwise(other), F.when(some, sure).otherwise(conf)


def _assume(name: str, default: int) -> tuple[Column, Column]:
    """`default` unless a rule of the other label fires; conf is the weight of the first of those."""
    hit = F.expr(f"get(filter({name}_fired, r -> r.rule_label = {1 - default}), 0)")
    some = hit.isNotNull()
    return F.when(some, 1 - default).otherwise(default), F.round(F.when(some, hit["weight"]).otherwise(1.0), 9)


def best_match(
    rows: DataFrame, rules: DataFrame, mode: str = "overlap_times_weight", min_weight: float = MIN_WEIGHT
) -> DataFrame:
    """row_id, label, pred, conf, is_exact."""
    pred, conf, exact = _best("rules")
    return facts(rows, rules, mode, min_weight).select(
        "row_id", "label", pred.alias("pred"), conf.alias("conf"), exact.alias("is_exact")
    )


def soft_vote(rows: DataFrame, rules: DataFrame, threshold: float = 0.5, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """row_id, label, pred, conf of the vote by weight; where no rule fires, of the best match by overlap times weight."""
    pred, conf = _soft("rules", threshold)
    return facts(rows, rules, min_weight=min_weight).select("row_id", "label", pred.alias("pred"), conf.alias("conf"))


def assume(rows: DataFrame, rules: DataFrame, default: int) -> DataFrame:
    pred, conf = _assume("rules", default)
    return facts(rows, rules).select("row_id", "label", pred.alias("pred"), conf.alias("conf"))


def soft_vote_argmax(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The label with more weight of firing rules (a tie: that of the first firing rule); else the best match by overlap."""
    other, conf, some = _best("rules")
    w0, w1 = _weight("rules", 0), _weight("rules", 1)
    one, zero = F.round(w1, 12), F.round(w0, 12)
    first = F.get("rules_fired", F.lit(0))["rule_label"]
    pred = F.when(one > zero, 1).when(zero > one, 0).otherwise(first)
    sure = F.round(F.when(one + zero > 0, F.greatest(w0, w1) / (w0 + w1)).otherwise(0.0), 9)
    voted = (F.when(some, pred).otherwise(other).alias("pred"), F.when(some, sure).otherwise(conf).alias("conf"))
    return facts(rows, rules, "overlap_only").select("row_id", "label", *voted)


def classify(
    rows: DataFrame, rules: DataFrame, voting: DataFrame | None = None, threshold: float = 0.5,
    mode: str = "overlap_times_weight", min_weight: float = MIN_WEIGHT,
) -> DataFrame:
    """All columns of rows with classifier, pred, conf: four rows for each, from one projection.

    The best match goes by `rules` in `mode`; the other three vote with `voting` where it is given.
    """
    votes = "rules" if voting is None and mode == "overlap_times_weight" else "voting"
    m = facts(rows, rules, mode, min_weight)
    if votes == "voting":
        m = facts(m, rules if voting is None else voting, min_weight=min_weight, name="voting")
    said = [_best("rules")[:2], _soft(votes, threshold), _assume(votes, 0), _assume(votes, 1)]
    each = (
        F.struct(F.lit(c).alias("classifier"), p.cast("int").alias("pred"), s.alias("conf"))
        for c, (p, s) in zip(CLASSIFIERS, said, strict=True)
    )
    return m.select(*rows.columns, F.inline(F.array(*each)))


def justify(rows: DataFrame, rules: DataFrame, mode: str = "overlap_times_weight") -> DataFrame:
    """best_match with its reason: rule_rank, overlap and weight of the first rule of the label with the overlap found.

    score is the raw overlap in both modes: 1 for a firing rule, 0 where only the first rule was left to take.
    """
    pred, _, exact = _best("rules")
    score = F.when(exact, 1.0).otherwise(F.coalesce(F.col("rules_part")["o"], F.lit(0.0)))
    m = facts(rows, rules, mode).withColumns({"pred": pred, "score": score, "is_exact": exact})
    why = F.expr(f"get(filter(rules, r -> r.rule_label = pred AND round({OVERLAP}, 12) = score), 0)")
    m = m.withColumn("r", F.coalesce(why, F.get("rules", F.lit(0))))
    reason = (
        F.col("r.rule_rank").alias("rule_rank"),
        F.round(F.expr(OVERLAP), 9).alias("overlap"),
        F.round("r.weight", 9).alias("weight"),
    )
    return m.select("row_id", "label", "pred", F.round("score", 9).alias("score"), "is_exact", *reason)


def rule_text(rules: DataFrame, names: list[str]) -> DataFrame:
    """rule_rank, text: IF a AND NOT (b) THEN class = L, with purity, support and weight; names[i] says what bit i means."""
    said = F.array(*map(F.lit, names))
    places = "filter(sequence(0, 61), i -> shiftright(mask, i) & 1 = 1)"
    names_of = F.transform(F.expr(places), lambda i: F.get(said, i))
    on = F.expr(f"transform({places}, i -> shiftright(vals, i) & 1 = 1)")
    text = F.zip_with(names_of, on, lambda n, on: F.when(on, n).otherwise(F.concat(F.lit("NOT ("), n, F.lit(")"))))
    whole = F.concat(F.lit("IF "), F.array_join(text, " AND "), F.lit(" THEN class = "), F.col("label").cast("string"))
    counted = F.format_string("purity=%.3f support=%d weight=%.3f", "purity", "repet", "weight")
    return rules.select("rule_rank", whole.alias("text"), counted.alias("facts"))


def rule_statistics(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_rank, support, purity, majority label (a tie: 0) of every rule's conjunction over a pattern table."""
    ranks = F.transform("rules_fired", lambda r: r["rule_rank"])
    fired = facts(patterns, rules).select("n0", "n1", F.explode(ranks).alias("rule_rank"))
    c = fired.groupBy("rule_rank").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    c = rules.select("rule_rank").join(c, "rule_rank", "left").fillna(0, ["n0", "n1"])
    n = F.col("n0") + F.col("n1")
    purity = F.round(F.when(n > 0, F.greatest("n0", "n1") / n).otherwise(0.0), 9)
    return c.select(
        "rule_rank", n.alias("support"), purity.alias("purity"), (F.col("n1") > F.col("n0")).cast("int").alias("majority")
    )
