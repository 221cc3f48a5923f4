"""Temperature mixing of sources, realised as budgeted block permutations.

A source with token share p gets weight p^t / sum of p^t. The exponent t lies between 0 (uniform) and 1 (as found)
and is bisected until the entropy of the weights reaches a target, or until no source is repeated more often than
a limit. The budget is the least that passes over every source once, so nothing is dropped: the source that gives
up most share gets one epoch, the others weight/share times as many.

A source is dealt into 256 blocks by a digest of the id. Each epoch orders them by a permutation of its own; full
epochs take all blocks, and the last takes blocks in order while its budget lasts, so every source ends within
one block of its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 256
STEPS = 50
WORDS = r"[^\x20\x09-\x0D]+"


def exponent(shares: Column, repetition: float | None = None, entropy: float | None = None) -> Column:
    """The bisected exponent for an array of structs (share, sources) of positive token shares, rounded to six places.

    With `repetition`: the least exponent at which the largest ratio of weight to share is no more than that many times
    the smallest; the least and the largest share decide that, so two entries do. With `entropy` (nats): the largest
    exponent at which the weights have that entropy; sources of equal shares are one entry with their number.
    """

    def fine(t: Column) -> Column:
        if repetition is not None:
            gain = F.transform(shares, lambda s: F.pow(s["share"], t - 1))
            return F.array_max(gain) <= F.array_min(gain) * repetition
        weights = F.transform(shares, lambda s: F.struct(F.pow(s["share"], t).alias("w"), s["sources"].alias("n")))
        z = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x["w"] * x["n"])
        h = F.aggregate(weights, F.lit(0.0), lambda a, x: a - x["n"] * (x["w"] / z * F.ln(x["w"] / z)))
        return h < entropy

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        ok = fine(mid)
        return F.struct(F.when(ok, s["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    if repetition is not None:
        return F.round(F.when(fine(F.lit(0.0)), 0.0).otherwise(found["hi"]), 6)
    return F.round(F.when(~fine(F.lit(1.0)), 1.0).otherwise(found["lo"]), 6)


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _source(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _block(doc_id: Column, seed: int) -> Column:
    return (
        F.conv(
            F.substring(_digest(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 6), 16, 10
        ).cast("long") % BLOCKS
    ).cast("int")


def plan(rows: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, seed: int = 42) -> DataFrame:
    """Blocks and epochs to take: _mix_source, block, epoch, weight, repeats, position.

    rows: _mix_source, block, n_tokens. A repetition limit is met by the least and the largest share; an entropy takes the
    distinct token counts of sources into one row, which are far fewer than sources where these are many.
    """
    blocks = rows.groupBy("_mix_source", "block").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    sources = blocks.groupBy("_mix_source").agg(F.sum("tokens").alias("tokens"))
    some = sources.where("tokens > 0")
    ends = some.agg(F.sum("tokens").alias("total"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi"))
    if repetition is None:
        counted = some.groupBy("tokens").agg(F.count("*").alias("n"))
        # one row each
        ends = ends.crossJoin(F.broadcast(counted.agg(F.array_sort(F.collect_list(F.struct("tokens", "n"))).alias("all"))))
    else:
        ends = ends.withColumn("all", F.array(*(F.struct(F.col(x).alias("tokens"), F.lit(1).alias("n")) for x in ("lo", "hi"))))
    shares = F.transform("all", lambda x: F.struct((x["tokens"] / F.col("total")).alias("share"), x["n"].alias("sources")))
    found = ends.withColumn("t", exponent(shares, repetition, entropy)).withColumn(
        "least", F.pow(F.col("hi") / F.col("total"), F.col("t") - 1)
    )
    share = F.col("tokens") / F.col("total")
    # one row, here and below
    powers = some.crossJoin(F.broadcast(found.select("total", "t"))).agg(F.sum(F.pow(share, F.col("t"))).alias("z"))
    told = found.select("total", "t", "least").crossJoin(F.broadcast(powers))
    weighed = sources.join(F.broadcast(told), F.lit(True), "left")
    holds = F.col("tokens") > 0
    weight = F.when(holds, F.round(F.pow(share, F.col("t")) / F.col("z"), 9)).otherwise(0.0)
    repeats = F.when(holds, F.greatest(F.lit(1.0), F.round(F.pow(share, F.col("t") - 1) / F.col("least"), 6))).otherwise(1.0)
    weighed = weighed.select(
        "_mix_source", F.col("tokens").alias("source_tokens"), weight.alias("weight"), repeats.alias("repeats")
    )
    each = blocks.join(weighed, "_mix_source").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.ceil("repeats").cast("int") - 1))
    )
    each = each.withColumn("turn", _digest(F.lit(seed), F.col("epoch"), F.col("_mix_source"), F.col("block")))
    order = Window.partitionBy("_mix_source", "epoch").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    budget = F.round((F.col("repeats") - F.floor("repeats")) * F.col("source_tokens")).cast("long")
    taken = each.where((F.col("epoch") < F.floor("repeats")) | (F.col("before") < budget))
    position = F.round((F.col("epoch") + F.col("before") / F.greatest("source_tokens", F.lit(1))) / F.col("repeats"), 9)
    return taken.select("_mix_source", "block", "epoch", "weight", "repeats", position.alias("position"))


def mix(docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, seed: int = 42) -> DataFrame:
    """The documents of the mixture, once for each epoch that takes them.

    All columns of docs stay; added are _mix_epoch, _mix_block, _mix_tokens, _mix_weight (of the source) and
    _mix_position (0 to 1: order by it to interleave the sources). A null source is a source of its own; a null
    text has no tokens; a source without tokens is taken once with weight 0. Repeated rows are taken alike.
    Columns of these names in docs are refused. An empty table gives an empty mixture.
    """
    clash = [c for c in docs.columns if c.startswith("_mix_")]
    if clash:
        raise ValueError(f"documents already have {clash}")
    keyed = docs.withColumns(
        {
            "_mix_source": _source(F.col("source")),
            "_mix_block": _block(F.col("doc_id"), seed),
            "_mix_tokens": n_tokens(F.col("text")),
        }
    )
    turns = plan(
        keyed.select("_mix_source", F.col("_mix_block").alias("block"), F.col("_mix_tokens").alias("n_tokens")),
        repetition,
        entropy,
        seed,
    )
    turns = turns.select(
        "_mix_source",
        F.col("block").alias("_mix_block"),
        F.col("epoch").alias("_mix_epoch"),
        F.col("weight").alias("_mix_weight"),
        F.col("position").alias("_mix_position"),
    )
    return keyed.join(turns, ["_mix_source", "_mix_block"]).select(
        *docs.columns, "_mix_epoch", "_mix_block", "_mix_tokens", "_mix_weight", "_mix_position"
    )
