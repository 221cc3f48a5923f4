"""Sharding by sampled splitters.

Records are ordered by (md5 of the text, md5 of the id, id). A size-weighted sample of these keys gives splitters
at its quantiles; records are range-partitioned by them, and ranges that come out overfull are subdivided along
the key. Exact sums of the ranges, then a running sum inside each, give every record its place in the whole
order, so shards are cut at exact byte quantiles: their sizes differ by no more than the records at the cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Ranges for each shard, sampled keys for each range, rows of a range, and the most ranges (their splitters are broadcast).
RANGES_A_SHARD = 32
SAMPLES_A_RANGE = 12
ROWS_A_RANGE = 100_000
MOST_RANGES = 65_536
OVERFULL = 2
OUT = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _digits(column: str, n: int):
    """The first n hex digits of a column as a number."""
    return F.conv(F.substring(column, 1, n), 16, 10).cast("long")


def shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards 0 to n_shards-1 of nearly equal bytes (law `bytes`), every row in one of them.

    A row weighs the UTF-8 bytes of its text (null: none) plus `overhead`. Returns doc_id, size, text_crc32
    (0 for null), law, shard, slot (the place in its shard, from 0 without gaps), grown_shard (null under this law).
    Rows of equal text stand together, so a group of copies is split only where it crosses a cut; null ids come
    first in their group; repeated rows are rows of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("k"),
    )
    rows = scratch.written(
        rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "digests"
    )
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if not whole["n"]:
        return spark.createDataFrame([], OUT)
    total = whole["bytes"]
    ranges = int(min(max(n_shards * RANGES_A_SHARD, whole["n"] // ROWS_A_RANGE), MOST_RANGES))
    chance = ranges * SAMPLES_A_RANGE / total
    draw = F.pmod(F.xxhash64("k", "h"), F.lit(1 << 40)) / float(1 << 40)
    order = Window.orderBy("k", "h")
    sample = rows.where(draw < F.col("size") * chance).select("k", "h").withColumn("r", F.row_number().over(order)).where(
        F.col("r") % SAMPLES_A_RANGE == 0
    )
    splitters = scratch.written(sample.select("k", "h").distinct().withColumn("r", F.row_number().over(order)), "splitters")
    # splitters by the first three digits of the text's digest: what stands before, and those to compare with
    own = splitters.groupBy(F.substring("k", 1, 3).alias("top")).agg(
        F.array_sort(F.collect_list(F.struct("k", "h"))).alias("near"), F.count("*").alias("n")
    )
    tops = spark.range(4096).select(F.lower(F.lpad(F.hex("id"), 3, "0")).alias("top"))
    table = tops.join(own, "top", "left").withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    table = table.select("top", "before", F.coalesce("near", F.array().cast("array<struct<k:string,h:string>>")).alias("near"))
    # at most MOST_RANGES splitters in 4096 rows
    placed = rows.join(F.broadcast(table), F.substring("k", 1, 3) == F.col("top"))
    placed = placed.withColumn(
        "rng", (F.col("before") + F.size(F.filter("near", lambda s: s <= F.struct("k", "h")))).cast("long")
    ).drop("top", "before", "near")
    placed = whole_order = scratch.written(placed, "placed")
    full = placed.groupBy("rng").agg(F.sum("size").alias("b"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    full = full.withColumn(
        "parts", F.greatest(F.lit(1), F.floor(F.col("b") / (OVERFULL * total / ranges))).cast("long")
    ).where("parts > 1")
    low, high = _digits("lo", 13), _digits("hi", 13)
    along = F.when(F.col("lo") == F.col("hi"), _digits("h", 13) / float(1 << 52)).otherwise(
        (_digits("k", 13) - low) / (high - low + 1)
    )
    # every overfull range takes OVERFULL shares of the bytes at least, so there are fewer of them than ranges
    placed = placed.join(F.broadcast(full.select("rng", "lo", "hi", "parts")), "rng", "left").withColumn(
        "sub", F.coalesce(F.least(F.floor(along * F.col("parts")), F.col("parts") - 1), F.lit(0)).cast("long")
    )
    ranged = scratch.written(placed.select("doc_id", "size", "text_crc32", "k", "h", "rng", "sub"), "ranges")
    scratch.drop(whole_order, splitters)
    placed = ranged
    sums = placed.groupBy("rng", "sub").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("rng", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.written(
        sums.select(
            "rng",
            "sub",
            F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        ),
        "starts",
    )
    inside = Window.partitionBy("rng", "sub").orderBy("k", "h", F.col("doc_id").asc_nulls_first(), "size")
    one = placed.join(F.broadcast(starts), ["rng", "sub"])  # a row for each range
    offset = F.col("b0") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("rank", F.col("n0") + F.row_number().over(inside) - 1).withColumn(
        "shard", F.floor(offset / F.lit(total) * n_shards).cast("int")
    )
    one = scratch.written(
        one.select("doc_id", "size", "text_crc32", F.least("shard", F.lit(n_shards - 1)).alias("shard"), "rank"), "ranked"
    )
    heads = one.groupBy("shard").agg(F.min("rank").alias("head"))
    out = one.join(F.broadcast(heads), "shard")  # a row for each shard
    scratch.drop(rows, ranged)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("head")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
