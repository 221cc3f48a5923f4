"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

One hash orders all shingles; the k lowest of a document are its sketch. Documents with equal shingle sets
are one class and are compared once. Inverted lists of retained values find overlaps in two steps:

* a probe of the 16 lowest values finds the classes that share values with others at all;
* of those, sketches of up to 256 values are indexed by their rarest values only. Two sketches that must
  share m of their s values share one of the s-m+1 rarest of each, so frequent passages list nothing.

Each list first compares its members with one hub, which puts most of a family of near copies into one component: the
union sketch of member and hub tells those apart that lie far from each other, and exact Jaccard on full sets decides
the others. Members that are left over are compared with others of other components only. Where both lie near their hub,
the differences from it decide: if Dx and Dy are the shingles in which x and y differ from the hub, x and y differ in
|Dx| + |Dy| - 2 |Dx & Dy| shingles, so a join over these short lists finds the exact Jaccard and returns nothing but
links; large families are dealt into blocks for it. Distance is a metric, so of the others only pairs remain that both
lie far from the hub; each comes up once, at its first common value. The union sketch of such a pair estimates its
similarity, and pairs within six standard errors of the threshold go on to exact Jaccard on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import components
from .scratch import Scratch, bound_batches

PROBE = 16
SKETCH = 256
#: Of a full probe a partner shares 12.8 values on average; under 4 has a chance of 1e-8.
PROBE_SHARED = 0.25
ERRORS = 4
#: Rows of ids that are broadcast rather than joined by a shuffle of texts: some 50 MB on an executor.
BROADCAST_ROWS = 2_000_000
#: Jaccard distance from a hub up to which differences from it are kept.
NEAR = 0.6
#: Members of a family in a block.
BLOCK = 256
NO_ID = -(1 << 63)


def _digests(n: int, with_sets: bool):
    """Arrow batches (doc_id, text) to the class id, set size and probe, or the full set, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, b, raw, offs in K.chunks(text):
                h, doc, _ = K.shingles(K.Words(raw, offs), n)
                values, off = K.distinct_by_doc(h, doc, b - a)
                size = np.diff(off)
                sums = np.zeros(len(values) + 1, np.uint64)
                np.cumsum(K.mix(values + np.uint64(0x51ED2701)), out=sums[1:])
                key = K.mix((sums[off[1:]] - sums[off[:-1]]) ^ K.mix(size.astype(np.uint64)))
                np.cumsum(K.mix(values ^ np.uint64(0x2545F4914F6CDD1D)), out=sums[1:])
                check = sums[off[1:]] - sums[off[:-1]]
                if with_sets:
                    lists = K.list_array(values.astype(np.int64), off, pa.int64())
                else:
                    short = np.minimum(size, PROBE)
                    starts = np.concatenate([[0], np.cumsum(short)])
                    pick = np.arange(starts[-1]) - np.repeat(starts[:-1], short) + np.repeat(off[:-1], short)
                    lists = K.list_array(values[pick].astype(np.int64), starts, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(size.astype(np.int64)), lists],
                    ["doc_id", "cid", "check", "n_shingles", "values"],
                )

    return run


DIGEST = "doc_id long, cid long, check long, n_shingles long, values array<long>"


def union_estimate(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> tuple[float, int]:
    """Share of the k lowest values of the union of two sketches that both hold, and the number looked at."""
    low, counts = np.unique(np.concatenate([a[:k], b[:k]]), return_counts=True)
    m = min(k, len(low))
    return float((counts[:m] == 2).sum()) / max(m, 1), m


def _both_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sides = []
    for name in ("a_set", "b_set"):
        lists = batch.column(name)
        o = lists.offsets.to_numpy()
        sides.append((lists.flatten().to_numpy(zero_copy_only=False), o - o[0]))
    (av, ao), (bv, bo) = sides
    for i in range(batch.num_rows):
        yield i, av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]


def _verify(percent: int):
    """Pairs (a, b) with their sets to those of the given similarity."""
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, a, b in _both_sets(batch):
                guess, m = union_estimate(a, b)
                if max(len(a), len(b)) > SKETCH and guess < t - 6 * math.sqrt(t * (1 - t) / m):
                    continue
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(a) + len(b) - shared) > 0
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


STAR = "a long, b long, n long, linked boolean, low double, high double, diff array<long>"


def _to_hub(percent: int):
    """Members a and hubs b with their sets to the members' distances and, near the hub, differences.

    The union sketch of a pair estimates its distance first. Where that lies beyond NEAR by six standard errors, low and
    high are the estimate less and plus as much; all other pairs go on to the exact distance, and low equals high.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, linked, low, high, diffs, size = [], [], [], [], [], [0]
            for _, a, b in _both_sets(batch):
                n.append(len(a))
                diff = a[:0]
                if far := _far_apart(a, b):
                    linked.append(False)
                    low.append(far[0])
                    high.append(far[1])
                else:
                    both = np.concatenate([a, b])
                    both.sort()
                    twice = both[1:] == both[:-1]
                    shared = int(twice.sum())
                    union = len(both) - shared
                    linked.append(100 * shared >= percent * union > 0)
                    low.append(1 - shared / union)
                    high.append(low[-1])
                    if low[-1] <= NEAR:
                        once = np.ones(len(both), bool)
                        once[1:] &= ~twice
                        once[:-1] &= ~twice
                        diff = both[once]
                diffs.append(diff)
                size.append(size[-1] + len(diff))
            flat = np.concatenate(diffs) if diffs else np.zeros(0, np.int64)
            facts = ((n, pa.int64()), (linked, pa.bool_()), (low, pa.float64()), (high, pa.float64()))
            columns = [batch.column("a"), batch.column("b"), *(pa.array(x, t) for x, t in facts)]
            yield pa.RecordBatch.from_arrays(
                [*columns, K.list_array(flat, np.array(size), pa.int64())], ["a", "b", "n", "linked", "low", "high", "diff"]
            )

    return run


def _far_apart(a: np.ndarray, b: np.ndarray) -> tuple[float, float] | None:
    """Bounds of the distance of two sets whose union sketch places them beyond NEAR; None for all others."""
    if max(len(a), len(b)) <= SKETCH:
        return None  # the sketches are the sets
    guess, m = union_estimate(a, b)
    room = 6 * math.sqrt(max(guess * (1 - guess), 1 / m) / m)
    return (1 - guess - room, min(1.0, 1 - guess + room)) if 1 - guess - room > NEAR else None


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def side(x: str) -> DataFrame:
        return sets.join(pairs.select(F.col(x).alias("cid")).distinct(), "cid", "left_semi").select(
            F.col("cid").alias(x), F.col("values").alias(f"{x}_set")
        )

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of percent/100 or more.

    Returns one row per input row: doc_id, n_shingles, component_id, kept. Words are lower-cased (A-Z) runs
    of anything but white space; a document with fewer words than a shingle has its whole sequence as one
    shingle; null text or one without words has no shingle and links with nothing. component_id is the
    smallest id reachable. Rows with equal ids are rows of their own: they are linked only by their texts;
    a row with a null id takes part in links, is never kept and gives no component its id (the component_id
    of rows that reach no id is null). Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digests = scratch.written(source.mapInArrow(K.tidied(_digests(shingle, False)), DIGEST), "digests")
    classes = scratch.written(
        digests.where("n_shingles > 0").groupBy("cid", "check", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("values").alias("values")),
        "classes",
    )
    probes = classes.select("cid", F.explode("values").alias("value"))
    shared = scratch.written(probes.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value"), "shared")
    enough = probes.join(shared, "value", "left_semi").groupBy("cid").agg(F.count("*").alias("hits"))
    suspects = scratch.written(
        classes.join(enough, "cid").where(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.size("values") * PROBE_SHARED))).select("cid", "check", "copies", F.coalesce("rep", F.lit(NO_ID)).alias("rep")),
        "suspects",
    )
    scratch.drop(shared)
    # few suspects go to the texts; beyond the bound both sides are shuffled
    sized = F.broadcast if suspects.count() <= BROADCAST_ROWS else (lambda df: df)
    wanted = source.withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID))).join(
        sized(suspects.select("rep").distinct()), "rep", "left_semi"
    )
    full = wanted.select("doc_id", "text").mapInArrow(K.tidied(_digests(shingle, True)), DIGEST)
    sets = full.join(sized(suspects.select("cid", "check", "copies")), ["cid", "check"]).groupBy("cid", "check").agg(
        F.first("copies").alias("copies"), F.first("n_shingles").alias("n"), F.first("values").alias("values")
    )
    sets = scratch.written(sets.drop("check"), "sets")
    scratch.drop(suspects)

    t = percent / 100
    s, k = F.least("n", F.lit(SKETCH)), t * SKETCH
    must = F.when(F.col("n") <= int(k), F.ceil(F.col("n") * percent / F.lit(100))).otherwise(
        F.floor(F.least(F.lit(k - ERRORS * math.sqrt(t * (1 - t) * SKETCH)), F.lit(t) * s))
    )
    retained = sets.select("cid", "n", "copies", F.explode(F.slice("values", 1, SKETCH)).alias("value"))
    frequency = scratch.written(retained.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "frequency")
    # a value of one class alone ranks first and lists nothing: only how many there are counts
    ranked = retained.join(frequency, "value").groupBy("cid", "n", "copies").agg(
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("ranked")
    )
    alone = s - F.size("ranked")
    rare = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), s - must + 1 - alone).cast("int"))
    listed = ranked.select("cid", "n", "copies", F.transform(rare, lambda x: x["value"]).alias("rare"))
    listed = scratch.written(listed.where(F.size("rare") > 0), "listed")
    entries = listed.select("cid", "n", "copies", F.explode("rare").alias("value"))
    fits = lambda x, y: F.col(x) * 100 >= F.col(y) * percent
    hubs = scratch.written(
        entries.groupBy("value").agg(
            F.min(F.struct((-F.col("copies")).alias("c"), F.col("cid").alias("hub"), F.col("n").alias("hub_n"))).alias("h"),
            F.count("*").alias("k"),
        ).where("k > 1").select("value", "h.hub", "h.hub_n"),
        "hubs",
    )
    pairs = entries.join(hubs, "value").where(F.col("cid") != F.col("hub")).select(
        F.col("cid").alias("a"), F.col("hub").alias("b")
    ).distinct()
    pairs = scratch.written(pairs, "pairs")
    star = scratch.written(_with_sets(pairs, sets).mapInArrow(K.tidied(_to_hub(percent)), STAR), "star")
    scratch.drop(pairs)
    star_links = star.where("linked").select("a", "b")
    roots = scratch.written(components(star_links, scratch), "roots")
    rooted = lambda df, key: df.join(roots.select(F.col("node").alias(key), "root"), key, "left").withColumn("root", F.coalesce("root", key))
    near_hub = star.where(F.col("high") <= NEAR)
    # written, so that few hubs are known to be few and nothing is dealt by hub
    loose_hubs = scratch.written(near_hub.where(~F.col("linked")).select("b").distinct(), "loose-hubs")
    family = scratch.written(rooted(near_hub.join(loose_hubs, "b", "left_semi"), "a"), "family")
    # a family is dealt into blocks, and each pair of blocks is a key of its own
    sizes = scratch.written(family.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    blocked = family.join(sizes, "b").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def side(x: str, df: DataFrame) -> DataFrame:
        keys = ("own", "other") if x == "x" else ("other", "own")
        named = [F.col(k).alias(f"block{i}_{x}") for i, k in enumerate(keys)]
        return df.select(
            F.col("b").alias(f"hub_{x}"), *named, *(F.col(c).alias(f"{c}_{x}") for c in ("a", "n", "linked", "diff", "root"))
        )

    room = (F.col("n_x") + F.col("n_y")) * (100 - percent)
    apart = F.size("diff_x") + F.size("diff_y") - 2 * F.size(F.array_intersect("diff_x", "diff_y"))
    same = reduce(Column.__and__, (F.col(f"{k}_x") == F.col(f"{k}_y") for k in ("hub", "block0", "block1")))
    once = F.col("linked_y") | (F.col("a_x") < F.col("a_y"))
    alike = F.abs(F.size("diff_x") - F.size("diff_y")) * (100 + percent) <= room
    close = (F.col("root_x") != F.col("root_y")) & once & alike & (apart * (100 + percent) <= room)
    near = side("x", blocked.where(~F.col("linked"))).join(side("y", blocked), same & close)
    near_links = scratch.written(near.select(F.col("a_x").alias("a"), F.col("a_y").alias("b")), "near-links")
    scratch.drop(family, sizes, loose_hubs)
    # both far from the hub of their list; within the threshold of each other, so not far apart in that
    far = star.where(F.col("high") > NEAR - (1 - t)).select(F.col("a").alias("cid"), F.col("b").alias("hub"), "low", "high")
    far_entries = entries.select("cid", "n", "value").join(hubs.select("value", "hub"), "value").join(far, ["cid", "hub"])
    joined = rooted(far_entries, "cid").join(listed.select("cid", "rare"), "cid")
    joined = scratch.written(joined.select("cid", "n", "value", "low", "high", "root", "rare"), "joined")
    left = joined.select("value", *(F.col(x).alias(f"{x}_a") for x in ("cid", "n", "rare", "root", "low", "high")))
    right = joined.select("value", *(F.col(x).alias(f"{x}_b") for x in ("cid", "n", "rare", "root", "low", "high")))
    step = 1 - t + 1e-9
    near_enough = (F.col("low_a") - F.col("high_b") <= step) & (F.col("low_b") - F.col("high_a") <= step)
    lies = (F.greatest("high_a", "high_b") > NEAR) & near_enough
    listed_first = F.array_min(F.array_intersect("rare_a", "rare_b")) == left["value"]
    apart = (left["value"] == right["value"]) & (F.col("cid_a") < F.col("cid_b")) & (F.col("root_a") != F.col("root_b"))
    cross = left.join(right, apart & fits("n_a", "n_b") & fits("n_b", "n_a") & lies & listed_first)
    cross = scratch.written(cross.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct(), "cross")
    cross = _with_sets(cross, sets).mapInArrow(K.tidied(_verify(percent)), "a long, b long")
    cross_links = scratch.written(cross.unionByName(near_links), "cross-links")
    root_links = cross_links.unionByName(star_links)
    final = scratch.written(components(root_links, scratch), "components")
    scratch.drop(sets, frequency, listed, hubs, joined, roots, star, near_links, cross_links)

    member = classes.select("cid", "check", "rep").join(final.withColumnRenamed("node", "cid"), "cid", "left").select(
        "cid", "check", "rep", F.coalesce("root", "cid").alias("root")
    )
    member = scratch.written(member, "members")
    lowest = scratch.written(member.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    named = scratch.written(member.join(lowest, "root").select("cid", "check", "component_id"), "named")
    out = digests.select("doc_id", "cid", "check", "n_shingles").join(named, ["cid", "check"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns: one document of each component.

    Rows that repeat an id are kept or dropped together; of kept ones that are equal in all columns one stays (columns
    that hold maps can't be compared and count by their text as JSON). Rows with a null id can't be told apart and stay.
    Columns named _dedup_* in docs are refused. An empty table gives an empty table.
    """
    if clash := [c for c in docs.columns if c.startswith("_dedup_")]:
        raise ValueError(f"documents already have {clash}")
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = near_duplicates(docs, shingle, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    found = scratch.written(found, "found")
    own = docs["doc_id"].cast("long")
    dropped = scratch.written(
        found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("_dedup_id")), "dropped"
    )
    left = docs.join(dropped, own == dropped["_dedup_id"], "left_anti")
    many = found.where("doc_id is not null and kept and n > 1").select(F.col("doc_id").alias("_dedup_id"))
    if many.isEmpty():
        return left
    repeated = left.join(many, own == many["_dedup_id"], "left_semi")
    same = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    names = [f"_dedup_{i}" for i in range(len(same))]
    one = repeated.select("*", *(x.alias(n) for x, n in zip(same, names, strict=True))).dropDuplicates(names).drop(*names)
    return left.join(many, own == many["_dedup_id"], "left_anti").unionByName(one)
