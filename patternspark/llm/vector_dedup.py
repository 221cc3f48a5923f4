"""Embedding near-duplicates through a robust-pruned flat graph.

Vectors are dealt to the clusters of their nearest centres, several each and more of them the more centres there are,
so that neighbours share one. Every cluster shard builds a graph: candidates of a node (its nearest in the shard and
some at random) are pruned so that no kept edge is shadowed by a shorter one, and edges also go back. The adjacency
lists of a node are united over its shards. In each shard every vector is then searched for greedily from itself and
the shard's medoids; when the search has come near, it goes on through all neighbours of hits until it meets no more
of them. Hits are verified in double precision. A pair that several shards hold counts in the first of them only.

Centres grow with the data up to a bound in bytes; many are found in two steps, through the centres of cells of centres.
A shard that grows over a bound is cut into blocks, and every pair of blocks becomes a task of its own, so a group of a
third of all rows is split without losing a pair. Only counts and spanning links leave a task, never pairs.

The result is audited: links of a sample of vectors are counted by brute force over all rows. Where fewer than nine of
ten were found, the work is done again with vectors dealt to more centres, at last with one shard that holds all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import components
from .scratch import Scratch, bound_batches

#: Vectors that centres are fitted on and centres, at least and at most (the latter by their bytes, as doubles).
SAMPLE = 8192
SAMPLE_BYTES = 64 << 20
MOST_CENTRES = 65_536
CENTRE_BYTES = 32 << 20
#: Beyond so many centres they lie in cells.
FLAT = 4096
SHARD_ROWS = 2500
BLOCK_ROWS = 3000
OVERLAP = 4
DEGREE = 24
NEAREST = 48
RANDOM_EDGES = 8
ALPHA = 1.2
MEDOIDS = 24
BEAM = 16
MARGIN = 0.06
#: Vectors that are audited, the recall that is asked for, and times the usual number of centres that a vector goes to.
AUDITED = 200
LEAST_RECALL = 0.9
SPREADS = (1, 2, 4)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, class id and unit vector (doubles) of each row; an unusable vector has neither."""
    for batch in batches:
        keys, units = [], []
        for x in batch.column(1).to_pylist():
            v = np.array(x, float) if x is not None and None not in x else np.zeros(0)
            with np.errstate(over="ignore"):
                top = np.abs(v).max() if len(v) else 0.0
            if not len(v) or not np.isfinite(v).all() or top == 0:
                keys.append(None)
                units.append(None)
                continue
            v = v / top
            v = np.trim_zeros(v / np.sqrt((v * v).sum()), "b")
            units.append(v.tobytes())
            keys.append(int(K.polynomial(K.mix(v.view(np.uint64)), np.array([0]), np.array([len(v)])).view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.int64()), pa.array(units, pa.binary())], ["vec_id", "cid", "unit"]
        )


def _stack(units: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(units), dims))
    for i, u in enumerate(units):
        out[i, : len(u) // 8] = np.frombuffer(u)
    return out


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    rng = np.random.default_rng(11)
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                s = sample[own == j].sum(0)
                c[j] = s / max(np.linalg.norm(s), 1e-12)
    return c


def overlap(k: int, spread: int = 1) -> int:
    """Centres that a vector is dealt to, of k: enough that of random pairs at a cosine of 0.9 fewer than 1e-4 share none."""
    return min(k, spread * max(OVERLAP, math.ceil(1.25 * math.log2(max(1, k)))))


def centres_for(n: int, dims: int, spread: int = 1) -> int:
    """Centres for n vectors, so that a shard holds about SHARD_ROWS of their copies."""
    k, most = 0, min(MOST_CENTRES, max(FLAT, CENTRE_BYTES // (8 * max(dims, 1))))
    while (more := min(most, max(1, math.ceil(n * spread * max(OVERLAP, overlap(k)) / SHARD_ROWS)))) > k:
        k = more
    return k


class Centres:
    """k centres of a sample; many are kept in cells, of which only the nearest are looked at."""

    def __init__(self, sample: np.ndarray, k: int):
        self.tops = None
        if k <= FLAT:
            self.all = centres(sample, k)
            return
        tops = centres(sample, math.isqrt(k), 4)
        own = np.argmax(sample @ tops.T, axis=1)
        some = np.unique(own)
        self.tops = tops[some]
        parts = [sample[own == j] for j in some]
        found = [centres(x, max(1, round(k * len(x) / len(sample))), 4) for x in parts]
        self.off = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        self.all = np.concatenate(found)

    def __len__(self) -> int:
        return len(self.all)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """n centres of every row, in order of their numbers."""
        if self.tops is None:
            return np.sort(np.argsort(-(x @ self.all.T), axis=1, kind="stable")[:, :n], axis=1)
        cells = np.argsort(-(x @ self.tops.T), axis=1, kind="stable")[:, : 2 * n]
        ids, score = np.zeros((*cells.shape, n), np.int64), np.full((*cells.shape, n), -3.0)
        for j in np.unique(cells):
            row, slot = np.nonzero(cells == j)
            near = x[row] @ self.all[self.off[j] : self.off[j + 1]].T
            top = np.argsort(-near, axis=1, kind="stable")[:, :n]
            ids[row, slot, : top.shape[1]] = self.off[j] + top
            score[row, slot, : top.shape[1]] = np.take_along_axis(near, top, 1)
        ids, score = ids.reshape(len(x), -1), score.reshape(len(x), -1)
        return np.sort(np.take_along_axis(ids, np.argsort(-score, axis=1, kind="stable")[:, :n], 1), axis=1)


def _dealt(c: Centres, dims: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                near = c.nearest(_stack(part.column("unit").to_pylist(), dims), n)
                homes = pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("copies"), part.column("unit"), homes], ["cid", "copies", "unit", "homes"]
                )

    return run


def robust_prune(
    x: np.ndarray, here: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA
) -> np.ndarray:
    """Kept candidates of the nodes `here`, -1 where none: nearest first, each kept one hiding what it is nearer to."""
    m, n = candidates.shape
    far = lambda s: np.sqrt(np.maximum(2 - 2 * s, 0))
    own = far(np.einsum("ijk,ik->ij", x[candidates], x[here]))
    alive = candidates != here[:, None]
    out = np.full((m, degree), -1, np.int32)
    rows = np.arange(m)
    for r in range(degree):
        best = np.argmin(np.where(alive, own, np.inf), axis=1)
        got = alive[rows, best]
        if not got.any():
            break
        chosen = candidates[rows, best]
        out[got, r] = chosen[got]
        between = far(np.einsum("ijk,ik->ij", x[candidates], x[chosen]))
        alive &= ~(alpha * between <= own) & (candidates != chosen[:, None])
    return out


def build_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adjacency lists of a shard."""
    m = len(x)
    if m < 2:
        return [np.zeros(0, np.int64) for _ in range(m)]
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    n = min(NEAREST, m - 1)
    kept = np.full((m, DEGREE), -1, np.int32)
    for a in range(0, m, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = np.argpartition(-s, n - 1, axis=1)[:, :n]
        near = np.concatenate([near, rng.integers(0, m, (len(s), RANDOM_EDGES))], axis=1)
        here = np.arange(a, a + len(s))
        kept[here] = robust_prune(x, here, near)
    src, slot = np.nonzero(kept >= 0)
    dst = kept[src, slot]
    both = np.unique(np.concatenate([src * m + dst, dst.astype(np.int64) * m + src]))
    both = both[both // m != both % m]
    return np.split(both % m, np.searchsorted(both // m, np.arange(1, m)))


class Search:
    """Batched search of a shard's graph."""

    def __init__(self, x: np.ndarray, lists: list[np.ndarray]):
        self.x, self.single, m = x, x.astype(np.float32), len(x)
        size = np.array([len(a) for a in lists])
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.flat = np.concatenate(lists).astype(np.int64) if m else np.zeros(0, np.int64)
        # medoids: the members nearest to the centres of a small k-means
        c = centres(x[np.random.default_rng(5).permutation(m)[:1024]], min(MEDOIDS, m), 3)
        self.medoids = np.unique(np.argmax(self.single @ c.astype(np.float32).T, axis=0))

    def _neighbours(self, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.off[node + 1] - self.off[node]
        first = np.concatenate([[0], np.cumsum(n)])
        return np.repeat(q, n), self.flat[np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(self.off[node], n)]

    def hits(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) with a cosine of `least` or more that the search meets."""
        m, k = len(self.x), len(queries)
        sim = np.full((k, m), -2.0, np.float32)  # -2: not visited
        rows = np.arange(k)

        def visit(q: np.ndarray, node: np.ndarray) -> np.ndarray:
            new = np.unique(q * m + node)
            new = new[sim.ravel()[new] == -2]
            for a in range(0, len(new), 200_000):
                part = new[a : a + 200_000]
                sim.ravel()[part] = np.einsum("ij,ij->i", self.single[queries[part // m]], self.single[part % m])
            return new

        visit(np.repeat(rows, len(self.medoids)), np.tile(self.medoids, k))
        visit(rows, queries)
        opened = np.zeros((k, m), bool)
        for _ in range(2 * BEAM):
            # the best node that isn't opened, if it is one of the BEAM best
            score = np.where(opened, np.float32(-3), sim)
            best = np.argmax(score, axis=1)
            top = score[rows, best]
            go = np.flatnonzero((top > -2) & ((sim > top[:, None]).sum(1) < BEAM))
            if not len(go):
                break
            node = best[go]
            opened[go, node] = True
            visit(*self._neighbours(go, node))
        # the range grows: every neighbour of what lies near is looked at, until nothing new lies near
        grow = np.flatnonzero((sim >= least - MARGIN).ravel())
        while len(grow):
            opened.ravel()[grow] = True
            new = visit(*self._neighbours(grow // m, grow % m))
            grow = new[sim.ravel()[new] >= least - MARGIN]
        q, node = np.nonzero(sim >= least - 1e-4)
        exact = np.concatenate(
            [
                np.einsum("ij,ij->i", self.x[queries[q[a : a + 200_000]]], self.x[node[a : a + 200_000]])
                for a in range(0, len(q), 200_000)
            ]
        ) if len(q) else np.zeros(0)
        ok = (exact >= least) & (queries[q] != node)
        return q[ok], node[ok]


def _members(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(table.column("cid").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    homes = table.column("homes").to_pylist()
    wide = max(map(len, homes))
    return table.column("cid").to_numpy(), table.column("copies").to_numpy(), _stack(
        table.column("unit").to_pylist(), dims
    ), np.array([h + [-1] * (wide - len(h)) for h in homes])


def _build(dims: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cid, _, x, _ = _members(table, dims)
        lists = build_graph(x, int(key[0].as_py()) + 1)
        return pa.Table.from_pydict({"cid": cid, "near": pa.array([cid[a].tolist() for a in lists], pa.list_(pa.int64()))})

    return run


def _search(dims: int, least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        centre, i, j = (k.as_py() for k in key)
        order = np.argsort(table.column("cid").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        cid, copies, x, homes = _members(table, dims)
        block = table.column("block").to_numpy()
        lists = []
        for a in table.column("near").to_pylist():
            near = np.array(a or [], np.int64)
            at = np.minimum(np.searchsorted(cid, near), len(cid) - 1)
            lists.append(np.unique(at[cid[at] == near]))
        search = Search(x, lists)
        links, parent = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for a in range(0, len(cid), 256):
            queries = np.arange(a, min(a + 256, len(cid)))
            q, node = search.hits(queries, least)
            q = queries[q]
            if i != j:
                cross = block[q] != block[node]
                q, node = q[cross], node[cross]
            shared = np.full(len(q), 1 << 30)
            for h in range(homes.shape[1]):
                mine = homes[q, h]
                common = (homes[node] == mine[:, None]).any(axis=1) & (mine >= 0)
                shared = np.where(common, np.minimum(shared, np.where(mine >= 0, mine, 1 << 30)), shared)
            first = shared == centre
            np.add.at(links, q[first], copies[node[first]])
            for u, v in zip(q.tolist(), node.tolist(), strict=True):
                if parent[u] != parent[v] or u == v:
                    while parent[u] != u:
                        parent[u] = parent[parent[u]]
                        u = parent[u]
                    while parent[v] != v:
                        parent[v] = parent[parent[v]]
                        v = parent[v]
                    if u != v:
                        parent[max(u, v)] = min(u, v)
        for u in range(len(parent)):
            parent[u] = parent[parent[u]]
        some = np.flatnonzero((links > 0) | (parent != np.arange(len(parent))))
        return pa.Table.from_pydict({"cid": cid[some], "links": links[some], "to": cid[parent[some]]})

    return run


def _unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(K.tidied(_read), "vec_id long, cid long, unit binary")


def _linked(classes: DataFrame, c: Centres, dims: int, near: int, least: float, scratch: Scratch) -> DataFrame:
    """cid, n_links, component_id of every class of equal vectors."""
    dealt = classes.select("cid", "copies", "unit").mapInArrow(
        K.tidied(_dealt(c, dims, near)), "cid long, copies long, unit binary, homes array<int>"
    )
    dealt = scratch.written(dealt, "dealt")
    each = dealt.withColumn("home", F.explode("homes"))
    # one row for each centre
    sizes = scratch.written(
        each.groupBy("home").count().select("home", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "sizes"
    )
    members = each.join(F.broadcast(sizes), "home").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = (F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    members = scratch.written(members.select("home", *pair, "block", "cid", "copies", "unit", "homes"), "members")
    lists = members.groupBy("home", "i", "j").applyInArrow(_build(dims), "cid long, near array<long>")
    graph = scratch.written(lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    found = members.join(graph, "cid").groupBy("home", "i", "j").applyInArrow(
        _search(dims, least), "cid long, links long, to long"
    )
    found = scratch.written(found, "found")
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = scratch.written(components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")), scratch), "roots")
    named = classes.select("cid", "rep", "copies").join(linked, "cid", "left").join(
        roots.withColumnRenamed("node", "cid"), "cid", "left"
    )
    links = F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1
    named = scratch.written(named.select("cid", "rep", links.alias("n_links"), F.coalesce("root", "cid").alias("root")), "named")
    lowest = scratch.written(named.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    scratch.drop(dealt, members, graph, found, roots)
    return scratch.written(named.join(lowest, "root").select("cid", "n_links", "component_id"), "final")


def similar_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, reached, recall for every row, by cosine of `least` or more.

    A vector that is null, zero, empty or holds null or non-finite components links with nothing and is its own
    component. Shorter vectors count as padded with zeros. Equal vectors are compared once and link with each
    other. Rows with equal ids are rows of their own; a row with a null id takes part in links, is never kept and
    gives no component its id. reached: whether the vector had a link. recall: of the audit, the same in every row;
    RuntimeError where it stays under LEAST_RECALL even in one shard. Other columns are ignored. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "vectors")
    rows = scratch.written(_unit_rows(vectors, id_col, vector_col), "rows")
    usable = rows.where("cid is not null")
    classes = usable.groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = scratch.written(classes, "classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("b")).first()
    n, dims = facts["n"], (facts["b"] or 0) // 8
    lone = F.lit(0).cast("long")
    if not n:
        none = (lone.alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
        return rows.select("vec_id", *none, F.lit(False).alias("reached"), F.lit(1.0).alias("recall"))
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    links, recall = F.coalesce("n_links", lone), 0.0
    for spread in (*SPREADS, 0):
        k = centres_for(n, dims, spread) if spread else 1
        size = min(max(SAMPLE, 4 * k), max(k, SAMPLE_BYTES // (8 * dims)))
        drawn = classes.where(F.pmod(F.xxhash64("cid"), F.lit(max(1, n // size))) == 0).select("unit").limit(2 * size).collect()
        c = Centres(_stack(sorted(bytes(r["unit"]) for r in drawn) or [b""], dims), k)
        final = _linked(classes, c, dims, overlap(len(c), max(spread, 1)), least, scratch)
        out = rows.select("vec_id", "cid").join(final, "cid", "left")
        kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
        out = out.select(
            "vec_id", links.alias("n_links"), component.alias("component_id"), kept.alias("kept"), (links > 0).alias("reached")
        )
        recall = _recall(usable, out, AUDITED, least)
        if recall >= LEAST_RECALL:
            return out.withColumn("recall", F.lit(recall))
        if len(c) == 1:
            break
    raise RuntimeError(f"the search finds {recall:.2f} of the links")


def _recall(rows: DataFrame, result: DataFrame, queries: int, least: float) -> float:
    """Share of the links of a sample of vectors that a result counts; 1.0 without links. rows: vec_id, cid, unit."""
    asked = rows.where("vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    if not asked:
        return 1.0
    dims = max(len(r["unit"]) // 8 for r in asked)
    q, ids = _stack([bytes(r["unit"]) for r in asked], dims), [r["vec_id"] for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack([u[: 8 * dims] for u in batch.column("unit").to_pylist()], dims)
            n = pa.array((x @ q.T >= least).sum(0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), n], ["vec_id", "n"])

    counted = rows.mapInArrow(K.tidied(run), "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    true = {r["vec_id"]: r["n"] for r in counted.collect()}
    # an id that repeats is asked for once each
    true = {k: x // ids.count(k) - 1 for k, x in true.items()}
    got = {r["vec_id"]: r["n_links"] for r in result.where(F.col("vec_id").isin(ids)).select("vec_id", "n_links").collect()}
    total = sum(true.values())
    return sum(min(got[k], x) for k, x in true.items()) / total if total else 1.0


def audit(
    vectors: DataFrame,
    result: DataFrame,
    queries: int = AUDITED,
    least: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> float:
    """Recall of links of a bounded sample of vectors, against brute force over all rows; 1.0 without links."""
    bound_batches(vectors.sparkSession)
    return _recall(_unit_rows(vectors, id_col, vector_col).where("cid is not null"), result, queries, least)
