"""Quality classifier on random-indexing vectors.

Every word is two symbols: its letters (lower-cased, hashed into 32,768 buckets) and its shape (runs of upper case, lower
case, digits and marks, and whether the word repeats one of the two before it; 4096 buckets). A symbol's index vector is
sparse and random; its context vector adds up the index vectors of the symbols of its kind on both sides of it, over the
whole corpus: words by their neighbouring words, shapes by neighbouring shapes. A document is the mean of its words'
vectors (own random signs plus normalised context), and a two-layer network in numpy, fitted on a bounded sample of
labelled rows (TRAIN_ROWS, of lowest id hash), turns it into a probability; a temperature fitted on rows set aside
calibrates it. All tables that go to the executors have a fixed size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import Scratch, bound_batches

WORD_BUCKETS, WORD_DIMS = 32_768, 24
SHAPE_BUCKETS, SHAPE_DIMS = 4096, 64
FEATURES = WORD_DIMS + SHAPE_DIMS + 2
#: Labelled rows that the network is fitted on, at most.
TRAIN_ROWS = 20_000
HIDDEN = 32
SLICES = 64

_kind = np.zeros(256, np.uint64)
_b = np.arange(256)
_kind[:] = 8 + _b
_kind[(_b >= 65) & (_b <= 90)] = 1
_kind[((_b >= 97) & (_b <= 122)) | (_b >= 128)] = 2
_kind[(_b >= 48) & (_b <= 57)] = 3


def symbols(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape bucket of every word of a chunk."""
    word = (w.hash >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    if not len(word):
        return word, word
    kind = _kind[w.raw]
    new = np.empty(len(kind), bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    run = np.flatnonzero(new)
    long_mark = (np.diff(np.append(run, len(kind))) > 1) & (kind[run] >= 8)
    first = np.searchsorted(run, w.start)
    last = np.minimum(first + 4, np.searchsorted(run, w.end))
    shape = K.polynomial(K.mix(kind[run] + np.uint64(512) * long_mark), first, last)
    doc = w.doc
    again = np.zeros(len(word), bool)
    for back in (1, 2):
        again[back:] |= (w.hash[back:] == w.hash[:-back]) & (doc[back:] == doc[:-back])
    shape = K.mix(shape + np.uint64(0xABCDEF) * again)
    return word, (shape >> np.uint64(40)).astype(np.int64) % SHAPE_BUCKETS


def index_vectors(buckets: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places and two signs of the index vector of every symbol of a kind."""
    rng = np.random.default_rng(20240 + dims)
    return rng.integers(0, dims, (buckets, 2)), rng.choice([-1.0, 1.0], (buckets, 2))


KINDS = ((WORD_BUCKETS, WORD_DIMS), (SHAPE_BUCKETS, SHAPE_DIMS))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = [np.zeros(buckets * dims) for buckets, dims in KINDS]
    index = [index_vectors(*kind) for kind in KINDS]
    for batch in batches:
        for _, _, raw, offs in K.chunks(batch.column(0)):
            w = K.Words(raw, offs)
            doc = w.doc
            same = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, np.int64)
            for total, (_, dims), (places, signs), own in zip(sums, KINDS, index, symbols(w), strict=True):
                for a, b in ((same, same + 1), (same + 1, same)):
                    for k in (0, 1):
                        np.add.at(total, own[a] * dims + places[own[b], k], signs[own[b], k])
    both = np.concatenate(sums).astype(np.float32).reshape(SLICES, -1)
    part = TaskContext.get().partitionId()
    columns = [pa.array(np.full(SLICES, part)), pa.array(np.arange(SLICES)), pa.array([x.tobytes() for x in both], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["part", "slice", "sums"])


SUMS = "part long, slice long, sums binary"


def _add_up(table: pa.Table) -> pa.Table:
    total = 0.0
    for x in table.column("sums").to_pylist():
        total = total + np.frombuffer(x, np.float32).astype(float)
    keys = {k: pa.array([table.column(k)[0].as_py()], pa.int64()) for k in ("part", "slice")}
    return pa.Table.from_pydict({**keys, "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def context_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all words' and shapes' buckets, from the contexts of the whole corpus."""
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(K.tidied(_contexts), SUMS)
    # two steps, so that no group grows with more than the square root of the partitions
    fan = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    some = sums.withColumn("part", F.col("part") % fan).groupBy("part", "slice").applyInArrow(_add_up, SUMS)
    rows = some.groupBy("slice").applyInArrow(_add_up, SUMS).collect()  # SLICES rows of fixed size
    sizes = [buckets * dims for buckets, dims in KINDS]
    flat = np.zeros((SLICES, sum(sizes) // SLICES))
    for r in rows:
        flat[r["slice"]] = np.frombuffer(bytes(r["sums"]), np.float32)
    out = []
    for k, part in enumerate(np.split(flat.ravel(), sizes[:1])):
        m = part.reshape(KINDS[k])
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        own = np.random.default_rng(777 + k).choice([-1.0, 1.0], KINDS[k]) / math.sqrt(KINDS[k][1])
        out.append((own + m).astype(np.float32))
    return out[0], out[1]


def _pooled(word_vectors: np.ndarray, shape_vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in K.chunks(batch.column(1)):
                w = K.Words(raw, offs)
                word, shape = symbols(w)
                n = np.diff(w.off)
                out = np.zeros((b - a, FEATURES), np.float32)
                full = np.flatnonzero(n)
                if len(full):
                    out[full, :WORD_DIMS] = np.add.reduceat(word_vectors[word], w.off[full], axis=0)
                    out[full, WORD_DIMS:-2] = np.add.reduceat(shape_vectors[shape], w.off[full], axis=0)
                    out[full] /= n[full, None]
                out[:, -2] = np.log1p(n)
                out[:, -1] = np.log1p(np.diff(offs)) - np.log1p(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([x.tobytes() for x in out], pa.binary())], ["doc_id", "vector"]
                )

    return run


class Network:
    """Two layers, fitted by Adam, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60, rate: float = 0.004, decay: float = 1e-4):
        rng = np.random.default_rng(seed)
        self.prior = (y.sum() + 1.0) / (len(y) + 2.0)
        self.shift, self.scale, self.temperature = np.zeros(x.shape[1]), np.ones(x.shape[1]), 1.0
        self.weights: list[np.ndarray] = []
        if len(y) < 20 or y.min() == y.max():
            return
        aside = rng.random(len(y)) < 0.2
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.shift) / self.scale
        d = z.shape[1]
        p = [
            rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 1)),
            np.zeros(1),
        ]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        tz, ty = z[~aside], y[~aside].astype(float)[:, None]
        for epoch in range(epochs):
            order = rng.permutation(len(ty))
            for a in range(0, len(order), 256):
                xb, yb = tz[order[a : a + 256]], ty[order[a : a + 256]]
                h = np.maximum(xb @ p[0] + p[1], 0)
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yb) / len(yb)
                back = (g @ p[2].T) * (h > 0)
                grads = [xb.T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], g.sum(0)]
                t += 1
                step = rate * (1 - epoch / epochs)
                for k, q in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    p[k] = p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.weights = p
        s, label = self._logit(x[aside]), y[aside].astype(float)
        grid = np.exp(np.linspace(math.log(0.3), math.log(6), 120))
        if len(label):
            loss = [np.mean(np.logaddexp(0, s / g) - label * s / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        return (np.maximum(z @ self.weights[0] + self.weights[1], 0) @ self.weights[2] + self.weights[3])[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1; the prior where too few labels were given."""
        if not self.weights:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -40, 40)))


SCORES = "doc_id long, held_out boolean, score double"


def held_out(ids: list[int | None], mod: int, rest: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(("" if x is None else str(x)).encode()) % mod == rest for x in ids), bool, len(ids))


def _scoring(net: Network, mod: int, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(held_out(batch.column("doc_id").to_pylist(), mod, rest)),
                    pa.array(net.probability(x)),
                ],
                ["doc_id", "held_out", "score"],
            )

    return run


def labelled_sample(
    labels: DataFrame, mod: int = 4, rest: int = 2, label_col: str = "quality", most: int = TRAIN_ROWS
) -> DataFrame:
    """doc_id, y of labelled ids outside the held-out part: all, or the `most` of lowest id hash.

    Labels other than 0 and 1 count for nothing; of several labels of an id the lowest counts.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        "y in (0, 1) and doc_id is not null"
    ).where(key % mod != rest)
    return known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(vectors: DataFrame, sample: DataFrame, most: int = TRAIN_ROWS) -> Network:
    """Fit on the vectors of a labelled sample."""
    rows = sorted(
        (r["doc_id"], bytes(r["vector"]), r["y"])
        for r in vectors.join(F.broadcast(sample), "doc_id").select("doc_id", "vector", "y").orderBy(
            F.xxhash64("doc_id"), "doc_id"
        ).limit(most).collect()
    )
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, FEATURES).astype(float)
    return Network(x, np.array([r[2] for r in rows], int))


def scores(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) of every row, from its whole text alone.

    Null and empty texts have a vector of their own (no words) and a score; a null id is never a label's; repeated
    rows are scored each; without usable labels every score is the prior. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    word_vectors, shape_vectors = context_vectors(docs)
    pooled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        K.tidied(_pooled(word_vectors, shape_vectors)), "doc_id long, vector binary"
    )
    pooled = scratch.written(pooled, "vectors")
    return pooled.mapInArrow(K.tidied(_scoring(train(pooled, labelled_sample(labels, mod, rest, label_col)), mod, rest)), SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of docs with a score of `least` or more, with all their columns; one pass, no shuffle of texts."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    word_vectors, shape_vectors = context_vectors(docs)
    pool = _pooled(word_vectors, shape_vectors)
    sample = scratch.written(labelled_sample(labels), "sample")
    # no more than TRAIN_ROWS ids
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"
    )
    net = train(scratch.written(labelled.mapInArrow(K.tidied(pool), "doc_id long, vector binary"), "vectors"), sample)
    at = (docs.columns.index("doc_id"), docs.columns.index("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays([batch.column(at[0]), batch.column(at[1])], ["doc_id", "text"])
            got = [x for b in pool(iter([part])) for x in b.column("vector").to_pylist()]
            x = np.frombuffer(b"".join(got), np.float32).reshape(-1, FEATURES).astype(float)
            yield batch.filter(pa.array(net.probability(x) >= least))

    return docs.mapInArrow(K.tidied(run), docs.schema)
