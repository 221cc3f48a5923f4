"""Benchmark decontamination by SimHash over item-sized windows.

For every length that items have, windows of that many shingles slide over a document. A window that holds too few
shingles of items of its length to reach the similarity is passed over (this loses nothing). The others get a 256-bit
SimHash in which each shingle weighs as often as it occurs. Sixteen 16-bit blocks index the items' fingerprints: two
fingerprints within 62 bits differ by at most 3 bits in some block. Every item is listed under all keys within 1 bit of
its own, and a window looks up all keys within 2 bits of its own, so some lookup of some block meets. Exact weighted
similarity (sum of smaller counts over sum of larger counts) then verifies each candidate.

At a similarity of 0.8 a fingerprint bit differs with a chance of 0.152, 39 of 256 bits on average with a standard
deviation of 5.7; 62 bits are four of them above.

Items go out in slices of a bounded size. With more than one slice, one pass over the documents first writes those that
hold enough shingles of any item at all, by a Bloom filter of a fixed size, and the slices read only these.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import Scratch, bound_batches

BLOCKS = 16
RADIUS = 62
LANES = 4
#: Bytes and items that go to the executors at once; a larger benchmark is worked off in slices.
SLICE_BYTES = 16 << 20
SLICE_ITEMS = 20_000
#: Bits in which a block may differ: those that items are listed with and those that windows are looked up with.
LISTED, ASKED = 1, 2
#: Windows that are looked up at once, and bits of the Bloom filter of all items' shingles.
ROWS = 4096
BLOOM_BITS = 1 << 27

_SEEDS = K.mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _masks(most: int) -> np.ndarray:
    """All 16-bit numbers of up to `most` set bits."""
    chosen = (c for r in range(most + 1) for c in itertools.combinations(range(16), r))
    return np.array(sorted(sum(1 << i for i in c) for c in chosen), np.uint16)


_LISTED, _ASKED = _masks(LISTED), _masks(ASKED)


def fingerprints(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash (rows of 16 16-bit blocks) of the runs h[starts:ends]."""
    out = np.zeros((len(starts), BLOCKS), np.uint16)
    for a in range(0, len(starts), ROWS):
        s, n = starts[a : a + ROWS], (ends - starts)[a : a + ROWS]
        first = np.concatenate([[0], np.cumsum(n)])
        flat = h[np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(s, n)]
        for lane, seed in enumerate(_SEEDS):
            bits = np.unpackbits(K.mix(flat ^ seed).view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, first[:-1], axis=0, dtype=np.int32)
            packed = np.packbits(2 * ones > n[:, None], axis=1)
            out[a : a + ROWS, 4 * lane : 4 * lane + 4] = packed.view(np.uint16)
    return out


class Items:
    """Items of a benchmark: shingles, fingerprints, block index."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int):
        words = [K.shingles(K.Words(raw, offs), shingle)[:2] + (a,) for a, _, raw, offs in K.chunks(pa.array(texts, pa.string()))]
        h = np.concatenate([x[0] for x in words]) if words else np.zeros(0, np.uint64)
        doc = np.concatenate([x[1] + x[2] for x in words]) if words else np.zeros(0, np.int64)
        off = np.searchsorted(doc, np.arange(len(texts) + 1))
        some = np.flatnonzero(np.diff(off))
        self.ids = np.array(ids, np.int64)[some]
        self.start, self.end, self.h = off[some], off[some + 1], h
        self.size = self.end - self.start
        self.sizes = np.unique(self.size)
        self.vocabulary, word = np.unique(h, return_inverse=True)
        # a bit for every shingle and size: whether an item of that size holds the shingle
        of = np.searchsorted(self.sizes, np.repeat(self.size, self.size))
        self.bits = np.zeros((len(self.vocabulary), len(self.sizes) // 8 + 1), np.uint8)
        np.bitwise_or.at(self.bits, (word, of >> 3), (1 << (of & 7)).astype(np.uint8))
        self.prints = fingerprints(h, self.start, self.end)
        self.counts = [np.unique(h[a:b], return_counts=True) for a, b in zip(self.start, self.end, strict=True)]
        self.index = []
        for b in range(BLOCKS):
            keys = (self.prints[:, b][:, None] ^ _LISTED[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            self.index.append(
                (np.searchsorted(keys[order], np.arange(65537)).astype(np.int32), (order // len(_LISTED)).astype(np.int32))
            )

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) within the radius."""
        out = [self._near(prints[a : a + ROWS], a) for a in range(0, len(prints), ROWS)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def _near(self, prints: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        found, items = [np.zeros(0, np.int64)], max(len(self.ids), 1)
        for b, (off, item) in enumerate(self.index):
            key = (prints[:, b][:, None] ^ _ASKED[None, :]).astype(np.int64).ravel()
            n = off[key + 1] - off[key]
            some = np.flatnonzero(n)
            key, n = key[some], n[some]
            first = np.concatenate([[0], np.cumsum(n)])
            which = np.repeat(some // len(_ASKED), n)
            place = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(off[key], n)
            found.append(np.unique(which * items + item[place]))
        pair = np.unique(np.concatenate(found))
        w, i = pair // items, pair % items
        close = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1) <= RADIUS
        return w[close] + at, i[close]

    def similarity(self, h: np.ndarray, item: int) -> float:
        values, counts = np.unique(h, return_counts=True)
        own, own_counts = self.counts[item]
        at = np.searchsorted(own, values)
        ok = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == values)
        shared = int(np.minimum(counts[ok], own_counts[at[ok]]).sum())
        return shared / (len(h) + int(own_counts.sum()) - shared)

    def _windows(self, k: int, found: np.ndarray, off: np.ndarray, spot: np.ndarray, least: float) -> tuple[
        np.ndarray, np.ndarray, np.ndarray
    ]:
        """Starts, ends and sizes of the windows of the k-th size that hold enough shingles of items of that size.

        found: places of shingles of any item; spot: their places in the vocabulary; off: where documents begin.
        """
        size = int(self.sizes[k])
        mine = found[(self.bits[spot, k >> 3] >> (k & 7) & 1).astype(bool)]
        docs = np.unique(np.searchsorted(off, mine, "right") - 1)
        windows = np.maximum(off[docs + 1] - off[docs] - size + 1, 1)
        first = np.concatenate([[0], np.cumsum(windows)])
        starts = np.arange(first[-1]) - np.repeat(first[:-1], windows) + np.repeat(off[docs], windows)
        ends = np.minimum(starts + size, np.repeat(off[docs + 1], windows))
        held = np.searchsorted(mine, ends) - np.searchsorted(mine, starts)
        # shared / (window + item - shared) reaches the similarity only with so many shared
        full = held * (1 + least) >= least * (ends - starts + size) - 1e-9
        return starts[full], ends[full], np.full(int(full.sum()), size)

    def matches(self, raw: np.ndarray, offs: np.ndarray, shingle: int, least: float) -> Iterator[
        tuple[int, int, int, int, float]
    ]:
        """(document, item, first word, words, similarity), the best window of each pair, of a chunk."""
        words = K.Words(raw, offs)
        h, doc, at = K.shingles(words, shingle)
        if not len(h) or not len(self.vocabulary):
            return
        spot = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        found = np.flatnonzero(self.vocabulary[spot] == h)
        if not len(found):
            return
        off = np.searchsorted(doc, np.arange(len(offs)))
        windows = [self._windows(k, found, off, spot[found], least) for k in range(len(self.sizes))]
        starts, ends, sizes = (np.concatenate(x) for x in zip(*windows, strict=True))
        w, i = self.near(fingerprints(h, starts, ends))
        same = self.size[i] == sizes[w]
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, item in zip(w[same].tolist(), i[same].tolist(), strict=True):
            score = self.similarity(h[starts[a] : ends[a]], item)
            key = (int(doc[starts[a]]), item)
            if score >= least and score > best.get(key, (0.0,))[0]:
                n_words = int(min(at[ends[a] - 1] + shingle, words.off[key[0] + 1]) - at[starts[a]])
                best[key] = (score, int(at[starts[a]] - words.off[key[0]]), n_words)
        for (d, item), (score, word, n) in sorted(best.items()):
            yield d, item, word, n, score


class Touched:
    """Documents that may hold an item: those with enough shingles of any item, by a Bloom filter."""

    def __init__(self, shingle: int, least: float):
        self.bits, self.shingle, self.least, self.size = np.zeros(BLOOM_BITS // 8, np.uint8), shingle, least, 1 << 62

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(s)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for s in (0, 32)]

    def add(self, items: Items) -> None:
        for at in self._places(items.vocabulary):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.size = min(self.size, int(items.size.min(initial=1 << 62)))

    def rows(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), bool)
        for a, b, raw, offs in K.chunks(column):
            h, doc, _ = K.shingles(K.Words(raw, offs), self.shingle)
            hit = np.ones(len(h), bool)
            for at in self._places(h):
                hit &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
            n = np.bincount(doc[hit], minlength=b - a)
            out[a:b] = (n > 0) & (n >= self.least * self.size)
        return out


def _plain(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    return rows.where("item_id is not null and text is not null")


def _slices(benchmark: DataFrame, shingle: int) -> tuple[int, Iterator[Items]]:
    """The number of slices, and the slices one after another."""
    rows = _plain(benchmark)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    slices = max(-(-total["n"] // SLICE_ITEMS), -(-total["b"] // SLICE_BYTES), 1)

    def each() -> Iterator[Items]:
        for k in range(slices):
            got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()  # about a slice
            got.sort(key=lambda r: (r["item_id"], r["text"]))
            yield Items([r["item_id"] for r in got], [r["text"] for r in got], shingle)

    return slices, each()


def _touched(benchmark: DataFrame, shingle: int, least: float) -> Touched:
    filter_ = Touched(shingle, least)
    for items in _slices(benchmark, shingle)[1]:
        filter_.add(items)
    return filter_


def _chosen(docs: DataFrame, touched: Touched, keep: bool) -> DataFrame:
    """The rows of docs that the filter lets through, or the others."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(touched.rows(batch.column(at)) == keep))

    return docs.mapInArrow(K.tidied(run), docs.schema)


HITS = "doc_id long, item_id long, first_word long, n_words long, similarity double"
_HITS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("first_word", pa.int64()),
        ("n_words", pa.int64()),
        ("similarity", pa.float64()),
    ]
)


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row for each document and benchmark item whose best item-sized window has a similarity of `least`.

    Returns doc_id, item_id, first_word, n_words, similarity. Null or empty documents and items match nothing; an
    item or document of fewer words than a shingle is one shingle, so it matches only documents that are that whole
    sequence. A document shorter than an item is one window. Repeated rows give repeated results; items with equal
    ids and other texts count each for itself. A null doc_id is reported as null. Other columns of docs are ignored.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    number, slices = _slices(benchmark, shingle)
    if number > 1:
        rows = Scratch(spark, "touched").written(_chosen(rows, _touched(benchmark, shingle, least), True), "rows")

    def finder(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for a, _, raw, offs in K.chunks(batch.column(1)):
                    hits = items.matches(raw, offs, shingle, least)
                    out += [(batch.column(0)[a + d].as_py(), int(items.ids[i]), word, n, score) for d, i, word, n, score in hits]
                if out:
                    columns = zip(zip(*out, strict=True), _HITS.types, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], schema=_HITS)

        return run

    found = None
    for items in slices:
        one = rows.mapInArrow(K.tidied(finder(items)), HITS)
        found = one if found is None else found.unionByName(one)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs without a benchmark item in them, with all their columns and without a shuffle.

    Rows with a null or empty text stay, and so do repeated rows; what contaminated() finds by a row's text alone decides.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    number, slices = _slices(benchmark, shingle)

    def cleaner(items: Items, at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, raw, offs in K.chunks(batch.column(at)):
                    for d, *_rest in items.matches(raw, offs, shingle, least):
                        keep[a + d] = False
                yield batch.filter(pa.array(keep))

        return run

    if number == 1:
        return docs.mapInArrow(K.tidied(cleaner(next(slices), docs.columns.index("text"))), docs.schema)
    scratch, touched = Scratch(spark, "touched"), _touched(benchmark, shingle, least)
    left = scratch.written(_chosen(docs, touched, True), "rows")
    for items in slices:
        less = scratch.written(left.mapInArrow(K.tidied(cleaner(items, docs.columns.index("text"))), docs.schema), "rows")
        scratch.drop(left)
        left = less
    return _chosen(docs, touched, False).unionByName(left)
