"""Vectorised text kernels over Arrow string columns.

A kernel works on the UTF-8 bytes of many documents at once, so no Python loop runs per word. A word is
a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Words and shingles are named by
64-bit hashes. Null text is the empty text. Chunks are bounded in bytes and in documents; one document
longer than the bound is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 4096
DOC_SHIFT = np.uint64(52)
HASH_BITS = np.uint64(64 - 52)
LOW52 = np.uint64((1 << 52) - 1)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: What a worker keeps from task to task, by operator: that of one operator at a time.
_kept: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]) -> object:
    """The worker's state of an operator, made where it has none. Tasks call this by name: what a closure holds
    itself is new in every task. tidied() drops it as soon as a task of another operator begins in this worker.
    """
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def tidy() -> None:
    """Give freed memory back: workers live on between tasks, two to an executor of a few GB."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidied(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """run, and tidy() at the end; what other operators than owner have kept in this worker goes first."""

    def tidy_run(batches: Iterator) -> Iterator:
        if owner not in _kept:
            _kept.clear()
        yield from run(batches)
        tidy()

    return tidy_run


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = mix(_FOLD.astype(np.uint64) + np.uint64(1))
_STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
#: Values whose running sums are formed at once, so that the longest text needs no longer table of powers.
PIECE = 1 << 18


def _powers(base: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64, from 0."""
    p = np.full(PIECE + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs values[starts:ends], each independent of where its run lies.

    Runs ascend and don't overlap. table: what stands for a value; it is looked up piece by piece.
    """
    out = np.zeros(len(starts), np.uint64)
    for a in range(0, len(values), PIECE):
        b = min(a + PIECE, len(values))
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if i >= j:
            continue
        own = values[a:b] if table is None else table[values[a:b]]
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(own * _POWERS[: b - a], out=total[1:])
        first, last = np.maximum(starts[i:j] - a, 0), np.minimum(ends[i:j], b) - a
        got = (total[last] - total[first]) * _INVERSES[first]
        if starts[i] < a:  # the one run that began in an earlier piece
            got[:1] *= np.uint64(pow(_BASE, a - int(starts[i]), 1 << 64))
        out[i:j] += got
    return mix(out + (ends - starts).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def chunks(column: pa.Array, most_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of bounded runs of rows."""
    raw, offs = text_buffers(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most_bytes, "right")) - 1
        b = min(max(b, a + 1), a + CHUNK_DOCS, n)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Words:
    """The words of a chunk: hash, byte start, byte end; off[d]:off[d+1] are those of document d."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw = raw
        space = _SPACE[raw]
        before = np.empty(len(raw), bool)
        after = np.empty(len(raw), bool)
        if len(raw):
            before[0] = after[-1] = True
            before[1:] = space[:-1]
            after[:-1] = space[1:]
            inner = offs[(offs > 0) & (offs < len(raw))]
            before[inner] = True
            after[inner - 1] = True
        solid = ~space
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.off = np.searchsorted(self.start, offs)
        self.hash = polynomial(raw, self.start, self.end, _BYTE)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n successive words, whatever documents they lie in."""
    m = max(0, len(words) - n + 1)
    total = np.full(m, n, np.uint64)
    for j in range(n):
        total += words[j : j + m] * _STEP[j]
    return mix(total)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, their documents and the index of their first words, in order.

    A document of 1 to n-1 words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(words.off)
    whole = window_hashes(words.hash, n)
    doc = words.doc
    at = np.arange(len(whole))
    fits = at + n <= words.off[doc[: len(whole)] + 1] if len(whole) else np.zeros(0, bool)
    out = [(whole[fits], doc[: len(whole)][fits], at[fits])]
    for m in range(1, n):
        few = np.flatnonzero(counts == m)
        if len(few):
            first = words.off[few]
            out.append((window_hashes(words.hash, m)[first], few, first))
    if len(out) == 1:
        return out[0]
    h, d, a = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(a, kind="stable")
    return h[order], d[order], a[order]


def distinct_by_doc(hashes: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct 52-bit hashes of each document, and the offsets of the documents."""
    key = np.unique((doc.astype(np.uint64) << DOC_SHIFT) | (hashes >> HASH_BITS))
    off = np.searchsorted(key, np.arange(docs + 1, dtype=np.uint64) << DOC_SHIFT)
    if docs == CHUNK_DOCS:
        off[-1] = len(key)
    return key & LOW52, off


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
