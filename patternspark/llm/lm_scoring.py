"""Language-model scores by a subword lattice.

One unigram model scores whole documents: its units are the pieces of an existing subword vocabulary with their own
scores, single bytes, the words that the training documents hold, and the end of a document. A document is the lattice
of everything that spells it; the forward recursion in log space sums over every segmentation and returns the marginal
probability. Words start with a mark, and no unit runs over one, so the marginal of a document is the product of its
words' marginals and that of its end, and a word's lattice is worked off once, however often the word occurs.

The shares of the two kinds of units are Good and Turing's: pieces and bytes, which spell what training didn't meet,
get the share of words seen once; words and ends share the rest by their counts. Nothing else is fitted. Scores of a
unigram vocabulary are log weights as they are. Those of a merge vocabulary are whole numbers, its merge ranks, which
say only what is more frequent: they are turned into weights once, by Zipf's law with an offset (RANK_OFFSET).

Documents are cut into chunks; a chunk lists its distinct words, and the lists are dealt by word hash into slices, where
counts are summed, lattices scored, and the figures sent back to the chunks. A slice holds a bounded number of list
entries, since their number follows the input, and a frequent word is one entry of each chunk only. No vocabulary of the
corpus is ever broadcast.
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
from .token_codes import vocabulary

#: Bytes of text whose words share one list, list entries in a slice, and words of one scored row.
CHUNK_BYTES = 8 << 20
SLICE_ENTRIES = 600_000
PART_WORDS = 40_000
#: Places of lattices that are worked off together.
PLACES = 1 << 16
#: A merge vocabulary's piece of rank r weighs 1 / (r + RANK_OFFSET); all single bytes together weigh BYTES of the pieces.
RANK_OFFSET = 50
BYTES = 0.01
WORD_START = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a vocabulary with their log weights, found by a rolling hash in an open-addressed table."""

    SLOTS = 1 << 18

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
        other = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        use = [i for i in range(model.get_piece_size()) if not any(f(i) for f in other)]
        self.pieces = [model.id_to_piece(i) for i in use]
        self.longest = max(map(len, self.pieces))
        self.logp, self.byte = weights(np.array([model.get_score(i) for i in use]))
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.vals = np.full(self.SLOTS, -1, np.int32)
        for i, p in enumerate(self.pieces):
            h = np.zeros(1, np.uint64)
            for c in p:
                h = self.add(h, np.array([ord(c)]))
            at = int(h[0] >> np.uint64(46))
            while self.keys[at]:
                at = (at + 1) % self.SLOTS
            self.keys[at], self.vals[at] = h[0], i

    @staticmethod
    def add(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h ^ (code.astype(np.uint64) + np.uint64(1))) * _STEP ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        open_, want, at = np.arange(len(h)), h, (h >> np.uint64(46)).astype(np.int64)
        while len(open_):
            key = self.keys[at]
            same = key == want
            out[open_[same]] = self.vals[at[same]]
            go = ~same & (key != 0)
            open_, want, at = open_[go], want[go], (at[go] + 1) % self.SLOTS
        return out


def weights(scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Log weights of pieces by their scores, and of one byte; all pieces and the 256 bytes sum to 1."""
    if (scores == np.round(scores)).all():
        rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
        scores = -np.log(rank + RANK_OFFSET)
    logp = scores - np.logaddexp.reduce(scores) - math.log1p(BYTES)
    return logp, math.log(BYTES / (1 + BYTES) / 256)


def log_marginals(words: list[bytes], p: Pieces, spelled: float, whole: np.ndarray) -> np.ndarray:
    """Log marginal of every word: the forward recursion over all its segmentations.

    spelled: log share of pieces and bytes, a factor of each; whole: log weight of the edge over the whole word.
    """
    said = [WORD_START + w.decode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, said), np.int64, len(said))
    order, out = np.argsort(size, kind="stable"), np.zeros(len(said))
    total, a = np.cumsum(size[order]), 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PLACES, "right")))
        at = order[a:b]
        flat = np.frombuffer("".join([said[i] for i in at.tolist()]).encode("utf-32-le"), np.uint32)
        out[at] = _forward(flat, size[at], p, spelled, whole[at])
        a = b
    return out


def _forward(flat: np.ndarray, size: np.ndarray, p: Pieces, spelled: float, whole: np.ndarray) -> np.ndarray:
    """Log marginals of words of rising sizes, whose code points follow one another."""
    k, n = len(size), len(flat)
    off = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(k), size)
    end = off[word + 1]
    # edges: pieces that match at a place, found for all places at once
    h, open_, found = np.zeros(n, np.uint64), np.arange(n), []
    for j in range(p.longest):
        open_ = open_[open_ + j < end[open_]]
        h[open_] = p.add(h[open_], flat[open_ + j])
        piece = p.find(h[open_])
        hit = np.flatnonzero(piece >= 0)
        found.append((open_[hit], np.full(len(hit), j + 1), p.logp[piece[hit]]))
    place, length, logp = (np.concatenate(x) for x in zip(*found, strict=True))
    step = place - off[word[place]]
    order = np.argsort(step, kind="stable")
    cuts = np.searchsorted(step[order], np.arange(size[-1] + 1))
    # a word has a node before each place and one after its last
    source = (place + word[place])[order]
    target, logp = source + length[order], logp[order] + spelled
    width = 1 + (flat > 0x7F).astype(np.int8) + (flat > 0x7FF) + (flat > 0xFFFF)
    in_bytes = width * (p.byte + spelled)
    alpha = np.full(n + k, -np.inf)
    first = off[:-1] + np.arange(k)
    alpha[first] = 0
    alpha[first + size] = whole
    for i in range(int(size[-1])):
        longer = slice(int(np.searchsorted(size, i, "right")), None)
        here = first[longer] + i
        alpha[here + 1] = np.logaddexp(alpha[here + 1], alpha[here] + in_bytes[off[:-1][longer] + i])
        e = slice(cuts[i], cuts[i + 1])
        alpha[target[e]] = np.logaddexp(alpha[target[e]], alpha[source[e]] + logp[e])
    return alpha[first + size]


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _pack_bytes(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _three(x: np.ndarray) -> bytes:
    """Counting numbers as planes of their bytes, compressed."""
    return _pack_bytes(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


LISTS = "chunk long, slice int, hashes binary, tf binary, words binary, docs binary, doc_ids array<long>, n_words binary, held binary"
_LISTS = pa.schema(
    [
        ("chunk", pa.int64()),
        ("slice", pa.int32()),
        ("hashes", pa.binary()),
        ("tf", pa.binary()),
        ("words", pa.binary()),
        ("docs", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.binary()),
        ("held", pa.binary()),
    ]
)


def _held_out(ids: list[int | None], mod: int, rest: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(("" if x is None else str(x)).encode()) % mod == rest for x in ids), bool, len(ids))


def _listing(slices: int, mod: int, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for group in _grouped(batches):
            ids = [x for b in group for x in b.column(0).to_pylist()]
            held = _held_out(ids, mod, rest)
            hashes, offs, starts, ends, raws, base = [], [0], [], [], [], 0
            for b in group:
                for _, _, raw, off in K.chunks(b.column(1)):
                    w = K.Words(raw, off)
                    hashes.append(w.hash)
                    offs.extend((offs[-1] + w.off[1:]).tolist())
                    starts.append(w.start + base)
                    ends.append(w.end + base)
                    raws.append(raw)
                    base += len(raw)
            h, start, end = (np.concatenate(x) for x in (hashes, starts, ends))
            raw = _LOW[np.concatenate(raws)]
            n_words = np.diff(offs)
            u, where, back, seen = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            trained = np.bincount(back, np.repeat(~held, n_words), len(u)).astype(np.int64)
            order = np.argsort(-seen, kind="stable")  # frequent words get low places, which compress
            place = np.empty(len(u), np.int64)
            place[order] = np.arange(len(u))
            u, where, trained = u[order], where[order], trained[order]
            number += 1
            chunk = (part << 32) | number
            row = {
                "chunk": [chunk],
                "slice": [-1],
                "hashes": [None],
                "tf": [None],
                "words": [None],
                "docs": [_three(place[back])],
                "doc_ids": [ids],
                "n_words": [_three(n_words)],
                "held": [held.tobytes()],
            }
            yield pa.RecordBatch.from_pydict(row, _LISTS)
            data = raw.tobytes()
            of = (u >> np.uint64(20)) % np.uint64(slices)
            for s in range(slices):
                at = np.flatnonzero(of == s)
                if len(at):
                    words = [data[a:b] for a, b in zip(start[where[at]].tolist(), end[where[at]].tolist(), strict=True)]
                    docs = np.ascontiguousarray(at.astype("<u4")).tobytes()
                    row = {
                        "chunk": [chunk],
                        "slice": [s],
                        "hashes": [u[at].tobytes()],
                        "tf": [_three(trained[at])],
                        "words": [zlib.compress(b"\n".join(words), 1)],
                        "docs": [zlib.compress(docs, 1)],
                        "doc_ids": [None],
                        "n_words": [None],
                        "held": [None],
                    }
                    yield pa.RecordBatch.from_pydict(row, _LISTS)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    group, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        group.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


VOCABULARY = "slice int, part int, n long, distinct long, once long, hashes binary, counts binary, words binary"
_VOCABULARY = pa.schema([
    ("slice", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("distinct", pa.int64()), ("once", pa.int64()),
    ("hashes", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()),
])


def _merge(table: pa.Table) -> pa.Table:
    """The distinct words of a slice with their training counts, in order of hash, in parts."""
    columns = (table.column(c).to_pylist() for c in ("hashes", "tf"))
    lists = [(np.frombuffer(a, np.uint64), _numbers(b)) for a, b in zip(*columns, strict=True)]
    h, first, back = np.unique(np.concatenate([a for a, _ in lists]), return_index=True, return_inverse=True)
    counts = np.bincount(back, np.concatenate([b for _, b in lists]), len(h)).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum([len(a) for a, _ in lists])])
    words: list[bytes] = [b""] * len(h)
    owner = np.searchsorted(edge, first, "right") - 1
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(lists) + 1))
    for k, blob in enumerate(table.column("words").to_pylist()):
        own = order[cuts[k] : cuts[k + 1]]
        if len(own):
            said = zlib.decompress(blob).split(b"\n")
            for i in own.tolist():
                words[i] = said[int(first[i] - edge[k])]
    s = table.column("slice")[0].as_py()
    rows = []
    for part, a in enumerate(range(0, len(h), PART_WORDS)):
        b = min(a + PART_WORDS, len(h))
        c = counts[a:b]
        facts = (int(c.sum()), int((c > 0).sum()), int((c == 1).sum()))
        rows.append((s, part, *facts, h[a:b].tobytes(), c.tobytes(), zlib.compress(b"\n".join(words[a:b]), 1)))
    return pa.Table.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _VOCABULARY.types, strict=True)], schema=_VOCABULARY
    )


SCORED = "slice int, part int, hashes binary, counts binary, logs binary"


def _scores(subwords: str, spelled: float, a_count: float):
    """a_count: log weight of one count of a training word."""
    owner = f"pieces {subwords}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = K.kept(owner, lambda: Pieces(subwords))
        for batch in batches:
            logs = []
            for counts, words in zip(batch.column("counts").to_pylist(), batch.column("words").to_pylist(), strict=True):
                with np.errstate(divide="ignore"):
                    whole = np.log(np.frombuffer(counts, np.int64)) + a_count
                logs.append(log_marginals(zlib.decompress(words).split(b"\n"), p, spelled, whole).tobytes())
            kept = [batch.column(c) for c in ("slice", "part", "hashes", "counts")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(logs, pa.binary())], ["slice", "part", "hashes", "counts", "logs"])

    return K.tidied(run, owner)


def _answer(key: tuple, lists: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """Counts and log marginals for the lists of a slice, chunk by chunk."""
    vocabulary = vocabulary.sort_by("part")
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in vocabulary.column("hashes").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in vocabulary.column("counts").to_pylist()])
    logs = np.concatenate([np.frombuffer(x, np.float64) for x in vocabulary.column("logs").to_pylist()])
    out = []
    for x in lists.column("hashes").to_pylist():
        at = np.searchsorted(h, np.frombuffer(x, np.uint64))
        out.append((_three(counts[at]), logs[at].astype(np.float32).tobytes()))
    return pa.Table.from_pydict(
        {
            "chunk": lists.column("chunk"),
            "docs": lists.column("docs"),
            "counts": [a for a, _ in out],
            "logs": [b for _, b in out],
        },
        _ANSWERS,
    )


ANSWERS = "chunk long, docs binary, counts binary, logs binary"
_ANSWERS = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("logs", pa.binary())])
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(n: int, v: int, ends: int, log_end: float):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        place = _numbers(docs.column("docs")[0].as_py())
        n_words = _numbers(docs.column("n_words")[0].as_py()).astype(np.int64)
        held = np.frombuffer(docs.column("held")[0].as_py(), bool)
        size = int(place.max()) + 1 if len(place) else 0
        counts, logs = np.zeros(size, np.int64), np.zeros(size)
        for where, c, x in zip(*(answers.column(k).to_pylist() for k in ("docs", "counts", "logs")), strict=True):
            at = np.frombuffer(zlib.decompress(where), "<u4")
            counts[at] = _numbers(c)
            logs[at] = np.frombuffer(x, np.float32)
        base = np.log10((counts + 1) / (n + v + 1))
        off = np.concatenate([[0], np.cumsum(n_words)])

        def by_doc(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(n_words), x.dtype)
            full = np.flatnonzero(n_words)
            if len(full):
                out[full] = np.add.reduceat(x[place], off[full])
            return out

        end = math.log10((ends + 1) / (n + v + 1))
        known = by_doc((counts > 0).astype(np.int64)) + int(ends > 0)
        marginal = (by_doc(logs) + log_end) / math.log(10)
        ids = docs.column("doc_ids")[0].as_py()
        cols = [ids, held, n_words + 1, known, np.full(len(held), n), by_doc(base) + end, marginal]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names)

    return run


def score(
    docs: DataFrame, subwords: str, mod: int = 7, rest: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Score every whole text (null: empty), learning from rows whose crc32(id as text) mod `mod` is not `rest`.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word counts) and score (log10 of the
    lattice model's probability of the words and the end). Words are lower-cased (A-Z) runs of anything but white space.
    subwords: a path, or the name of a public vocabulary file. A null id counts as the empty text for its remainder;
    repeated rows count and are returned each; a text without words is its end alone; bytes that are no UTF-8 count as
    U+FFFD in lattices; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    facts = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.count_if(F.crc32(key) % mod != rest).alias("ends")).first()
    size, ends = facts["size"] or 0, facts["ends"]
    # about one list entry for 40 bytes of text
    slices = max(2, math.ceil(size / 40 / SLICE_ENTRIES))
    lists = scratch.written(rows.mapInArrow(K.tidied(_listing(slices, mod, rest)), LISTS), "lists")
    own = lists.where("slice >= 0")
    # a slice is a task of its own, so no task grows with the input
    dealt = own.select("slice", "hashes", "tf", "words").repartitionById(slices, F.col("slice"))
    words = scratch.written(dealt.groupBy("slice").applyInArrow(_merge, VOCABULARY), "words")
    known = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "distinct", "once"))).first()
    n, v = known["n"] + ends, known["distinct"] + int(ends > 0)
    new = (known["once"] + 1) / (known["n"] + 2)
    a_count = math.log1p(-new) - math.log(n + 1)
    tasks = max(1, math.ceil(size / (4 << 20)))
    tasks = min(tasks, max(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    scored = words.select("slice", "part", "hashes", "counts", "words").repartition(tasks, "slice", "part")
    scored = scratch.written(scored.mapInArrow(_scores(subwords, math.log(new), a_count), SCORED), "scored")
    scratch.drop(words)
    asked = own.select("chunk", "slice", "hashes", "docs").repartitionById(slices, F.col("slice")).groupBy("slice")
    told = scored.repartitionById(slices, F.col("slice")).groupBy("slice")
    answers = asked.cogroup(told).applyInArrow(_answer, ANSWERS)
    whole = lists.where("slice < 0").select("chunk", "docs", "doc_ids", "n_words", "held")
    finish = _finish(n, v, ends, math.log(ends + 1) + a_count)
    return whole.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, OUT)
