"""Token ids as directly addressable codes.

An id is cut into 8-bit chunks. Level l holds chunk l of every id that has one, a bitmap tells which of its
entries continue on level l+1, and a rank directory counts the set bits before every 512th entry. Entry i of a
level continues at position rank(i) of the next, so any id is read in as many steps as it has chunks and no
block is decoded.

A written table is a folder of Parquet files of segments: (part, segment, first, n_tokens, doc_ids, lengths,
codes). Parts follow one another in ascending id order, segments follow within a part; codes is the container
that pack() makes. A segment holds whole documents, about a million ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import bound_batches

MAGIC = b"DAC1"
STRIDE = 512
SEGMENT_TOKENS = 1 << 20
#: Encoded pieces that a worker remembers, some 60 MB.
CACHE = 1_200_000
#: Pieces encoded at once: the library's results are large.
BATCH = 2048


def pack(ids: np.ndarray) -> bytes:
    """The container of an array of unsigned 32-bit ids."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), STRIDE), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else ones
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


class Codes:
    """Reads a container in place."""

    def __init__(self, blob: bytes):
        if bytes(blob[:4]) != MAGIC:
            raise ValueError("not a container of token codes")
        self.levels, at = [], 5
        for _ in range(blob[4]):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            parts = []
            for kind, count in ((np.uint8, n), (np.uint8, (n + 7) // 8), (np.dtype("<u4"), (n + STRIDE - 1) // STRIDE)):
                parts.append(np.frombuffer(blob, kind, count, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // STRIDE
            before = bits[block * (STRIDE // 8) : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        raise ValueError("a code continues beyond the last level")

    def all(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint32)
        where: np.ndarray | slice = slice(None)
        for level, (chunk, bits, _) in enumerate(self.levels):
            out[where] |= chunk.astype(np.uint32) << np.uint32(8 * level)
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunk), bitorder="little"))
            where = more if isinstance(where, slice) else where[more]
        return out


_b = np.arange(256)
_BLANK = np.isin(_b, [9, 10, 11, 12, 13, 32])
_LINE = np.isin(_b, [9, 10, 11, 12, 13])
_LETTER = ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122))
_SEEN = (_b > 32) & (_b < 127)
_MARK = _SEEN & ~_LETTER & ~((_b >= 48) & (_b <= 57)) & (_b != 39)
_WIDE = _b >= 128
_RAW = K.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x7777))


def cut(raw: np.ndarray, offs: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of pieces that the tokenizer's splitting pattern never joins.

    whole: starts and ends of added tokens; each is one piece, as the library takes them out before it splits.

    It never joins a visible character with white space after it, one line break with the visible character
    after it, nor a letter with a mark other than an apostrophe. A wide character counts as visible unless its
    lead byte is one that also leads wide white space; where nothing is known to separate, nothing is cut.
    """
    n = len(raw)
    at = np.zeros(n + 1, bool)
    at[offs] = True
    if n > 1:
        p, c = raw[:-1], raw[1:]
        seen = _SEEN[raw]
        wide = np.flatnonzero(_WIDE[raw])
        if len(wide):
            two, three = raw[np.maximum(wide - 1, 0)], raw[np.maximum(wide - 2, 0)]
            seen[wide] = ~(
                (two == 0xC2) | (three == 0xC2) | np.isin(two, (0xE1, 0xE2, 0xE3)) | np.isin(three, (0xE1, 0xE2, 0xE3))
            )
        rule = _BLANK[c] & seen[:-1]
        rule |= (_LETTER[p] & _MARK[c]) | (_MARK[p] & _LETTER[c])
        line = np.flatnonzero(_LINE[p] & _SEEN[c])
        alone = (line == 0) | seen[np.maximum(line - 1, 0)] | at[line]
        rule[line[alone]] = True
        at[1:-1] |= rule
    for a, b in whole.tolist():
        at[a + 1 : b] = False
        at[[a, b]] = True
    edges = np.flatnonzero(at)
    return edges[:-1], edges[1:]


class Encoder:
    """Encodes whole texts by a byte-level BPE file; ids of pieces are kept by the hash of their bytes."""

    SLOTS = 1 << 21

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that depend on the text around them are not supported")
        # the library takes the leftmost, of those the longest
        literals = sorted((t.content.encode() for t in added), key=lambda x: (-len(x), x))
        self.added = re.compile(b"|".join(map(re.escape, literals))) if literals else None
        self.end = end
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.vals = np.zeros(self.SLOTS, np.int32)
        self.flat = np.array([self.end], np.uint32)
        self.first = np.zeros(1, np.int64)
        self.length = np.ones(1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 for those not kept."""
        out = np.full(len(h), -1, np.int32)
        open_, slot = np.arange(len(h)), (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        want = h
        while len(open_):
            key = self.keys[slot]
            same = key == want
            out[open_[same]] = self.vals[slot[same]]
            go = ~same & (key != 0)
            open_, want, slot = open_[go], want[go], (slot[go] + 1) & (self.SLOTS - 1)
        return out

    def _keep(self, h: np.ndarray, coded: list[list[int]]) -> None:
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        vals = (len(self.first) + np.arange(len(h))).astype(np.int32)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, np.fromiter((x for y in coded for x in y), np.uint32, int(length.sum()))])
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.vals[slot[won]] = vals[won]
            h, vals, slot = h[~won], vals[~won], (slot[~won] + 1) & (self.SLOTS - 1)

    def literals(self, data: bytes, offs: np.ndarray) -> np.ndarray:
        """Byte starts and ends of the added tokens that stand in the documents, one row each."""
        found = [m.span() for m in self.added.finditer(data)] if self.added else []
        spans = np.array(found, np.int64).reshape(-1, 2)
        torn = np.searchsorted(offs, spans[:, 0], "right") != np.searchsorted(offs, spans[:, 1], "left")
        if not torn.any():
            return spans
        # one that runs over the end of a document is none, and may hide another
        found = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            found += [(a + m.start(), a + m.end()) for m in self.added.finditer(data[a:b])]
        return np.array(found, np.int64).reshape(-1, 2)

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents of a chunk, each followed by the end id, and their offsets."""
        if len(self.first) > CACHE:
            self.clear()
        data = raw.tobytes()
        starts, ends = cut(raw, offs, self.literals(data, offs))
        starts, ends = (starts, ends) if len(raw) else (starts[:0], ends[:0])
        h = K.polynomial(raw, starts, ends, _RAW)
        h[h == 0] = 1
        entry = self._find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            texts = [
                data[a:b].decode("utf-8", "replace")
                for a, b in zip(starts[miss[where]].tolist(), ends[miss[where]].tolist(), strict=True)
            ]
            n = len(self.first)
            coded = [
                e.ids for a in range(0, len(texts), BATCH)
                for e in self.tokenizer.encode_batch_fast(texts[a : a + BATCH], add_special_tokens=False)
            ]
            self._keep(new, coded)
            entry[miss] = n + back
        entry = np.insert(entry, np.searchsorted(starts, offs[1:]), 0)
        length = self.length[entry]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.first[entry] - total[:-1], length)]
        closes = np.searchsorted(starts, offs[1:]) + np.arange(1, len(offs))
        return ids, np.concatenate([[0], total[closes]])


def vocabulary(name: str) -> str:
    """A path as it is; the bare name of a public vocabulary file as its place on the machine that asks."""
    if os.path.basename(name) != name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(path: str, end: int):
    owner = f"tokens {path} {end}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = K.kept(owner, lambda: Encoder(vocabulary(path), end))
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        found: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            row = [
                [part], [segment], [first], [held], pa.concat_arrays(ids), np.concatenate(lengths), pack(np.concatenate(found))
            ]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in row[4:6]]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row[:4], _ARROW.types[:4], strict=True)] + lists + [
                    pa.array([row[6]], pa.binary())
                ],
                schema=_ARROW,
            )

        for batch in batches:
            for a, b, raw, offs in K.chunks(batch.column(1)):
                coded, off = coder.encode(raw, offs)
                ids.append(batch.column(0)[a:b])
                found.append(coded)
                lengths.append(np.diff(off))
                held += len(coded)
                if held >= SEGMENT_TOKENS:
                    yield close()
                    segment, first, held, ids, found, lengths = segment + 1, first + held, 0, [], [], []
        if ids:
            yield close()

    return K.tidied(run, owner)


SEGMENTS = "part int, segment int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"
_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("first", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("codes", pa.binary()),
    ]
)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text (null: empty), append the end id, and write segments in ascending id order.

    tokenizer: a path, or the name of a public vocabulary file, which is then looked up where a task runs. Bytes
    that are no UTF-8 count as U+FFFD.

    Null ids come first; rows that repeat an id stay rows of their own, next to each other. Other columns are
    ignored. Ranges of ids are cut by a sample of (id, text hash), so no range depends on one key alone.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    sorted_rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), tie
    )
    sorted_rows.mapInArrow(_encode(tokenizer, end), SEGMENTS).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i] for k in ("part_start", "first", "doc_ids", "lengths", "codes")}
            ids = Codes(row["codes"].as_py()).all().astype("<u4")
            lengths = np.array(row["lengths"].as_py(), np.int64)
            ends = np.cumsum(lengths)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            start = row["part_start"].as_py() + row["first"].as_py() + ends - lengths
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _segments(spark: SparkSession, path: str) -> DataFrame:
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    # one row for each task that wrote: no more than the partitions of one exchange
    return segments.join(F.broadcast(starts), "part")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids (with the end id)."""
    bound_batches(spark)
    return _segments(spark, path).mapInArrow(K.tidied(_decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position of the whole table: one segment is picked by its bounds, and no block decoded."""
    at = F.col("part_start") + F.col("first")
    row = _segments(spark, path).where((at <= position) & (at + F.col("n_tokens") > position)).select(
        at.alias("at"), "codes"
    ).first()
    if row is None:
        raise IndexError(position)
    return Codes(bytes(row["codes"]))[position - row["at"]]
