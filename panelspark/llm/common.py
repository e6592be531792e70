"""What the operators of this subpackage share: bounded Arrow batches, keys of rows, vectorised words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.staging import Scratch, new_folder  # noqa: F401
from panelspark.sources.staging import staged as materialize  # noqa: F401

#: Bytes of text that a task turns into numpy arrays at once; a single longer text is taken alone.
SLICE_BYTES = 1 << 19
#: Most bytes and rows of an Arrow batch that goes to a Python worker, as rows hold whole texts.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small enough for rows that hold whole texts (a row is never split)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def numbered(documents: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """documents with its columns named c0, c1, ... by place, and the new names of some columns: helper columns then clash with
    none of them, dots in names are harmless, and `.toDF(*documents.columns)` gives the old names back."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    return documents.toDF(*names), [names[documents.columns.index(c)] for c in columns]


def row_key(documents: DataFrame) -> Column:
    """64 bits of all columns of a row (a null differs from every value); columns that Spark can't hash are left out. Rows
    with equal keys and equal ids count as one another's copies."""
    fields = [f for f in documents.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "void"))]
    named = [F.col(f"`{f.name}`") for f in fields]
    return F.xxhash64(*[x for c in named for x in (c, c.isNull())]) if named else F.lit(0).cast("long")


# ---------------------------------------------------------------- words in numpy

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words between white space, `[^\x20\x09-\x0D]+`.
NON_SPACE = _SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of words of lower-cased text, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = _ALNUM
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of slices of about SLICE_BYTES; a null text is empty."""
    values = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    if not len(values):
        return
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(values):
        end = max(row + 1, int(np.searchsorted(off, off[row] + SLICE_BYTES, "right")) - 1)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and for each text the index of its first word (one more entry at the end)."""
    inside = is_word[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[off[:-1][off[:-1] < len(inside)]] = False
        after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n; kept, as every slice needs it."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


class Rolling:
    """Hashes of any spans of a sequence: sums of (value + 1) * base**i modulo 2**64, moved to a common origin."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


class HashSet:
    """Sorted 64-bit hashes behind a bitmap on the top bits, so that most lookups end at one small read."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.astype(np.uint64))
        bits = max(16, min(24, int(len(self.sorted)).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(self.sorted >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes that are members, and the place of each in self.sorted."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bitmap[(hashes >> self.shift).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        same = self.sorted[place] == hashes[maybe]
        return maybe[same], place[same]


# ---------------------------------------------------------------- XXH64 of many short pieces

_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
#: Pieces of more bytes are hashed one by one.
LONG_PIECE = 512


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[starts[i]:ends[i]] for all i at once: a lane of 8, 4 or 1 bytes a step, over the pieces that have it."""
    size = ends - starts
    out = np.empty(len(size), np.uint64)
    first = [np.uint64((seed + d) % (1 << 64)) for d in (int(_P[0]) + int(_P[1]), int(_P[1]), 0, -int(_P[0]), int(_P[4]))]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    mixed = lambda acc, lane: _turn(acc + lane * _P[1], 31) * _P[0]
    h, at = np.full(len(size), first[4], np.uint64), starts.astype(np.int64).copy()
    wide = np.flatnonzero((size >= 32) & (size <= LONG_PIECE))
    if len(wide):
        acc = [np.full(len(wide), v, np.uint64) for v in first[:4]]
        left = size[wide] // 32
        for step in range(int(left.max())):
            on = np.flatnonzero(left > step)
            for k in range(4):
                acc[k][on] = mixed(acc[k][on], eight[at[wide[on]] + 32 * step + 8 * k])
        both = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            both = (both ^ mixed(np.zeros(len(wide), np.uint64), a)) * _P[0] + _P[3]
        h[wide] = both
        at[wide] += 32 * left
    h += size.astype(np.uint64)
    short = size <= LONG_PIECE
    on = np.flatnonzero(short & (ends - at >= 8))
    while len(on):
        h[on] = _turn(h[on] ^ mixed(np.zeros(len(on), np.uint64), eight[at[on]]), 27) * _P[0] + _P[3]
        at[on] += 8
        on = on[ends[on] - at[on] >= 8]
    on = np.flatnonzero(short & (ends - at >= 4))
    h[on] = _turn(h[on] ^ (four[at[on]].astype(np.uint64) * _P[0]), 23) * _P[1] + _P[2]
    at[on] += 4
    on = np.flatnonzero(short & (ends > at))
    while len(on):
        h[on] = _turn(h[on] ^ (padded[at[on]].astype(np.uint64) * _P[4]), 11) * _P[0]
        at[on] += 1
        on = on[ends[on] > at[on]]
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    out[:] = h ^ (h >> np.uint64(32))
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out
