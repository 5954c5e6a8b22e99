"""Texts as byte arrays inside a task: spans, hashes and the pair of Bloom filters.

Everything works on stretches of about two megabytes of text, whatever the size
of a batch; a longer text is a stretch of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from itemspark.session import ship

ship(__name__)

STRETCH = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64
_SHARD_BITS = 20

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, up to ``n``."""
    if len(_powers[0]) <= n:
        size = max(n + 1, STRETCH + 1)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for i, b in enumerate((_BASE, inverse)):
            row = np.full(size, b, _U)
            row[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(row, dtype=_U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x.astype(_U, copy=True)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def stretches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within those bytes) of stretches of whole texts."""
    data, offsets = texts_of(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STRETCH, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every span of bytes, equal for equal spans: polynomials from running sums."""
    if not len(starts):
        return np.zeros(0, _U)
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each text (one more entry than texts)."""
    solid = ~is_space(data)
    edge = np.zeros(len(data) + 1, bool)  # a word also ends where its text ends
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    starts = np.nonzero(solid & (~before | edge[:-1]))[0]
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    ends = np.nonzero(solid & (~after | edge[1:]))[0] + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; a shorter text is one shingle, one without words has none."""
    low = lower_ascii(data)
    starts, ends, first = words_of(low, offsets)
    word = span_hashes(low, starts, ends)
    n = max(0, len(word) - width + 1)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, _U)
        for j in range(width):
            rolled = rolled * _U(0xA24BAED4963EE407) + word[j : j + n]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            every = np.sort(rolled[a : b - width + 1])
            new = np.ones(len(every), bool)
            new[1:] = every[1:] != every[:-1]
            out.append(every[new])
        elif b > a:
            with np.errstate(over="ignore"):
                h = np.zeros(1, _U)
                for w in word[a:b]:
                    h = h * _U(0x8BB84B93962EACC9) + w
            out.append(mix(h + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


class TwiceFilter:
    """The second of two Bloom filters: what it does not hold was seen at most once.

    ``bits`` is a fixed power of two. Where far more values than bits are added,
    the filter holds nearly everything: callers then shuffle more, and stay exact.
    """

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    def parts(self) -> tuple:
        """What a broadcast carries: an object of this class would need the package on the workers."""
        return self.packed, self.bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in places(hashes, self.bits):
            found &= (self.packed[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return found


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = _U(64 - (bits.bit_length() - 1))
    with np.errstate(over="ignore"):
        return [(h >> shift).astype(np.int64) for h in (hashes, mix(hashes + _U(0x632BE59BD9B4E019)))]


def twice_seen(rows: DataFrame, columns: list[str], hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = 1 << 27) -> TwiceFilter:
    """Build both filters over the hashes of all rows.

    A task fills its own pair; the pairs meet per shard of 2**20 bits, where a
    bit seen by two tasks moves to the second filter. Only the second filter,
    of ``bits`` bits at most, comes to the driver.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, held, size = np.zeros(0, _U), np.zeros(0, _U), [], 0

        def settle(once, twice, held):
            every, n = np.unique(np.concatenate([once, *held]), return_counts=True)
            return every, np.union1d(twice, every[n > 1])

        for batch in batches:
            for h in hashes_of(batch):
                held.append(h)
                size += len(h)
                if size > 1 << 21:
                    once, twice = settle(once, twice, held)
                    held, size = [], 0
        once, twice = settle(once, twice, held)
        marks = [np.unique(np.concatenate(places(x, bits))) for x in (once, twice)]
        shards = np.unique(marks[0] >> _SHARD_BITS)
        low = (1 << _SHARD_BITS) - 1
        cut = [[m[np.searchsorted(m, s << _SHARD_BITS) : np.searchsorted(m, (s + 1) << _SHARD_BITS)] & low for s in shards] for m in marks]
        blobs = [[x.astype("<u4").tobytes() for x in c] for c in cut]
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], ["shard", "once", "twice"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(1 << _SHARD_BITS, bool), np.zeros(1 << _SHARD_BITS, bool)
        for a, b in zip(part["once"], part["twice"], strict=True):
            seen = np.frombuffer(a, "<u4")
            twice[seen[once[seen]]] = True
            once[seen] = True
            twice[np.frombuffer(b, "<u4")] = True
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "at": [np.nonzero(twice)[0].astype("<u4").tobytes()]})

    made = rows.select(*columns).mapInArrow(local, "shard int, once binary, twice binary")
    merged = made.groupBy("shard").applyInPandas(merge, "shard int, at binary")
    packed = np.zeros(bits // 8, np.uint8)
    width = 1 << (_SHARD_BITS - 3)
    for r in merged.toLocalIterator():
        shard = np.zeros(1 << _SHARD_BITS, bool)
        shard[np.frombuffer(r["at"], "<u4")] = True
        packed[r["shard"] * width : (r["shard"] + 1) * width] = np.packbits(shard, bitorder="little")
    return TwiceFilter(packed, bits)


class RepeatedFilter(TwiceFilter):
    """A Bloom filter of the values that occur twice or more, by fingerprints of ``kept`` bits."""

    def __init__(self, packed: np.ndarray, bits: int, kept: int):
        super().__init__(packed, bits)
        self.kept = kept

    def parts(self) -> tuple:
        return self.packed, self.bits, self.kept

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return super().holds(mix(hashes >> _U(64 - self.kept)))


def _gaps(sorted_values: np.ndarray) -> bytes:
    """Ascending 32-bit values as gaps of the fewest bytes; the first byte tells the width."""
    gaps = np.diff(sorted_values, prepend=0)
    top = int(gaps.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 3 if top < 1 << 24 else 4
    return bytes([width]) + gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _from_gaps(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u4").ravel(), dtype=np.int64)


def repeated(rows: DataFrame, columns: list[str], hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = 1 << 27) -> RepeatedFilter:
    """A filter of the hashes that occur twice or more among all rows.

    For many more values than a filter of once-seen ones could hold: tasks send
    the fingerprints of their different values as gaps, shards count them, and
    only repeated ones enter the filter, which is all that comes to the driver.
    """
    shard_bits = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 2)
    kept = shard_bits + 32

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, held, size = np.zeros(0, _U), np.zeros(0, _U), [], 0

        def settle(once, twice, held):
            every, n = np.unique(np.concatenate([once, *held]), return_counts=True)
            return every, np.union1d(twice, every[n > 1])

        for batch in batches:
            for h in hashes_of(batch):
                held.append(h >> _U(64 - kept))
                size += len(h)
                if size > 1 << 21:
                    once, twice = settle(once, twice, held)
                    held, size = [], 0
        once, twice = settle(once, twice, held)
        shards = np.unique(once >> _U(32)).astype(np.int64)
        blobs = []
        for values in (once, twice):
            low = (values & _U(0xFFFFFFFF)).astype(np.int64)
            begins, ends = (np.searchsorted(values, (shards + k).astype(_U) << _U(32)) for k in (0, 1))
            blobs.append([_gaps(low[a:b]) for a, b in zip(begins, ends, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], ["shard", "once", "twice"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        every = np.sort(np.concatenate([_from_gaps(b) for b in part["once"]]))
        often = np.concatenate([every[1:][every[1:] == every[:-1]], *[_from_gaps(b) for b in part["twice"]]])
        shard = int(part["shard"].iloc[0])
        fingerprint = (_U(shard) << _U(32)) | np.unique(often).astype(_U)
        at = np.unique(np.concatenate(places(mix(fingerprint), bits)))
        return pd.DataFrame({"at": [at.astype("<u4").tobytes()]})

    made = rows.select(*columns).mapInArrow(local, "shard int, once binary, twice binary")
    packed = np.zeros(bits // 8, np.uint8)
    for r in made.groupBy("shard").applyInPandas(merge, "at binary").toLocalIterator():
        at = np.frombuffer(r["at"], "<u4").astype(np.int64)
        np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return RepeatedFilter(packed, bits, kept)
