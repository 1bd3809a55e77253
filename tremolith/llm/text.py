"""Whole-array text kernels: words and word hashes of Arrow string columns, without a Python loop over words.

A kernel gets row slices of bounded size (one row may be longer) and works on the bytes of all their texts at once,
so its memory follows the slice and not the batch.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: The white space of the contracts: blank and 0x09 to 0x0D.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: ASCII that is neither a digit nor a lower-case letter (after A-Z is lowered).
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
NOT_LETTER = bytes([*range(0x00, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD, _C1, _C2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(salt)) | np.uint64(1)


_OF_BYTE = seeds(256, 11)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""
    base, up, down = int(_ODD), np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, b in (("up", cls.base), ("down", pow(cls.base, -1, 1 << 64))):
                a = np.full(max(n, SLICE_BYTES + 1), b, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


class _Places:
    """Fixed odd numbers for the places in a word, grown on demand."""
    known = np.empty(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if n > SLICE_BYTES:
            return seeds(n, 12)  # of one huge word, not kept
        if len(cls.known) < n:
            cls.known = seeds(min(SLICE_BYTES, 2 * n), 12)
        return cls.known[:n]


@dataclass
class Texts:
    """A slice of rows: bytes of all texts, where each text starts and ends, which are null."""
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a slice in order; ``first[i]:first[i + 1]`` are those of row i."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)

    def get(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``longest`` bytes."""
        if not len(self):
            return np.empty(0, np.uint64)
        up, down = _Powers.upto(len(self.data) + 1)
        if self.sums is None:
            self.sums = np.empty(len(self.data) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(_OF_BYTE[self.data] * up[:-1], out=self.sums[1:])
        sums = self.sums
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mix((sums[ends] - sums[self.starts]) * down[self.starts] + (ends - self.starts).astype(np.uint64))

    def keys(self) -> np.ndarray:
        """64-bit hash of each word with unrelated weights for its places: no pattern of letters (such as that of Thue and
        Morse, which breaks polynomials modulo 2**64 in every odd base) makes two words equal."""
        if not len(self):
            return np.empty(0, np.uint64)
        place = np.zeros(len(self.data), np.int64)
        place[self.starts] = self.starts
        place = np.arange(len(place)) - np.maximum.accumulate(place, out=place)
        longest = int((self.ends - self.starts).max())
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[self.data] * _Places.upto(longest)[np.minimum(place, longest - 1, out=place)], out=sums[1:])
        return mix(sums[self.ends] - sums[self.starts] + (self.ends - self.starts).astype(np.uint64))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Row slices of at most ``most`` bytes of text; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if not len(column):
        return
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        own = offsets[at:end + 1]
        yield Texts(data[own[0]:own[-1]], own - own[0], null[at:end])
        at = end


def words(texts: Texts, between: bytes = BLANKS) -> Words:
    """Maximal runs of bytes outside ``between``, with A-Z lowered."""
    data, offsets = _LOWER[texts.data], texts.offsets
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    table = np.ones(256, bool)
    table[list(between)] = False
    inside = table[data]
    full = np.flatnonzero(np.diff(offsets))
    opens, closes = np.empty(len(data), bool), np.empty(len(data), bool)
    opens[0], opens[1:] = True, ~inside[:-1]
    opens[offsets[full]] = True
    closes[-1], closes[:-1] = True, ~inside[1:]
    closes[offsets[full + 1] - 1] = True
    starts = np.flatnonzero(inside & opens)
    return Words(data, starts, np.flatnonzero(inside & closes) + 1, np.searchsorted(starts, offsets))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (or of its columns) over each row's part; 0 for rows without words."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def maxima(values: np.ndarray, first: np.ndarray, empty: float) -> np.ndarray:
    out = np.full((len(first) - 1, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.maximum.reduceat(values, first[full], axis=0)
    return out


def struct(**columns) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def release() -> None:
    """Give freed memory back to the system: Python workers live on for later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def column_udf(make: Callable[[], Callable[[Texts], pa.Array]], kind: pa.DataType, ddl: str):
    """A column function that applies the kernel from ``make`` (called once a task) slice by slice."""
    def body(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = make()
        for column in batches:
            parts = [kernel(s).cast(kind) for s in slices(column)]
            out = pa.concat_arrays(parts) if parts else pa.array([], kind)
            del parts
            release()
            yield out
        del kernel
        release()
    return F.arrow_udf(body, ddl)
