"""Vectorised byte and word work on Arrow batches, shared by the operators.

Spark partitions the rows; these helpers look at one batch of them at a time, in chunks of
bounded size, so that a batch of long texts needs no more memory than one of short ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18


@dataclass
class Texts:
    """Some rows' texts, one after the other: text i is ``data[starts[i]:starts[i] + sizes[i]]``."""

    rows: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The rows of a string column in runs of about ``size`` bytes."""
    data, at = utf8(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        last = min(last, n, first + (1 << 16))
        yield Texts(np.arange(first, last), data[at[first]:at[last]], at[first:last] - at[first], np.diff(at[first:last + 1]))
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers of a seed."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15)) | U64(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def run(b: int) -> np.ndarray:
                steps = np.full(max(n, 1 << 16), b, U64)
                steps[0] = 1
                return np.multiply.accumulate(steps)

            self.up, self.down = run(self.base), run(self.inverse)
        return self.up, self.down


_POWERS = [Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)]
_LETTERS = [numbers(11, 256), numbers(12, 256)]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [begin, end): a polynomial over mapped bytes, then mixed."""
    up, down = _POWERS[which].upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_LETTERS[which][data] * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64))


@dataclass
class Words:
    """Word spans of some texts; words of text i are ``first[i]:first[i + 1]``."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def byte_set(pattern_ranges: Iterable[tuple[int, int]]) -> np.ndarray:
    """A table of 256 flags, true outside the given ranges of byte values."""
    flags = np.ones(256, bool)
    for low, high in pattern_ranges:
        flags[low:high + 1] = False
    return flags


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(texts: Texts, letters: np.ndarray) -> Words:
    """Maximal runs of bytes whose flag in ``letters`` is set, within each text."""
    return runs(texts, letters[texts.data])


def runs(texts: Texts, flags: np.ndarray) -> Words:
    """Maximal runs of places whose flag is set, within each text."""
    n = len(texts.data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = flags
    step = np.diff(inside)
    opens, closes = step[:-1] == 1, step[1:] == -1
    edges = texts.starts[(texts.sizes > 0) & (texts.starts > 0)]
    both = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
    opens[both] = True
    closes[both - 1] = True
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    bounds = np.append(texts.starts, n)
    return Words(begin, end, np.searchsorted(begin, bounds))


_STEPS = numbers(13, 64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k hashes in a row; entry i covers i .. i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += mix(hashes[j:j + n] + _STEPS[j]) * _STEPS[j]
    return mix(out + U64(k))


def owner(first: np.ndarray, n: int) -> np.ndarray:
    """For each of n items the text that holds it; text i holds ``first[i]:first[i + 1]``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each count c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given lengths over flat values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
