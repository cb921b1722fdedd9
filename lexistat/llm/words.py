"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and return. In UTF-8 these
bytes never occur inside another character, so cutting bytes and cutting characters is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
PRIME = U64(0x9E3779B97F4A7C13)  # odd, 3 modulo 8


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(256, dtype=U64), 7)


def text_bytes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; `lower` maps A-Z to a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n, first = len(texts), texts.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[first : first + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if lower:
        data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    return data, offsets


class Words:
    """Where the words of a column of texts lie, and their 64-bit hashes.

    start, end: byte positions; first: for each text the number of its first word (one entry more than texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~IS_SPACE[data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[1:-1][cuts]
        ends[cuts - 1] = inside[1:-1][cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """One hash for each word: the sum of its bytes' values times powers of a constant, then mixed."""
        if not len(self.start):
            return np.zeros(0, U64)
        length = self.end - self.start
        total = np.zeros(len(self.start), U64)
        live, at, power = np.arange(len(self.start)), 0, U64(1)
        with np.errstate(over="ignore"):
            while len(live):  # one step for each byte place; few words are long, so later steps are short
                total[live] += BYTE_VALUE[self.data[self.start[live] + at]] * power
                at += 1
                power = U64((int(power) * int(PRIME)) & 0xFFFFFFFFFFFFFFFF)
                live = live[length[live] > at]
                if at >= 64 and len(live):
                    for i in live:  # words of more than 64 bytes, each on its own
                        rest = BYTE_VALUE[self.data[self.start[i] + at : self.end[i]]]
                        powers = np.multiply.accumulate(np.full(len(rest), PRIME, U64))
                        total[i] += power * (rest * powers).sum(dtype=U64)
                    break
        return mix(total ^ mix(length.astype(U64), 3))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every `size` consecutive words, for the whole array (callers drop those across texts)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = (total ^ words[k : k + n]) * U64(0xD6E8FEB86659FD93)
            total ^= total >> U64(32)
    return total


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges [first, last), one after the other."""
    length = np.maximum(last - first, 0)
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(first - (ends - length), length)


def batches(parts: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text is a batch of its own."""
    for part in parts:
        if not part.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - 1) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield part.slice(a, b - a)
