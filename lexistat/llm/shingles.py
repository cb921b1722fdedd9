"""Sets of word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexistat.llm.words import U64, Words, mix, ranges, text_bytes, window_hashes

SIZE = 5


def shingle_sets(texts: pa.Array, size: int = SIZE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text i are hashes[first[i]:first[i + 1]], in ascending order.

    A text with fewer words than `size` has one shingle, its whole word sequence; without words it has none.
    """
    words = Words(*text_bytes(texts, lower))
    hashed, a, b = words.hashes(), words.first[:-1], words.first[1:]
    windows = window_hashes(hashed, size)
    stop = np.maximum(b - size + 1, a)
    short = np.flatnonzero((b > a) & (stop == a))
    length = stop - a
    length[short] = 1
    first = np.append(0, np.cumsum(length))
    out = np.empty(first[-1], U64)
    long = np.flatnonzero(stop > a)
    out[ranges(first[long], first[long + 1])] = windows[ranges(a[long], stop[long])] if len(long) else 0
    for i in short:
        own = hashed[a[i] : b[i]]
        out[first[i]] = mix(window_hashes(own, len(own)), len(own))[0]
    fresh = np.ones(len(out), bool)
    for i in long:
        out[first[i] : first[i + 1]].sort()
    fresh[1:] = out[1:] != out[:-1]
    fresh[first[:-1][length > 0]] = True
    kept = np.append(0, np.cumsum(fresh))
    return out[fresh], kept[first]
