"""Token ids of whole texts by a public tokenizer file, many texts at once.

Texts are cut before white space that follows a visible character, and before a punctuation mark that follows
an ASCII letter. Both public vocabularies split there in any case and look no further back, so the ids of the
pieces, joined, are the ids of the text; equal pieces are encoded once for each task.
"""

from __future__ import annotations

import ctypes
import os
import sys
from array import array
from bisect import bisect_left
from contextlib import suppress
from operator import itemgetter
from types import ModuleType

import numpy as np
import pyarrow as pa

from lexistat.llm.frames import SPACES
from lexistat.llm.words import IS_SPACE, ranges, text_bytes

CACHE_BYTES = 128_000_000
AT_ONCE = 4096  # pieces whose encodings are held together
JOINED = 32  # pieces encoded as one text
ENTRY_BYTES = 180  # of a dictionary entry and its two objects, besides their content
IS_LETTER, IS_MARK = np.zeros(256, bool), np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
IS_MARK[list(b".,;:!?*#$%&)")] = True


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where a piece starts, and the end of the data.

    The character before a cut is visible: ASCII from ! to ~, or a letter of two bytes from U+00C0 on, so no
    white space outside ASCII is ever parted from the white space after it.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    before = np.zeros(n, bool)
    before[1:] = (data[:-1] > 32) & (data[:-1] < 127)
    before[2:] |= (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & (data[1:-1] >= 0x80)
    cut = before & IS_SPACE[data]
    cut[1:] |= IS_LETTER[data[:-1]] & IS_MARK[data[1:]]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.append(np.flatnonzero(cut), n)


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker. Spark reuses workers for many tasks; functions are sent by value, so
    what a worker keeps lies in a module of its own, and known pieces serve later tasks too."""
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def forget_pieces() -> None:
    """Let go of what this worker kept; called where a worker turns to another operator with large arrays."""
    sys.modules.pop("_kept_by_worker", None)
    release_unused()


def release_unused() -> None:
    """Give back what this worker has freed: an idle worker otherwise keeps the most that any of its tasks held."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has this call
        ctypes.CDLL(None).malloc_trim(0)


class Encoder:
    """Encodes columns of texts; keeps the ids of pieces seen before, in two generations of bounded bytes.

    A full generation becomes the old one, and pieces met again move to the new one, so frequent pieces stay.
    """

    def __init__(self, path: str, most: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.old, self.size, self.most = Tokenizer.from_file(path), {}, {}, 0, most // 2
        self.with_offsets = self.tokenizer.encode_batch

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit numbers."""
        known, old = self.known, self.old
        out = list(map(known.get, pieces))
        missed = [i for i, ids in enumerate(out) if ids is None]
        if missed:
            fresh = [pieces[i] for i in missed]
            again = list(map(old.get, fresh))
            new = [p for p, ids in zip(fresh, again) if ids is None]
            made = iter(self.fresh_ids(new))
            added = [next(made) if ids is None else ids for ids in again]
            known.update(zip(fresh, added))
            for i, ids in zip(missed, added):
                out[i] = ids
            self.size += ENTRY_BYTES * len(added) + sum(map(len, fresh)) + sum(map(len, added))
            if self.size > self.most:
                self.known, self.old, self.size = {}, known, 0
        return out

    def fresh_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are not kept.

        An encoding costs more than its few ids, so pieces from white space to a visible ASCII character are encoded
        many as one text, which is cut between them in any case; the offset of an id tells its piece.
        """
        out: list[bytes] = [b""] * len(pieces)
        whole = [i for i, p in enumerate(pieces) if p[0] in SPACES and "!" <= p[-1] <= "~"]
        alone = sorted(set(range(len(pieces))).difference(whole))
        for at in range(0, len(alone), AT_ONCE):  # an encoding takes many times the memory of its ids
            some = alone[at : at + AT_ONCE]
            found = self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)
            for i, e in zip(some, found):
                out[i] = array("I", e.ids).tobytes()
        for at in range(0, len(whole), AT_ONCE):
            some = whole[at : at + AT_ONCE]
            groups = [[pieces[i] for i in some[a : a + JOINED]] for a in range(0, len(some), JOINED)]
            found = self.with_offsets(["".join(g) for g in groups], add_special_tokens=False)
            rows = iter(some)
            for group, e in zip(groups, found):
                ids = array("I", e.ids).tobytes()
                first = list(map(itemgetter(0), e.offsets))
                begin, used = 0, 0
                for piece in group:
                    begin += len(piece)
                    till = bisect_left(first, begin, used)
                    out[next(rows)] = ids[4 * used : 4 * till]
                    used = till
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them); null as empty."""
        data, offsets = text_bytes(texts)
        cuts = cut_places(data, offsets)
        if len(cuts) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(
            pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        values = self.ids_of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat = np.frombuffer(b"".join(values), "<u4")
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(length))), pa.array(flat)).take(pieces.indices)
        return lists.values.to_numpy(), lists.offsets.to_numpy()[np.searchsorted(cuts, offsets)]
