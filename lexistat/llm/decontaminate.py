"""Benchmark decontamination: passages within a few word edits of a benchmark item, found by CGK and LSH.

The CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) walks through a sequence and, at each step, writes
the word it stands on and moves on or stays by a random bit of word and step. Sequences at a small edit distance
meet again after an edit and agree in most places, so their Hamming distance is small; bit sampling then finds
them: tables of hashes of a few sampled places, over several walks. Windows have the length of an item. By the
q-gram lemma a passage within the allowed edits keeps some three-word groups of its item (shorter groups for the
shortest items), so from each such group a window is laid where the item would begin, whatever other items hold
around it. Candidates are verified by the exact edit distance over the surrounding words.

Words are compared with A-Z in lower case. Documents are only read: no shuffle, no join.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistat.llm.frames import col, free_name
from lexistat.llm.words import U64, Words, mix, ranges, text_bytes, window_hashes

EDIT_PERCENT = 20
CHANCE_WORDS = 5  # shorter items occur by chance, so that they alone remove no document
GRAM = 3
WALKS = 4
TABLES = 10  # for each walk
SAMPLED = 3
BLOCK_BYTES = 8_000_000
BATCH_BYTES = 4_000_000
SEEDS = 2_000_000
HIT = "array<struct<item_id bigint, distance int, first_word int, n_words int>>"
HIT_TYPE = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32())
]))


def allowed(length: int, percent: int) -> int:
    return length * percent // 100


def group_size(length: int, percent: int) -> int:
    """The words of a group: the most, up to GRAM, of which one is sure to stay whole in a passage."""
    for size in range(GRAM, 1, -1):
        if length - size + 1 > size * allowed(length, percent):
            return size
    return 1


class Groups:
    """The word groups of one size of some items: for each group the (length, place) at which items hold it.

    An item lists its rarest groups only: as many as the allowed edits can destroy, and one more."""

    def __init__(self, size: int, items: list[np.ndarray], percent: int):
        self.size = size
        lengths = np.array([len(w) for w in items])
        number = lengths - size + 1
        grams = np.concatenate([window_hashes(w, size) for w in items])
        self.all, held, times = np.unique(grams, return_inverse=True, return_counts=True)
        item = np.repeat(np.arange(len(items)), number)
        place = ranges(np.zeros(len(items), np.int64), number)
        order = np.lexsort((place, times[held], item))  # of each item, the rarest first
        rank = np.empty(len(order), np.int64)
        rank[order] = place  # lexsort keeps items together, so places count up there too
        sure = rank <= size * (lengths * percent // 100)[item]
        rows = np.stack([held, lengths[item], place], 1)[sure]
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))]
        self.first = np.searchsorted(rows[:, 0], np.arange(len(self.all) + 1))
        self.length, self.place = rows[:, 1], rows[:, 2]
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.all & U64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashed: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of `hashed` where a text holds a group, numbers of these groups)."""
        grams = window_hashes(hashed, self.size)
        at = np.flatnonzero(self.quick[(grams & U64((1 << 20) - 1)).astype(np.int64)]
                            & (np.arange(len(grams)) + self.size <= end[: len(grams)]))
        near = np.minimum(np.searchsorted(self.all, grams[at]), len(self.all) - 1)
        same = self.all[near] == grams[at]
        return at[same], near[same]

    def starts(self, hits: np.ndarray, groups: np.ndarray, begin: np.ndarray, end: np.ndarray,
               percent: int) -> dict[int, np.ndarray]:
        """For each length of items, where windows begin: a hit less the place of its group in an item. They lie
        in the text of the hit but for the edits allowed."""
        number = self.first[groups + 1] - self.first[groups]
        ends, keys, a = np.cumsum(number), [], 0
        while a < len(hits):  # bounded parts: a common group stands at many places of items
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - number[a] + SEEDS, "right")))
            row, at = ranges(self.first[groups[a:b]], self.first[groups[a:b] + 1]), np.repeat(hits[a:b], number[a:b])
            length, start = self.length[row], at - self.place[row]
            most = length * percent // 100
            inside = (start >= begin[at] - most) & (start + length <= end[at] + most)
            keys.append(np.unique((length << 40 | np.maximum(start, begin[at]))[inside]))
            a = b
        whole = np.unique(np.concatenate(keys))
        edges = np.flatnonzero(np.diff(whole >> 40)) + 1
        return {int(own[0] >> 40): own & ((1 << 40) - 1) for own in np.split(whole, edges) if len(own)}


def sampled_places(length: int, walk: int) -> np.ndarray:
    """The sampled steps of each table, from 0 to 3 * length - 1."""
    numbers = mix(np.arange(TABLES * SAMPLED, dtype=U64), 1000 * length + walk)
    return (numbers % U64(3 * length)).astype(np.int64).reshape(TABLES, SAMPLED)


def cgk_keys(windows: np.ndarray) -> np.ndarray:
    """The table keys of each row of word hashes: (rows, WALKS * TABLES)."""
    rows, length = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), U64)], 1)  # past the end: an empty word
    at_row, out = np.arange(rows), []
    for walk in range(WALKS):
        places = sampled_places(length, walk)
        seen, place = np.zeros((3 * length, rows), U64), np.zeros(rows, np.int64)
        seeds = mix(np.arange(3 * length, dtype=U64), 77 + walk) | U64(1)
        for step in range(int(places.max()) + 1):
            word = padded[at_row, place]
            seen[step] = word
            with np.errstate(over="ignore"):
                bit = ((word ^ (word >> U64(29))) * seeds[step]) >> U64(63)
            place = np.minimum(place + bit.astype(np.int64), length)
        for table in range(TABLES):
            key = np.full(rows, U64(walk * TABLES + table))
            for p in places[table]:
                key = mix(key ^ seen[p], 3)
            out.append(key)
    return np.stack(out, 1)


def last_row(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Edit distances of the whole item to the best substring that ends at each place of `words` (0: before all)."""
    steps = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, x in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (words != x), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    return row


def best_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the substring nearest to the item; of equals the first end, then the longest."""
    row = last_row(item, words)
    end = int(row.argmin())
    back = last_row(item[::-1], words[:end][::-1])
    size = int(np.flatnonzero(back == row[end]).max(initial=0))
    return int(row[end]), end - size, end


class Items:
    """The items of one block: word hashes, their three-word groups, and the tables for each length."""

    def __init__(self, ids: list[int], texts: list[str], percent: int, least_words: int = 1):
        words = Words(*text_bytes(pa.array(texts, pa.string()), True))
        hashed = words.hashes()
        self.percent, self.ids, self.words = percent, [], []
        for i, a, b in zip(ids, words.first, words.first[1:]):
            if b - a >= max(1, least_words):
                self.ids.append(i)
                self.words.append(hashed[a:b])
        by_length = defaultdict(list)
        for i, w in enumerate(self.words):
            by_length[len(w)].append(i)
        self.tables = {}
        for length, own in by_length.items():
            keys = cgk_keys(np.stack([self.words[i] for i in own]))
            order = np.argsort(keys.ravel(), kind="stable")
            self.tables[length] = keys.ravel()[order], np.repeat(np.array(own), keys.shape[1])[order]
        by_size = defaultdict(list)
        for w in self.words:
            by_size[group_size(len(w), percent)].append(w)
        self.groups = [Groups(size, own, percent) for size, own in by_size.items()]

    def candidates(self, hashed: np.ndarray, begin: np.ndarray, end: np.ndarray) -> set[tuple[int, int]]:
        """(item, first word of the window) for windows laid from the groups of each item; begin, end: the bounds
        of the text that each word belongs to."""
        found: set[tuple[int, int]] = set()
        for groups in self.groups:
            hits, numbers = groups.find(hashed, end)
            if not len(hits):
                continue
            total = np.cumsum(np.bincount(hits + 1, minlength=len(hashed) + 1))  # hits before each word
            for length, starts in groups.starts(hits, numbers, begin, end, self.percent).items():
                most = allowed(length, self.percent)
                need = max(1, length - groups.size + 1 - groups.size * most)  # what a passage keeps at least
                first = np.maximum(starts - most, begin[starts])
                last = np.minimum(starts + length + 2 * most, end[starts]) - groups.size + 1
                self.ask(length, starts[total[np.maximum(first, last)] - total[first] >= need], hashed, end, found)
        return found

    def ask(self, length: int, starts: np.ndarray, hashed: np.ndarray, end: np.ndarray, found: set) -> None:
        """Add (item, start) for the windows that share a table key with an item."""
        keys, items = self.tables[length]
        for a in range(0, len(starts), 20_000):
            own = starts[a : a + 20_000]
            place = own[:, None] + np.arange(length)
            # A window may run past its text by the edits allowed; it is filled with empty words there.
            asked = cgk_keys(np.where(place < end[own][:, None], hashed[np.minimum(place, len(hashed) - 1)], U64(0)))
            low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
            for w, t in zip(*np.nonzero(high > low)):
                found.update((int(i), int(own[w])) for i in items[low[w, t] : high[w, t]])

    def leaks(self, texts: pa.Array) -> list[list[dict]]:
        """For each text its items with distance, first word and number of words; the best passage of each."""
        words = Words(*text_bytes(texts, True))
        hashed, out = words.hashes(), [[] for _ in range(len(texts))]
        if not len(hashed) or not self.words:
            return out
        counts = np.diff(words.first)
        begin, end = np.repeat(words.first[:-1], counts), np.repeat(words.first[1:], counts)
        regions = defaultdict(list)
        for item, start in sorted(self.candidates(hashed, begin, end)):
            length = len(self.words[item])
            margin = length // 2 + allowed(length, self.percent)
            a, b = max(start - margin, int(begin[start])), min(start + length + margin, int(end[start]))
            known = regions[item, int(begin[start])]
            if known and known[-1][1] >= a:
                known[-1][1] = b
            else:
                known.append([a, b])
        for (item, first), areas in regions.items():
            own, best, most = self.words[item], None, allowed(len(self.words[item]), self.percent)
            for a, b in areas:
                area = np.sort(hashed[a:b])
                there = area[np.minimum(np.searchsorted(area, own), b - a - 1)] == own
                if len(own) - there.sum() > most:  # each word that is missing costs an edit
                    continue
                if last_row(own, hashed[a:b]).min() > most:
                    continue
                distance, x, y = best_match(own, hashed[a:b])
                if best is None or distance < best[0]:
                    best = distance, a + x, a + y
            if best:
                text = int(np.searchsorted(words.first, first, "right")) - 1
                out[text].append({"item_id": self.ids[item], "distance": best[0], "first_word": best[1] - first,
                                  "n_words": best[2] - best[1]})
        for hit in out:
            hit.sort(key=lambda h: h["item_id"])
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, most: int = BLOCK_BYTES) -> list[list[tuple[int, str]]]:
    """The items in blocks of about `most` bytes. Their sizes are measured first, so each collect is bounded;
    a benchmark is a stated query set, and every block meets all documents."""
    slim = benchmark.select(col(item_id).cast("bigint").alias("item"), col(text).alias("text")).where(
        "item is not null and text is not null")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, math.ceil(size / most))
    return [
        [(r.item, r.text) for r in slim.where(F.pmod(F.hash("item"), F.lit(number)) == b).collect()]
        for b in range(number)
    ]


def leak_column(text: Column, items: list[tuple[int, str]], spark, percent: int = EDIT_PERCENT, least_words: int = 1) -> Column:
    """The leaks of a block of items in each text, as an array of (item_id, distance, first_word, n_words)."""
    sent = spark.sparkContext.broadcast(items)

    @F.arrow_udf(HIT)
    def find(texts: pa.Array) -> pa.Array:
        if "items" not in ready:
            ready["items"] = Items([i for i, _ in sent.value], [t for _, t in sent.value], percent, least_words)
        out, at, sizes = [], 0, texts_sizes(texts)
        while at < len(texts):  # bounded parts of a large batch
            stop, room = at, BATCH_BYTES
            while stop < len(texts) and (stop == at or sizes[stop] <= room):
                room -= sizes[stop]
                stop += 1
            out.extend(ready["items"].leaks(texts.slice(at, stop - at)))
            at = stop
        return pa.array(out, HIT_TYPE)

    ready: dict[str, Items] = {}
    return find(text)


def texts_sizes(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    percent: int = EDIT_PERCENT, least_words: int = 1,
) -> tuple[DataFrame, str]:
    """The rows of `docs` with one more column, the array of leaks, and that column's name.

    A passage leaks an item of n words if its word edit distance is at most percent * n / 100, rounded down.
    Items so short that this allows no edit leak where their words stand unchanged. Items that are null, without an
    id, without words or of fewer than `least_words` words leak nowhere; null and empty texts leak nothing. Repeated rows each get the same leaks. Empty tables give no rows or empty arrays.
    """
    blocks = item_blocks(benchmark, item_id, item_text)
    found = [leak_column(col(text), items, docs.sparkSession, percent, least_words) for items in blocks]
    name = free_name(docs, "leaks")
    return docs.withColumn(name, found[0] if len(found) == 1 else F.concat(*found)), name


def remove_leaking(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", least_words: int = CHANCE_WORDS
) -> DataFrame:
    """The rows of `docs` that leak no item of `least_words` words or more.

    Every document may hold an item of one to four words by chance; with `least_words` 1 these remove documents too.
    """
    found, leaks = find_leaks(docs, benchmark, text, least_words=least_words)
    return found.where(F.size(col(leaks)) == 0).select(*[col(c) for c in docs.columns])


def leak_rows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, first_word, n_words: the best passage of each item in each leaking document."""
    slim = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    found, leaks = find_leaks(slim, benchmark, "text")
    return found.select("doc_id", F.inline(col(leaks)))
