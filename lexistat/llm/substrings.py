"""Substring deduplication: words inside passages that an earlier document holds already are removed.

A passage is any run of `window` consecutive words. The corpus is its own reference. A reference shard is all
that the documents hold around one anchor, the smallest hash of the six-word groups of a window: equal windows
have equal anchors, so a window only needs the shard of its anchor. Each shard gets a suffix automaton, filled
in ascending order of doc_id; the runs of a document are streamed through it before they are added, and where
the matching statistics reach `window`, the words go.

Only anchors that occur twice are dealt out. Which ones do comes from counts over all documents, kept in a
filter of fixed size that is broadcast; a wrong bit only deals out a run in vain. A run that occurs several
times in one batch of a task is sent once: for the later documents the answer is known there.
The runs of a frequent anchor are cut into single windows, each with its own hash as anchor: equal windows still
meet, and a passage that many documents hold among different neighbours doesn't fill one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistat.llm.automaton import Automaton
from lexistat.llm.frames import col, free_name, settle
from lexistat.llm.jaccard import Filter, REPEAT_BITS, bucket_bits, by_bucket, joined, rest_of
from lexistat.llm.tokens import forget_pieces, release_unused
from lexistat.llm.words import U64, Words, batches, mix, ranges, text_bytes, window_hashes

WINDOW = 13
GRAM = 6
PIECE = 64
HOT = 4096  # runs of an anchor from which on they are cut into windows
HOT_BITS = 1 << 22
BATCH_BYTES = 8_000_000
COUNT_BYTES = 2_000_000  # counts of a batch are small, so smaller batches send little more


def runs(words: Words, hashed: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, anchor) of the maximal runs of windows that have the same anchor.

    Runs of more than PIECE windows are cut: a word repeated for pages then gives equal pieces, sent once."""
    gram = min(GRAM, window)
    low = window_hashes(hashed, gram)
    width, reach = window - gram + 1, 1
    while reach < width:  # minimum over `width` neighbours, by doubling
        step = min(reach, width - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    a, b = words.first[:-1], np.maximum(words.first[1:] - window + 1, words.first[:-1])
    at = ranges(a, b)
    text = np.repeat(np.arange(len(a)), b - a)
    if not len(at):
        return text, at, at, np.zeros(0, U64)
    anchor = low[at]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    number = np.diff(np.append(new, len(at)))
    new = ranges(np.zeros(len(new), np.int64), -(-number // PIECE)) * PIECE + np.repeat(new, -(-number // PIECE))
    # A minimum of hashes is small: mixed, anchors fill buckets and filter slices evenly.
    return text[new], at[new], np.diff(np.append(new, len(at))), mix(anchor[new], 9)


def cut_hot(runs_: tuple[np.ndarray, ...], hot: np.ndarray, hashed: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The same windows, those of the runs marked in `hot` each as a run whose anchor is the window's hash."""
    text, first, number, anchor = runs_
    times = np.where(hot, number, 1)
    row = np.repeat(np.arange(len(number)), times)
    first = ranges(first, first + times)
    whole = hot[row]
    own = anchor[row]
    own[whole] = mix(window_hashes(hashed, window)[first[whole]], 9)
    return text[row], first, np.where(whole, 1, number[row]), own


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (.., doc, mark, first word, words) with those that follow and touch in one document as one."""
    if not len(spans):
        return spans
    same = (spans[1:, 1:3] == spans[:-1, 1:3]).all(1) & (spans[1:, 3] >= spans[:-1, 3])
    same &= spans[1:, 3] <= spans[:-1, 3] + spans[:-1, 4]
    new = np.flatnonzero(np.append(True, ~same))
    out = spans[new]
    out[:, 4] = np.maximum.reduceat(spans[:, 3] + spans[:, 4], new) - out[:, 3]
    return out


def anchor_filter(docs: DataFrame, window: int, bits: int, hot: int) -> tuple[np.ndarray, Filter, np.ndarray, Filter]:
    """Bits of the anchors that occur twice or more in all documents, and of those of more than `hot` runs."""
    repeat, often = Filter(bits, REPEAT_BITS), Filter(bits, HOT_BITS)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        for part in batches(parts, "text", COUNT_BYTES):
            words = Words(*text_bytes(part.column("text")))
            anchors, times = np.unique(runs(words, words.hashes(), window)[3], return_counts=True)
            rows = list(by_bucket(anchors >> U64(64 - bits), rest_of(anchors, bits), times.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in rows], pa.int32()), pa.array([v[0] for _, v in rows], pa.binary()),
                pa.array([v[1] for _, v in rows], pa.binary()),
            ], ["bucket", "rest", "times"])
        release_unused()

    def mark(table: pa.Table) -> pa.Table:
        rest, times = joined(table, "rest", np.uint32), joined(table, "times", np.uint32)
        order = np.argsort(rest, kind="stable")
        rest, times = rest[order], times[order]
        starts = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
        counts = np.add.reduceat(times.astype(np.int64), starts)
        rest = rest[starts]
        return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()),
                         "repeat": pa.array([repeat.slice_of(rest[counts > 1])], pa.binary()),
                         "often": pa.array([often.slice_of(rest[counts > hot])], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "bucket int, rest binary, times binary")
    found = rows.groupBy("bucket").applyInArrow(mark, "bucket int, repeat binary, often binary").collect()  # 17 MB in all
    return (repeat.whole({r.bucket: bytes(r.repeat) for r in found}), repeat,
            often.whole({r.bucket: bytes(r.often) for r in found}), often)


def matched(words: np.ndarray, facts: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(doc, mark, first word, words) of what earlier documents hold, for the runs of one bucket.

    facts: anchor, doc, mark, first word, number of words of each run, in the order of `words`.
    """
    if not len(facts):
        return []
    ends = np.cumsum(facts[:, 4])
    order = np.lexsort((facts[:, 1], facts[:, 0]))
    out, i, n = [], 0, len(order)
    anchors, docs = facts[order, 0], facts[order, 1]
    shard_ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, n)
    for stop in shard_ends:
        if docs[i] == docs[stop - 1]:  # one document alone
            i = stop
            continue
        shard, held = Automaton(), set()
        while i < stop:
            same = i
            while same < stop and docs[same] == docs[i]:
                same += 1
            fresh = []
            for k in order[i:same]:
                _, doc, mark, first, size = facts[k].tolist()
                own = words[ends[k] - size : ends[k]]
                key = own.tobytes()
                if key in held:
                    out.append((doc, mark, first, size))
                    continue
                sequence = own.tolist()
                fits = [e for e, m in enumerate(shard.matches(sequence)) if m >= window] if shard.added else []
                start = None
                for e in fits:
                    if start is not None and e == last + 1:
                        last = e
                        continue
                    if start is not None:
                        out.append((doc, mark, first + start, last + 1 - start))
                    start, last = e - window + 1, e
                if start is not None:
                    out.append((doc, mark, first + start, last + 1 - start))
                fresh.append((key, sequence, len(fits) < size - window + 1))
            for key, sequence, new in fresh:
                if key not in held:
                    held.add(key)
                    if new and same < stop:
                        shard.add(sequence)
            i = same
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc, mark, spans) from docs (doc, mark, text): first word and number of words of every repeated passage,
    as 32-bit numbers, in one row for each document that has any."""
    bits = bucket_bits(docs)
    twice, repeat, many, often = anchor_filter(docs, window, bits, hot)
    sent = docs.sparkSession.sparkContext.broadcast((twice, many))  # of fixed size, 17 MB

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        for part in batches(parts, "text", BATCH_BYTES):
            words = Words(*text_bytes(part.column("text")))
            hashed = words.hashes()
            text, first, number, anchor = runs(words, hashed, window)
            keep = repeat.hit(sent.value[0], anchor)
            text, first, number, anchor = text[keep], first[keep], number[keep], anchor[keep]
            text, first, number, anchor = cut_hot(
                (text, first, number, anchor), often.hit(sent.value[1], anchor), hashed, window)
            size = number + window - 1
            doc = part.column("doc").to_numpy(zero_copy_only=False)[text]
            mark = part.column("mark").to_numpy(zero_copy_only=False)[text]
            start = first - words.first[text]
            # A name for the content of each run: a sum of its words by place.
            at = ranges(first, first + size)
            place = at - np.repeat(first, size)
            ends = np.cumsum(size)
            name = np.zeros(0, U64)
            if len(size):
                name = mix(np.add.reduceat(mix(hashed[at] + mix(place.astype(U64), 5), 6), ends - size) ^ anchor)
            order = np.lexsort((doc, name))
            new = np.append(True, name[order][1:] != name[order][:-1]) if len(order) else np.zeros(0, bool)
            least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else doc
            known = np.zeros(len(order), bool)
            known[order] = doc[order] > least
            ask = np.flatnonzero(~known)
            known = np.flatnonzero(known)
            facts = np.stack([anchor.view(np.int64), doc, mark, start, size], 1).astype(np.int64)
            rows = []
            bucket = (anchor[ask] >> U64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.append(0, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else np.zeros(0, int)
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                own = ask[order[a:b]]
                rows.append((int(bucket[order[a]]), hashed[ranges(first[own], first[own] + size[own])].tobytes(),
                             facts[own].tobytes(), b""))
            known = merged(facts[known])
            for k, v in by_bucket(mix(known[:, 1].astype(U64)) >> U64(64 - bits), known):
                rows.append((k, b"", b"", v[0]))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))
            ], ["bucket", "words", "asked", "known"])
        release_unused()

    def match(table: pa.Table) -> pa.Table:
        found = matched(joined(table, "words", U64), joined(table, "asked", np.int64).reshape(-1, 5), window)
        spans = np.concatenate([np.array(found, np.int64).reshape(-1, 4), joined(table, "known", np.int64).reshape(-1, 5)[:, 1:]])
        spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
        edges = np.flatnonzero(np.append(True, (np.diff(spans[:, :2], axis=0) != 0).any(1))) if len(spans) else np.zeros(0, int)
        return pa.table({
            "doc": spans[edges, 0], "mark": spans[edges, 1],
            "spans": pa.array([spans[a:b, 2:].astype(np.int32).tobytes() for a, b in zip(
                edges, np.append(edges[1:], len(spans)))], pa.binary()),
        })

    dealt = docs.where("doc is not null").select("doc", "mark", "text").mapInArrow(
        deal, "bucket int, words binary, asked binary, known binary")
    found = dealt.groupBy("bucket").applyInArrow(match, "doc bigint, mark bigint, spans binary")
    return found.groupBy("doc", "mark").agg(F.collect_list("spans").alias("spans"))  # at most a document's words


def kept_words(texts: pa.Array, spans: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of some texts, and which of them stay."""
    words = Words(*text_bytes(texts))
    edge = np.zeros(len(words.start) + 1, np.int64)
    for i, lists in enumerate(spans.to_pylist()):
        if lists:
            own = np.frombuffer(b"".join(lists), np.int32).reshape(-1, 2).astype(np.int64)
            np.add.at(edge, words.first[i] + own[:, 0], 1)
            np.add.at(edge, words.first[i] + own[:, 0] + own[:, 1], -1)
    return words, np.cumsum(edge)[:-1] == 0


def text_of(words: Words, kept: np.ndarray, i: int) -> bytes:
    """The kept words of text i, joined by one space."""
    own = np.arange(words.first[i], words.first[i + 1])
    own = own[kept[own]]
    data = words.data.tobytes() if not hasattr(words, "raw") else words.raw
    words.raw = data
    return b" ".join(data[a:b] for a, b in zip(words.start[own].tolist(), words.end[own].tolist()))


def with_spans(docs: DataFrame, doc_id: str, text: str, window: int, hot: int = HOT) -> tuple[DataFrame, str]:
    """The rows of `docs` with the repeated passages of each in a new column, and that column's name."""
    slim = docs.select(col(doc_id).cast("bigint").alias("doc"), F.xxhash64(col(text)).alias("mark"), col(text).alias("text"))
    spans = settle(repeated_spans(slim, window, hot))
    name, key, mark = (free_name(docs, x) for x in ("_spans", "_doc", "_mark"))
    spans = spans.toDF(key, mark, name)
    joined_rows = docs.join(spans, (col(doc_id).cast("bigint") == col(key)) & (F.xxhash64(col(text)) == col(mark)), "left")
    return joined_rows.select(*[col(c) for c in docs.columns], col(name)), name


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of `docs` with repeated passages removed from their texts.

    A text that loses words becomes its kept words joined by one space (empty if none is left); other texts,
    null and empty ones included, stay as they are. Windows are judged on the input. The first document with a
    passage is the one with the smallest doc_id. Rows with equal ids are one document: they do not remove words
    from each other. Rows without an id keep their text and take no part. An empty table stays empty.
    """

    @F.arrow_udf("string")
    def strip(texts: pa.Array, spans: pa.Array) -> pa.Array:
        words, kept = kept_words(texts, spans)
        old = texts.to_pylist()
        return pa.array([
            text_of(words, kept, i).decode() if s else old[i] for i, s in enumerate(spans.to_pylist())
        ], pa.string())

    rows, spans = with_spans(docs, doc_id, text, window)
    return rows.select(*[
        strip(col(text), col(spans)).alias(text) if c == text else col(c) for c in docs.columns
    ])


def repeat_digests(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, from the texts that `strip_repeats` leaves."""

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, "text", BATCH_BYTES):
            words, kept = kept_words(part.column("text"), part.column("spans"))
            total = np.append(0, np.cumsum(kept))
            n = np.diff(words.first)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(n), pa.array(n - (total[words.first[1:]] - total[words.first[:-1]])),
                pa.array([hashlib.sha256(text_of(words, kept, i)).hexdigest() for i in range(len(n))], pa.string()),
            ], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows, spans = with_spans(docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")),
                             "doc_id", "text", window, hot)
    return rows.select("doc_id", "text", col(spans).alias("spans")).mapInArrow(
        digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
