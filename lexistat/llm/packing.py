"""Best-fit packing of token sequences by minimum bin slack.

Bins depend on lengths alone, so they are planned on the histogram of lengths: at most `capacity` counters,
however many documents there are. Each step takes the longest length left, finds with a bitset subset-sum over
the lengths left the fullest combination for the rest of the bin, and removes it as often as the counters
allow. Pieces of one length are then numbered without one big task, and take the places of the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistat.functions.ranks import hash_order, number_by_hash
from lexistat.llm.frames import arrow_rows, col, settle
from lexistat.llm.tokens import release_unused, worker_encoder
from lexistat.llm.words import batches

CAPACITY = 4096
END_ID = 1
HELD_BYTES = 1_000_000  # of text at once: a pipeline packs in executors that its earlier stages have filled
HELD_ROWS = 1000  # sent to a Python worker at once


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the lengths left whose sum is the largest one up to `room` (bit i: sum i is reachable)."""
    whole, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        before, left, step = reach, min(counts[length], room // length), 1
        while left > 0:  # up to `left` copies, in powers of two
            step = min(step, left)
            reach |= (reach << (length * step)) & whole
            left, step = left - step, step * 2
        if reach != before:
            layers.append((length, before))
        if reach >> room:
            break
    rest, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        while not (before >> rest) & 1:
            rest -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: copies}) of each kind of bin; lengths from 1 to capacity."""
    left, plan = {n: c for n, c in histogram.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = {n: c for n, c in left.items() if c > 0}
        chosen = fullest(rest, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        plan.append((times, chosen))
    return plan


def plan_rows(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, copies, first sequence, place in the sequence) of the plan."""
    rows, used, sequence = [], {}, 0
    for times, chosen in plan:
        place = 0
        for length in sorted(chosen, reverse=True):
            copies, first = chosen[length], used.get(length, 0)
            used[length] = first + copies * times
            rows.append((length, first, used[length], copies, sequence, place))
            place += copies * length
        sequence += times
    return rows


def pack(pieces: DataFrame, length: str, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Rows with `length` (1 to capacity) get sequence_id and offset; `keys` name a row.

    The sequences are numbered from 0; offsets run without gaps from 0. Rows with equal keys keep places of
    their own. An empty table stays empty. A length outside 1 to capacity raises an error.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy(col(length)).count().collect()}  # capacity rows at most
    wrong = [n for n in histogram if n is None or not 1 <= n <= capacity]
    if wrong:
        raise ValueError(f"lengths must be 1 to {capacity}, not {wrong[0]}")
    plan = np.array(plan_rows(plan_bins(histogram, capacity)), np.int64).reshape(-1, 6)
    # An Arrow table: rows of Python objects would be pickled anew by workers of their own, which then stay.
    places = pieces.sparkSession.createDataFrame(pa.table({
        name: plan[:, i] for i, name in enumerate(["its_length", "first", "after", "copies", "sequence", "place"])
    }))
    ordered = pieces.withColumn("_order", hash_order("pack", *[col(k) for k in keys]))
    ranked = number_by_hash(ordered, "_order", keys, [length], "_rank").withColumn("_rank", F.col("_rank") - 1)
    # The plan has a few rows for each of the lengths, so its size does not grow with the documents.
    joined = ranked.join(
        F.broadcast(places),
        (col(length) == F.col("its_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("after")),
    )
    at = F.col("_rank") - F.col("first")
    return joined.select(
        *[col(c) for c in pieces.columns],
        (F.col("sequence") + F.floor(at / F.col("copies")).cast("bigint")).alias("sequence_id"),
        (F.col("place") + at % F.col("copies") * col(length)).cast("bigint").alias("offset"),
    )


def token_pieces(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece: a document's ids, then the end id.

    Only documents longer than `capacity` are cut; a null or empty text is the end id alone. Rows with equal
    or null ids are documents of their own.
    """
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for part in batches(parts, "text", HELD_BYTES):
            ids, first = encoder.encode(part.column("text"))
            length = np.diff(first) + 1
            number = -(-length // capacity)
            row = np.repeat(np.arange(len(length)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            size = np.minimum(length[row] - start, capacity)
            made = []
            for r, s, n in zip(row, start, size):
                own = ids[first[r] + s : min(first[r] + s + n, first[r + 1])]
                made.append(np.append(own, end_id).astype("<u4") if len(own) < n else own.astype("<u4"))
            columns = [
                part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(size, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in made], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in made], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        release_unused()

    return docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")).mapInArrow(cut, fields)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their places: sequence_id and offset."""
    pieces = token_pieces(docs, vocabulary, capacity=capacity, end_id=end_id)
    with arrow_rows(docs.sparkSession, HELD_ROWS):
        pieces = settle(pieces)
    return pack(pieces, "length", ["doc_id", "piece", "ids_crc32"], capacity)
