"""Language-model scores of documents by stupid backoff (Brants et al., 2007), as joins on hashed n-grams.

Documents are dealt into batches by a hash of their rows. Each batch asks for the counts of its distinct n-grams:
the requests are partitioned by the hash of the n-gram, where a bucket adds up the counts of all batches, and the
answers are joined back to their batch. Only distinct n-grams of a batch with their counts are shuffled, so a word
or n-gram of a third of all text is one row for each batch. Keys travel as their sorted differences, and differences
and counts as compressed byte planes, since few of their bytes say anything.

S(w | context) = count(context w) / count(context) if count(context w) >= least, else 0.4 S(w | shorter context);
a single word has count / words of the corpus. Counts are those of all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistat.llm.frames import col
from lexistat.llm.words import U64, Words, mix, text_bytes, window_hashes

ORDER = 3
BACKOFF = 0.4
LEAST = 2
BATCH_BYTES = 8_000_000
BUCKET_BYTES = 4_000_000
PLANES = 6  # bytes of a number that is sent: of a key within its bucket, or a count
MOST = 2**32 - 1  # counts beyond it are sent as this


def grams(words: Words, order: int) -> list[np.ndarray]:
    """For each order n, the key of the n-gram that ends at each word; 0 where the text has no such n-gram."""
    hashed, out = words.hashes(), []
    place = np.arange(len(hashed)) - np.repeat(words.first[:-1], np.diff(words.first))
    for n in range(1, order + 1):
        keys = np.zeros(len(hashed), U64)
        if len(hashed) >= n:
            keys[n - 1 :] = mix(window_hashes(hashed, n), n) | U64(1)
        keys[place < n - 1] = 0
        out.append(keys)
    return out


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers below 2**48 byte by byte, lowest bytes of all first, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PLANES].T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def widen(packed: bytes, many: int) -> np.ndarray:
    """The `many` numbers that `squeeze` made into bytes."""
    out = np.zeros((many, 8), np.uint8)
    if many:
        out[:, :PLANES].T[:] = np.frombuffer(pa.decompress(packed, many * PLANES, codec="zstd"), np.uint8).reshape(PLANES, many)
    return out.view("<u8").ravel()


def log_scores(keys: list[np.ndarray], counts: list[np.ndarray], total: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(natural logarithm of the score, order used) of each word."""
    score, used = np.log(np.maximum(counts[0], 1) / max(total, 1)), np.ones(len(counts[0]), np.int64)
    for n in range(2, len(keys) + 1):
        has = keys[n - 1] > 0
        context = np.append(1, counts[n - 2][:-1])
        good = has & (counts[n - 1] >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = np.log(counts[n - 1] / np.maximum(context, 1))
        score = np.where(good, direct, score + np.where(has, math.log(BACKOFF), 0.0))
        used = np.where(good, n, used)
    return score, used


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, least: int = LEAST,
) -> DataFrame:
    """doc_id, n_words, log_score (sum over words), n_backed_off (words scored below the highest order they allow).

    A null or empty text has no words and score 0. Repeated rows each get their score, and all of them count.
    An empty table gives an empty table.
    """
    slim = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(size / BATCH_BYTES))
    bits = max(3, min(24, math.ceil(math.log2(max(size / BUCKET_BYTES, 1)))))
    dealt = slim.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int"))

    def keys_of(table: pa.Table) -> tuple[Words, list[np.ndarray], np.ndarray, np.ndarray]:
        words = Words(*text_bytes(table.column("text")))
        keys = grams(words, order)
        flat = np.concatenate(keys)
        found, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
        return words, keys, inverse, np.stack([found, times.astype(U64)])

    def ask(table: pa.Table) -> pa.Table:
        """For each bucket the distinct keys of a batch (sorted) and their counts; bucket -1 has its words."""
        words, _, _, (found, times) = keys_of(table)
        rest = (found << U64(bits)) >> U64(16)
        owner = (found >> U64(64 - bits)).astype(np.int64)  # rises with the keys
        edges = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
        rows = [(-1, len(words.start), b"", b"")]
        for a, b in zip(edges, edges[1:]):
            own = rest[a:b]
            rows.append((int(owner[a]), int(b - a), squeeze(np.diff(own, prepend=U64(0))), squeeze(np.minimum(times[a:b], U64(MOST)))))
        batch = table.column("batch")[0].as_py()
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([batch] * len(rows), pa.int32()),
            "many": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary()),
            "times": pa.array([r[3] for r in rows], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        """The counts of each batch's keys over all batches, in the order asked; bucket -1 has the words of all."""
        many = table.column("many").to_numpy()
        if table.column("bucket")[0].as_py() < 0:
            many, sums = np.full(len(many), many.sum()), [b""] * len(many)
        else:
            key = np.concatenate([np.cumsum(widen(x, n), dtype=U64) for x, n in zip(table.column("keys").to_pylist(), many)])
            times = np.concatenate([widen(x, n) for x, n in zip(table.column("times").to_pylist(), many)])
            _, inverse = np.unique(key, return_inverse=True)
            counts = np.bincount(inverse, weights=times).astype(U64)[inverse]
            counts, ends = np.minimum(counts, U64(MOST)), np.cumsum(many)
            sums = [squeeze(counts[e - n : e]) for n, e in zip(many, ends)]
        return pa.table({"batch": table.column("batch").cast(pa.int32()), "bucket": table.column("bucket").cast(pa.int32()),
                         "many": pa.array(many, pa.int64()), "counts": pa.array(sums, pa.binary())})

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        words, keys, inverse, _ = keys_of(rows)
        order_of = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        parts, many = answers.column("counts").to_pylist(), answers.column("many").to_numpy()
        total = int(many[order_of[0]])
        counts = np.concatenate([np.zeros(0, U64)] + [widen(parts[i], many[i]) for i in order_of[1:]]).astype(np.float64)[inverse]
        counts = counts.reshape(order, -1)
        scores, used = log_scores(keys, list(counts), total, least)
        most = np.sum([k > 0 for k in keys], axis=0)
        n = np.diff(words.first)
        off = np.append(0, np.cumsum(used < most))
        sums = np.zeros(len(n))
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(scores, words.first[:-1][full])
        return pa.table({
            "doc_id": rows.column("doc_id"), "n_words": n, "log_score": sums,
            "n_backed_off": off[words.first[1:]] - off[words.first[:-1]],
        })

    asked = dealt.groupBy("batch").applyInArrow(ask, "bucket int, batch int, many bigint, keys binary, times binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "batch int, bucket int, many bigint, counts binary")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        score, "doc_id bigint, n_words bigint, log_score double, n_backed_off bigint")
