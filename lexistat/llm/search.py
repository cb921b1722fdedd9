"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

Index: each scan task cuts its documents into shards of bounded bytes and writes one posting list per shard and
term. A list is cut into blocks of 128 postings, compressed as variable-byte gaps and counts; a block keeps its last
document, its largest count and its smallest document length, so its best possible score follows from any corpus
statistics. Nothing of the index depends on the queries.

Search: the statistics of the asked terms are summed over the shards. Every shard then answers the queries alone,
window of documents by window: list bounds split the terms of a query into essential lists, which are read, and
others, whose block maxima reject candidates before a block is decompressed. Shard heaps are merged by rank.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexistat.llm.frames import col, settle

SHARD_BYTES = 16_000_000  # of text; one longer document is a shard of its own
SHARD_ROWS = 16_384
BLOCK = 128
WINDOW = 2_048  # documents of a shard that are scored together
TOP = 20
QUERY_BYTES = 2_000_000  # of query text in one pass over the index
UNIT = 1_000_000_000
BATCH_BYTES = 16_000_000

INDEX = "shard bigint, term string, n_docs bigint, n_terms bigint, blocks binary, postings binary"
# Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. All
# bytes of a character beyond ASCII are 128 or more, so the rule holds for UTF-8 bytes too.
TO_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TO_TERMS).split(b" ") if text else []


def counted_terms(text: str | None) -> Counter:
    found = Counter(terms_of(text))
    del found[b""]
    return found


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code (seven bits a byte, the last byte below 128), and the number of bytes before each value."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28, 35, 42):
        size += values >= (1 << bits)
    ends = np.cumsum(size)
    starts = ends - size
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        more = np.where(size[some] > k + 1, 128, 0)
        out[starts[some] + k] = ((values[some] >> (7 * k)) & 127) | more
    return out, np.append(starts, len(out))


def decode(code: np.ndarray) -> np.ndarray:
    last = code < 128
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    place = np.arange(len(code)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((code & 127).astype(np.int64) << (7 * place), starts) if len(starts) else ends


class Shard:
    """Postings of documents in the order they come."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths, self.docs, self.terms, self.counts = (array("q") for _ in range(4))
        self.known: dict[bytes, int] = {}
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = counted_terms(text)
        if not found:
            return  # no term: not counted, never a result
        known = self.known
        for t in found:
            if t not in known:
                known[t] = len(known)
        self.docs.extend([len(self.ids)] * len(found))
        self.terms.extend(map(known.__getitem__, found))
        self.counts.extend(found.values())
        self.lengths.append(sum(found.values()))
        self.ids.append(doc_id)
        self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_ROWS

    def rows(self, shard: int) -> Iterator[tuple]:
        """The index rows: the documents under a null term, then one row per term."""
        lengths = np.array(self.lengths, np.int64)
        known = np.array([i is not None for i in self.ids], np.int64)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        yield shard, None, len(ids), int(lengths.sum()), np.stack([ids, known]).tobytes(), lengths.tobytes()
        terms, docs, counts = (np.array(x, np.int64) for x in (self.terms, self.docs, self.counts))
        order = np.argsort(terms, kind="stable")
        terms, docs, counts = terms[order], docs[order], counts[order]
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        sizes = np.diff(np.append(first, len(terms)))
        within = np.arange(len(terms)) - np.repeat(first, sizes)
        heads = np.flatnonzero(within % BLOCK == 0)  # where blocks start, over all lists
        before = np.empty(len(docs), np.int64)
        before[1:] = docs[:-1]
        before[heads] = -1  # gaps start anew in each block
        code, starts = encode(np.stack([docs - before - 1, counts - 1], axis=1).ravel())
        ends = np.append(heads[1:], len(docs))
        tops, shortest = np.maximum.reduceat(counts, heads), np.minimum.reduceat(lengths[docs], heads)
        at = np.append(np.searchsorted(heads, first), len(heads))
        names = list(self.known)
        for k, (f, n) in enumerate(zip(first.tolist(), sizes.tolist())):
            b = slice(at[k], at[k + 1])
            low, high = starts[2 * f], starts[2 * (f + n)]
            blocks = np.stack([docs[ends[b] - 1], tops[b], shortest[b], starts[2 * ends[b]] - low])
            yield shard, names[terms[f]].decode(), n, 0, blocks.tobytes(), code[low:high].tobytes()


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of the documents of one task, shard after shard."""
    from pyspark import TaskContext

    part, made, shard = TaskContext.get().partitionId(), 0, Shard()

    def written() -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in shard.rows((part << 32) + made):
            rows.append(row)
            size += len(row[4]) + len(row[5]) + 64
            if size > BATCH_BYTES:
                yield index_batch(rows)
                rows, size = [], 0
        yield index_batch(rows)

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, text in enumerate(texts):
            shard.add(ids[i], text.as_py())
            if shard.full():
                yield from written()
                made, shard = made + 1, Shard()
    if shard.ids:
        yield from written()


def index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = ("shard", "term", "n_docs", "n_terms", "blocks", "postings")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))


def index_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index of all documents; write it (or settle it) before searching, as its shards are numbered by
    the tasks that make them.

    Null, empty and term-free texts are in no list. Each row is a document of its own, also if ids repeat or are
    null. Texts of any length are indexed whole; an empty table gives an empty index.
    """
    return docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")).mapInArrow(index_rows, INDEX)


def corpus_sizes(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    row = index.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + (25 * lengths * n_docs) // n_terms


def impact(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight gives; grows with the count and falls with the norm."""
    return (UNIT * counts) // (1000 * counts + 12 * m)


class PostingList:
    """One term in one shard: block bounds at hand, postings only where asked for."""

    def __init__(self, blocks: bytes, postings: bytes, n_docs: int, n_terms: int) -> None:
        self.last, tops, shortest, self.ends = np.frombuffer(blocks, np.int64).reshape(4, -1)
        self.code = np.frombuffer(postings, np.uint8)
        self.bounds = impact(tops, norms(shortest, n_docs, n_terms))
        self.bound = int(self.bounds.max())
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of one block, decompressed when first asked for."""
        if b not in self.read:
            low = self.ends[b - 1] if b else 0
            gaps, counts = decode(self.code[low : self.ends[b]]).reshape(-1, 2).T
            self.read[b] = np.cumsum(gaps + 1) - 1, counts + 1
        return self.read[b]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents low to high - 1."""
        first, last = np.searchsorted(self.last, [low, high - 1])
        parts = [self.block(b) for b in range(int(first), min(int(last) + 1, len(self.last)))]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, counts = (np.concatenate(x) for x in zip(*parts))
        a, z = np.searchsorted(docs, [low, high])
        return docs[a:z], counts[a:z]

    def bound_between(self, low: int, high: int) -> int:
        """The largest bound of the blocks that may hold documents low to high - 1."""
        first, last = np.searchsorted(self.last, [low, high - 1])
        return int(self.bounds[first : last + 1].max(initial=0))

    def bounds_at(self, docs: np.ndarray) -> np.ndarray:
        """The bound of the block that would hold each document."""
        return np.append(self.bounds, 0)[np.searchsorted(self.last, docs)]

    def counts_of(self, docs: np.ndarray) -> np.ndarray:
        """The count in each of some sorted documents; only blocks that may hold one of them are read."""
        where, out = np.searchsorted(self.last, docs), np.zeros(len(docs), np.int64)
        for b in np.unique(where[where < len(self.last)]).tolist():
            held, counts = self.block(b)
            asked = np.flatnonzero(where == b)
            at = np.minimum(np.searchsorted(held, docs[asked]), len(held) - 1)
            out[asked] = np.where(held[at] == docs[asked], counts[at], 0)
        return out


def best_of_shard(
    lists: list[tuple[int, PostingList]], m: np.ndarray, ids: np.ndarray, unknown: np.ndarray, top: int
) -> list[tuple[int, int]]:
    """(document, score) of the best documents of one shard, for the weighted lists of one query.

    A document is dropped only if its bound is below the score of the top-th best so far, so equal scores are all
    compared by their ids (null ids last, then the order in the shard).
    """
    lists = sorted(lists, key=lambda x: x[0] * x[1].bound)
    sums = np.cumsum([w * x.bound for w, x in lists])
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    least = 1  # a result has a score above 0
    for low in range(0, len(m), WINDOW):
        high = min(low + WINDOW, len(m))
        rest = int(np.searchsorted(sums, least))  # these lists together stay below the threshold
        if rest == len(lists):
            break
        if least > 1 and sum(w * x.bound_between(low, high) for w, x in lists) < least:
            continue
        found = np.zeros(high - low, np.int64)
        for w, x in lists[rest:]:
            d, c = x.between(low, high)
            found[d - low] += w * impact(c, m[d])
        some = np.flatnonzero(found)
        got = found[some]
        if rest:
            keep = got + int(sums[rest - 1]) >= least
            some, got = some[keep], got[keep]
            open_bounds = np.zeros(len(some), np.int64)
            each = []
            for w, x in lists[:rest]:
                each.append(w * x.bounds_at(some + low))
                open_bounds += each[-1]
            for k in range(rest - 1, -1, -1):
                w, x = lists[k]
                keep = got + open_bounds >= least
                some, got, open_bounds = some[keep], got[keep], open_bounds[keep]
                each = [e[keep] for e in each[: k + 1]]
                ask = np.flatnonzero(each[k])
                c = np.zeros(len(some), np.int64)
                c[ask] = x.counts_of(some[ask] + low)
                got = got + np.where(c > 0, w * impact(c, m[some + low]), 0)
                open_bounds = open_bounds - each[k]
        keep = got >= least
        docs, scores = np.append(docs, some[keep] + low), np.append(scores, got[keep])
        if len(docs) > top:
            best = np.lexsort((docs, ids[docs], unknown[docs], -scores))[:top]
            docs, scores = docs[best], scores[best]
        if len(docs) == top:
            least = max(least, int(scores.min()))
    return list(zip(docs.tolist(), scores.tolist()))


def answers(queries: list[tuple], weights: dict[str, int], n_docs: int, n_terms: int, top: int):
    """A function from the lists of one shard to its best documents for each query."""

    def of_shard(table: pa.Table) -> pa.Table:
        held, rows = {}, table.to_pydict()
        for term, blocks, postings in zip(rows["term"], rows["blocks"], rows["postings"]):
            if term is None:
                ids, known = np.frombuffer(blocks, np.int64).reshape(2, -1)
                m = norms(np.frombuffer(postings, np.int64), n_docs, n_terms)
            else:
                held[term] = PostingList(blocks, postings, n_docs, n_terms)
        shard, out = rows["shard"][0], []
        for number, item_id, terms in queries:
            lists = [(weights[t] * n, held[t]) for t, n in terms.items() if t in held and weights[t] > 0]
            if lists:
                for d, score in best_of_shard(lists, m, ids, 1 - known, top):
                    out.append((number, item_id, int(ids[d]) if known[d] else None, score, shard, d))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["number", "item_id", "doc_id", "score", "shard", "place"]
        columns = list(zip(*out)) or [()] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return of_shard


def query_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The queries as (number, item_id, counts of terms), in blocks of bounded bytes; one block at a time is held."""
    held, size = [], 0
    rows = items.select(col(item_id).cast("bigint").alias("i"), col(text).alias("t")).where("t is not null")
    for number, row in enumerate(rows.toLocalIterator()):
        held.append((number, row["i"], {t.decode(): n for t, n in counted_terms(row["t"]).items()}))
        size += len(row["t"])
        if size > QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item, equal scores by ascending doc_id.

    index is a written `index_documents`. Items with null, empty or unknown text have no rows; repeated items are
    queries of their own, each with its ranks. Null doc_ids come last among equal scores; rows that agree in score
    and doc_id keep the order of the index. An empty index or no items give no rows. Other columns are not used.
    """
    spark = index.sparkSession
    n_docs, n_terms = corpus_sizes(index)
    found = []
    for block in query_blocks(items, item_id, text) if n_docs else ():
        words = sorted({t for _, _, terms in block for t in terms})
        asked = F.broadcast(spark.createDataFrame([(t,) for t in words], "term string"))  # of one block of queries
        lists = index.where("term is not null").join(asked, "term", "left_semi")
        weights = {r["term"]: weight(n_docs, r["df"]) for r in lists.groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}
        parts = lists.select("shard", "term", "blocks", "postings").unionByName(
            index.where("term is null").select("shard", "term", "blocks", "postings"))
        found.append(settle(parts.groupBy("shard").applyInArrow(
            answers(block, weights, n_docs, n_terms, top),
            "number bigint, item_id bigint, doc_id bigint, score bigint, shard bigint, place bigint",
        )))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "place")
    # Every task keeps its best rows of a query before they are merged.
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index the documents and answer the items."""
    return search(settle(index_documents(docs)), items, top=top)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that was written as Parquet."""
    return spark.read.schema(INDEX).parquet(path)
