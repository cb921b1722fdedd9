"""Jaccard self-join on word shingles by T-occurrence search with DivideSkip (Li, Lu and Lu, 2008).

A text with n shingles shares at least T = ceil(0.8 n) of them with any partner. Shingles are ordered: first
those that few documents hold, then the frequent ones. Two partners share at least s of the first n - T + s shingles
of each ("prefix"), where s = 3 + n // 10 for the smaller of them.

* Short lists (infrequent shingles) are merged by a shuffle on the shingle: pairs that occur often enough in
  the prefixes are candidates, and their whole sets are compared.
* Long lists (frequent shingles) are never merged for texts that short lists can decide. Only a text that
  consists of frequent shingles needs them: such texts fall into families, and each family is searched in
  blocks with an inverted index, merging the short lists of a query and probing its long ones.

Copies of a set are one node. Before both searches, near copies are linked to the smallest text with the same
minimum hash, so searches only look for links between groups that are still apart; no link between different
groups is lost, while pairs inside a group are never written out.

Which shingles are frequent comes from counts over all documents, kept as bits of a filter of fixed size. A
wrong bit changes the order of a shingle alone, in all texts alike, so results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistat.llm.components import components
from lexistat.llm.frames import col, settle
from lexistat.llm.shingles import shingle_sets
from lexistat.llm.tokens import forget_pieces, release_unused
from lexistat.llm.words import U64, batches, mix, ranges

PERCENT = 80
FEW = 16  # a shingle of more documents than that is frequent
SHARED = 3  # shingles that two partners of any size share in their prefixes at least
HASHES = 4
FREQUENT_BITS = 1 << 25
REPEAT_BITS = 1 << 27
WANTED_BITS = 1 << 25
BLOCK = 1024


def least_overlap(n: np.ndarray) -> np.ndarray:
    return -(-n * PERCENT // 100)


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shingles that a text's prefix has in common with that of a larger partner at least; at most T."""
    return SHARED + n // 10


def bucket_bits(docs: DataFrame) -> int:
    """Buckets grow with the input: about four for each of its partitions."""
    return max(4, min(24, int(docs.rdd.getNumPartitions() * 4 - 1).bit_length()))


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, bytes of each array) of the rows of each bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    found = bucket[order]
    edges = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
    arrays = [x[order] for x in arrays]
    for a, b in zip(edges, edges[1:]):
        yield int(found[a]), [x[a:b].tobytes() for x in arrays]


def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


class Filter:
    """Bits for (bucket, remainder) of a hash: a slice of fixed size for each bucket."""

    def __init__(self, bits: int, total: int):
        self.bits, self.slice = bits, max(64, total >> bits)

    def places(self, rest: np.ndarray) -> np.ndarray:
        return rest.astype(np.int64) % self.slice

    def slice_of(self, rest: np.ndarray) -> bytes:
        flags = np.zeros(self.slice, bool)
        flags[self.places(rest)] = True
        return np.packbits(flags).tobytes()

    def whole(self, slices: dict[int, bytes]) -> np.ndarray:
        """The filter as an array of bytes, one slice after the other."""
        out = np.zeros((1 << self.bits, -(-self.slice // 8)), np.uint8)
        for k, v in slices.items():
            out[k] = np.frombuffer(v, np.uint8)
        return out

    def hit(self, whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        bucket, at = (hashes >> U64(64 - self.bits)).astype(np.int64), self.places(rest_of(hashes, self.bits))
        return (whole[bucket, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def rest_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes << U64(bits)) >> U64(32)).astype(np.uint32)


def frequency_filters(docs: DataFrame, text: str, bits: int) -> tuple[np.ndarray, np.ndarray, Filter, Filter]:
    """Bits of the frequent shingles and of those of two documents or more, from counts over all documents.

    Counts are summed for each batch before the shuffle. A bucket whose slice would fill raises its own limit.
    """
    frequent, repeat = Filter(bits, FREQUENT_BITS), Filter(bits, REPEAT_BITS)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        for part in batches(parts, "text"):
            hashes, times = np.unique(shingle_sets(part.column("text"))[0], return_counts=True)
            rows = list(by_bucket(hashes >> U64(64 - bits), rest_of(hashes, bits), times.astype(np.uint32)))
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
        rest, sums = rest[starts], np.add.reduceat(times.astype(np.int64), starts)
        limit = FEW
        while (sums > limit).sum() * 4 > frequent.slice:
            limit *= 2
        return pa.table({
            "bucket": table.column("bucket")[:1], "frequent": [frequent.slice_of(rest[sums > limit])],
            "repeat": [repeat.slice_of(rest[sums > 1])],
        }).cast(pa.schema([("bucket", pa.int32()), ("frequent", pa.binary()), ("repeat", pa.binary())]))

    rows = docs.select(col(text).alias("text")).mapInArrow(count, "bucket int, rest binary, times binary")
    # Both filters have a fixed size in all, 20 MB, whatever the number of documents.
    found = rows.groupBy("bucket").applyInArrow(mark, "bucket int, frequent binary, repeat binary").collect()
    return (
        frequent.whole({r.bucket: bytes(r.frequent) for r in found}),
        repeat.whole({r.bucket: bytes(r.repeat) for r in found}), frequent, repeat,
    )


def sketches(docs: DataFrame, doc_id: str, text: str, bits: int) -> DataFrame:
    """For each row: doc_id, n, mark (fingerprint of the set), hashes (minimum hashes), frequent (frequent
    shingles in the prefix, which come last), prefix (its shingles that some other document may hold)."""
    frequent_bits, repeat_bits, frequent, repeat = frequency_filters(docs, text, bits)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((frequent_bits, repeat_bits))  # of fixed size
    fields = "doc_id bigint, n bigint, mark binary, hashes array<bigint>, frequent int, prefix binary"

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        frequent_bits, repeat_bits = sent.value
        for part in batches(parts, "text"):
            flat, first = shingle_sets(part.column("text"))
            n = np.diff(first)
            full = np.flatnonzero(n)
            marks = np.zeros((len(n), 2), U64)
            lows = np.zeros((len(n), HASHES), U64)
            for k in range(2 if len(full) else 0):
                marks[full, k] = np.add.reduceat(mix(flat, 11 + k), first[:-1][full])
            for k in range(HASHES if len(full) else 0):
                lows[full, k] = np.minimum.reduceat(mix(flat, 21 + k), first[:-1][full])
            often, again = frequent.hit(frequent_bits, flat), repeat.hit(repeat_bits, flat)
            size = n - least_overlap(n) + least_shared(n)
            prefixes, late = [], []
            for i in range(len(n)):
                own, f = flat[first[i] : first[i + 1]], often[first[i] : first[i + 1]]
                if n[i] < SHARED + 1:
                    prefixes.append(b"")
                    late.append(0)
                    continue
                r = again[first[i] : first[i + 1]]
                few = np.flatnonzero(~f)[: size[i]]
                many = np.flatnonzero(f)[: size[i] - len(few)]
                prefixes.append(own[few[r[few]]].tobytes() + own[many].tobytes())
                late.append(len(many))
            low = lows.view(np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in marks], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * HASHES, pa.int32()), pa.array(low.ravel())),
                pa.array(late, pa.int32()), pa.array(prefixes, pa.binary()),
            ], ["doc_id", "n", "mark", "hashes", "frequent", "prefix"])

    return docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")).mapInArrow(sketch, fields)


def id_filter(wanted: DataFrame) -> tuple[np.ndarray, Filter]:
    """Bits of the documents in `wanted` (doc), 4 MB in all whatever their number."""
    bits = 6
    known = Filter(bits, WANTED_BITS)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes = mix(part.column("doc").to_numpy().astype(U64))
            rows = list(by_bucket(hashes >> U64(64 - bits), rest_of(hashes, bits)))
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in rows], pa.int32()), pa.array([v[0] for _, v in rows], pa.binary())
            ], ["bucket", "rest"])

    def mark(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()),
                         "bits": pa.array([known.slice_of(joined(table, "rest", np.uint32))], pa.binary())})

    found = wanted.select("doc").mapInArrow(deal, "bucket int, rest binary").groupBy("bucket").applyInArrow(
        mark, "bucket int, bits binary").collect()
    return known.whole({r.bucket: bytes(r.bits) for r in found}), known


def whole_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(doc, shingles) of the documents in `wanted` (doc) and a few others, from their whole texts.

    A filter of fixed size picks the documents while they are read, so texts are never shuffled; what it lets
    through besides has to be dropped by a join.
    """
    bits, known = id_filter(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc").to_numpy(zero_copy_only=False)
            part = part.filter(pa.array(known.hit(sent.value, mix(ids.astype(np.int64).astype(U64)))))
            for own in batches(iter([part]), "text", 1_000_000):
                flat, first = shingle_sets(own.column("text"))
                yield pa.RecordBatch.from_arrays([
                    own.column("doc"),
                    pa.array([flat[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary()),
                ], ["doc", "shingles"])

    rows = docs.select(col(doc_id).cast("bigint").alias("doc"), col(text).alias("text")).where("doc is not null")
    return rows.mapInArrow(sets, "doc bigint, shingles binary")


def linked(overlap: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    return overlap * 100 >= PERCENT * (n + m - overlap)


def overlap_of(a: np.ndarray, b: np.ndarray) -> int:
    """The number of common elements of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def compare(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Each b meets its partners in slices of 64."""
    pairs = settle(pairs.withColumn("part", F.pmod(F.hash("a"), F.lit(64))))
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    asked = pairs.select(F.col("a").alias("doc"), "b", "part", "a").union(pairs.select(
        F.col("b").alias("doc"), "b", "part", F.lit(None).cast("bigint").alias("a")).distinct())
    # Pairs grow with the documents: they are merged with the sets, which are shuffled once, and never broadcast.
    rows = whole_sets(docs, doc_id, text, wanted).join(asked.hint("merge"), "doc").select("b", "part", "a", "shingles")

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, np.zeros(0, U64)
        for part in parts:
            found = []
            for b, slot, a, raw in zip(*(part.column(c).to_pylist() for c in ("b", "part", "a", "shingles"))):
                own = np.frombuffer(raw, U64)
                if a is None:
                    at, hub = (b, slot), own
                elif at == (b, slot) and linked(np.int64(overlap_of(own, hub)), len(own), np.int64(len(hub))):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())
            ], ["a", "b"])

    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return rows.mapInArrow(check, "a bigint, b bigint")


def star_pairs(nodes: DataFrame) -> DataFrame:
    """Each text with the smallest text that has the same minimum hash: fewer pairs than texts times hashes."""
    homes = nodes.select("doc", "n", F.posexplode("hashes").alias("k", "low"))
    hubs = homes.groupBy("k", "low").agg(
        F.min(F.struct("doc", "n")).alias("hub"), F.count(F.lit(1)).alias("texts")
    ).where("texts > 1").select("k", "low", F.col("hub.doc").alias("b"), F.col("hub.n").alias("m"))
    return homes.join(hubs, ["k", "low"]).where("doc <> b and " + SIZES).select(
        F.col("doc").alias("a"), "b"
    ).distinct()


SIZES = f"100 * least(n, m) >= {PERCENT} * greatest(n, m)"


def short_list_pairs(nodes: DataFrame, bits: int) -> DataFrame:
    """Pairs of texts under different labels that share enough infrequent shingles of their prefixes."""

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = [np.frombuffer(x, U64)[: len(x) // 8 - f] for x, f in zip(
                part.column("prefix").to_pylist(), part.column("frequent").to_pylist())]
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            flat = np.concatenate(lists) if lists else np.zeros(0, U64)
            facts = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[row]
                     for c in ("doc", "label", "n", "frequent")]
            rows = list(by_bucket(flat >> U64(64 - bits), flat, *facts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32())]
                + [pa.array([v[i] for _, v in rows], pa.binary()) for i in range(5)],
                ["bucket", "shingle", "doc", "label", "n", "frequent"],
            )

    def pair(table: pa.Table) -> pa.Table:
        shingle = joined(table, "shingle", U64)
        doc, label, n, frequent = (joined(table, c, np.int64) for c in ("doc", "label", "n", "frequent"))
        order = np.lexsort((doc, shingle))
        shingle, doc, label, n, frequent = (x[order] for x in (shingle, doc, label, n, frequent))
        made, step = [], 1
        while True:  # the texts of one list at distance `step`; infrequent lists are short
            same = np.flatnonzero(shingle[step:] == shingle[:-step])
            if not len(same):
                break
            i, j = same, same + step
            fit = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
            i, j = i[fit], j[fit]
            need = least_shared(np.minimum(n[i], n[j])) - np.minimum(frequent[i], frequent[j])
            made.append(np.stack([doc[i], doc[j], np.maximum(need, 1)], 1))
            step += 1
        pairs, times = np.unique(np.concatenate(made), axis=0, return_counts=True) if made else (
            np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "need": pairs[:, 2], "times": times.astype(np.int64)})

    dealt = nodes.where("length(prefix) > 8 * frequent").select("doc", "label", "n", "frequent", "prefix").mapInArrow(
        deal, "bucket int, shingle binary, doc binary, label binary, n binary, frequent binary")
    found = dealt.groupBy("bucket").applyInArrow(pair, "a bigint, b bigint, need bigint, times bigint")
    return found.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).where(
        "times >= need").select("a", "b")


class Index:
    """An inverted index of some texts, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((doc, flat))
        self.shingles, self.docs = flat[order], doc[order]

    def partners(self, query: np.ndarray) -> np.ndarray:
        """The texts similar enough to the query: short lists are merged, long ones probed for candidates."""
        low, high = np.searchsorted(self.shingles, query), np.searchsorted(self.shingles, query, "right")
        length = high - low
        need = int(least_overlap(np.int64(len(query))))
        longest = max(int(length.max(initial=0)), 1)
        long = min(need - 1, int(need / (0.0085 * np.log2(longest + 1) + 1)))  # the rule of the method
        order = np.argsort(-length, kind="stable")
        probe, merge = order[:long], order[long:]
        count = np.bincount(self.docs[ranges(low[merge], high[merge])], minlength=len(self.sizes))
        found = np.flatnonzero(count >= need - long)
        total = count[found]
        for i in probe[length[probe] > 0]:
            own = self.docs[low[i] : high[i]]
            total = total + (own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found)
        return found[linked(total, len(query), self.sizes[found])]


def family_links(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links between texts that share frequent shingles of their prefixes, under different labels."""
    spread = nodes.where(f"frequent >= {SHARED}").select(
        "doc", "label", "n", F.expr("transform(sequence(1, frequent), i -> "
                                    "substring(prefix, length(prefix) - 8 * i + 1, 8))").alias("late")
    ).select("doc", "label", "n", F.explode("late").alias("shingle"))
    hubs = spread.groupBy("shingle").agg(
        F.min("doc").alias("b"), F.min("label").alias("low"), F.max("label").alias("high")
    ).where("low < high").select("shingle", "b")
    family = components(spread.join(hubs, "shingle").select(F.col("doc").alias("a"), "b").distinct())
    members = settle(family.withColumnRenamed("node", "doc").join(nodes.select("doc", "label", "n"), "doc"))
    counts = members.groupBy("root", "label").agg(F.count(F.lit(1)).alias("texts"))
    shapes = counts.groupBy("root").agg(
        F.max(F.struct("texts", "label")).alias("main"), F.sum("texts").alias("texts")
    ).select("root", F.col("main.label").alias("main"),
             F.ceil(F.col("texts") / BLOCK).cast("int").alias("blocks"),
             F.ceil((F.col("texts") - F.col("main.texts")) / BLOCK).cast("int").alias("slices"))
    placed = members.join(shapes, "root").withColumn("spot", F.xxhash64("doc"))
    index = placed.select("root", "doc", "label", F.pmod("spot", "blocks").cast("int").alias("block"), F.explode(
        F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("side"))
    queries = placed.where("label <> main").select("root", "doc", "label", F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod("spot", "slices").cast("int").alias("slice"), F.lit(1).alias("side"))
    sets = whole_sets(docs, doc_id, text, members.select("doc"))
    tasks = sets.join(index.unionByName(queries).hint("merge"), "doc")

    def search(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        doc = table.column("doc").to_numpy()
        # Texts under one label are linked already; labels that a link joins become one group.
        group = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        sets, found = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()], []
        own, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(own) and len(asked):
            index = Index([sets[i] for i in own])
            for q in asked:
                met = own[index.partners(sets[q])]
                others, at = np.unique(group[met], return_index=True)
                for other, i in zip(others, at):  # a spanning forest: fewer links than labels
                    if other != group[q]:
                        found.append((int(doc[q]), int(doc[met[i]])))
                        group[group == other] = group[q]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return tasks.groupBy("root", "block", "slice").applyInArrow(search, "a bigint, b bigint")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of every row.

    A null or empty text, or one without words, has no shingles and is linked with nothing. Rows without an id
    get no component and link nothing. Rows with equal ids and different texts each follow their own text.
    An empty table gives an empty table.
    """
    bits = bucket_bits(docs)
    rows = settle(sketches(docs, doc_id, text, bits))
    nodes = rows.where("n > 0 and doc_id is not null").groupBy("mark").agg(
        F.min(F.struct("doc_id", "n", "hashes", "frequent", "prefix")).alias("x")
    ).select("mark", F.col("x.doc_id").alias("doc"), "x.n", "x.hashes", "x.frequent", "x.prefix")
    nodes = settle(nodes)
    near = components(settle(compare(star_pairs(nodes), docs, doc_id, text)))
    # Labels grow with the documents: they are merged at every size, never broadcast.
    labelled = settle(nodes.join(near.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").select(
        "mark", "doc", "n", "frequent", "prefix", F.coalesce("root", "doc").alias("label")
    ))
    links = compare(short_list_pairs(labelled, bits), docs, doc_id, text).union(
        family_links(labelled, docs, doc_id, text)
    )
    labels = labelled.select("doc", "label")
    between = settle(
        links.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").select(
            F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()
    )
    roots = components(between).withColumnRenamed("node", "label")
    known = labelled.join(roots, "label", "left").select("mark", F.coalesce("root", "label").alias("component"))
    return rows.join(known.hint("merge"), "mark", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")))
        .alias("component_id"),
    )
