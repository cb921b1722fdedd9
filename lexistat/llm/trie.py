"""The prefix trie of conversations, built as a burst trie.

A turn becomes a record of 20 bytes (hash of role and text, length of the text), a conversation the string of its
records; equal conversations collapse into one sequence before anything else is done. Containers hold the sequences
under one trie head. A container of more than `limit` sequences bursts: its members' common prefix becomes the head,
and its members go to containers by their next turn id. Every other container is sorted by its records and swept
once with a stack, which gives the nodes under it. Heads add up the totals of the containers below them.

Containers are dealt to tasks by the hash of their prefix; sizes of containers are counted by (container, salt), so
neither counting nor bursting brings all sequences of a hot head into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistat.llm.frames import col, settle

RECORD = 20  # 16 bytes of md5 and 4 bytes of length
LIMIT = 4096
SALTS = 64
ID_BITS = 8  # conversations ending at one node are listed in pieces of 256 neighbouring ids
BATCH_ROWS = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()
FIRST_TURNS = 5  # a rebuilt conversation borrows at most five turns

NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string, turn_id string")


def conversation_records(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, records): the records of each conversation by turn, null turns first, equal turns by their record.

    Null roles and texts are empty. Rows without a conversation id belong to none and are left out. One
    conversation's records (20 bytes a turn) are one value.
    """
    said, by = F.coalesce(col(text), F.lit("")), F.coalesce(col(role), F.lit(""))
    record = F.concat(
        F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary")),
        F.lpad(F.hex(F.length(said)), 8, "0"),
    )
    rows = conversations.where(col(conv).isNotNull()).select(
        col(conv).cast("bigint").alias("conv_id"), F.struct(col(turn).alias("t"), F.unhex(record).alias("r")).alias("x")
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("xs", lambda x: F.hex(x["r"])), "")).alias("records"))


def head(records: Column, turns: Column) -> Column:
    """The records of the first turns."""
    return F.substring(records, F.lit(1), (turns * RECORD).cast("int"))


def turn_count(records: Column) -> Column:
    return (F.length(records) / RECORD).cast("int")


def rebuild(listed: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 100 in place of its own, h = crc32(c) % 6.

    Fewer turns are taken if there are fewer, none if that conversation is absent; a conversation may end up empty.
    The remainder has the sign of c, as in SQL.
    """
    own = listed.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).withColumn(
        "from_id", F.col("conv_id") - F.col("conv_id") % 100
    )
    lent = listed.where("conv_id % 100 = 0").select(
        F.col("conv_id").alias("from_id"), head(F.col("records"), F.lit(FIRST_TURNS)).alias("lent")
    )
    kept = F.substring(F.col("records"), (F.col("h") * RECORD + 1).cast("int"), F.length("records"))
    taken = head(F.coalesce(F.col("lent"), F.lit(b"")), F.col("h"))
    return own.join(lent, "from_id", "left").select("conv_id", F.concat(taken, kept).alias("records"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """One row per distinct sequence: records, n conversations, the smallest id, the digest of all ids in order.

    Ids are joined in pieces first, so the stream that digests a sequence of many copies reads few rows.
    """
    pieces = sequences.groupBy(
        F.md5("records").alias("same"), F.shiftright("conv_id", ID_BITS).alias("piece")
    ).agg(
        F.first("records").alias("records"), F.sort_array(F.collect_list("conv_id")).alias("ids")
    ).select(
        "same", "piece", "records", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first_id"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("listed"),
    )
    ordered = pieces.repartition("same").sortWithinPartitions("same", "piece")
    return ordered.mapInArrow(digest_ids, "records binary, n bigint, first_id bigint, ends string")


def digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each sequence, in order, as one row with the SHA-256 of its comma-joined ids."""
    names = ["records", "n", "first_id", "ends"]
    same, state = None, None
    for batch in batches:
        done: list[list] = [[], [], [], []]
        keys, records, counts, firsts, listed = (
            batch.column(c).to_pylist() for c in ("same", "records", "n", "first_id", "listed")
        )
        for i, key in enumerate(keys):
            if key != same:
                if state:
                    for out, value in zip(done, (*state[:3], state[3].hexdigest())):
                        out.append(value)
                same, state = key, [records[i], 0, firsts[i], hashlib.sha256()]
            else:
                state[3].update(b",")
            state[1] += counts[i]
            state[3].update(listed[i].encode())
        yield pa.RecordBatch.from_arrays(sequence_arrays(done), names)
    if state:
        yield pa.RecordBatch.from_arrays(sequence_arrays([[x] for x in (*state[:3], state[3].hexdigest())]), names)


def sequence_arrays(columns: list[list]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))]


def containers(live: DataFrame, limit: int, force: bool) -> DataFrame:
    """Each sequence with the totals of its container: size, conversations, smallest id, length of the prefix that
    all members share, and whether it bursts."""
    salted = live.withColumn("salt", F.pmod(F.xxhash64("records"), F.lit(SALTS)))
    parts = salted.groupBy("box", "salt").agg(
        F.count("*").alias("c"), F.min("records").alias("low"), F.max("records").alias("high"),
        F.sum("n").alias("m"), F.min("first_id").alias("f"), F.first("depth").alias("d"),
    )
    box = Window.partitionBy("box")  # at most SALTS rows
    totals = parts.select(
        "box", "salt", "d", F.sum("c").over(box).alias("size"), F.sum("m").over(box).alias("box_n"),
        F.min("f").over(box).alias("box_id"), F.min("low").over(box).alias("low"), F.max("high").over(box).alias("high"),
    )
    shorter = F.least(turn_count(F.col("low")), turn_count(F.col("high")))

    def record(of: str, k: Column) -> Column:
        return F.substring(F.col(of), ((k - 1) * RECORD + 1).cast("int"), F.lit(RECORD))

    differ = F.array_min(F.filter(
        F.sequence(F.col("d") + 1, F.greatest(shorter, F.col("d") + 1)), lambda k: record("low", k) != record("high", k)
    ))
    shared = F.when(shorter <= F.col("d"), shorter).otherwise(F.coalesce(F.least(differ - 1, shorter), shorter))
    bursts = (F.col("size") > limit) | F.lit(force)
    totals = totals.select(
        "box", "salt", "box_n", "box_id", bursts.alias("bursts"), F.when(bursts, shared).alias("shared")
    )
    return salted.join(totals, ["box", "salt"]).drop("salt")


def prefix_trie(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie over (conv_id, records), as `conversation_records` gives them.

    Per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (over the subtree, members but one times the length of the last
    text), ends_sha256 (of the comma-joined ids of conversations that end here), turn_id (hash of the last turn;
    null at the root). Conversations without turns belong to the root alone; no conversations give no nodes.
    Repeated rows of one id must be one sequence already; other columns are not used.
    """
    live = settle(distinct_sequences(sequences.select("conv_id", "records"))).select(
        "records", "n", "first_id", "ends", F.lit(0).alias("depth"), F.unhex(F.lit("")).alias("box"),
        F.lit(None).cast("bigint").alias("parent_id"), F.array().cast("array<binary>").alias("path"),
    )
    final, heads, force = [], [], True
    while True:
        # One write per round: each sequence knows what its container does, wherever it is read again.
        dealt = settle(containers(live, limit, force))
        final.append(dealt.where("not bursts"))
        burst = dealt.where("bursts")
        if burst.isEmpty():
            break
        prefix = head(F.col("records"), F.col("shared"))
        over = turn_count(F.col("records")) == F.col("shared")
        heads.append(burst.groupBy("box").agg(
            *[F.first(c).alias(c) for c in ("depth", "shared", "box_n", "box_id", "parent_id", "path")],
            F.min(prefix).alias("prefix"), F.max(F.when(over, F.col("ends"))).alias("ends"),
        ))
        below = (F.col("shared") + 1).cast("int")
        live = burst.where(~over).select(
            "records", "n", "first_id", "ends", below.alias("depth"),
            F.unhex(F.md5(head(F.col("records"), below))).alias("box"), F.col("box_id").alias("parent_id"),
            F.concat("path", F.array("box")).alias("path"),
        )
        force = False
    boxes = reduce(DataFrame.unionAll, final).select("box", "depth", "parent_id", "path", "records", "n", "first_id", "ends")
    ordered = boxes.repartition("box").sortWithinPartitions("box", "records")
    swept = settle(ordered.mapInArrow(sweep, f"{NODE}, path array<binary>"))
    if not heads:
        return swept.drop("path")
    tops = settle(reduce(DataFrame.unionAll, heads))
    return swept.drop("path").unionAll(head_nodes(tops, swept))


def head_nodes(heads: DataFrame, swept: DataFrame) -> DataFrame:
    """The nodes of the heads' prefixes, with totals from all containers and heads below them."""
    def chars(k: Column) -> Column:
        return F.conv(F.hex(F.substring(F.col("prefix"), (k * RECORD - 3).cast("int"), F.lit(4))), 16, 10).cast("bigint")

    first = F.greatest(F.col("depth"), F.lit(1))
    own = F.when(F.col("shared") >= first, F.aggregate(
        F.sequence(first, F.greatest(F.col("shared"), first)), F.lit(0).cast("bigint"), lambda a, k: a + chars(k)
    )).otherwise(0) * (F.col("box_n") - 1)
    zero = F.lit(0).cast("bigint")
    gifts = swept.where("path is not null").select("path", "n_leaves", "saved_tokens").unionAll(
        heads.where(F.size("path") > 0).select("path", zero, own)
    )
    totals = gifts.select(
        F.posexplode("path").alias("at", "box"), "n_leaves", "saved_tokens", (F.size("path") - 1).alias("last")
    ).groupBy("box").agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.sum(F.when(F.col("at") == F.col("last"), 1).otherwise(0)).alias("children"),
    )
    whole = heads.join(totals, "box", "left").select(
        "depth", "shared", "box_n", "box_id", "parent_id", "prefix", "ends",
        *[F.coalesce(c, zero).alias(c) for c in ("leaves", "saved", "children")],
    )
    return whole.mapInArrow(unroll, NODE)


def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain of nodes of each head: only its last node may end conversations or branch."""
    out = Nodes(with_path=False)
    for batch in batches:
        for x in batch.to_pylist():
            saved, shared, prefix, members = x["saved"], x["shared"], x["prefix"], x["box_n"]
            for d in range(shared, x["depth"] - 1, -1):
                turn = prefix[RECORD * (d - 1) : RECORD * d] if d else b""
                saved += (members - 1) * int.from_bytes(turn[16:], "big")
                last = d == shared
                out.add((
                    x["box_id"], d, x["parent_id"] if d == x["depth"] else x["box_id"], members,
                    x["children"] if last else 1, x["leaves"] or 1, saved, (last and x["ends"]) or NO_ENDS,
                    turn[:16].hex() if d else None,
                ))
                if out.full():
                    yield out.batch()
    yield out.batch()


class Nodes:
    """Rows of nodes on their way into a record batch."""

    def __init__(self, with_path: bool) -> None:
        self.names = [f.split()[0] for f in NODE.split(", ")] + ["path"] * with_path
        self.types = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.binary())] * with_path
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> None:
        self.rows.append(row)

    def full(self) -> bool:
        return len(self.rows) >= BATCH_ROWS

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], self.names)


def common_turns(a: bytes, b: bytes, known: int) -> int:
    """How many records two sequences share, at least `known`."""
    low, high = known, min(len(a), len(b)) // RECORD
    while low < high:
        middle = (low + high + 1) // 2
        if a[known * RECORD : middle * RECORD] == b[known * RECORD : middle * RECORD]:
            low = middle
        else:
            high = middle - 1
    return low


class Open:
    """A node of the sweep whose subtree is not complete yet."""

    __slots__ = ("chars", "children", "ends", "first_id", "leaves", "n", "saved", "turn", "waiting")

    def __init__(self, record: bytes) -> None:
        self.turn, self.chars = record[:16].hex(), int.from_bytes(record[16:], "big")
        self.first_id, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, NO_ENDS
        self.waiting: list[tuple] = []  # finished children, which still need this node's smallest member


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each container, from its sorted sequences: a stack holds the path to the last sequence, and a
    node is finished when a sequence leaves it. Nodes wait for their parent, so at most the children of the open
    path are held."""
    out, path = Nodes(with_path=True), []
    box = before = None
    top = (0, None, None)  # depth, parent and heads of the container

    def close(depth: int) -> None:
        """Finish the open nodes below a depth."""
        while path and top[0] + len(path) - 1 > depth:
            node = path.pop()
            node.saved += (node.n - 1) * node.chars
            node.leaves = node.leaves or 1
            for c in node.waiting:
                out.add((*c[:2], node.first_id, *c[2:], None))
            row = (node.first_id, top[0] + len(path), node.n, node.children, node.leaves, node.saved, node.ends, node.turn)
            if path:
                up = path[-1]
                up.waiting.append(row)
                up.first_id = node.first_id if up.first_id is None else min(up.first_id, node.first_id)
                up.n, up.children = up.n + node.n, up.children + 1
                up.leaves, up.saved = up.leaves + node.leaves, up.saved + node.saved
            else:
                out.add((*row[:2], top[1], *row[2:], top[2]))

    for batch in batches:
        names = ("box", "depth", "parent_id", "path", "records", "n", "first_id", "ends")
        for key, depth, parent, heads, records, n, first_id, ends in zip(*(batch.column(c).to_pylist() for c in names)):
            if key != box:
                close(-1)
                box, top, before = key, (depth, parent, heads), None
                shared = depth - 1
            else:
                shared = common_turns(before, records, depth)
                close(shared)
            for d in range(shared + 1, len(records) // RECORD + 1):
                path.append(Open(records[RECORD * (d - 1) : RECORD * d]))
            node, before = path[-1], records
            node.first_id, node.n, node.ends = first_id, node.n + n, ends
            if out.full():
                yield out.batch()
    close(-1)
    yield out.batch()


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of conversations as they are."""
    return prefix_trie(conversation_records(conversations), limit)
