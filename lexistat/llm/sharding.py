"""Shards by jump consistent hashing (Lamping and Veach, 2014), with DataFrame functions only.

The shard of a key follows from the key and the number of shards alone: no ring table, no state. One more
shard takes rows from the others and moves no row between them. Rows get gapless places within their shard
without a task that holds a shard: they are numbered inside slices, and counts of the slices before are added.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistat.functions.ranks import number_by_hash
from lexistat.llm.frames import col, free_name

# Fixed values of the algorithm: multiplier of the generator, and 2 ** 64.
MULTIPLIER = 2862933555777941757
WORD = 18446744073709551616


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a bigint key, taken as an unsigned number; a null key counts as 0.

    Each step is one jump of the algorithm. A jump moves forward by one shard at least, so `shards` steps are
    always enough; steps after the last jump change nothing. 64-bit arithmetic is done in decimals, since a
    bigint product may overflow.
    """
    big = T.DecimalType(38, 0)
    unsigned = F.coalesce(key, F.lit(0)).cast(big)
    unsigned = F.when(unsigned < 0, unsigned + F.lit(Decimal(WORD)).cast(big)).otherwise(unsigned).cast(T.DecimalType(20, 0))

    def jump(state: Column, _: Column) -> Column:
        product = (state["key"] * F.lit(MULTIPLIER).cast(T.DecimalType(19, 0)) + F.lit(1).cast(T.DecimalType(1, 0)))
        after = (product.cast(big) % F.lit(Decimal(WORD)).cast(T.DecimalType(20, 0))).cast(T.DecimalType(20, 0))
        top = F.floor(after / F.lit(2 ** 33).cast(T.DecimalType(10, 0))).cast("double") + 1.0
        place = F.floor((state["next"] + 1).cast("double") * (F.lit(float(2 ** 31)) / top)).cast("bigint")
        moved = F.struct(after.alias("key"), state["next"].alias("now"), place.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(
        unsigned.alias("key"), F.lit(-1).cast("bigint").alias("now"), F.lit(0).cast("bigint").alias("next")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, jump, lambda s: s["now"].cast("int"))


def key_of(column: Column, kind: T.DataType) -> Column:
    """Whole numbers are their own key; any other type is hashed from its text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("bigint")
    return F.xxhash64(column.cast("string"))


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", prefix: str = "") -> DataFrame:
    """The rows of `docs` with `shard`, `slot` (gapless from 0 in each shard) and `grown_shard` (with one more).

    Repeated keys share a shard and take slots of their own; null keys go where key 0 goes. An empty table
    stays empty. New columns get underscores until their names are free.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    k = key_of(col(key), docs.schema[key].dataType)
    shard, slot, grown, order = (free_name(docs, prefix + x) for x in ("shard", "slot", "grown_shard", "_order"))
    placed = docs.withColumns({
        shard: F.coalesce(jump_hash(k, shards), F.lit(0)), grown: jump_hash(k, shards + 1),
        order: F.md5(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")),
    })
    numbered = number_by_hash(placed, order, [key], [shard], slot)
    return numbered.withColumn(slot, col(slot) - 1).select(
        *[col(c) for c in docs.columns], col(shard), col(slot), col(grown)
    )


def shard_layout(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot, grown_shard of every document; null text: empty."""
    raw = F.coalesce(col(text), F.lit("")).cast("binary")
    slim = docs.select(
        col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    return shard_rows(slim, shards, "doc_id")
