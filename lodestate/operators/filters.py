"""Approximate membership: bitmaps of key hashes as (bucket, bitmap) tables, built and joined by Spark's bitmap aggregates.

A table of buckets grows with its number of bits and is never gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter; a power of two. It suits some hundred thousand keys: see ``bits_for``.
BITS = 1 << 22
#: Filters of up to so many bits (4 MB) are broadcast.
BROADCAST = 1 << 25
#: Bytes of the pieces of a bitmap that keys are joined with, and how many a bucket of 4 KB has.
BLOCK = 64
_PIECES = 4096 // BLOCK


def position(hash_: Column, bits: int = BITS) -> Column:
    return F.pmod(hash_, F.lit(bits))


def bits_for(keys: int, per_key: int = 10) -> int:
    """A power of two of bits, some per_key or more for each key: few absent keys get through then."""
    return 1 << max(16, (keys * per_key - 1).bit_length())


def build(keys: DataFrame, hash_: Column, bits: int = BITS, by: list[str] | None = None) -> DataFrame:
    """(bucket, bitmap) of the hashes; by: columns with a filter each."""
    rows = keys.select(*(by or []), position(hash_, bits).alias("p"))
    return rows.groupBy(*(by or []), F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def union(*filters: DataFrame) -> DataFrame:
    """A filter that has whatever any of the filters has."""
    rows = filters[0]
    for other in filters[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _bit(bitmap: Column, position_: Column) -> Column:
    byte = F.ascii(F.decode(F.substr(bitmap, (position_ / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    return F.getbit(byte, (position_ % 8).cast("int")) == 1


def _blocks(filter_: DataFrame) -> DataFrame:
    """(_block, _bits): the pieces of a filter's bitmaps that have any bit. What joins one carries a piece, not a whole bitmap."""
    piece = lambda i: F.struct((F.col("bucket") * _PIECES + i).alias("_block"), F.substr(F.col("bitmap"), i * BLOCK + 1, F.lit(BLOCK)).alias("_bits"))
    return filter_.select(F.inline(F.transform(F.sequence(F.lit(0), F.lit(_PIECES - 1)), piece))).where(F.col("_bits") != F.lit(bytes(BLOCK)))


def may_contain(keys: DataFrame, filter_: DataFrame, *hashes: Column, bits: int = BITS) -> DataFrame:
    """keys with ``may_contain``: whether the filter may have any of the hashes. Never false for a key that was added.

    Filters of at most BROADCAST bits go to where the keys are; the pieces of larger ones are repeated 16 times and keys
    dealt over them, so that a hash that many keys share isn't one task's work.
    """
    blocks = _blocks(filter_)
    small = bits <= BROADCAST
    blocks = F.broadcast(blocks) if small else blocks.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    out = keys if small else keys.withColumn("_dealt", F.pmod(F.xxhash64(*hashes), F.lit(16)).cast("int"))
    for i, hash_ in enumerate(hashes):
        p = position(hash_, bits)
        at = F.bitmap_bit_position(p)
        rows = out.withColumns({"_block": F.bitmap_bucket_number(p) * _PIECES + F.floor(at / (8 * BLOCK)), "_at": at % (8 * BLOCK)})
        # the answer is computed before the next join: no row takes a piece along
        hit = F.coalesce(_bit(F.col("_bits"), F.col("_at")), F.lit(False)).alias(f"_hit{i}")
        out = rows.join(blocks, ["_block"] if small else ["_block", "_dealt"], "left").select(*out.columns, hit)
    hits = reduce(Column.__or__, (F.col(f"_hit{i}") for i in range(len(hashes))), F.lit(False))
    return out.select(*keys.columns, hits.alias("may_contain"))


def added_first(keys: DataFrame, hash_: Column, order: str) -> DataFrame:
    """keys with ``was_new``: the first of its hash in the given order."""
    first = keys.groupBy(hash_.alias("_h")).agg(F.min(order).alias("_first"))
    return keys.withColumn("_h", hash_).join(first, "_h").withColumn("was_new", F.col(order) == F.col("_first")).drop("_h", "_first")
