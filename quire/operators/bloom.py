"""Split-block Bloom filter, built, sent and probed in the JVM.

A block is eight words of 64 bits, one row of the filter.  A key sets one bit in each word of
one block, so one lookup by block number and eight bit tests answer a probe, all of it inside
generated code.  The filter is sized from the number of keys.  Up to ``BROADCAST_MB`` it is
broadcast; a larger one is joined by block number, so that it never fills up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS_PER_KEY = 16
BROADCAST_MB = 32
ROW_BYTES = 96  # of a block with its number, as a row


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("bigint"))


def _bits(key: Column) -> list[Column]:
    """For each word of the block the one bit that the key sets."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")) for i in range(WORDS)]


def blocks_for(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Number of blocks for about ``keys`` keys."""
    return max(1, -(-keys * bits_per_key // (64 * WORDS)))


def build(parents: DataFrame, key: Column, blocks: int) -> DataFrame:
    """Filter of all non-null keys: (block, w0 .. w7 BIGINT), one row a block in use."""
    bits = parents.where(key.isNotNull()).select(_block(key, blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(key))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def probe(refs: DataFrame, key: Column, filter_: DataFrame, blocks: int, into: str, broadcast_mb: int = BROADCAST_MB) -> DataFrame:
    """``refs`` with a boolean column ``into``: False proves that no parent has the key.

    A null key is False.
    """
    held = filter_.select(F.col("block").alias("_block"), *(F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)))
    if blocks * ROW_BYTES <= broadcast_mb << 20:
        held = F.broadcast(held)
    own = refs.withColumns({"_block": _block(key, blocks), **{f"_b{i}": b for i, b in enumerate(_bits(key))}})
    hit = reduce(lambda x, y: x & y, (F.col(f"_w{i}").bitwiseAND(F.col(f"_b{i}")) != 0 for i in range(WORDS)))
    found = own.join(held, "_block", "left").withColumn(into, key.isNotNull() & F.coalesce(hit, F.lit(False)))
    return found.drop("_block", *(f"_{c}{i}" for c in "wb" for i in range(WORDS)))
