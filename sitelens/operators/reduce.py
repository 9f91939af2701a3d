"""Wide rows reduced by wanted keys before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
#: blocks of 64 bits that are broadcast at most (about 128 MB as a hash table)
MAX_BLOCKS = 1 << 22


def _place(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block and mask (three of 64 bits) of a key."""
    h = F.xxhash64(key)
    one = F.lit(1).cast("long")
    bits = [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int") for s in (0, 6, 12)]
    mask = F.lit(0).cast("long")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, b))
    return F.pmod(F.shiftrightunsigned(h, 18), F.lit(blocks)), mask


def maybe_in(df: DataFrame, key: str, wanted: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Rows of df whose key may be among the keys of ``wanted`` (one column, read twice): none that is
    gets lost, of the others about three in a hundred stay. A Bloom filter of 64-bit blocks is made by
    an aggregate and broadcast; its size follows the number of keys up to ``max_blocks``, beyond that
    only more rows stay. df itself is not shuffled."""
    keys = wanted.select(F.col(wanted.columns[0]).alias("key")).where("key is not null")
    blocks = max(1, min(max_blocks, keys.count() * BITS_PER_KEY // 64))
    block, mask = _place(F.col("key"), blocks)
    bloom = keys.select(block.alias("_block"), mask.alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_bits"))
    block, mask = _place(F.col(key), blocks)
    return df.where(F.col(key).isNotNull()).join(F.broadcast(bloom), (block == F.col("_block")) & (F.col("_bits").bitwiseAND(mask) == mask), "left_semi")
