"""A Bloom filter of keys in expressions: rows that are certainly not among the keys are told apart without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block; bits a key; blocks at most (32 MB), beyond which more rows pass as possible members.
BLOCK, BITS_A_KEY, BLOCKS = 32_768, 16, 8192


def _places(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    spread = F.xxhash64(key, F.lit(1))
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.pmod(spread, F.lit(BLOCK)).cast("int"), F.pmod(F.shiftright(spread, 24), F.lit(BLOCK)).cast("int")


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", F.coalesce(byte, F.lit(0)), F.pmod(place, F.lit(8))) == 1


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: false only where ``key`` is certainly not in the one column of ``keys``. The bitmaps are broadcast: 32 MB at most."""
    n = keys.count()
    blocks = max(1, min(BLOCKS, -(-n * BITS_A_KEY // BLOCK)))
    block, one, two = _places(F.col("key"), blocks)
    hit = keys.toDF("key").select(block.alias("bloom_block"), F.explode(F.array(one, two)).alias("bit"))
    bloom = hit.groupBy("bloom_block").agg(F.bitmap_construct_agg("bit").alias("bloom_bits"))
    block, one, two = _places(F.col("bloom_key"), blocks)
    probed = df.withColumn("bloom_key", key).withColumn("bloom_at", block).join(F.broadcast(bloom), F.col("bloom_at") == F.col("bloom_block"), "left")
    return probed.withColumn(flag, F.coalesce(_bit(F.col("bloom_bits"), one) & _bit(F.col("bloom_bits"), two), F.lit(False))).drop("bloom_key", "bloom_at", "bloom_block", "bloom_bits")
