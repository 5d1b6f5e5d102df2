"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes every text to two bit positions of a blocked Bloom filter and counts how often each position is hit
(map-side combined, so a hot text sends one record per task). Positions hit at least twice become bitmaps, one row of 4 KB per
block. Pass 2 probes the bitmaps: a row of which either position was hit only once is certainly unique and passes straight
through without a shuffle. Only the rest, as (digest, id), is shuffled and grouped exactly.

The filter has 32 bits per row, rounded to blocks, and never over ``MAX_BLOCKS`` blocks (64 MB), so what is broadcast has a fixed
bound; beyond it more unique rows take the exact path, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, fresh

BLOCK_BITS = 32_768
MAX_BLOCKS = 16_384
BITS_PER_ROW = 32
HOT_SHARE = 1000


def _blocks(rows: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-rows * BITS_PER_ROW // BLOCK_BITS)))


def _positions(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block and two bit positions in it, from one 64-bit hash."""
    h = F.xxhash64(key)
    block = F.pmod(h, F.lit(blocks)).cast("int")
    spread = F.xxhash64(h)
    return block, F.pmod(spread, F.lit(BLOCK_BITS)).cast("int"), F.pmod(F.shiftright(spread, 20), F.lit(BLOCK_BITS)).cast("int")


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", F.coalesce(byte, F.lit(0)), F.pmod(position, F.lit(8))) == 1, F.lit(False))


def repeated_filter(keys: DataFrame, key: Column, rows: int) -> tuple[DataFrame, int]:
    """Pass 1: (block, bitmap) of the bit positions that the rows of ``keys`` hit at least twice; at most MAX_BLOCKS rows of 4 KB."""
    return _filter(keys, key, rows, 2)


def member_filter(keys: DataFrame, key: Column, rows: int) -> tuple[DataFrame, int]:
    """As repeated_filter(), of all the bit positions that the rows of ``keys`` hit: a Bloom filter of the keys, for maybe_repeated()."""
    return _filter(keys, key, rows, 1)


def _filter(keys: DataFrame, key: Column, rows: int, least: int) -> tuple[DataFrame, int]:
    blocks = _blocks(rows)
    block, one, two = _positions(key, blocks)
    hits = keys.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit"))
    slot = F.col("block").cast("long") * BLOCK_BITS + F.col("bit")
    twice = hits.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # bitmap_bit_position maps x to x % 32768 within its bucket; the bucket is kept by ourselves
    bit = F.pmod("slot", F.lit(BLOCK_BITS))
    return twice.groupBy(F.floor(F.col("slot") / BLOCK_BITS).cast("int").alias("bloom_block")).agg(F.bitmap_construct_agg(bit).alias("bloom_bits")), blocks


def maybe_repeated(df: DataFrame, key: Column, bloom: DataFrame, blocks: int, flag: str) -> DataFrame:
    """Pass 2: ``df`` with the boolean ``flag``: false only where the key occurs once for certain. The bitmaps are broadcast: 64 MB at most."""
    block, one, two = _positions(key, blocks)
    at, of, bits = fresh(df, "at", flag), fresh(df, "of", flag), fresh(df, "bits", flag)
    probe = bloom.select(F.col("bloom_block").alias(of), F.col("bloom_bits").alias(bits))
    return df.withColumn(at, block).join(F.broadcast(probe), F.col(at) == F.col(of), "left").withColumn(flag, _bit(F.col(bits), one) & _bit(F.col(bits), two)).drop(at, of, bits)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, and SHA-256 stands for the text. The row with the largest id stays; a null
    id is smaller than any other, and a group in which all ids are null keeps one of them. Of repeated rows (same id, same text)
    exactly one is kept. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    rows, total = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt")), docs.count()
    bloom, blocks = repeated_filter(rows, F.col("txt"), total)
    # texts are read once for their digests; a row's number tells repeated rows apart
    probed = maybe_repeated(rows, F.col("txt"), bloom, blocks, "again").select("id", "again", F.sha2("txt", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    probed = cut(probed, "digests")
    alone = probed.where(~F.col("again")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = probed.where("again")
    # a null id is smaller than any other in a struct's order too
    groups = again.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")).withColumnRenamed("sha", "of")
    # a group of over a thousandth of all rows is one of under a thousand: those are broadcast, so that no task gets a hot group
    size = F.col("group_size") * HOT_SHARE > total
    hot, on = F.broadcast(groups.where(size)), F.col("sha") == F.col("of")
    found = again.join(hot, on).unionByName(again.join(hot, on, "left_anti").join(groups.where(~size), on))
    rest = found.select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "sha")
    return alone.unionByName(rest).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_groups() keeps, with all their columns, whatever their names and types: rows that are unique for
    certain pass straight through; of the others, each task keeps the row of the largest id of a text before anything is shuffled.

    Of repeated rows one stays; rows of one id and text that differ elsewhere are told apart by their columns that have an order. Null
    texts count as empty, and the row that stays keeps its null. An empty table gives an empty result.
    """
    text, name = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), fresh(docs, "again")
    bloom, blocks = repeated_filter(docs.select(text.alias("txt")), F.col("txt"), docs.count())
    probed = maybe_repeated(docs, text, bloom, blocks, name)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ordered = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != id_col and "map<" not in kind and "variant" not in kind]
    row = F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns)))
    order = F.struct(F.col(f"`{id_col}`").alias("id"), *(c.alias(f"o{k}") for k, c in enumerate(ordered)))
    best = probed.where(F.col(name)).groupBy(F.sha2(text, 256).alias("sha")).agg(F.max_by(row, order).alias("row"))
    return probed.where(~F.col(name)).select(*columns).unionByName(best.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns))))
