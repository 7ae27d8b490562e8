"""A blocked Bloom filter held as a DataFrame.

Each key falls into one 64-bit block and sets four bits of it; 64 blocks make a
row of packed words. Building is a ``bit_or`` aggregation with map-side combine,
and probing is a single broadcast hash join on the row: no Python, no
driver-side bitmap, and a size that is proven by the number of blocks (8 bytes
each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest number of blocks, 64 MB to broadcast: 16 bits a key up to 32 million keys, 4 bits up to 128 million.
MAX_BLOCKS = 1 << 23
MIN_BLOCKS = 1 << 8
KEYS_PER_BLOCK = 4
#: Keys of a block beyond which most keys pass, so that the filter is not worth its broadcast.
FULL = 16
#: Blocks of a row.
ROW = 64


def blocks_for(n_keys: int) -> int:
    """Number of blocks for ``n_keys``, a power of two within the bounds."""
    want = max(MIN_BLOCKS, n_keys // KEYS_PER_BLOCK)
    return min(MAX_BLOCKS, 1 << (want - 1).bit_length())


def is_worth(n_keys: int, n_blocks: int) -> bool:
    return n_keys <= FULL * n_blocks


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(0x5EED))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def build(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(bloom_row, bloom_words) of the non-null values of ``key``; at most ``n_blocks / ROW`` rows of ROW words."""
    blocks = (
        keys.where(F.col(key).isNotNull())
        .groupBy(_block(F.col(key), n_blocks).alias("block"))
        .agg(F.bit_or(_mask(F.col(key))).alias("bits"))
    )
    row = blocks.groupBy(F.shiftright("block", 6).alias("bloom_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("block").bitwiseAND(ROW - 1), "bits"))).alias("set"))
    return row.select("bloom_row", F.transform(F.sequence(F.lit(0), F.lit(ROW - 1)), lambda i: F.coalesce(F.try_element_at("set", i), F.lit(0).cast("long"))).alias("bloom_words"))


def probe(rows: DataFrame, key: str, bloom: DataFrame, n_blocks: int, flag: str) -> DataFrame:
    """``rows`` with boolean ``flag``: false proves that ``key`` is not in the filter (null: false)."""
    probed = rows.withColumn("__block", _block(F.col(key), n_blocks))
    joined = probed.join(F.broadcast(bloom), F.shiftright(probed["__block"], 6) == bloom["bloom_row"], "left")
    mask = _mask(F.col(key))
    word = F.get("bloom_words", F.col("__block").bitwiseAND(ROW - 1))
    hit = F.col("bloom_words").isNotNull() & F.col(key).isNotNull() & (word.bitwiseAND(mask) == mask)
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__block", "bloom_row", "bloom_words")
