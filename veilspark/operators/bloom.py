"""A blocked Bloom filter made of built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_left_join

#: A key sets so many bits, all in one block of WORDS longs.
HASHES, WORDS = 3, 4


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """For each word of the block the bits that the key sets in it: eight bits of a second hash name the word and the bit."""
    h = F.xxhash64(key, F.lit(1))
    probes = [F.shiftrightunsigned(h, 8 * i) for i in range(HASHES)]
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    out = []
    for w in range(WORDS):
        mask = no
        for p in probes:
            bit = F.call_function("shiftleft", one, p.bitwiseAND(F.lit(63)).cast("int"))
            mask = mask.bitwiseOR(F.when(F.shiftrightunsigned(p, 6).bitwiseAND(F.lit(WORDS - 1)) == w, bit).otherwise(no))
        out.append(mask)
    return out


#: Bits a member, and the most bits of a filter that is broadcast (some 32 MB); a larger one is joined block by block instead.
BITS_A_MEMBER, MOST_BITS = 12, 1 << 27


def bits_for(members: DataFrame, member_key: str) -> int:
    """A power of two that gives each distinct member BITS_A_MEMBER bits or more, by an approximate count (one number comes to the driver)."""
    n = members.agg(F.approx_count_distinct(member_key, 0.05)).first()[0]
    return 1 << max(16, (n * BITS_A_MEMBER - 1).bit_length())


def mark_absent(df: DataFrame, key: str, members: DataFrame, member_key: str, out: str, bits: int | None = None, most: int = MOST_BITS) -> DataFrame:
    """`df` with the boolean `out`: true only if `key` is certainly no `member_key` of `members`; null for a null key.

    The filter has bits / 256 rows at most; `bits` follows from the number of members (see bits_for), so the share of keys that
    stay undecided doesn't grow with it; callers verify those exactly. Up to `most` bits it is broadcast. A larger one is
    partitioned by block and rows go to their block, those of frequent blocks salted. Members meet map-side, by bit_or, so a
    member that holds a third of the rows is one row a task. Without members every key is absent.
    """
    if bits is None:
        bits = bits_for(members, member_key)
    blocks = max(1, bits // (64 * WORDS))
    m = members.where(F.col(member_key).isNotNull()).select(_block(F.col(member_key), blocks).alias("_block"), *[x.alias(f"_m{i}") for i, x in enumerate(_masks(F.col(member_key)))])
    words = m.groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(WORDS)])
    placed = df.withColumn("_block", _block(F.col(key), blocks))
    probed = placed.join(F.broadcast(words), "_block", "left") if bits <= most else salted_left_join(placed, words, "_block", F.struct(*df.columns))
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col(key))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(mask) == mask)
    return probed.select(*df.columns, F.when(F.col(key).isNotNull(), ~F.coalesce(hit, F.lit(False))).alias(out))
