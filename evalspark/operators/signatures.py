"""Content signatures of keyed datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.ordering import row_numbers


ROWS_PER_BLOCK = 100_000


def ordered_signature(df: DataFrame, keys: Sequence[str], seq: str, texts: dict[str, str],
                      rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """sha256 over the newline-joined digests of blocks of ``rows_per_block`` texts in ``seq`` order.

    One rule for any number of rows, and no task holds more than one block. Pass short texts (row digests).
    """
    pos = row_numbers(df.select(*keys, seq, *texts.values()), keys, [seq], "_i")
    block = F.floor(F.col("_i") / rows_per_block).alias("_blk")
    lists = F.array_sort(F.collect_list(F.struct("_i", *texts.values()))).alias("_l")
    digest = lambda c: F.sha2(F.array_join(F.transform("_l", lambda s: s[c]), "\n"), 256)
    blocks = pos.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"), lists).select(
        *keys, "_blk", "_n", *[digest(c).alias(n) for n, c in texts.items()])
    g = blocks.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.array_sort(F.collect_list(F.struct("_blk", *texts))).alias("_d"))
    whole = lambda n: F.sha2(F.array_join(F.transform("_d", lambda s: s[n]), "\n"), 256)
    return g.select(*keys, "n_rows", *[whole(n).alias(n) for n in texts])


def order_free_signature(df: DataFrame, keys: Sequence[str], parts: Sequence[Column]) -> DataFrame:
    """Count, xor and sum of 48-bit row digests: mergeable, so any dataset size works; row order does not matter.

    The sum is taken modulo 2^64 as a signed number: 32,768 digests may already leave the range. Its two halves of 24
    bits are added apart, which holds for 5 * 10^11 rows.
    """
    h = F.conv(F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")
    g = df.select(*keys, h.alias("_h")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_xor("_h").alias("sig_xor"),
        F.sum(F.shiftright("_h", 24)).alias("_high"), F.sum(F.col("_h").bitwiseAND((1 << 24) - 1)).alias("_low"))
    carried = F.col("_high") + F.shiftright("_low", 24)  # the low half's overflow
    total = F.shiftleft(carried, 24).bitwiseOR(F.col("_low").bitwiseAND((1 << 24) - 1))
    return g.select(*keys, "n_rows", "sig_xor", total.alias("sig_sum"))


def options_signature(options: dict, length: int = 16) -> str:
    """Hash of run options as sorted JSON (driver side; options are a few hundred values)."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:length]
