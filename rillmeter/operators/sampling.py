"""Repeatable random samples without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of the row's key.

    The choice depends on seed and key only, not on partitioning. A table much
    larger than the sample is first cut to the lowest hashes, about the sample's
    own size, so tasks do not each send ``n`` rows to be merged; the cut is
    counted and widened until it holds the whole sample.
    """
    token = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    drawn = df.withColumn("_draw", token)
    total = df.count()
    share = (n + 8 * n**0.5 + 32) / max(total, 1)
    while share < 0.25:
        cut = drawn.where(F.col("_draw") < F.lit(f"{int(share * 16**32):032x}"))
        if cut.count() >= n:
            drawn = cut
            break
        share *= 4
    return drawn.orderBy("_draw").limit(n).drop("_draw")


def sample_per_group(df: DataFrame, by: str, groups: Sequence, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """:func:`sample_rows` within each of a few known groups."""
    parts = [sample_rows(df.where(F.col(by) == g), keys, n, seed) for g in groups]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
