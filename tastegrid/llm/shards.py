"""Weighted rendezvous hashing of stable record keys over shards, in DataFrame functions only.

Every shard draws a number for a key from a hash of (key, shard); the shard whose ``-weight / ln(u)`` is
largest wins. The draws of the old shards do not depend on how many shards there are, so one more shard
takes rows only into itself, and it takes its share ``weight / sum(weights)`` of them.

Defined results: a null key is a key like any other (all such rows share one shard); a null text has no bytes
and checksum 0; repeated keys go to the same shard and get different slots; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

ROWS_PER_CELL = 200_000  # rows numbered by one window partition


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard of ``key``; ``weights[i]`` is the weight of shard ``i``."""

    def score(shard: int, weight: float) -> Column:
        # 53 bits of the hash, moved off both ends of (0, 1)
        drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit("rendezvous")), 11)
        return -F.lit(float(weight)) / F.ln((drawn + F.lit(0.5)) / F.lit(float(1 << 53)))

    ranked = F.array(*(F.struct(score(i, w).alias("s"), F.lit(-i).alias("n")) for i, w in enumerate(weights)))
    return (-F.array_max(ranked)["n"]).cast("int")


def assign(
    df: DataFrame,
    key: str,
    text: str,
    weights: Sequence[float],
    grown: Sequence[float] | None = None,
    overhead: int = 16,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` of every row.

    ``slot`` numbers a shard's rows without gaps from 0. A shard is numbered in cells of its keys' hashes of
    about ``rows_per_cell`` rows each, with one offset per cell, so no task ever sorts a whole shard. Rows of one
    key share a cell unless the key is repeated more often than a cell should hold rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)
    rows = df.select(
        F.col(key),
        size.alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("shard", rendezvous(F.col(key), weights)).withColumn(
        "grown_shard", rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")
    )
    total = df.count()
    cells = max(8, -(-total // (rows_per_cell * len(weights))))
    rows = rows.withColumn(
        "_cell", F.pmod(F.xxhash64(F.col(key), "text_crc32", "size", F.lit("cell")), F.lit(cells)).cast("int")
    )
    # at most shards x cells rows, that is rows / rows_per_cell
    counts = rows.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_cell").orderBy(key, "text_crc32", "size")
    return (
        rows.withColumn("_at", F.row_number().over(within))
        .join(offsets, ["shard", "_cell"])
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
