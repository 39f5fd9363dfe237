"""Joins and per-key numbering that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.config import DEFAULTS


def hot_keys(df: DataFrame, key: str, rows_per_split: int = DEFAULTS.rows_per_split) -> DataFrame:
    """``(key, _rows, _splits)`` of the keys with more than ``rows_per_split`` rows.

    At most ``total_rows / rows_per_split`` keys can qualify, which is what makes the result safe to
    broadcast: 3e12 rows give at most 3e6 narrow rows.
    """
    return hot_from_counts(df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), key, "_rows", rows_per_split)


def hot_from_counts(counts: DataFrame, key: str, n: str, rows_per_split: int = DEFAULTS.rows_per_split) -> DataFrame:
    """Same as :func:`hot_keys` for a table that already carries one count per key."""
    return counts.where(F.col(n) > rows_per_split).select(
        key,
        F.col(n).alias("_rows"),
        F.ceil(F.col(n) / rows_per_split).cast("int").alias("_splits"),
    )


NO_HOT_KEYS = False  # value of ``hot`` when a caller has already found that there are none


def checked(hot: DataFrame) -> DataFrame | bool:
    """The table of hot keys, or ``NO_HOT_KEYS`` when it is empty; for callers that join repeatedly."""
    return NO_HOT_KEYS if hot.isEmpty() else hot


def split_join(
    small: DataFrame,
    long: DataFrame,
    key: str,
    spread: str,
    *,
    hot: DataFrame | bool | None = None,
    rows_per_split: int = DEFAULTS.rows_per_split,
) -> DataFrame:
    """Inner equi-join whose ``long`` side may be dominated by single keys.

    Rows of a hot key are dealt over ``_splits`` sub-keys by the hash of ``spread``; the matching rows
    of the other side are repeated once per sub-key. Cold keys keep one sub-key, so nothing is copied
    for them. Without any hot key (one light counting job tells) it is an ordinary join.
    """
    if hot is None:
        hot = hot_keys(long, key, rows_per_split)
    if hot is NO_HOT_KEYS or checked(hot) is NO_HOT_KEYS:
        return small.join(long, key)
    hot = F.broadcast(hot.select(key, "_splits"))
    dealt = long.join(hot, key, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_splits")).cast("int"), F.lit(0))
    )
    repeated = small.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits") - 1, F.lit(0))))
    )
    return repeated.drop("_splits").join(dealt.drop("_splits"), [key, "_salt"]).drop("_salt")


def numbered_per_key(
    df: DataFrame,
    key: str,
    order: list[Column],
    position: Column,
    *,
    rows_per_split: int = DEFAULTS.rows_per_split,
) -> DataFrame:
    """Add ``_rn`` (1-based place within ``key``) and ``_n`` (rows of ``key``).

    ``position`` maps the leading order expression monotonically into [0, 1). Keys above
    ``rows_per_split`` are cut into order-preserving ranges of it; each range is numbered on its own
    and shifted by the sizes of the ranges before it. All other keys use one ordinary window.
    """
    hot = hot_keys(df, key, rows_per_split)
    if hot.isEmpty():
        whole = Window.partitionBy(key)
        return df.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn(
            "_rn", F.row_number().over(whole.orderBy(*order))
        )
    cut = df.join(F.broadcast(hot), key, "left").withColumn(
        "_range",
        F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(F.floor(position * F.col("_splits")).cast("int")),
    )
    # one row per range of a hot key: bounded by 2 * total_rows / rows_per_split, like the hot keys
    sizes = cut.where(F.col("_splits").isNotNull()).groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    cell = Window.partitionBy(key, "_range")
    return (
        cut.withColumn("_n", F.coalesce("_rows", F.count(F.lit(1)).over(cell)))
        .withColumn("_rn", F.row_number().over(cell.orderBy(*order)))
        .join(F.broadcast(offsets), [key, "_range"], "left")
        .withColumn("_rn", F.col("_rn") + F.coalesce("_offset", F.lit(0)))
        .drop("_range", "_splits", "_rows", "_offset")
    )
