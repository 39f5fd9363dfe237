"""Global ranks, running totals and exact quantiles without a single-task window over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.config import DEFAULTS
from tastegrid.operators.staging import stage


def score_key(column: str, digits: int = DEFAULTS.score_digits) -> Column:
    """Scores are compared after rounding so that equal values tie on every engine."""
    return F.round(F.col(column), digits)


def top_n(df: DataFrame, key: str, score: str, item: str, n: int) -> DataFrame:
    """Best ``n`` rows per key with a ``rank`` column.

    The ``rank <= n`` filter sits right on the window, so each task keeps at most n rows per key
    before the exchange; a key holding most of the table still sends only a handful of rows.
    """
    w = Window.partitionBy(key).orderBy(score_key(score).desc(), F.col(item).asc())
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def _placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Range-sorted copy of ``df`` with its sort partition ``_part`` and place ``_pos`` in it."""
    ident = F.monotonically_increasing_id()  # partition number in the upper 31 bits, row number below
    copy = stage(df.orderBy(*order).withColumn("_mid", ident), name)
    return copy.select(
        "*", F.shiftright("_mid", 33).alias("_part"), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")
    ).drop("_mid")


def _part_offsets(placed: DataFrame, amount: Column) -> DataFrame:
    """Running total over whole sort partitions: as many rows as the sort had tasks."""
    totals = placed.groupBy("_part").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1-based global row number in the given total order."""
    placed = _placed(df, order, "rank")
    offsets = F.broadcast(_part_offsets(placed, F.lit(1)))
    return (
        placed.join(offsets, "_part")
        .withColumn(out, (F.col("_offset") + F.col("_pos") + 1).cast("long"))
        .drop("_part", "_pos", "_offset")
    )


def running_total(df: DataFrame, order: list[Column], amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over all rows strictly before each row in the given total order."""
    placed = _placed(df, order, "running")
    offsets = F.broadcast(_part_offsets(placed, F.col(amount)))
    within = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(offsets, "_part")
        .withColumn(out, F.col("_offset") + F.col("_within"))
        .drop("_part", "_pos", "_offset", "_within")
    )


RANKS_BROADCAST = 1_000_000  # most distinct values that are sent to every task


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Descending rank with ties sharing their mean place; nulls stay unranked.

    Only the table of distinct values is ordered; the ranks are joined back by value.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_ties"))
    placed = running_total(counts, [F.col(column).desc()], "_ties", "_above")
    ranks = placed.select(column, (F.col("_above") + (F.col("_ties") + 1) / 2.0).cast("double").alias(out))
    ranks = stage(ranks, "ranks")
    if ranks.count() <= RANKS_BROADCAST:  # a value that most rows share then meets its rank without a shuffle
        ranks = F.broadcast(ranks)
    return df.join(ranks, column, "left")


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One-row frame ``(value)`` with the linearly interpolated quantile.

    Works on the histogram of distinct values, ordered by a distributed sort, so neither many rows
    nor many distinct values meet in one task.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    cum = running_total(counts, [F.col("v").asc()], "c", "before")
    n = cum.agg(F.sum("c").alias("n")).scalar()
    place = (n - 1) * F.lit(q)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("c"))
    edges = cum.where(holds(low) | holds(high)).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return edges.select((F.col("a") + (F.col("b") - F.col("a")) * (place - low)).alias("value"))


def filled_lists(best: DataFrame, asked: DataFrame, items: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """``best (l, rank, r, score)`` with every list of ``asked (l)`` filled up to ``n`` by the smallest ids of ``items (r)``,
    at score 0; ``gone (l, r)`` are pairs that no list may hold.

    A list with ``h`` rows and ``g`` pairs gone finds what it lacks among the ``n + h + g`` smallest ids, so it joins that many
    places of the ordered items.
    """
    sizes = best.groupBy("l").agg(F.count(F.lit(1)).alias("_have"))
    lost = gone.groupBy("l").agg(F.count(F.lit(1)).alias("_gone"))
    short = asked.select("l").distinct().join(sizes, "l", "left").where(F.coalesce("_have", F.lit(0)) < n)
    short = stage(short.join(lost, "l", "left").fillna(0, ["_have", "_gone"]), "short-lists")
    if short.isEmpty():
        return best
    places = global_rank(items.select("r").distinct(), [F.col("r").asc()], "_place")
    more = short.select("l", "_have", F.explode(F.sequence(F.lit(1), n + F.col("_have") + F.col("_gone"))).alias("_place"))
    more = more.join(places, "_place").join(best.select("l", "r"), ["l", "r"], "left_anti").join(gone.select("l", "r"), ["l", "r"], "left_anti")
    rank = F.col("_have") + F.row_number().over(Window.partitionBy("l").orderBy("r"))
    more = more.select("l", rank.cast("long").alias("rank"), "r", F.lit(0.0).alias("score")).where(F.col("rank") <= n)
    return best.select("l", "rank", "r", "score").unionByName(more)
