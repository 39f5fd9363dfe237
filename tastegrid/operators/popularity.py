"""Bayesian popularity and the ranked lists built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.config import DEFAULTS
from tastegrid.operators.blocks import block_top, finish_biased, finish_overlap_bias
from tastegrid.operators.ranking import global_rank, score_key, top_n
from tastegrid.operators.staging import stage


def bayes_popularity(ratings: DataFrame, quantile: float = DEFAULTS.smoothing_quantile) -> DataFrame:
    """Mean rating shrunk towards the mean of movie means, by the given quantile of the counts.

    ``percentile`` keeps one counter per distinct count, at most about the square root of twice the
    rating rows, so the exact aggregate stays small.
    """
    stats = ratings.groupBy("movieId").agg(F.count("rating").alias("n_ratings"), F.avg("rating").alias("avg_rating"))
    c = stats.agg(F.percentile("n_ratings", quantile).alias("c")).scalar()
    m = stats.agg(F.avg("avg_rating").alias("m")).scalar()
    n = F.col("n_ratings")
    return stats.withColumn("score", n / (n + c) * F.col("avg_rating") + c / (n + c) * m)


def with_any_tag(popularity: DataFrame, catalog: DataFrame, tags: list[str]) -> DataFrame:
    """Popularity rows of the items that carry any of the tags."""
    wanted = catalog.where(F.arrays_overlap("genre_names", F.array(*[F.lit(t) for t in tags]))).select("movieId")
    return popularity.join(wanted, "movieId", "left_semi")


def ranked(popularity: DataFrame) -> DataFrame:
    return global_rank(popularity, [score_key("score").desc(), F.col("movieId").asc()])


def pages(popularity: DataFrame, page_size: int = DEFAULTS.page_size) -> DataFrame:
    """Ranked list cut into numbered pages."""
    return ranked(popularity).withColumn("page", F.floor((F.col("rank") - 1) / page_size).cast("long") + 1)


def _quota(users: DataFrame, seen: DataFrame) -> DataFrame:
    counts = seen.groupBy("userId").agg(F.count(F.lit(1)).alias("_seen"))
    return users.select("userId").distinct().join(counts, "userId", "left").na.fill(0, ["_seen"])


def popular_for_users(
    popularity: DataFrame,
    users: DataFrame,
    seen: DataFrame,
    *,
    n: int = DEFAULTS.top_n,
    light_history: int = DEFAULTS.light_history,
) -> DataFrame:
    """``(userId, rank, movieId, score)``: most popular unseen items of every user.

    A user with s seen items can only receive ranks up to n + s. Users with short histories take the first n of
    those ranks that none of their seen items holds: only seen items that are in the head of the list, which has
    at most ``n + light_history`` rows and is therefore safe to broadcast, are gathered per user, and the ranks
    become rows when the n are chosen. The few users beyond that bound are scored against the whole list
    tile by tile.
    """
    seen = seen.select("userId", "movieId").join(users.select("userId"), "userId", "left_semi").distinct()
    quota = stage(_quota(users, seen), "quota")
    order = ranked(popularity.select("movieId", "score")).withColumnRenamed("rank", "_place")
    head = stage(order.where(F.col("_place") <= n + light_history), "list-head")
    gone = seen.join(F.broadcast(head.select("movieId", "_place")), "movieId").groupBy("userId").agg(F.collect_list("_place").alias("_gone"))
    places = F.sequence(F.lit(1).cast("long"), F.col("_seen") + n)
    free = F.slice(F.array_except(places, F.coalesce("_gone", F.array().cast("array<bigint>"))), 1, n)
    light = (
        quota.where(F.col("_seen") <= light_history)
        .join(gone, "userId", "left")
        .select("userId", F.posexplode(free).alias("_at", "_place"))
        .join(F.broadcast(head), "_place")
        .select("userId", "movieId", "score", (F.col("_at") + 1).cast("long").alias("rank"))
    )
    heavy_users = quota.where(F.col("_seen") > light_history).select("userId")
    if heavy_users.isEmpty():
        return light
    heavy = block_top(
        heavy_users.select(F.col("userId").alias("l"), F.lit(0).alias("col"), F.lit(0.0).alias("w0")),
        order.select(F.col("movieId").alias("r"), F.lit(0).alias("col"), F.lit(0.0).alias("w0")),
        n=n,
        finish=finish_biased,
        skip=seen.join(heavy_users, "userId", "left_semi").select(F.col("userId").alias("l"), F.col("movieId").alias("r")),
        bias=order.select(F.col("movieId").alias("r"), F.col("score").alias("bias")),
    ).select(F.col("l").alias("userId"), F.col("r").alias("movieId"), "score", "rank")
    return light.unionByName(heavy)


def popular_in_genres(
    popularity: DataFrame,
    tags: DataFrame,
    wanted: DataFrame,
    seen: DataFrame,
    *,
    n: int = DEFAULTS.top_n,
    light_history: int = DEFAULTS.light_history,
) -> DataFrame:
    """Popular unseen items that carry any genre a user prefers.

    ``tags``: ``movieId, genre``; ``wanted``: ``userId, genre``. Each genre keeps a ranked list; users
    with short histories need only its first ``n + seen`` places, the others go through score tiles.
    """
    wanted = wanted.select("userId", "genre").distinct()
    seen = seen.select("userId", "movieId").distinct().join(wanted, "userId", "left_semi")
    quota = stage(_quota(wanted, seen), "quota")
    scored = tags.select("movieId", "genre").distinct().join(popularity.select("movieId", "score"), "movieId")
    place = Window.partitionBy("genre").orderBy(score_key("score").desc(), F.col("movieId"))
    heads = scored.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n + light_history)
    light = (
        wanted.join(quota.where(F.col("_seen") <= light_history), "userId")
        .select("userId", "genre", F.explode(F.sequence(F.lit(1), (F.col("_seen") + n).cast("int"))).alias("_place"))
        .join(heads, ["genre", "_place"])
        .select("userId", "movieId", "score")
        .distinct()
        .join(seen, ["userId", "movieId"], "left_anti")
    )
    heavy_users = quota.where(F.col("_seen") > light_history).select("userId")
    if heavy_users.isEmpty():
        return top_n(light, "userId", "score", "movieId", n)
    heavy = block_top(
        wanted.join(heavy_users, "userId", "left_semi").select(
            F.col("userId").alias("l"), F.col("genre").alias("col"), F.lit(1.0).alias("w0")
        ),
        scored.select(F.col("movieId").alias("r"), F.col("genre").alias("col"), F.lit(1.0).alias("w0")),
        n=n,
        finish=finish_overlap_bias,
        skip=seen.join(heavy_users, "userId", "left_semi").select(F.col("userId").alias("l"), F.col("movieId").alias("r")),
        bias=scored.select(F.col("movieId").alias("r"), F.col("score").alias("bias")).distinct(),
    ).select(F.col("l").alias("userId"), F.col("r").alias("movieId"), "score")
    return top_n(light.unionByName(heavy), "userId", "score", "movieId", n)
