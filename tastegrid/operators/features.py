"""User and item feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.config import DEFAULTS
from tastegrid.functions.numeric import DAY
from tastegrid.operators.ranking import average_rank
from tastegrid.operators.skew import split_join
from tastegrid.operators.staging import stage


def user_features(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("userId").agg(
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("std_rating"),
        F.count("rating").alias("n_ratings"),
        F.min("timestamp").alias("first_rating"),
        F.max("timestamp").alias("last_rating"),
    ).withColumn(
        "rating_span_days", F.floor((F.col("last_rating") - F.col("first_rating")) / DAY).cast("long")
    )


def movie_features(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("std_rating"),
        F.count("rating").alias("n_ratings"),
        F.countDistinct("userId").alias("n_unique_users"),
    )


def _spread(ratings: DataFrame, key: str, other: str, distinct_name: str) -> DataFrame:
    return ratings.groupBy(key).agg(
        F.count("rating").alias("n_ratings"),
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("std_rating"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.countDistinct(other).alias(distinct_name),
    )


def user_activity(ratings: DataFrame) -> DataFrame:
    df = _spread(ratings, "userId", "movieId", "n_unique_movies")
    return df.withColumn("rating_diversity", F.col("max_rating") - F.col("min_rating"))


def movie_popularity(ratings: DataFrame) -> DataFrame:
    """Spread per movie plus average-method ranks by count and by mean."""
    df = _spread(ratings, "movieId", "userId", "n_unique_users").withColumn(
        "rating_consistency", 1.0 / (1.0 + F.coalesce("std_rating", F.lit(0.0)))
    )
    # ranked after rounding so that means equal up to float noise share their rank
    df = stage(df.withColumn("_mean", F.round("avg_rating", 9)), "movie-spread")
    return average_rank(average_rank(df, "n_ratings", "popularity_rank"), "_mean", "avg_rating_rank").drop("_mean")


def item_tags(catalog: DataFrame, column: str, out: str) -> DataFrame:
    """Long form ``(movieId, tag)``, each tag once per item."""
    return catalog.where(F.col("movieId").isNotNull()).select(
        "movieId", F.explode(F.array_distinct(column)).alias(out)
    )


def rated_tags(ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """Ratings ⋈ item tags; an item with very many ratings is dealt over several tasks."""
    return split_join(tags, ratings.select("userId", "movieId", "rating"), "movieId", "userId")


def user_top_genres(ratings: DataFrame, catalog: DataFrame, n: int = 3) -> DataFrame:
    """Most rated genres per user, best first."""
    counts = rated_tags(ratings, item_tags(catalog, "genre_names", "genre")).groupBy("userId", "genre").agg(
        F.count(F.lit(1)).alias("c")
    )
    w = Window.partitionBy("userId").orderBy(F.col("c").desc(), F.col("genre"))
    best = counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("rn", "genre")))
    return best.groupBy("userId").agg(F.transform(ordered, lambda x: x["genre"]).alias("top_genres"))


def bias(ratings: DataFrame, key: str, out: str) -> DataFrame:
    """Group mean minus the mean over all ratings (a scalar subquery)."""
    overall = ratings.agg(F.avg("rating").alias("m")).scalar()
    return ratings.groupBy(key).agg(F.avg("rating").alias("_m")).select(key, (F.col("_m") - overall).alias(out))


def release_features(catalog: DataFrame, key: str = "movieId") -> DataFrame:
    """Age against the latest year of the catalogue, and decade."""
    dated = catalog.where(F.col("year").isNotNull()).select(key, "year", "month")
    latest = dated.agg(F.max("year").alias("y")).scalar()
    return dated.withColumn("movie_age_years", latest - F.col("year")).withColumn(
        "decade", (F.floor(F.col("year") / 10) * 10).cast("long")
    )


def engineered_users(ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    return (
        user_activity(ratings)
        .join(user_top_genres(ratings, catalog), "userId", "left")
        .join(bias(ratings, "userId", "user_rating_bias"), "userId", "left")
    )


def engineered_movies(ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    return (
        movie_popularity(ratings)
        .join(release_features(catalog), "movieId", "left")
        .join(bias(ratings, "movieId", "movie_rating_bias"), "movieId", "left")
    )


def tag_stats(ratings: DataFrame, tags: DataFrame, tag: str, *, deviation: bool = True) -> DataFrame:
    """Per tag: mean of item means, ratings, (deviation of item means,) items.

    Ratings are reduced to one row per movie before they meet the tags.
    """
    per_movie = ratings.groupBy("movieId").agg(F.avg("rating").alias("m"), F.count("rating").alias("c"))
    aggs = [F.avg("m").alias("avg_rating"), F.sum("c").alias("n_ratings")]
    if deviation:
        aggs.append(F.stddev_samp("m").alias("std_rating"))
    return tags.join(per_movie, "movieId").groupBy(tag).agg(*aggs, F.count("movieId").alias("n_movies"))


def filter_active(
    ratings: DataFrame,
    *,
    min_ratings: int = DEFAULTS.min_ratings,
    min_movie_ratings: int = 3,
    max_users: int | None = None,
    max_movies: int | None = None,
) -> DataFrame:
    """Users and movies with enough ratings, both counted on the unfiltered input.

    The optional caps are the caller's choice of the most active users or movies; they are off by
    default.
    """

    def active(key: str, at_least: int, cap: int | None) -> DataFrame:
        counts = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
        if at_least > 1:
            counts = counts.where(F.col("c") >= at_least)
        if cap is not None:
            counts = counts.orderBy(F.col("c").desc(), F.col(key)).limit(cap)
        return counts.select(key)

    users = active("userId", min_ratings, max_users)
    # a movie cap replaces the movie threshold
    movies = active("movieId", 1 if max_movies is not None else min_movie_ratings, max_movies)
    return ratings.join(users, "userId", "left_semi").join(movies, "movieId", "left_semi")
