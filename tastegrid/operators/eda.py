"""Aggregates behind the exploratory charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastegrid.functions.numeric import epoch_year


def rating_histogram(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def counts_per(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def top_users(ratings: DataFrame, n: int = 10) -> DataFrame:
    return counts_per(ratings, "userId").orderBy(F.col("n").desc(), F.col("userId")).limit(n)


def top_movies(ratings: DataFrame, catalog: DataFrame, n: int = 20) -> DataFrame:
    """Most rated movies with titles; only the n winners meet the catalogue."""
    best = counts_per(ratings, "movieId").orderBy(F.col("n").desc(), F.col("movieId")).limit(n)
    return best.join(catalog.select("movieId", "title"), "movieId", "left")


def titled_ratings(ratings: DataFrame, links: DataFrame, movies: DataFrame) -> DataFrame:
    """Ratings ⟕ links ⟕ movies by tmdb id, for charts that show titles.

    Ratings without a tmdb id meet nothing; a second key deals them out over many tasks.
    """
    by_link = ratings.join(links.select("movieId", "tmdbId"), "movieId", "left")
    dealt = F.when(F.col("tmdbId").isNull(), F.pmod(F.xxhash64("userId", "movieId"), F.lit(4096))).otherwise(0)
    titles = movies.select(F.col("id").alias("tmdbId"), "title", F.lit(0).cast("long").alias("_dealt"))
    return by_link.withColumn("_dealt", dealt.cast("long")).join(titles, ["tmdbId", "_dealt"], "left").drop("_dealt")


def ratings_by_year(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(epoch_year("timestamp").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def year_histogram(catalog: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of release years; the last bin includes the maximum."""
    years = catalog.where(F.col("year").isNotNull()).select(F.col("year").cast("double").alias("y"))
    low = years.agg(F.min("y").alias("v")).scalar()
    high = years.agg(F.max("y").alias("v")).scalar()
    width = (high - low) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("y") - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return years.groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def summary(ratings: DataFrame) -> DataFrame:
    """One row of scale facts: moments, sizes, sparsity and averages per user and movie.

    The rating scale has ten steps, so the exact median needs ten counters.
    """
    facts = ratings.agg(
        F.avg("rating").alias("mean"), F.median("rating").alias("median"), F.stddev_samp("rating").alias("std"),
        F.min("rating").alias("min"), F.max("rating").alias("max"), F.count(F.lit(1)).alias("n_ratings"),
    )
    sizes = ratings.agg(F.countDistinct("userId").alias("u")).scalar(), ratings.agg(F.countDistinct("movieId").alias("i")).scalar()
    n, u, i = F.col("n_ratings"), F.col("n_users"), F.col("n_movies")
    return (
        facts.withColumn("n_users", sizes[0])
        .withColumn("n_movies", sizes[1])
        .withColumn("density", n / (u.cast("double") * i))
        .withColumn("sparsity", 1.0 - F.col("density"))
        .withColumn("ratings_per_user", n / u)
        .withColumn("ratings_per_movie", n / i)
    )
