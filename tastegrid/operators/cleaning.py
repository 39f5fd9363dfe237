"""Cleaning of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.functions import jsonish, numeric

# Accepted ranges.
RUNTIME_RANGE = (30.0, 300.0)
YEAR_RANGE = (1900, 2026)
RATING_RANGE = (0.5, 5.0)
NUMERIC_FIELDS = ("budget", "revenue", "runtime", "popularity", "vote_average", "vote_count")


def with_numeric_id(raw: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id reads as a number, id as long."""
    return raw.withColumn(column, numeric.id_number(column)).where(F.col(column).isNotNull())


def clean_movies(raw: DataFrame) -> DataFrame:
    """Typed movies: ids and numbers coerced, zero money to null, date parts, genre lists, range filter."""
    df = with_numeric_id(raw)
    for field in NUMERIC_FIELDS:
        if field in df.columns:
            value = numeric.number(field)
            df = df.withColumn(field, numeric.zero_to_null(value) if field in ("budget", "revenue") else value)
    if "release_date" in df.columns:
        df = (
            df.withColumn("release_date", F.try_to_timestamp("release_date"))
            .withColumn("year", F.year("release_date"))
            .withColumn("month", F.month("release_date"))
        )
    if "runtime" in df.columns:
        df = df.where(F.col("runtime").between(*RUNTIME_RANGE))
    if "year" in df.columns:
        df = df.where(F.col("year").between(*YEAR_RANGE))
    if "genres" in df.columns:
        df = df.withColumn("genres_parsed", jsonish.parse_items_or_empty(F.col("genres"))).withColumn(
            "genre_names", jsonish.names(F.col("genres_parsed"))
        )
    return df


def clean_credits(raw: DataFrame) -> DataFrame:
    """Cast and crew lists, first five cast names, directors."""
    return (
        with_numeric_id(raw)
        .withColumn("cast_parsed", jsonish.parse_items_or_empty(F.col("cast")))
        .withColumn("crew_parsed", jsonish.parse_items_or_empty(F.col("crew")))
        .withColumn("cast_names", jsonish.first_names(F.col("cast_parsed")))
        .withColumn("director", jsonish.names_with_job(F.col("crew_parsed")))
    )


def clean_keywords(raw: DataFrame) -> DataFrame:
    return (
        with_numeric_id(raw)
        .withColumn("keywords_parsed", jsonish.parse_items_or_empty(F.col("keywords")))
        .withColumn("keyword_names", jsonish.names(F.col("keywords_parsed")))
    )


def list_rejects(raw: DataFrame, column: str) -> DataFrame:
    """How many cells of a list column could not be read."""
    cell = F.col(column)
    bad = jsonish.is_reject(cell, jsonish.parse_items(cell))
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejects"))


def clean_ratings(raw: DataFrame) -> DataFrame:
    """Whole-row duplicates dropped, ratings inside the scale."""
    return raw.where(F.col("rating").between(*RATING_RANGE)).dropDuplicates()


def clean_links(raw: DataFrame) -> DataFrame:
    """Numeric link ids, one row per movieId (lowest tmdbId)."""
    typed = raw
    for column in ("movieId", "tmdbId", "imdbId"):
        if column in typed.columns:
            typed = typed.withColumn(column, numeric.id_number(column))
    typed = typed.where(F.col("movieId").isNotNull() & F.col("tmdbId").isNotNull())
    order = [F.col("tmdbId")] + ([F.col("imdbId").asc_nulls_last()] if "imdbId" in typed.columns else [])
    first = Window.partitionBy("movieId").orderBy(*order)
    return typed.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def rating_time_features(ratings: DataFrame) -> DataFrame:
    """Approximate calendar parts and the rating on a 0..1 scale."""
    return (
        ratings.withColumn("year", numeric.mean_year("timestamp"))
        .withColumn("month", numeric.mean_month("timestamp"))
        .withColumn("day_of_week", numeric.day_slot("timestamp"))
        .withColumn("rating_normalized", (F.col("rating") - 0.5) / 4.5)
    )


def user_item(ratings: DataFrame) -> DataFrame:
    """One row per (userId, movieId): the best rating and the latest time."""
    extra = [F.max("timestamp").alias("timestamp")] if "timestamp" in ratings.columns else []
    return ratings.groupBy("userId", "movieId").agg(F.max("rating").alias("rating"), *extra)


def dense_index(df: DataFrame, column: str, out: str) -> DataFrame:
    """``(column, out)`` with 0-based dense indexes in id order, numbered without a single-task sort."""
    from tastegrid.operators.ranking import global_rank

    ranked = global_rank(df.select(column).distinct(), [F.col(column)], "_r")
    return ranked.select(column, (F.col("_r") - 1).alias(out))
