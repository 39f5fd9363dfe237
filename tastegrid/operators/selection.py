"""Column filters and fills before modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tastegrid.operators.ranking import exact_quantile
from tastegrid.operators.staging import stage

# The feature columns kept for users and movies, optional ones last.
USER_COLUMNS = (
    "userId", "n_ratings", "avg_rating", "std_rating", "n_unique_movies", "user_rating_bias",
    "rating_span_days", "rating_diversity", "top_genres",
)
MOVIE_COLUMNS = (
    "movieId", "n_ratings", "avg_rating", "std_rating", "n_unique_users", "movie_rating_bias",
    "rating_consistency", "popularity_rank", "avg_rating_rank", "movie_age_years", "decade",
)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def variances(df: DataFrame) -> DataFrame:
    """``(column, variance)`` of every numeric column, from one pass over the table."""
    columns = _numeric(df)
    wide = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("variance")) for c in columns])
    return wide.select(F.inline(pairs))


def low_variance_columns(df: DataFrame, threshold: float = 0.01) -> list[str]:
    """Names of the numeric columns below the threshold; undefined variance is kept."""
    return [r["column"] for r in variances(df).where(F.col("variance") < threshold).collect()]


def drop_low_variance(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    return df.drop(*low_variance_columns(df, threshold))


def fill_missing(df: DataFrame) -> DataFrame:
    """Numbers to the column median, everything else to 'Unknown'; complete columns stay untouched.

    Null counts come from one pass; a median is computed only for a column that needs it, on its
    histogram of distinct values.
    """
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    out = df
    for field in df.schema.fields:
        if not gaps[field.name]:
            continue
        if isinstance(field.dataType, T.NumericType):
            median = exact_quantile(df, field.name, 0.5).first()
            fill = F.lit(median["value"] if median else None)
            kind = "double"
        elif isinstance(field.dataType, T.ArrayType):
            fill, kind = F.array(F.lit("Unknown")), field.dataType
        else:
            fill, kind = F.lit("Unknown"), "string"
        out = out.withColumn(field.name, F.coalesce(F.col(field.name).cast(kind), fill))
    return out


def select_present(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def process_features(users: DataFrame, movies: DataFrame, threshold: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Low-variance drop, fill, then the final column sets. Both tables are read several times, so they are stored first."""
    stored = [stage(users, "user-features"), stage(movies, "movie-features")]
    ready = [fill_missing(drop_low_variance(df, threshold)) for df in stored]
    return select_present(ready[0], USER_COLUMNS), select_present(ready[1], MOVIE_COLUMNS)
