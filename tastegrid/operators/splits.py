"""Hold-out splits and seeded user samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastegrid.config import DEFAULTS
from tastegrid.functions.numeric import hash_position, keyed_hash
from tastegrid.operators.ranking import exact_quantile
from tastegrid.operators.skew import numbered_per_key


def mark_user_split(
    ratings: DataFrame,
    *,
    test_share: float = DEFAULTS.test_share,
    min_ratings: int = DEFAULTS.min_ratings_per_user,
    seed: int = DEFAULTS.seed,
    rows_per_split: int = DEFAULTS.rows_per_split,
) -> DataFrame:
    """Ratings of users with enough rows plus ``is_test``: a seeded share of each user's rows, at least one."""
    digest = keyed_hash(seed, "userId", "movieId")
    placed = numbered_per_key(
        ratings.withColumn("_digest", digest),
        "userId",
        [F.col("_digest"), F.col("movieId")],
        hash_position(F.col("_digest")),
        rows_per_split=rows_per_split,
    )
    n_test = F.greatest(F.lit(1), F.floor(F.col("_n") * test_share))
    return (
        placed.where(F.col("_n") >= min_ratings)
        .withColumn("is_test", F.col("_rn") <= n_test)
        .drop("_n", "_rn", "_digest")
    )


def train_test(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def mark_time_split(ratings: DataFrame, test_share: float = DEFAULTS.test_share) -> DataFrame:
    """Ratings plus ``is_test``: later than the time quantile."""
    cut = exact_quantile(ratings, "timestamp", 1.0 - test_share).scalar()
    return ratings.withColumn("is_test", F.col("timestamp") > cut)


def overlap(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides reduced to the users they share."""
    return (
        train.join(test.select("userId").distinct(), "userId", "left_semi"),
        test.join(train.select("userId").distinct(), "userId", "left_semi"),
    )


def sample_users(users: DataFrame, n: int, seed: int = DEFAULTS.seed) -> DataFrame:
    """``n`` users in seeded hash order."""
    picked = users.select("userId").distinct().withColumn("_h", keyed_hash(seed, "userId"))
    return picked.orderBy("_h", "userId").limit(n).select("userId")


def evaluation_users(
    train: DataFrame,
    test: DataFrame,
    *,
    n: int = DEFAULTS.eval_users,
    min_train: int = DEFAULTS.min_train_ratings,
    min_test: int = DEFAULTS.min_test_items,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """Seeded sample of users with enough history and enough held-out items."""

    def with_rows(df: DataFrame, at_least: int) -> DataFrame:
        return df.groupBy("userId").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= at_least).select("userId")

    return sample_users(with_rows(test, min_test).join(with_rows(train, min_train), "userId", "left_semi"), n, seed)


def cf_training_subset(
    train: DataFrame,
    forced_users: DataFrame,
    *,
    target: int | None = DEFAULTS.cf_target_users,
    min_ratings: int = DEFAULTS.min_ratings,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """Rows of the forced users and of a seeded fill of other active users up to ``target`` users; no target keeps all
    of them."""
    forced = forced_users.select("userId").distinct()
    room = None if target is None else max(0, target - forced.count())
    rows = train.join(forced, "userId", "left_semi")
    if room == 0:
        return rows
    others = (
        train.groupBy("userId").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_ratings)
        .join(forced, "userId", "left_anti")
    )
    fill = others if room is None else sample_users(others, room, seed)
    return rows.unionByName(train.join(fill, "userId", "left_semi"))


def sampled_training(
    train: DataFrame,
    test: DataFrame,
    *,
    sample_size: int,
    min_ratings: int = DEFAULTS.min_ratings_per_user,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """Training rows of ``sample_size // 100`` seeded users and of every test user."""
    counts = train.groupBy("userId").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_ratings)
    keep = sample_users(counts, sample_size // 100, seed).unionByName(test.select("userId")).distinct()
    return train.join(keep, "userId", "left_semi")


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = DEFAULTS.seed) -> DataFrame:
    """Exactly ``n`` rows, uniform over the whole table, reproducible by key."""
    order = [F.col("_h"), *[F.col(k) for k in keys]]
    return df.withColumn("_h", keyed_hash(seed, *keys)).orderBy(*order).limit(n).drop("_h")
