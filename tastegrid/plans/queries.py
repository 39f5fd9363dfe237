"""Registered queries: name → function of ``(spark, folder)``.

Every query runs over the whole tables. Scores are rounded and lists joined to text so that results
can be compared with other engines by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tastegrid.config import DEFAULTS
from tastegrid.operators import (
    catalog as cat, cleaning, content, eda, evaluation, factors, features, hybrid, interactions, neighbours,
    popularity as pop, search, selection, splits, textmodel,
)
from tastegrid.operators.staging import stage
from tastegrid.sources.fixtures import StoredViews, Views
from tastegrid.streaming import jobs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Parameters of the registered runs, shared with the SQL checks.
POOL = DEFAULTS.pool_size
CF_TARGET = 200
SAMPLE_ROWS = 1_000
SAMPLE_SIZE = 20_000
SVD_K = DEFAULTS.svd_components


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def model(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """A query that reads ratings or items several times and so starts from stored tables."""
    QUERIES[fn.__name__] = lambda spark, folder: fn(StoredViews(spark, folder))
    return fn


def r7(column: str | Column, name: str | None = None) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 7).alias(name or column)


def text(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def num(column: str) -> Column:
    return F.col(column).cast("long").alias(column)


# --- cleaning -------------------------------------------------------------------------------------


@query
def clean_ratings(v: Views) -> DataFrame:
    return cleaning.clean_ratings(v.ratings_raw)


@query
def user_item(v: Views) -> DataFrame:
    return cleaning.user_item(cleaning.clean_ratings(v.ratings_raw))


@query
def ratings_temporal(v: Views) -> DataFrame:
    df = cleaning.rating_time_features(v.ratings)
    return df.select("userId", "movieId", "year", "month", "day_of_week", r7("rating_normalized"))


def raw_movies(v: Views) -> DataFrame:
    """The movie view as untyped text with some unreadable ids, amounts and dates."""
    key = F.col("movieId")
    genres = F.to_json(F.transform("genre_names", lambda g, i: F.struct(i.alias("id"), g.alias("name"))))
    return v.movies.select(
        F.when(key % 97 == 0, "1997-08-20").otherwise(key.cast("string")).alias("id"),
        "title",
        F.col("budget").cast("string").alias("budget"),
        F.when(key % 13 == 0, "n/a").otherwise(F.col("revenue").cast("string")).alias("revenue"),
        F.col("runtime").cast("string").alias("runtime"),
        F.when(key % 89 == 0, "soon").otherwise(F.date_format("release_date", "yyyy-MM-dd")).alias("release_date"),
        genres.alias("genres"),
    )


@query
def clean_catalog(v: Views) -> DataFrame:
    df = cleaning.clean_movies(raw_movies(v))
    return df.select("id", "title", "budget", r7("revenue"), "runtime", num("year"), num("month"), text("genre_names"))


@query
def json_names(v: Views) -> DataFrame:
    quoted = lambda names, extra="": F.concat(
        F.lit("[{" + extra + "'name': '"), F.array_join(names, "'}, {" + extra + "'name': '"), F.lit("'}]")
    )
    crew = F.concat(
        F.lit("[{'job': 'Director', 'name': '"), F.element_at("director", 1),
        F.lit("'}, {'job': 'Editor', 'name': \""), F.col("title"), F.lit("\"}]"),
    )
    full = v.movies.join(v.credits, "movieId")
    raw = full.select(
        F.col("movieId").cast("string").alias("id"),
        quoted(F.col("cast_names"), "'id': 1, ").alias("cast"),
        crew.alias("crew"),
        F.to_json(F.transform("keyword_names", lambda g: F.struct(g.alias("name")))).alias("keywords"),
    )
    people = cleaning.clean_credits(raw).select("id", text("cast_names"), text("director"))
    words = cleaning.clean_keywords(raw).select("id", text("keyword_names"))
    return people.join(words, "id")


@query
def link_table(v: Views) -> DataFrame:
    raw = v.links.unionByName(v.links.where("movieId % 10 = 0").withColumn("tmdbId", F.col("tmdbId") + 7))
    return cleaning.clean_links(raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]))


@query
def list_cells(v: Views) -> DataFrame:
    from tastegrid.sources.layers import decode_list_columns

    cell = F.concat(F.lit("['"), F.array_join("genre_names", "', '"), F.lit("']"))
    raw = v.movies.select("movieId", cell.alias("genre_names"))
    return decode_list_columns(raw, ["genre_names"]).select("movieId", F.size("genre_names").cast("long").alias("n"), text("genre_names"))


# --- catalogue ------------------------------------------------------------------------------------


def tmdb_tables(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = (F.col("movieId") + 100_000).alias("id")
    return (
        v.movies.select(key, "title", "genre_names", "year"),
        v.credits.join(v.movies, "movieId").select(key, "cast_names", "director"),
        v.movies.select(key, "keyword_names"),
    )


@query
def catalog_integrated(v: Views) -> DataFrame:
    df = cat.integrate(*tmdb_tables(v), v.links)
    return df.select("id", "title", text("cast_names"), text("director"), text("keyword_names"), "movieId", "tmdbId")


@query
def titled_ratings(v: Views) -> DataFrame:
    movies, _, _ = tmdb_tables(v)
    df = eda.titled_ratings(v.ratings, v.links, movies)
    return df.select("userId", "movieId", "rating", "tmdbId", "title")


Z_COLUMNS = ["runtime", "vote_average", "vote_count", "budget", "revenue"]


@query
def catalog_zscore(v: Views) -> DataFrame:
    df = cat.zscores(v.movies, Z_COLUMNS)
    return df.select("movieId", *[r7(f"{c}_normalized") for c in Z_COLUMNS])


@query
def genre_dummies(v: Views) -> DataFrame:
    wide = cat.tag_dummies(v.movies.select("movieId", "genre_names"), n=20).drop("genre_names")
    flags = [c for c in wide.columns if c != "movieId"]
    return wide.unpivot("movieId", flags, "genre", "flag")


@query
def display_rows(v: Views) -> DataFrame:
    df = cat.display_rows(v.catalog, keyword_n=1)
    return df.select("movieId", "title", text("genre_names"), text("cast_names"), text("director"), text("keyword_names"), "year")


@query
def vote_popularity(v: Views) -> DataFrame:
    return cat.vote_popularity(v.movies).select("movieId", r7("score"))


# --- features -------------------------------------------------------------------------------------


@query
def user_features(v: Views) -> DataFrame:
    return features.user_features(v.ratings).select(
        "userId", r7("avg_rating"), r7("std_rating"), "n_ratings", "first_rating", "last_rating", "rating_span_days"
    )


@query
def movie_features(v: Views) -> DataFrame:
    return features.movie_features(v.ratings_raw).select(
        "movieId", r7("avg_rating"), r7("std_rating"), "n_ratings", "n_unique_users"
    )


@query
def user_activity(v: Views) -> DataFrame:
    return features.user_activity(v.ratings_raw).select(
        "userId", "n_ratings", r7("avg_rating"), r7("std_rating"), "min_rating", "max_rating", "n_unique_movies",
        "rating_diversity",
    )


@query
def user_top_genres(v: Views) -> DataFrame:
    return features.user_top_genres(v.ratings, v.tagged).select("userId", text("top_genres"))


@model
def movie_popularity(v: Views) -> DataFrame:
    return features.movie_popularity(v.ratings).select(
        "movieId", "n_ratings", r7("avg_rating"), r7("std_rating"), "min_rating", "max_rating", "n_unique_users",
        r7("rating_consistency"), "popularity_rank", "avg_rating_rank",
    )


@query
def bias(v: Views) -> DataFrame:
    users = features.bias(v.ratings, "userId", "bias").select(F.lit("user").alias("side"), F.col("userId").alias("id"), r7("bias"))
    movies = features.bias(v.ratings, "movieId", "bias").select(F.lit("movie").alias("side"), F.col("movieId").alias("id"), r7("bias"))
    return users.unionByName(movies)


@query
def temporal_features(v: Views) -> DataFrame:
    return features.release_features(v.movies)


@model
def user_engineered(v: Views) -> DataFrame:
    return features.engineered_users(v.ratings, v.movies).select(
        "userId", "n_ratings", r7("avg_rating"), "rating_diversity", text("top_genres"), r7("user_rating_bias")
    )


@model
def movie_engineered(v: Views) -> DataFrame:
    return features.engineered_movies(v.ratings, v.movies).select(
        "movieId", "n_ratings", r7("avg_rating"), "popularity_rank", "avg_rating_rank", "year", "movie_age_years",
        "decade", r7("movie_rating_bias"),
    )


@query
def genre_stats(v: Views) -> DataFrame:
    df = features.tag_stats(v.ratings, features.item_tags(v.movies, "genre_names", "genre"), "genre")
    return df.select("genre", r7("avg_rating"), "n_ratings", r7("std_rating"), "n_movies")


@query
def keyword_stats(v: Views) -> DataFrame:
    tags = features.item_tags(v.movies, "keyword_names", "keyword")
    return features.tag_stats(v.ratings, tags, "keyword", deviation=False).select(
        "keyword", r7("avg_rating"), "n_ratings", "n_movies"
    )


def _gappy_movies(v: Views) -> DataFrame:
    """Item features with missing numbers, texts and lists."""
    key = F.col("movieId")
    return v.movies.select(
        "movieId",
        F.when(key % 3 != 0, F.col("revenue")).alias("revenue"),
        F.when(key % 5 != 0, F.col("runtime")).alias("runtime"),
        F.when(key % 4 != 0, F.col("title")).alias("title"),
        F.when(key % 6 != 0, F.col("genre_names")).alias("genre_names"),
        F.lit(1.0).alias("constant"),
    )


@query
def low_variance(v: Views) -> DataFrame:
    df = selection.variances(_gappy_movies(v))
    return df.select("column", r7(F.round("variance", 2), "variance"), (F.col("variance") < 0.01).cast("long").alias("dropped"))


@model
def fill_missing(v: Views) -> DataFrame:
    df = selection.fill_missing(selection.drop_low_variance(_gappy_movies(v)))
    return df.select("movieId", r7("revenue"), "runtime", "title", text("genre_names"))


@model
def select_features(v: Views) -> DataFrame:
    users = features.engineered_users(v.ratings, v.movies)
    movies = features.engineered_movies(v.ratings, v.movies)
    picked, _ = selection.process_features(users, movies)
    return picked.select(
        "userId", "n_ratings", r7("avg_rating"), "n_unique_movies", r7("user_rating_bias"), "rating_diversity",
        text("top_genres"),
    )


@model
def select_movie_features(v: Views) -> DataFrame:
    """The movie half; the year columns stay in the operator's output only, as few years give them a low variance."""
    users = features.engineered_users(v.ratings, v.movies)
    movies = features.engineered_movies(v.ratings, v.movies)
    _, picked = selection.process_features(users, movies)
    return picked.select(
        "movieId", "n_ratings", r7("avg_rating"), r7("std_rating"), "n_unique_users", r7("movie_rating_bias"), "popularity_rank",
        "avg_rating_rank",
    )


@model
def enriched_recs(v: Views) -> DataFrame:
    """Popular lists with titles and genres, as served."""
    lists = pop.popular_for_users(pop.bayes_popularity(v.ratings), v.users, v.ratings)
    df = cat.enrich(lists, v.movies.where("movieId % 11 != 0"))
    return df.select("userId", "rank", "movieId", r7("score"), "title", text("genre_names"))


# --- exploration ----------------------------------------------------------------------------------


@query
def eda_histogram(v: Views) -> DataFrame:
    return eda.rating_histogram(v.ratings_raw)


@query
def eda_counts(v: Views) -> DataFrame:
    users = eda.counts_per(v.ratings_raw, "userId").select(F.lit("user").alias("side"), F.col("userId").alias("id"), "n")
    movies = eda.counts_per(v.ratings_raw, "movieId").select(F.lit("movie").alias("side"), F.col("movieId").alias("id"), "n")
    return users.unionByName(movies)


@query
def eda_top_users(v: Views) -> DataFrame:
    return eda.top_users(v.ratings)


@query
def eda_top_movies(v: Views) -> DataFrame:
    return eda.top_movies(v.ratings, v.movies)


@query
def genre_frequency(v: Views) -> DataFrame:
    return cat.tag_counts(v.movies, "genre_names")


@query
def ratings_by_year(v: Views) -> DataFrame:
    return eda.ratings_by_year(v.ratings_raw)


@query
def year_histogram(v: Views) -> DataFrame:
    return eda.year_histogram(v.ratings.select(F.year(F.timestamp_seconds("timestamp")).alias("year")))


@query
def eda_summary(v: Views) -> DataFrame:
    df = eda.summary(v.ratings)
    return df.select(*[r7(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- splits ---------------------------------------------------------------------------------------


def _train_test(v: Views) -> tuple[DataFrame, DataFrame]:
    """The seeded split, written once because train and test are read several times."""
    return splits.train_test(stage(splits.mark_user_split(v.ratings), "split"))


@query
def split_user(v: Views) -> DataFrame:
    return splits.mark_user_split(v.ratings).select("userId", "movieId", "rating", num("is_test"))


@query
def split_time(v: Views) -> DataFrame:
    return splits.mark_time_split(v.ratings).select("userId", "movieId", "timestamp", num("is_test"))


@model
def eval_users(v: Views) -> DataFrame:
    return splits.evaluation_users(*_train_test(v))


@model
def cf_subset(v: Views) -> DataFrame:
    train, test = _train_test(v)
    users = splits.evaluation_users(train, test)
    return splits.cf_training_subset(train, users, target=CF_TARGET).select("userId", "movieId", "rating")


@model
def sampled_training(v: Views) -> DataFrame:
    train, test = splits.train_test(stage(splits.mark_time_split(v.ratings), "time-split"))
    df = splits.sampled_training(train, test, sample_size=SAMPLE_SIZE)
    return df.select("userId", "movieId", "rating")


@query
def split_overlap(v: Views) -> DataFrame:
    train, test = splits.overlap(*splits.train_test(stage(splits.mark_time_split(v.ratings), "time-split")))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "userId", "movieId")
    return side(train, "train").unionByName(side(test, "test"))


@query
def sample_load(v: Views) -> DataFrame:
    return splits.sample_rows(v.ratings, SAMPLE_ROWS, "userId", "movieId").select("userId", "movieId", "rating")


@query
def cf_filter(v: Views) -> DataFrame:
    return features.filter_active(v.ratings, min_ratings=30, min_movie_ratings=28).select("userId", "movieId", "rating")


# --- recommenders ---------------------------------------------------------------------------------


def recs(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*(keys or ("userId",)), "rank", "movieId", r7("score"))


@query
def bayes_popularity(v: Views) -> DataFrame:
    return pop.bayes_popularity(v.ratings).select("movieId", "n_ratings", r7("avg_rating"), r7("score"))


@query
def popularity_pages(v: Views) -> DataFrame:
    return pop.pages(pop.bayes_popularity(v.ratings)).select("rank", "page", "movieId", r7("score"))


@query
def genre_top(v: Views) -> DataFrame:
    rows = pop.with_any_tag(pop.bayes_popularity(v.ratings), v.movies, ["SMALL", "red"])
    return pop.ranked(rows).select("rank", "movieId", r7("score"))


@model
def pop_recs(v: Views) -> DataFrame:
    return recs(pop.popular_for_users(pop.bayes_popularity(v.ratings), v.users, v.ratings))


@model
def genre_recs(v: Views) -> DataFrame:
    return recs(content.tag_recommendations(v.ratings, v.movies, pop.bayes_popularity(v.ratings), v.users))


def _user_cf(v: Views, n: int) -> DataFrame:
    active = features.filter_active(v.ratings, min_movie_ratings=3)
    return neighbours.user_cf(active, v.users, n=n)


@model
def user_cf(v: Views) -> DataFrame:
    return recs(_user_cf(v, 10))


def _item_cf(v: Views, n: int) -> DataFrame:
    active = features.filter_active(v.ratings, min_movie_ratings=5)
    return neighbours.item_cf(active, v.users, n=n)


@model
def item_cf(v: Views) -> DataFrame:
    return recs(_item_cf(v, 10))


def _factors(v: Views, n: int) -> DataFrame:
    model = factors.fit_svd(features.filter_active(v.ratings), k=SVD_K)
    return factors.factor_top_n(model.users, model.items, v.ratings, n=n)


@model
def svd_recs(v: Views) -> DataFrame:
    return recs(_factors(v, 10))


@model
def svd_grid(v: Views) -> DataFrame:
    return factors.svd_grid(features.filter_active(v.ratings))


@model
def svd_fold_in(v: Views) -> DataFrame:
    """Serving form on the rated interactions: ridge, global mean, at least two known items."""
    base = features.filter_active(v.ratings)
    model = factors.fit_svd(base, k=SVD_K)
    overall = base.agg(F.avg("rating")).first()[0]
    rated = _rated_once(v)
    users = factors.fold_in_svd(rated, model.items, SVD_K, ridge=0.01 * SVD_K, centre=overall, min_items=2)
    return recs(factors.factor_top_n(users, model.items, interactions.viewed_items(v.interactions)))


def _rated_once(v: Views) -> DataFrame:
    return interactions.rated_items(v.interactions).groupBy("userId", "movieId").agg(F.max("rating").alias("rating"))


@model
def als_recs(v: Views) -> DataFrame:
    model = factors.als_factors(factors.fit_als(features.filter_active(v.ratings, min_movie_ratings=1)))
    return recs(factors.factor_top_n(model.users, model.items, v.ratings))


@model
def als_fold_in(v: Views) -> DataFrame:
    model = factors.als_factors(factors.fit_als(features.filter_active(v.ratings, min_movie_ratings=1)))
    rated = _rated_once(v)
    users = factors.fold_in_als(rated, model.items, DEFAULTS.als_rank)
    return recs(factors.factor_top_n(users, model.items, rated))


@query
def factor_topn(v: Views) -> DataFrame:
    return recs(factors.factor_top_n(v.user_vectors, v.item_vectors))


@model
def factor_predict(v: Views) -> DataFrame:
    """Every rated pair; one user and one item in seven have no vector."""
    model = factors.FactorModel(
        _vectors_for(v.users, "userId", v.user_vectors).withColumn("mean", F.lit(2.5)),
        _vectors_for(v.movies.select("movieId"), "movieId", v.item_vectors),
        [],
    )
    return factors.predict(v.ratings.select("userId", "movieId", "rating"), model, 3.0).select("userId", "movieId", r7("pred"))


def _vectors_for(ids: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """The vectors dealt out over all ids in turn, but for ids divisible by seven."""
    n = vectors.count()
    picked = ids.where(F.col(key) % 7 != 0).select(key, (F.col(key) % n).alias("_v"))
    return picked.join(vectors.select(F.col(key).alias("_v"), "vec"), "_v").drop("_v")


FOLD_K = 4  # length of the fixed item vectors on which users are folded in


def _folded(v: Views, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``(userId, place, x)`` of every user's vector; the item vectors are fixed, and one movie in seven has none."""
    items = _vectors_for(v.movies.select("movieId"), "movieId", v.item_vectors).withColumn("vec", F.slice("vec", 1, FOLD_K))
    users = fold(v.ratings.select("userId", "movieId", "rating"), stage(items, "fixed-vectors"))
    return users.select("userId", F.posexplode("vec").alias("place", "x")).select(
        "userId", (F.col("place") + 1).cast("long").alias("place"), F.round("x", 5).alias("x")
    )


@model
def fold_least_squares(v: Views) -> DataFrame:
    """The solution of smallest norm, on deviations from the user's own mean."""
    return _folded(v, lambda ratings, items: factors.fold_in_svd(ratings, items, FOLD_K))


@model
def fold_ridge(v: Views) -> DataFrame:
    """The serving form: ridge, one centre, at least two known items."""
    return _folded(v, lambda ratings, items: factors.fold_in_svd(ratings, items, FOLD_K, ridge=0.01 * FOLD_K, centre=3.0, min_items=2))


@model
def fold_als(v: Views) -> DataFrame:
    return _folded(v, lambda ratings, items: factors.fold_in_als(ratings, items, FOLD_K))


@model
def fold_als_observed(v: Views) -> DataFrame:
    return _folded(v, lambda ratings, items: factors.fold_in_als(ratings, items, FOLD_K, observed_only=True))


# --- text -----------------------------------------------------------------------------------------


@query
def soup(v: Views) -> DataFrame:
    return textmodel.feature_soup(v.texts)


def _weights(v: Views) -> DataFrame:
    return stage(textmodel.fit_tfidf(textmodel.feature_soup(v.texts)), "tfidf")


@query
def tfidf(v: Views) -> DataFrame:
    return textmodel.fit_tfidf(textmodel.feature_soup(v.texts)).select("movieId", "term", r7("weight"))


@query
def similar_items(v: Views) -> DataFrame:
    return textmodel.similar_items(_weights(v)).select("movieId", "rank", "similarId", r7("score"))


def _asked(v: Views) -> DataFrame:
    """Items touched in the log and, as unknown ids, the linked tmdb ids."""
    touched = interactions.viewed_items(v.interactions).select("movieId")
    return touched.unionByName(v.links.where("tmdbId % 40 = 1").select(F.col("tmdbId").alias("movieId"))).distinct()


@model
def similar_or_popular(v: Views) -> DataFrame:
    df = textmodel.similar_or_popular(_asked(v), _weights(v), pop.bayes_popularity(v.ratings))
    return df.select("movieId", "rank", "similarId", r7("score"))


@query
def because_you_watched(v: Views) -> DataFrame:
    watched = v.interactions.where("interaction_type = 'watch'").select("movieId").distinct()
    sims = textmodel.similar_items(_weights(v), of=watched)
    titles = v.movies.select("movieId", F.col("title").alias("context"))
    return sims.join(titles, "movieId").select(
        "movieId", "rank", "similarId", r7("score"), "context",
        F.concat(F.lit("Because you watched "), F.col("context")).alias("reason"),
    )


@query
def latest_like_similar(v: Views) -> DataFrame:
    liked = stage(interactions.latest_liked(v.interactions), "latest-likes")
    sims = textmodel.similar_items(_weights(v), of=liked)
    return liked.join(sims, "movieId").select("userId", "movieId", "rank", "similarId", r7("score"))


def _profile(v: Views, n: int) -> DataFrame:
    return textmodel.profile_recommendations(textmodel.liked_items(v.ratings), _weights(v), v.ratings, n=n)


@model
def profile_recs(v: Views) -> DataFrame:
    return recs(_profile(v, 10))


# --- blend and serving ----------------------------------------------------------------------------


def _components(v: Views, **more: DataFrame) -> DataFrame:
    popular = pop.popular_for_users(pop.bayes_popularity(v.ratings), v.users, v.ratings, n=POOL)
    return stage(
        hybrid.stack_components({"content": _profile(v, POOL), "user_cf": _user_cf(v, POOL), "popularity": popular, **more}),
        "components",
    )


@model
def minmax(v: Views) -> DataFrame:
    popular = pop.popular_for_users(pop.bayes_popularity(v.ratings), v.users, v.ratings, n=POOL)
    voted = pop.popular_for_users(cat.vote_popularity(v.movies), v.users, v.ratings, n=POOL)
    long = hybrid.stack_components({"popularity": popular, "votes": voted})
    return hybrid.minmax(long).select("userId", "component", "movieId", r7("norm"))


@model
def hybrid_recs(v: Views) -> DataFrame:
    counts = v.ratings.groupBy("userId").agg(F.count(F.lit(1)).alias("n_ratings"))
    return recs(hybrid.blend(_components(v), counts))


@model
def hybrid_all_recs(v: Views) -> DataFrame:
    """The blend over the mean of all three collaborative signals; ``hybrid_recs`` has the one that SQL can state alone."""
    counts = v.ratings.groupBy("userId").agg(F.count(F.lit(1)).alias("n_ratings"))
    return recs(hybrid.blend(_components(v, item_cf=_item_cf(v, POOL), factors=_factors(v, POOL)), counts))


def _wanted_genres(v: Views) -> DataFrame:
    return v.preferences.select("userId", F.explode("preferred_genres").alias("genre"))


def _assigned(v: Views) -> DataFrame:
    return hybrid.strategies(
        v.users, interactions.rated_items(v.interactions), interactions.implicit_weights(v.interactions),
        _wanted_genres(v), v.movies.select("movieId"),
    )


@query
def strategy(v: Views) -> DataFrame:
    return _assigned(v).select("userId", "rated", "liked", "genres", "strategy", "label")


@model
def genre_cold_start(v: Views) -> DataFrame:
    tags = features.item_tags(v.movies, "genre_names", "genre")
    seen = interactions.viewed_items(v.interactions)
    return recs(pop.popular_in_genres(pop.bayes_popularity(v.ratings), tags, _wanted_genres(v), seen))


@model
def served_recs(v: Views) -> DataFrame:
    """The whole serving waterfall for every user."""
    from tastegrid.plans.serving import fit_models, recommend_all

    models = fit_models(v.ratings, _weights(v), components=SVD_K)
    df = recommend_all(v.users, v.interactions, v.preferences, v.movies, models)
    return df.select("userId", "strategy", "rank", "movieId", r7("score"), "reason")


@query
def implicit_weights(v: Views) -> DataFrame:
    return interactions.implicit_weights(v.interactions)


@query
def viewed_items(v: Views) -> DataFrame:
    return interactions.viewed_items(v.interactions)


@query
def rated_items(v: Views) -> DataFrame:
    return interactions.rated_items(v.interactions)


@query
def history(v: Views) -> DataFrame:
    return interactions.history(v.interactions).select("userId", "rank", "id", "movieId", "interaction_type")


@query
def user_status(v: Views) -> DataFrame:
    df = interactions.user_status(v.users, v.interactions, v.preferences)
    return df.select("userId", "n_interactions", num("has_onboarding"), num("has_preferences"), num("is_empty"))


# --- search ---------------------------------------------------------------------------------------


@model
def search_titles(v: Views) -> DataFrame:
    return recs(search.search_titles(v.queries, v.movies, pop.bayes_popularity(v.ratings)), "query_id")


@model
def suggest(v: Views) -> DataFrame:
    df = search.suggest(v.queries, v.movies, pop.bayes_popularity(v.ratings))
    return df.select("query_id", "rank", "movieId", "title", text("genres"), r7("score"))


@query
def lookup(v: Views) -> DataFrame:
    return cat.lookup(v.movies, interactions.viewed_items(v.interactions)).select("movieId", "title", text("genre_names"))


# --- evaluation -----------------------------------------------------------------------------------


@model
def eval_global(v: Views) -> DataFrame:
    train, test = _train_test(v)
    shown = pop.bayes_popularity(train).orderBy(F.round("score", 7).desc(), "movieId").limit(10)
    ranked = shown.select("movieId", F.lit(1).alias("rank"))
    df = evaluation.global_metrics(ranked, test, min_rating=4.0)
    return df.select(*[F.col(c) if c == "evaluated_users" else r7(c) for c in df.columns])


def _personal(v: Views) -> DataFrame:
    """All seven models on one set of users; the factors are fixed vectors, so that every row has an SQL twin."""
    train, test = _train_test(v)
    train_rows = train.select("userId", "movieId", "rating")
    users = stage(splits.evaluation_users(train, test), "eval-users")
    mine = stage(train_rows.join(users, "userId", "left_semi"), "eval-ratings")
    scores = stage(pop.bayes_popularity(train), "popularity")
    popular = stage(pop.popular_for_users(scores, users, mine, n=POOL), "popular-lists")
    tfidf = stage(textmodel.profile_recommendations(textmodel.liked_items(mine), _weights(v), mine, n=POOL), "tfidf-lists")
    fixed = _vectors_for(users, "userId", v.user_vectors).withColumn("mean", F.lit(2.5))
    latent = stage(factors.factor_top_n(fixed, _vectors_for(v.movies.select("movieId"), "movieId", v.item_vectors), mine, n=POOL), "factor-lists")
    counts = mine.groupBy("userId").agg(F.count(F.lit(1)).alias("n_ratings"))
    long = hybrid.stack_components({"content": tfidf, "factors": latent, "popularity": popular})
    lists = {
        "popularity": popular,
        "user_cf": neighbours.user_cf(features.filter_active(train_rows, min_movie_ratings=3), users, n=50),
        "item_cf": neighbours.item_cf(features.filter_active(train_rows, min_movie_ratings=5), users, n=50),
        "matrix_factorization": latent,
        "genre_content": content.tag_recommendations(train, v.movies, scores, users, n=50),
        "tfidf_content": tfidf,
        # ranking weights of the offline comparison: collaborative 0.70, content 0.30
        "hybrid": hybrid.blend(long, counts, n=50, content_weight=0.30, collab_weight=0.70),
    }
    stacked = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("model"), "userId", F.col("rank").cast("long").alias("rank"), "movieId")
        stacked = part if stacked is None else stacked.unionByName(part)
    return evaluation.personal_metrics(stage(stacked, "lists"), test, users, train=train)


def _rounded_metrics(df: DataFrame) -> DataFrame:
    return df.select(*[r7(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@model
def eval_personal(v: Views) -> DataFrame:
    return _rounded_metrics(_personal(v))


@model
def compare_models(v: Views) -> DataFrame:
    from pyspark.sql.window import Window

    best = evaluation.compare(_personal(v))
    place = F.row_number().over(Window.orderBy(F.col("f1").desc(), F.col("model")))  # one row per model
    return _rounded_metrics(best.select(place.cast("long").alias("place"), "model", "f1"))


@query
def rmse(v: Views) -> DataFrame:
    train, test = _train_test(v)
    users = train.groupBy("userId").agg(F.avg("rating").alias("pred"))
    return _rounded_metrics(evaluation.rating_errors(test.join(users, "userId")))


@model
def gates(v: Views) -> DataFrame:
    train, test = _train_test(v)
    chosen = stage(splits.evaluation_users(train, test), "eval-users")
    shown = pop.popular_for_users(stage(pop.bayes_popularity(train), "popularity"), chosen, train, n=50)
    metrics = evaluation.personal_metrics(shown.select(F.lit("popularity").alias("model"), "userId", "rank", "movieId"), test, chosen, train=train)
    users = train.groupBy("userId").agg(F.avg("rating").alias("pred"))
    error = evaluation.rating_errors(test.join(users, "userId"))
    one = lambda gate, df, column: df.select(F.lit(gate).alias("gate"), F.col(column).cast("double").alias("value"))
    overlap = test.join(train, "userId", "left_semi").agg(F.countDistinct("userId").alias("n"))
    rows = [
        one("overlap_users", overlap, "n"),
        one("cf_rows", train.agg(F.count(F.lit(1)).alias("n")), "n"),
        one("rmse", error, "rmse"),
        one("evaluated_users", metrics, "evaluated_users"),
        one("coverage", metrics, "coverage"),
    ]
    values = rows[0]
    for row in rows[1:]:
        values = values.unionByName(row)
    return evaluation.gates(values).select("gate", r7("value"), "bound", num("ok"))


# --- streams --------------------------------------------------------------------------------------


@query
def stream_weights(v: Views) -> DataFrame:
    return streams.run_weights(v.spark, v.folder)


@query
def stream_counts(v: Views) -> DataFrame:
    return streams.run_counts(v.spark, v.folder)


@query
def stream_strategy(v: Views) -> DataFrame:
    """Strategy per user as the stream keeps it; equal to ``strategy`` on the same events."""
    genres = v.preferences.select("userId", F.size("preferred_genres").alias("genres"))
    df = streams.run_status(v.spark, v.folder, v.users, v.movies, genres)
    return df.select("userId", "rated", "liked", "genres", "strategy")


@query
def stream_activity(v: Views) -> DataFrame:
    return streams.run_activity(v.spark, v.folder)


@query
def stream_dedupe(v: Views) -> DataFrame:
    return streams.run_dedupe(v.spark, v.folder)
