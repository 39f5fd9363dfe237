"""Recommendation tables as views over a star schema of orders, parts, customers and events.

Each view exists once as a DataFrame and once as a SQL common table expression for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tastegrid.functions.numeric import epoch_seconds
from tastegrid.operators.cleaning import user_item
from tastegrid.operators.staging import stage
from tastegrid.session import tune

# Part types in the order used for onboarding preferences, and the search batch.
PREFERENCE_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SEARCH_QUERIES = ("red widget", "RED-WIDGET", "widget", "econ", "zzz gear", "zzzz", "a")


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ratings_raw(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("userId"),
            F.col("l_partkey").alias("movieId"),
            (((F.col("l_quantity").cast("int") - 1) % 10 + 1) / 2.0).alias("rating"),
            epoch_seconds("o_orderdate").alias("timestamp"),
        )

    @cached_property
    def ratings(self) -> DataFrame:
        return user_item(self.ratings_raw)

    @cached_property
    def movies(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
        orders = self.table("orders").select("o_orderkey", "o_orderdate")
        sales = (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("l_partkey")
            .agg(
                F.count(F.lit(1)).alias("vote_count"),
                F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"),
                F.min("o_orderdate").alias("release_date"),
            )
        )
        return (
            self.table("part")
            .join(sales, F.col("p_partkey") == F.col("l_partkey"), "left")
            .select(
                *_tag_columns(),
                (F.col("p_size") * 8.0).alias("runtime"),
                (1.0 + F.col("p_size") % 9).alias("vote_average"),
                F.coalesce("vote_count", F.lit(0)).cast("long").alias("vote_count"),
                F.when(F.col("p_partkey") % 7 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("budget"),
                "revenue",
                F.col("release_date").cast("timestamp").alias("release_date"),
                F.year("release_date").cast("long").alias("year"),
                F.month("release_date").cast("long").alias("month"),
            )
        )

    @cached_property
    def tagged(self) -> DataFrame:
        """Titles and tags of the movies, for readers that need no sales: these come from one small table."""
        return self.table("part").select(*_tag_columns())

    @cached_property
    def credits(self) -> DataFrame:
        """First five supplier names per part in name order; the window prunes to five before the list."""
        pairs = (
            self.table("lineitem").select("l_partkey", "l_suppkey").distinct()
            .join(self.table("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        )
        w = Window.partitionBy("l_partkey").orderBy("s_name")
        first = pairs.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
        names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "s_name"))), lambda x: x["s_name"])
        return first.groupBy(F.col("l_partkey").alias("movieId")).agg(names.alias("cast_names"))

    @cached_property
    def overview(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("movieId"), F.col("text").alias("overview"))

    @cached_property
    def catalog(self) -> DataFrame:
        """Movies with cast and overview: the integrated item table."""
        return self.movies.join(self.credits, "movieId", "left").join(self.overview, "movieId", "left")

    @cached_property
    def texts(self) -> DataFrame:
        """What the soup of an item is made of."""
        return self.tagged.join(self.credits, "movieId", "left").join(self.overview, "movieId", "left")

    @cached_property
    def links(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("movieId"), F.when(key % 50 != 0, key + 100_000).alias("tmdbId"), (key * 3).alias("imdbId")
        )

    @cached_property
    def interactions(self) -> DataFrame:
        return interaction_rows(self.table("events"))

    @cached_property
    def preferences(self) -> DataFrame:
        key = F.col("c_custkey")
        chosen = F.element_at(F.array(*[F.lit(t) for t in PREFERENCE_TYPES]), (key % 6 + 1).cast("int"))
        return self.table("customer").where(key % 4 != 1).select(
            key.alias("userId"),
            F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(chosen)).alias("preferred_genres"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("userId"))

    @cached_property
    def user_vectors(self) -> DataFrame:
        v = self.table("embeddings").where("vec_id % 2 = 0")
        return v.select(F.floor(F.col("vec_id") / 2).alias("userId"), F.lit(0.0).alias("mean"), F.col("embedding").cast("array<double>").alias("vec"))

    @cached_property
    def item_vectors(self) -> DataFrame:
        v = self.table("embeddings").where("vec_id % 2 = 1")
        return v.select(F.floor(F.col("vec_id") / 2).alias("movieId"), F.col("embedding").cast("array<double>").alias("vec"))

    @cached_property
    def queries(self) -> DataFrame:
        rows = [(i, q) for i, q in enumerate(SEARCH_QUERIES)]
        return self.spark.createDataFrame(rows, "query_id long, q string")


def _tag_columns() -> list[Column]:
    words = F.split("p_name", " ")
    return [
        F.col("p_partkey").alias("movieId"),
        F.col("p_name").alias("title"),
        F.array_distinct(F.array("p_type", words[0])).alias("genre_names"),
        F.array_distinct(F.array(words[1], F.col("p_brand"))).alias("keyword_names"),
        F.array("p_brand").alias("director"),
    ]


class StoredViews(Views):
    """The same views with the rating and item tables written out first, as the layered store holds them."""

    @cached_property
    def ratings(self) -> DataFrame:
        return stage(super().ratings, "ratings")

    @cached_property
    def movies(self) -> DataFrame:
        return stage(super().movies, "movies")


def interaction_rows(events: DataFrame) -> DataFrame:
    """Interaction log over the event table; also used on the stream of the same rows."""
    kind, even = F.col("event_type"), F.col("event_id") % 5 == 0
    stars = F.least(F.lit(5.0), F.greatest(F.lit(0.5), F.floor(F.col("value") / 20) / 2 + 0.5))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("userId"),
        F.when(kind != "signup", F.get_json_object("props", "$.k").cast("long")).alias("movieId"),
        F.when(kind == "purchase", "rate")
        .when((kind == "view") & even, "watch")
        .when((kind == "click") & even, "like")
        .when(kind == "signup", "search")
        .when(kind == "error", "dislike")
        .otherwise(kind)
        .alias("interaction_type"),
        F.when(kind == "purchase", stars).alias("rating"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


# --- the same views as SQL ------------------------------------------------------------------------

_TYPES = ", ".join(f"'{t}'" for t in PREFERENCE_TYPES)
_QUERIES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(SEARCH_QUERIES))

SQL_VIEWS = {
    "ratings_raw": """
        SELECT o_custkey AS userId, l_partkey AS movieId,
               ((CAST(l_quantity AS INTEGER) - 1) % 10 + 1) / 2.0::DOUBLE AS rating,
               CAST(epoch(o_orderdate) AS BIGINT) AS "timestamp"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ratings": """
        SELECT userId, movieId, max(rating) AS rating, max("timestamp") AS "timestamp"
        FROM ratings_raw GROUP BY userId, movieId""",
    "sales": """
        SELECT l_partkey, count(*) AS vote_count,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, min(o_orderdate) AS release_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""",
    "movies": """
        SELECT p_partkey AS movieId, p_name AS title,
               CASE WHEN p_type = split_part(p_name, ' ', 1) THEN [p_type]
                    ELSE [p_type, split_part(p_name, ' ', 1)] END AS genre_names,
               CASE WHEN p_brand = split_part(p_name, ' ', 2) THEN [p_brand]
                    ELSE [split_part(p_name, ' ', 2), p_brand] END AS keyword_names,
               [p_brand] AS director, p_size * 8.0::DOUBLE AS runtime,
               CAST(1 + p_size % 9 AS DOUBLE) AS vote_average, CAST(coalesce(vote_count, 0) AS BIGINT) AS vote_count,
               CASE WHEN p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE p_retailprice END AS budget,
               revenue, release_date, CAST(year(release_date) AS BIGINT) AS year,
               CAST(month(release_date) AS BIGINT) AS month
        FROM part LEFT JOIN sales ON p_partkey = l_partkey""",
    "credits": """
        SELECT l_partkey AS movieId, list(s_name ORDER BY s_name) AS cast_names
        FROM (SELECT l_partkey, s_name, row_number() OVER (PARTITION BY l_partkey ORDER BY s_name) AS rn
              FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey)
        WHERE rn <= 5 GROUP BY l_partkey""",
    "catalog": """
        SELECT m.*, c.cast_names, d.text AS overview
        FROM movies m LEFT JOIN credits c ON m.movieId = c.movieId LEFT JOIN documents d ON d.doc_id = m.movieId""",
    "links": """
        SELECT p_partkey AS movieId, CASE WHEN p_partkey % 50 <> 0 THEN p_partkey + 100000 END AS tmdbId,
               p_partkey * 3 AS imdbId FROM part""",
    "interactions": """
        SELECT event_id AS id, user_id AS userId,
               CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS movieId,
               CASE WHEN event_type = 'purchase' THEN 'rate'
                    WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'watch'
                    WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'like'
                    WHEN event_type = 'signup' THEN 'search'
                    WHEN event_type = 'error' THEN 'dislike' ELSE event_type END AS interaction_type,
               CASE WHEN event_type = 'purchase'
                    THEN least(5.0, greatest(0.5, floor(value / 20) / 2 + 0.5))::DOUBLE END AS rating,
               ts AS created_at
        FROM events""",
    "preferences": f"""
        SELECT c_custkey AS userId,
               CASE WHEN c_custkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [([{_TYPES}])[c_custkey % 6 + 1]] END
                   AS preferred_genres
        FROM customer WHERE c_custkey % 4 <> 1""",
    "queries": f"SELECT CAST(column0 AS BIGINT) AS query_id, column1 AS q FROM (VALUES {_QUERIES}) AS t(column0, column1)",
}

_NEEDS = {
    "ratings": ("ratings_raw",),
    "movies": ("sales",),
    "catalog": ("sales", "movies", "credits"),
}


def with_views(*names: str) -> list[tuple[str, str]]:
    """``(name, sql)`` of the views and what they need, in order."""
    wanted: list[str] = []
    for name in names:
        for dep in (*_NEEDS.get(name, ()), name):
            if dep not in wanted:
                wanted.append(dep)
    return [(n, SQL_VIEWS[n]) for n in wanted]
