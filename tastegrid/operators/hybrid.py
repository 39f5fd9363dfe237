"""Blending of component lists and the serving waterfall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.config import DEFAULTS
from tastegrid.operators.ranking import top_n

# The label shown with each strategy.
STRATEGY_LABELS = {
    "hybrid": "Recommended for you",
    "content": "Based on movies you liked",
    "genre": "Based on your interests",
    "popularity": "Trending now",
}
COLLABORATIVE = ("user_cf", "item_cf", "factors")


def first_score(df: DataFrame) -> Column:
    """First non-null of the score columns a list may carry, else 0."""
    known = [F.col(c) for c in ("hybrid_score", "weighted_score", "score", "pred") if c in df.columns]
    return F.coalesce(*known, F.lit(0.0))


def stack_components(components: dict[str, DataFrame]) -> DataFrame:
    """Long form ``(userId, component, movieId, score)`` of several component lists, scores rounded."""
    digits = DEFAULTS.score_digits
    parts = [
        df.select("userId", F.lit(name).alias("component"), "movieId", F.round(first_score(df), digits).alias("score"))
        for name, df in components.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def minmax(long: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 per user and component; a constant list becomes 0.5.

    A list holds at most the candidate pool of one user, so the window is small by construction.
    """
    w = Window.partitionBy("userId", "component")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high == low, 0.5).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)))
    return long.withColumn("norm", scaled)


def blend(
    long: DataFrame,
    history: DataFrame,
    *,
    n: int = DEFAULTS.top_n,
    content_weight: float = DEFAULTS.content_weight,
    collab_weight: float = DEFAULTS.collab_weight,
    cold_start_ratings: int = DEFAULTS.cold_start_ratings,
    pop_weight: float = DEFAULTS.cold_start_pop_weight,
    collaborative: tuple[str, ...] = COLLABORATIVE,
) -> DataFrame:
    """Top-n of ``content·w + mean(available collaborative)·w``; cold users mix popularity in.

    ``long``: ``userId, component, movieId, score`` with components ``content``, ``popularity`` and the
    collaborative ones. ``history``: ``userId, n_ratings``. One aggregation replaces a chain of outer
    joins; popularity candidates stay in the pool with score 0 for warm users.
    """
    norm = minmax(long)
    pick = lambda name: F.max(F.when(F.col("component") == name, F.col("norm")))
    merged = norm.groupBy("userId", "movieId").agg(
        F.coalesce(pick("content"), F.lit(0.0)).alias("content"),
        F.coalesce(F.avg(F.when(F.col("component").isin(*collaborative), F.col("norm"))), F.lit(0.0)).alias("collab"),
        F.coalesce(pick("popularity"), F.lit(0.0)).alias("pop"),
    )
    known = merged.join(history.select("userId", "n_ratings"), "userId", "left")
    main = content_weight * F.col("content") + collab_weight * F.col("collab")
    cold = F.coalesce("n_ratings", F.lit(0)) < cold_start_ratings
    score = F.when(cold, (1.0 - pop_weight) * main + pop_weight * F.col("pop")).otherwise(main)
    return top_n(known.select("userId", "movieId", score.alias("score")), "userId", "score", "movieId", n)


def strategies(
    users: DataFrame,
    rated: DataFrame,
    liked: DataFrame,
    wanted_genres: DataFrame,
    known_items: DataFrame,
    *,
    cold_start: int = DEFAULTS.cold_start_ratings,
    min_known: int = 2,
    min_liked: int = DEFAULTS.min_liked,
) -> DataFrame:
    """``(userId, strategy, label)``: the first strategy each user qualifies for.

    Enough rated rows and enough of them known to the factor model: hybrid. Enough liked items with a
    usable vector: content. Preferred genres: genre. Everyone else: popularity.
    """
    known = F.when(F.col("_known"), 1)
    marked = rated.join(known_items.select("movieId").distinct().withColumn("_known", F.lit(True)), "movieId", "left")
    ratings = marked.groupBy("userId").agg(F.count(F.lit(1)).alias("rated"), F.count(known).alias("known"))
    likes = liked.groupBy("userId").agg(F.count(F.lit(1)).alias("liked"))
    genres = wanted_genres.groupBy("userId").agg(F.count(F.lit(1)).alias("genres"))
    facts = users.select("userId").distinct()
    for part in (ratings, likes, genres):
        facts = facts.join(part, "userId", "left")
    facts = facts.na.fill(0)
    strategy = (
        F.when((F.col("rated") >= cold_start) & (F.col("known") >= min_known), "hybrid")
        .when(F.col("liked") >= min_liked, "content")
        .when(F.col("genres") > 0, "genre")
        .otherwise("popularity")
    )
    labels = F.create_map(*[F.lit(x) for pair in STRATEGY_LABELS.items() for x in pair])
    return facts.withColumn("strategy", strategy).withColumn("label", labels[F.col("strategy")])


def waterfall(assigned: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Rows of each user's strategy; users whose list is empty fall to the next one.

    ``assigned``: ``userId, strategy``; ``lists``: strategy → ``userId, rank, movieId, score`` in
    falling order, each computed for all users that may need it.
    """
    order = list(lists)
    place = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    start = assigned.select("userId", place[F.col("strategy")].alias("_start"))
    rows = reduce(
        DataFrame.unionByName,
        [df.select("userId", F.lit(i).alias("_i"), "rank", "movieId", "score") for i, df in enumerate(lists.values())],
    )
    usable = rows.join(start, "userId").where(F.col("_i") >= F.col("_start"))
    # a user has at most n rows per list
    chosen = F.min("_i").over(Window.partitionBy("userId"))
    kept = usable.withColumn("_use", chosen).where(F.col("_i") == F.col("_use"))
    name = F.element_at(F.array(*[F.lit(s) for s in order]), F.col("_i") + 1)
    labels = F.create_map(*[F.lit(x) for pair in STRATEGY_LABELS.items() for x in pair])
    return kept.select(
        "userId", name.alias("strategy"), "rank", "movieId", "score", labels[name].alias("reason")
    )
