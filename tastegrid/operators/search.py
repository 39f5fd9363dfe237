"""Batch title search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.config import DEFAULTS
from tastegrid.functions.text import grams, joined, squash
from tastegrid.operators.ranking import top_n
from tastegrid.operators.staging import stage

_GRAM_SIZES = (1, 2, 3)


def _query_forms(queries: DataFrame) -> DataFrame:
    raw = F.lower(F.trim("q"))
    norm = squash(raw)
    return (
        queries.where(F.trim("q") != "")
        .select("query_id", raw.alias("q_raw"), norm.alias("q_norm"))
        .withColumn("q_words", F.filter(F.split("q_norm", r"\s+"), lambda w: F.length(w) > 1))
    )


def _catalog_forms(catalog: DataFrame) -> DataFrame:
    title = F.lower(F.coalesce("title", F.lit("")))
    return catalog.select(
        "movieId",
        title.alias("t_raw"),
        squash(title).alias("t_norm"),
        F.lower(joined(F.col("genre_names"))).alias("t_genres"),
    )


def _key(needle: Column) -> Column:
    """Leading characters of a needle: any text containing it contains this key."""
    return F.substring(needle, 1, max(_GRAM_SIZES))


KEYS_BROADCAST = 500_000  # most asked keys that are sent to every task; of more both sides are shuffled


def _candidates(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct ``(query_id, movieId)`` that may match, by equal keys instead of a product.

    A text that contains a needle contains its first one to three characters. Both sides meet on that
    key per field; the match itself is checked afterwards on the few pairs that remain.
    """
    needle = lambda field, text: F.struct(F.lit(field).alias("field"), _key(text).alias("key"))
    wanted = queries.select(
        "query_id",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array(needle("norm", F.col("q_norm")), needle("raw", F.col("q_raw")), needle("genre", F.col("q_raw"))),
                    F.transform("q_words", lambda w: needle("norm", w)),
                )
            )
        ).alias("k"),
    ).select("query_id", "k.field", "k.key").where(F.col("key") != "")
    parts = None
    for field, column in (("norm", "t_norm"), ("raw", "t_raw"), ("genre", "t_genres")):
        keys = F.concat(*[grams(F.col(column), size) for size in _GRAM_SIZES])
        part = items.select("movieId", F.lit(field).alias("field"), F.explode(keys).alias("key"))
        parts = part if parts is None else parts.unionByName(part)
    wanted = stage(wanted, "search-keys")
    if wanted.count() <= KEYS_BROADCAST:  # then no gram leaves its task unless somebody asks for it
        wanted = F.broadcast(wanted)
    return parts.join(wanted, ["field", "key"]).select("query_id", "movieId").distinct()


def search_titles(
    queries: DataFrame, catalog: DataFrame, popularity: DataFrame, *, n: int = 20
) -> DataFrame:
    """``(query_id, rank, movieId, score)`` for a batch of queries ``(query_id, q)``.

    Tiers: normalised containment 4, prefix 3, raw containment 2, all longer words 1, genre text 0.5.
    A query without any hit falls back to single words at 0.5. Final score: twice the match plus the
    popularity score.
    """
    asked, items = _query_forms(queries), _catalog_forms(catalog)
    pairs = _candidates(asked, items).join(asked, "query_id").join(items, "movieId")
    has_norm = F.col("q_norm") != ""
    flag = lambda cond, points: F.when(cond, points).otherwise(0.0)
    inside = lambda w: F.col("t_norm").contains(w)
    match = (
        flag(has_norm & F.col("t_norm").contains(F.col("q_norm")), 4.0)
        + flag(has_norm & F.col("t_norm").startswith(F.col("q_norm")), 3.0)
        + flag(F.col("t_raw").contains(F.col("q_raw")), 2.0)
        + flag((F.size("q_words") > 0) & F.forall("q_words", inside), 1.0)
        + flag(F.col("t_genres").contains(F.col("q_raw")), 0.5)
    )
    judged = stage(
        pairs.select("query_id", "movieId", match.alias("match"), F.exists("q_words", inside).alias("word")), "matches"
    )
    hits = judged.where(F.col("match") > 0)
    lost = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    loose = judged.where("word").join(lost, "query_id", "left_semi").withColumn("match", F.lit(0.5))
    found = hits.unionByName(loose).join(popularity.select("movieId", "score"), "movieId", "left")
    score = F.col("match") * 2.0 + F.coalesce("score", F.lit(0.0))
    return top_n(found.select("query_id", "movieId", score.alias("score")), "query_id", "score", "movieId", n)


def suggest(
    queries: DataFrame,
    catalog: DataFrame,
    popularity: DataFrame,
    *,
    n: int = DEFAULTS.suggestions,
    n_genres: int = DEFAULTS.suggestion_genres,
) -> DataFrame:
    """Short result rows for a drop-down: title and the first genres."""
    best = search_titles(queries, catalog, popularity, n=n)
    meta = catalog.select("movieId", "title", F.slice("genre_names", 1, n_genres).alias("genres"))
    return best.join(meta, "movieId").select("query_id", "rank", "movieId", "title", "genres", "score")
