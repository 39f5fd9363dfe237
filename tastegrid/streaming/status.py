"""Serving strategy per user, kept by a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tastegrid.config import DEFAULTS
from tastegrid.operators.interactions import implicit_weight

OUT = "userId long, rated long, known long, liked long, genres long, strategy string"
STATE = "rated long, known long, movies array<long>, weights array<double>, changed array<long>"


class UserStatus(StatefulProcessor):
    """Per user: numbers of ratings and of known rated items, and the liked items with their strongest weight.

    All of it is forgotten ``keep_ms`` after its last change, so users who stay away leave no state behind, and a like counts
    only that long. A user's state is one value, read and written once per batch: every access is a round trip to the JVM.
    """

    def __init__(self, cold_start: int, min_known: int, min_liked: int, keep_ms: int | None):
        self.cold_start, self.min_known, self.min_liked, self.keep_ms = cold_start, min_known, min_liked, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms else 0
        held = self.status.get()
        rated, known, movies, weights, changed = held if held is not None else (0, 0, [], [], [])
        kept = {m: (w, at) for m, w, at in zip(movies, weights, changed) if not self.keep_ms or at + self.keep_ms > now}
        genres = 0
        for movie, weight, is_rated, is_known, wanted in ((r["movieId"], r["weight"], r["is_rated"], r["is_known"], r["genres"]) for r in rows):
            rated += is_rated
            known += is_known
            genres = max(genres, wanted)
            if movie is not None and weight is not None and (movie not in kept or kept[movie][0] < weight):
                kept[movie] = weight, now
        liked = len(kept)
        self.status.update((rated, known, [*kept], [w for w, _ in kept.values()], [at for _, at in kept.values()]))
        if rated >= self.cold_start and known >= self.min_known:
            strategy = "hybrid"
        elif liked >= self.min_liked:
            strategy = "content"
        else:
            strategy = "genre" if genres else "popularity"
        yield Row(userId=int(key[0]), rated=rated, known=known, liked=liked, genres=genres, strategy=strategy)

    def close(self) -> None:
        pass


def user_status(
    events: DataFrame,
    known_items: DataFrame,
    genres: DataFrame,
    *,
    keep_ms: int | None = None,
    cold_start: int = DEFAULTS.cold_start_ratings,
    min_known: int = 2,
    min_liked: int = DEFAULTS.min_liked,
) -> DataFrame:
    """A stream of ``(userId, rated, known, liked, genres, strategy)`` rows, one per user and batch with events.

    ``known_items``: ``movieId``; ``genres``: ``userId, genres``, how many a user prefers. Both are stored tables.
    """
    known = known_items.select("movieId").distinct().withColumn("_known", F.lit(True))
    marked = events.where(F.col("userId").isNotNull()).join(known, "movieId", "left").join(genres.select("userId", "genres"), "userId", "left")
    rated = F.col("rating").isNotNull() & F.col("movieId").isNotNull()
    rows = marked.select(
        F.col("userId").cast("long").alias("userId"), F.col("movieId").cast("long").alias("movieId"), implicit_weight().alias("weight"),
        rated.alias("is_rated"), (rated & F.coalesce("_known", F.lit(False))).alias("is_known"), F.coalesce("genres", F.lit(0)).cast("long").alias("genres"),
    )
    return rows.groupBy("userId").transformWithState(
        statefulProcessor=UserStatus(cold_start, min_known, min_liked, keep_ms), outputStructType=OUT, outputMode="Update",
        timeMode="ProcessingTime" if keep_ms else "None",
    )
