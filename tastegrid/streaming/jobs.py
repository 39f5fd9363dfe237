"""Structured Streaming upkeep of weights, counts and activity from the interaction log."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tastegrid.config import DEFAULTS
from tastegrid.operators.interactions import implicit_weights
from tastegrid.operators.staging import stage_root
from tastegrid.session import tune
from tastegrid.sources.fixtures import interaction_rows
from tastegrid.streaming.log import SEEN, BatchLog, SeenRows
from tastegrid.streaming.status import user_status

DELAY = "1 hour"
WINDOW = "6 hours"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Event files of a folder as an interaction stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return interaction_rows(reader.parquet(folder))


def _per_batch(
    df: DataFrame, log: BatchLog, checkpoint: str, mode: str, shape=lambda batch, number: batch, trigger: dict | None = None
) -> StreamingQuery:
    """Write each micro-batch to the log."""
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True})
        .foreachBatch(lambda batch, number: log.write(shape(batch, number), number)).start()
    )


def _weights_log(spark: SparkSession, path: str) -> BatchLog:
    return BatchLog(spark, path, lambda rows: rows.groupBy("userId", "movieId").agg(F.max("weight").alias("weight")))


def keep_weights(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Implicit weights as a log of per-batch maxima.

    The maximum is idempotent and associative, so the stream needs no state at all: each batch is
    reduced to its own maxima, and the log folds by maximum.
    """
    return _per_batch(events, _weights_log(events.sparkSession, path), checkpoint, "append", lambda batch, _: implicit_weights(batch))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return _weights_log(spark, path).read()


def compact_weights(spark: SparkSession, path: str, target: str) -> None:
    """All batches as one at a new place."""
    _weights_log(spark, target).write(read_weights(spark, path), 0)


def _counts_log(spark: SparkSession, path: str) -> BatchLog:
    """Counts only grow, so the greatest are the newest."""
    newest = [F.max(c).alias(c) for c in ("n_interactions", "n_rated")]
    return BatchLog(spark, path, lambda rows: rows.groupBy("userId").agg(*newest))


def keep_counts(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running event and rating counts per user; readers decide what is enough."""
    rated = F.count(F.when(F.col("rating").isNotNull() & F.col("movieId").isNotNull(), 1))
    counts = events.groupBy("userId").agg(F.count(F.lit(1)).alias("n_interactions"), rated.alias("n_rated"))
    return _per_batch(counts, _counts_log(events.sparkSession, path), checkpoint, "update")


def read_counts(spark: SparkSession, path: str, *, cold_start: int = DEFAULTS.cold_start_ratings) -> DataFrame:
    return _counts_log(spark, path).read().withColumn("rated_enough", F.col("n_rated") >= cold_start)


def _status_log(spark: SparkSession, path: str) -> BatchLog:
    def newest(rows: DataFrame) -> DataFrame:
        fields = [c for c in rows.columns if c != "userId"]
        return rows.groupBy("userId").agg(F.max(F.struct("batch", *(c for c in fields if c != "batch"))).alias("s")).select("userId", *(f"s.{c}" for c in fields))

    return BatchLog(spark, path, newest)


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_status(events: DataFrame, known_items: DataFrame, genres: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Serving strategy of each user with events; see :func:`status.user_status` for the options."""
    spark = events.sparkSession
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKS)  # read when the query starts
    try:
        rows = user_status(events, known_items, genres, **options)
        numbered = lambda batch, number: batch.withColumn("batch", F.lit(number).cast("long"))
        # with state that expires there is always another batch to run, so what has come is taken as one
        trigger = {"once": True} if options.get("keep_ms") else None
        return _per_batch(rows, _status_log(spark, path), checkpoint, "update", numbered, trigger)
    finally:
        spark.conf.unset(STATE_PROVIDER) if before is None else spark.conf.set(STATE_PROVIDER, before)


def read_status(spark: SparkSession, path: str, users: DataFrame, genres: DataFrame) -> DataFrame:
    """``(userId, rated, known, liked, genres, strategy)`` of all ``users``; those without events have only their genres."""
    found = _status_log(spark, path).read().drop("genres", "batch")
    out = users.select("userId").distinct().join(genres.select("userId", "genres"), "userId", "left").join(found, "userId", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rated", "known", "liked", "genres")]
    quiet = F.when(F.col("genres") > 0, "genre").otherwise("popularity")
    return out.select("userId", *zero, F.coalesce("strategy", quiet).alias("strategy"))


def activity(events: DataFrame, *, window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """Events per type and tumbling window; on a stream, later rows than ``delay`` are dropped and counted
    in the progress report (``numRowsDroppedByWatermark``)."""
    timed = events.withWatermark("created_at", delay) if events.isStreaming else events
    return timed.groupBy(F.window("created_at", window).alias("w"), "interaction_type").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), "interaction_type", "n")


def _activity_log(spark: SparkSession, path: str) -> BatchLog:
    return BatchLog(spark, path, lambda rows: rows.groupBy("window_start", "interaction_type").agg(F.max("n").alias("n")))


def keep_activity(events: DataFrame, path: str, checkpoint: str, seen: SeenRows | None = None, **options: str) -> StreamingQuery:
    """Activity per window. ``seen``, a listener that the caller has added to the session, keeps the number of rows that came."""
    marked = events.observe(SEEN, F.count("created_at").alias("rows"))
    query = _per_batch(activity(marked, **options), _activity_log(events.sparkSession, path), checkpoint, "update")
    if seen:
        seen.follow(query)
    return query


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return _activity_log(spark, path).read()


def late_rows(spark: SparkSession, path: str, seen: SeenRows) -> int:
    """Timed rows that came after their window had been closed: those seen less those counted, over all runs of the stream."""
    return seen.total() - int(read_activity(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def dropped_late_rows(query: StreamingQuery) -> int:
    """What the query still reports of refused rows, after partial aggregation; :func:`late_rows` is exact and lasts."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def without_repeats(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event id once; ids are forgotten when the watermark passes."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def keep_unique(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        without_repeats(events).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# --- bounded runs over one folder, used as registered queries ---------------------------------------


def _run(spark: SparkSession, job, events: DataFrame) -> str:
    base = f"{stage_root(spark)}/tastegrid-stream-{uuid4().hex}"
    job(events, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out"


def run_weights(spark: SparkSession, folder: str) -> DataFrame:
    return read_weights(spark, _run(tune(spark), keep_weights, read_events(spark, folder)))


def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    df = read_counts(spark, _run(tune(spark), keep_counts, read_events(spark, folder)))
    return df.withColumn("rated_enough", F.col("rated_enough").cast("long"))


def run_status(spark: SparkSession, folder: str, users: DataFrame, known_items: DataFrame, genres: DataFrame) -> DataFrame:
    job = lambda events, path, checkpoint: keep_status(events, known_items, genres, path, checkpoint)
    return read_status(spark, _run(tune(spark), job, read_events(spark, folder)), users, genres)


def run_activity(spark: SparkSession, folder: str) -> DataFrame:
    df = read_activity(spark, _run(tune(spark), keep_activity, read_events(spark, folder)))
    return df.select(F.unix_timestamp("window_start").alias("window_start"), "interaction_type", "n")


def run_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth event arrives twice; each id must come out once."""
    events = read_events(tune(spark), folder)
    copies = F.when(F.col("id") % 10 == 0, 2).otherwise(1)
    repeated = events.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_copy")
    path = _run(spark, keep_unique, repeated)
    return spark.read.parquet(path).select("id", "userId", "movieId", "interaction_type", "rating")
