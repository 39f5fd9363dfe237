import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import hybrid
from tastegrid.operators.interactions import implicit_weights, rated_items
from tastegrid.operators.staging import stage
from tastegrid.sources.fixtures import interaction_rows
from tastegrid.sources.layers import Store
from tastegrid.sources.raw import read_ratings, read_text_table
from tastegrid.streaming import jobs
from tastegrid.streaming.log import BatchLog, SeenRows

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = datetime(2024, 1, 1)


def write_events(frame, folder, batches):
    """One file per batch, in arrival order."""
    for i, rows in enumerate(batches):
        frame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/events-{i:03d}.parquet")


def event(i, hours, kind="view", user=1, movie=1):
    return (i, START + timedelta(hours=hours), user, kind, 50.0 + i, f'{{"k": {movie}}}')


BATCHES = [
    [event(1, 1), event(2, 2, "click", movie=2), event(3, 3, "purchase", movie=3)],
    [event(5, 30, "click", movie=1), event(6, 31, "purchase", user=2, movie=3)],
    [event(1, 1), event(7, 1, "view", user=2, movie=9), event(8, 40, "signup", user=3)],
]


def stream(spark, folder):
    return jobs.read_events(spark, folder, "*.parquet/*.parquet", 1)


def test_weights_equal_batch(spark, frame, tmp_path):
    write_events(frame, f"{tmp_path}/in", BATCHES)
    schema = spark.read.parquet(f"{tmp_path}/in/*.parquet").schema
    source = interaction_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet"))
    jobs.keep_weights(source, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    batch = implicit_weights(interaction_rows(spark.read.parquet(f"{tmp_path}/in/*.parquet")))
    assert sorted(jobs.read_weights(spark, f"{tmp_path}/out").collect()) == sorted(batch.collect())
    jobs.compact_weights(spark, f"{tmp_path}/out", f"{tmp_path}/compact")
    assert sorted(jobs.read_weights(spark, f"{tmp_path}/compact").collect()) == sorted(batch.collect())


def test_late_rows_are_dropped_and_counted(spark, frame, tmp_path):
    for i, rows in enumerate(BATCHES):  # one run per arriving file, same checkpoint
        write_events(frame, f"{tmp_path}/in{i}", [rows])
        frame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = interaction_rows(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"))
        query = jobs.keep_activity(source, f"{tmp_path}/out", f"{tmp_path}/cp")
        query.awaitTermination()
    assert jobs.dropped_late_rows(query) >= 1
    got = {(r["window_start"].hour, r["interaction_type"]): r["n"] for r in jobs.read_activity(spark, f"{tmp_path}/out").collect()}
    assert got[0, "view"] == 1 and sum(got.values()) == 6  # two late rows of the third file are gone


def test_counts_and_repeats(spark, frame, tmp_path):
    rows = [event(i, i / 10, user=i % 2) for i in range(10)]
    frame(rows + rows[:4], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = lambda: interaction_rows(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"))
    jobs.keep_unique(source(), f"{tmp_path}/u", f"{tmp_path}/ucp").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/u").collect()) == list(range(10))
    jobs.keep_counts(source(), f"{tmp_path}/c", f"{tmp_path}/ccp").awaitTermination()
    assert {r["userId"]: r["n_interactions"] for r in jobs.read_counts(spark, f"{tmp_path}/c").collect()} == {0: 7, 1: 7}


def test_store_and_metrics(spark, frame, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(frame([(1, "a")], "movieId long, title string"), "integrated", "merged_data.csv")
    assert store.read("integrated", "movies_integrated").first()["title"] == "a"
    store.save_metrics(frame([("m", 0.5)], "model string, f1 double"), "final", run_id="r1")
    assert store.load_metrics().first()["run_id"] == "r1"


def test_raw_csv(spark, tmp_path):
    (tmp_path / "movies_metadata.csv").write_text('id,title,genres\n1,"a ""b""\nc","[{\'name\': \'x\'}]"\n2,d,[]\n')
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.5,100\n1,3,4.0,200\n")
    movies = read_text_table(spark, str(tmp_path), "movies").orderBy("id").collect()
    assert [m["title"] for m in movies] == ['a "b"\nc', "d"]
    assert read_ratings(spark, str(tmp_path), nrows=1).count() == 1
    assert read_ratings(spark, str(tmp_path)).schema["rating"].dataType.typeName() == "double"


def test_a_cluster_needs_a_shared_folder():
    from tastegrid.operators.staging import check_shared

    check_shared("file", "local[8]", "/x")
    check_shared("hdfs", "spark://a:7077", "/x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        check_shared("file", "spark://a:7077", "/x")


def _log(spark, path, fanout=4):
    return BatchLog(spark, str(path), lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), fanout)


def test_a_long_log_has_few_folders(spark, frame, tmp_path):
    """Sums would show a batch that counts twice."""
    log = _log(spark, tmp_path / "log", 3)
    for number in range(30):
        log.write(frame([(number % 2, 1), (7, number)], "k long, n long").coalesce(1), number)
        if number in (4, 13, 26):  # a replay before and after its folder was folded
            log.write(frame([(number % 2, 1), (7, number)], "k long, n long"), number)
            log.write(frame([(0, 99)], "k long, n long"), 1)
    want = {0: 15, 1: 15, 7: sum(range(30))}
    assert {r["k"]: r["n"] for r in log.read().collect()} == want
    assert len(log.folders()) <= 2 * 4
    again = _log(spark, tmp_path / "log", 3)  # as after a restart
    assert {r["k"]: r["n"] for r in again.read().collect()} == want
    live = {p.rsplit("/", 1)[1] for p in log.folders()}
    kept = {x.name for x in (tmp_path / "log").iterdir() if x.name.startswith("batch=")}
    assert {n for n in live if n.startswith("batch=")} <= kept and len(kept) <= 2 * 3
    with pytest.raises(ValueError):
        _log(spark, tmp_path / "none").read()


def test_levels_stay_bounded(spark, tmp_path):
    """A hundred batches in four folders a level; the folding itself is left out."""
    log = _log(spark, tmp_path / "log")
    log.spark, log.fold = _NoSpark(), lambda rows: rows
    parts = []
    for number in range(100):
        parts, _ = log._folded(parts + [{"name": f"batch={number}", "level": 0, "first": number, "last": number}])
        assert len(parts) <= 10 and [p["first"] for p in parts] == [0, *(p["last"] + 1 for p in parts[:-1])]


class _NoSpark:
    """Reads and writes nothing."""

    def __getattr__(self, _):
        return self

    def __call__(self, *_):
        return self


def test_late_rows_outlive_progress_and_restarts(spark, frame, tmp_path):
    total = []
    for i, rows in enumerate([*BATCHES, [event(9, 1), event(10, 2, "click")], [event(11, 3)]]):
        frame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = interaction_rows(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"))
        seen = SeenRows(spark, f"{tmp_path}/seen")
        spark.streams.addListener(seen)
        query = jobs.keep_activity(source, f"{tmp_path}/out", f"{tmp_path}/cp", seen)
        query.awaitTermination()
        assert seen.wait()
        spark.streams.removeListener(seen)
        total.append(jobs.late_rows(spark, f"{tmp_path}/out", seen))
    assert total == [0, 0, 2, 4, 5]
    seen.take(1, 50)  # a batch that is reported again
    assert SeenRows(spark, f"{tmp_path}/seen").total() == 11
    for batch in range(1000, 1150):  # more than a query's reports reach back
        seen.take(batch, 1)
    assert seen.total() == 161 and len(list((tmp_path / "seen").iterdir())) <= 6


def test_status_follows_the_events(spark, frame, tmp_path):
    known, users = frame([(1,), (2,), (3,)], "movieId long"), frame([(u,) for u in range(1, 7)], "userId long")
    genres = frame([(3, 2), (5, 1), (6, 0)], "userId long, genres int")
    files = [
        [event(1, 1, "purchase", 1, 1), event(2, 1, "purchase", 1, 2), event(3, 1, "view", 2, 1), event(5, 1, "signup", 3)],
        [event(6, 2, "purchase", 1, 9), event(7, 2, "click", 2, 1), event(8, 2, "click", 2, 2), event(9, 2, "error", 3, 4)],
        [event(11, 3, "purchase", 4, 8), event(12, 3, "purchase", 4, 9), event(13, 3, "purchase", 4, 7), event(14, 3, "view", 5, 3)],
    ]
    for i, rows in enumerate(files):
        frame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = interaction_rows(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"))
        jobs.keep_status(source, known, genres, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        got = {r["userId"]: (r["rated"], r["liked"], r["genres"], r["strategy"]) for r in jobs.read_status(spark, f"{tmp_path}/out", users, genres).collect()}
        events = interaction_rows(spark.read.schema(EVENT).parquet(f"{tmp_path}/in"))
        wanted = genres.select("userId", F.explode(F.expr("array_repeat('g', genres)")).alias("genre"))
        batch = hybrid.strategies(users, rated_items(events), implicit_weights(events), wanted, known)
        assert got == {r["userId"]: (r["rated"], r["liked"], r["genres"], r["strategy"]) for r in batch.collect()}
    assert {s for *_, s in got.values()} == {"hybrid", "content", "genre", "popularity"}


def test_status_is_forgotten_in_time(spark, frame, tmp_path):
    known, genres = frame([(1,), (2,)], "movieId long"), frame([], "userId long, genres int")
    for i, rows in enumerate([[event(j, 1, "purchase", 1, 1) for j in (1, 2, 3)], [event(7, 2, "click", 1, 2)]]):
        frame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = interaction_rows(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"))
        jobs.keep_status(source, known, genres, f"{tmp_path}/out", f"{tmp_path}/cp", keep_ms=1500).awaitTermination()
        row = jobs.read_status(spark, f"{tmp_path}/out", frame([(1,)], "userId long"), genres).first()
        assert (row["rated"], row["liked"]) == ((3, 0), (0, 1))[i] and row["strategy"] == ("hybrid", "popularity")[i]
        time.sleep(2)


def test_status_is_read_and_written_once_per_user():
    from pyspark.sql import Row
    from tastegrid.streaming.status import UserStatus

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return Value()

    status = UserStatus(3, 2, 2, None)
    status.init(Handle())
    row = lambda movie, weight: Row(movieId=movie, weight=weight, is_rated=False, is_known=False, genres=0)
    for weight in (3.0, 5.0):
        out = list(status.handleInputRows((7,), iter([row(m, weight) for m in range(50)] + [row(None, 1.0), row(9, None)]), None))
        assert [(r["userId"], r["liked"], r["strategy"]) for r in out] == [(7, 50, "content")]
    assert calls == ["get", "update"] * 2 and set(status.status.held[3]) == {5.0}


def test_shuffle_files_go_with_their_step(spark):
    """What a staged step shuffled is deleted when the step ends."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(files.getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(files.getAllFiles().size()))
    before = held()
    assert stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted").count() == 7
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before
