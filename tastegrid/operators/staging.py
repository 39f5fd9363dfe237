"""Write an intermediate table once to the shared folder and read it back.

Used where a result is consumed several times, where two branches must see the very same rows, or
where an iterative job would otherwise grow its lineage. The copy is a plain Parquet table, so losing
executors costs a re-read, never a recompute.

The folder is the one named by ``spark.checkpoint.dir``; where a session leaves it unset, a folder inside
the warehouse takes its place. A warehouse on the driver's own disk is refused on a cluster, as executors can't share it.
Each session writes below one run folder of its own, which is removed when the session's JVM ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Event, Thread
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, str] = {}


def check_shared(scheme: str, master: str, folder: str) -> None:
    """Refuse a folder on a machine's own disk unless everything runs on that machine."""
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {folder} is on the driver's disk")


def stage_root(spark: SparkSession) -> str:
    """The run folder of this session's application."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        configured = spark.conf.get("spark.checkpoint.dir", "")
        parent = configured.rstrip("/") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"
        _runs[app] = f"{parent}/tastegrid-{app}-{uuid4().hex[:8]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_runs[app])
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not configured:
            try:
                check_shared(files.getUri().getScheme(), spark.sparkContext.master, parent)
            except ValueError:
                del _runs[app]
                raise
        files.deleteOnExit(path)
    return _runs[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as Parquet under the run folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`stage`, as a table bucketed by ``key``: tables of as many buckets join on it without a shuffle."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{stage_root(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def unstage(df: DataFrame) -> None:
    """Delete a copy that no frame needs any more."""
    spark = df.sparkSession
    configuration = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder))
        table = folder.rsplit("/", 1)[1]
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        path.getFileSystem(configuration).delete(path, True)


@contextmanager
def garbage_collected(spark: SparkSession, seconds: float = 5.0) -> Iterator[None]:
    """Let the driver collect garbage every few ``seconds``: Spark deletes the shuffle files of what nothing refers to any more."""
    done, system = Event(), spark.sparkContext._jvm.System

    def run() -> None:
        while not done.wait(seconds):
            system.gc()

    thread = Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
