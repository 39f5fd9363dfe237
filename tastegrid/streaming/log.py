"""A levelled log of micro-batches, and a durable count of the rows that a stream has seen.

Each batch is a folder of its own. When ``fanout`` folders of a level have come together, they are folded into one folder
of the next level, so a reader opens few folders however long the stream has run. The manifest names the live folders and
the batches in them; it is replaced by a rename, so a crash leaves the old one. A batch that is replayed overwrites its
folder, or is left alone if it has been folded already; nothing counts twice. Folders that a manifest lets go are deleted
when the next but one is written, so readers that began before can finish.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

Fold = Callable[[DataFrame], DataFrame]
FANOUT = 4
SEEN = "seen"  # name of the observed number of rows


class SharedFile:
    """A small JSON file on any file system Spark can reach, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self) -> list[tuple[int, object]]:
        if not self._files.exists(self._path):
            return []
        found = [s.getPath() for s in self._files.listStatus(self._path) if s.getPath().getName().endswith(".json")]
        return sorted(((int(p.getName()[1:-5]), p) for p in found), key=lambda x: x[0])

    def read(self, default: dict) -> dict:
        versions = self._versions()
        if not versions:
            return default
        stream = self._files.open(versions[-1][1])
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, value: dict) -> None:
        """A new version appears by rename; the one before stays for readers that have just listed it."""
        versions = self._versions()
        number = versions[-1][0] + 1 if versions else 0
        part = self._jvm.org.apache.hadoop.fs.Path(self._path, f".v{number:012d}")
        stream = self._files.create(part, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if not self._files.rename(part, self._jvm.org.apache.hadoop.fs.Path(self._path, f"v{number:012d}.json")):
            raise OSError(f"no rename in {self._path}")
        for _, old in versions[:-1]:
            self._files.delete(old, False)

    def delete(self, path: str) -> None:
        self._files.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)


class BatchLog:
    """The log below ``path``; ``fold`` reduces rows of several batches, and may be applied again to its own results."""

    def __init__(self, spark: SparkSession, path: str, fold: Fold, fanout: int = FANOUT):
        self.spark, self.path, self.fold, self.fanout = spark, path.rstrip("/"), fold, fanout
        self._manifest = SharedFile(spark, f"{self.path}/_manifest")

    def manifest(self) -> dict:
        """``parts``: live folders ``name, level, first, last`` in the order of their batches; ``gone``: those let go."""
        return self._manifest.read({"parts": [], "gone": []})

    def write(self, batch: DataFrame, number: int) -> None:
        now = self.manifest()
        if any(p["level"] and p["first"] <= number <= p["last"] for p in now["parts"]):
            return
        name = f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{self.path}/{name}")
        parts = [p for p in now["parts"] if p["name"] != name]
        parts.append({"name": name, "level": 0, "first": number, "last": number})
        parts, gone = self._folded(sorted(parts, key=lambda p: p["first"]))
        self._manifest.write({"parts": parts, "gone": gone})
        for old in now["gone"]:
            self._manifest.delete(f"{self.path}/{old}")

    def _folded(self, parts: list[dict]) -> tuple[list[dict], list[str]]:
        gone, level = [], 0
        while any(p["level"] >= level for p in parts):
            own = [p for p in parts if p["level"] == level]
            if len(own) >= self.fanout:
                first, last = own[0]["first"], own[-1]["last"]
                name = f"level={level + 1}/{first}-{last}"
                rows = self.spark.read.parquet(*(f"{self.path}/{p['name']}" for p in own))
                self.fold(rows).write.mode("overwrite").parquet(f"{self.path}/{name}")
                parts = [p for p in parts if p["level"] != level] + [{"name": name, "level": level + 1, "first": first, "last": last}]
                gone += [p["name"] for p in own]
            level += 1
        return sorted(parts, key=lambda p: p["first"]), gone

    def folders(self) -> list[str]:
        return [f"{self.path}/{p['name']}" for p in self.manifest()["parts"]]

    def read(self) -> DataFrame:
        """The fold of all batches."""
        found = self.folders()
        if not found:
            raise ValueError(f"no batch has been written below {self.path}")
        return self.fold(self.spark.read.parquet(*found))


class SeenRows(StreamingQueryListener):
    """Adds up the rows that a query has observed under ``SEEN``, by batch, in a file that outlives the query and its session.

    Progress reports are forgotten after a while, so each is taken when it arrives; a batch that is reported again after a
    restart counts once. Spark's own number of rows refused by a watermark counts them after partial aggregation, several
    as one; what was seen less what was counted is exact.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._file = SharedFile(spark, path)
        self._query: str | None = None
        self._ended = threading.Event()

    def follow(self, query) -> SeenRows:
        self._query = str(query.id)
        return self

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self._query in (None, str(progress.id)):
            seen = progress.observedMetrics.get(SEEN)
            if seen is not None:
                self.take(int(progress.batchId), int(seen["rows"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._query in (None, str(event.id)):
            self._ended.set()

    def take(self, batch: int, rows: int) -> None:
        now = self._file.read({"upto": -1, "rows": 0})
        if batch > now["upto"]:
            self._file.write({"upto": batch, "rows": now["rows"] + rows})

    def wait(self, seconds: float = 60.0) -> bool:
        """Wait until the end of the query has been reported, after all its progress."""
        return self._ended.wait(seconds)

    def total(self) -> int:
        return int(self._file.read({"upto": -1, "rows": 0})["rows"])
