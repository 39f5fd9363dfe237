"""The layered Parquet store the jobs read from and write to."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.functions.jsonish import decode_list_cell

LAYERS = ("clean", "integrated", "split", "features", "models", "results")
# Older table names still accepted.
ALIASES = {"merged_data": "movies_integrated"}


class Store:
    """Tables under ``root/<layer>/<name>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}")
        name = name.removesuffix(".csv")
        return f"{self.root}/{layer}/{ALIASES.get(name, name)}"

    def read(self, layer: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, name))

    def write(self, df: DataFrame, layer: str, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
        """Overwrite one table and return a scan of the written copy."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(layer, name))
        return self.read(layer, name)

    def read_clean(self) -> dict[str, DataFrame]:
        return {t: self.read("clean", t) for t in ("movies", "credits", "keywords", "ratings", "links")}

    def read_preprocessed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Catalogue, training ratings, test ratings."""
        return (
            self.read("integrated", "movies_integrated"),
            self.read("split", "train_ratings"),
            self.read("split", "test_ratings"),
        )

    def save_metrics(self, metrics: DataFrame, tag: str, *, run_id: str | None = None) -> str:
        """Metrics rows as JSON, stamped with run id and tag; one folder per run, never overwritten."""
        run_id = run_id or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
        path = f"{self.root}/results/checkpoint_{run_id}_{tag}"
        metrics.withColumn("run_id", F.lit(run_id)).withColumn("tag", F.lit(tag)).write.json(path)
        return path

    def load_metrics(self) -> DataFrame:
        return self.spark.read.json(f"{self.root}/results/checkpoint_*")


def decode_list_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """List columns that came through CSV text back to arrays; native arrays stay as they are."""
    kinds = dict(df.dtypes)
    for column in columns:
        if kinds.get(column) == "string":
            df = df.withColumn(column, decode_list_cell(F.col(column)))
    return df
