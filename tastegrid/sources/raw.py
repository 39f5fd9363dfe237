"""Scans of the raw CSV tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# Raw file names; movie, credit, keyword and link cells are read as text and coerced later.
FILES = {
    "movies": "movies_metadata.csv",
    "credits": "credits.csv",
    "keywords": "keywords.csv",
    "links": "links.csv",
    "ratings": "ratings.csv",
}
SMALL_FILES = {"links": "links_small.csv", "ratings": "ratings_small.csv"}

RATINGS = T.StructType(
    [
        T.StructField("userId", T.LongType()),
        T.StructField("movieId", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)


def _text_header(spark: SparkSession, path: str) -> T.StructType:
    """All columns as text, named by the header line."""
    names = spark.read.option("header", True).csv(path).columns
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_text_table(spark: SparkSession, folder: str, table: str, *, small: bool = False, nrows: int | None = None) -> DataFrame:
    """Item tables: quoted cells may span lines, so each file is one task; split large exports into files."""
    name = SMALL_FILES.get(table, FILES[table]) if small else FILES[table]
    path = f"{folder}/{name}"
    reader = spark.read.schema(_text_header(spark, path)).option("header", True)
    df = reader.option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df if nrows is None else df.limit(nrows)


def read_ratings(spark: SparkSession, folder: str, *, small: bool = False, nrows: int | None = None) -> DataFrame:
    """Ratings hold no quoted text: plain splittable CSV with the final types."""
    name = SMALL_FILES["ratings"] if small else FILES["ratings"]
    df = spark.read.schema(RATINGS).option("header", True).csv(f"{folder}/{name}")
    return df if nrows is None else df.limit(nrows)
