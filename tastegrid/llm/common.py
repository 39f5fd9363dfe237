"""Small helpers that several text operators share."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the engine's fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join that also matches null keys; the keys of ``left`` are kept."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys))
    return left.join(right, same, how).drop(*(f"_r_{k}" for k in keys))


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only when the counted rows are within ``most``; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, gone: DataFrame, keys: list[str], most: int = 500_000) -> DataFrame:
    """Rows of ``df`` whose keys are not in ``gone``; sent to every task only if it has at most ``most`` rows."""
    return joined(df, broadcast_if(gone.select(*keys), gone.count(), most), keys, "left_anti")


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20, column: int = 1):
    """Cut an Arrow batch into runs of rows of about ``most_bytes`` of the text or bytes in a column."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= most_bytes:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
