"""Numeric and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86_400


def number(column: str) -> Column:
    """Text to double, unreadable text to null."""
    return F.expr(f"try_cast(`{column}` as double)")


def id_number(column: str) -> Column:
    return number(column).cast("long")


def zero_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(0.0))


def mean_year(ts: str) -> Column:
    """Year by 365.25-day years since 1970, truncated."""
    return F.floor(F.col(ts) / (365.25 * DAY) + 1970).cast("long")


def mean_month(ts: str) -> Column:
    """Month by 30.44-day months modulo 12, truncated."""
    return F.floor((F.col(ts) / (30.44 * DAY)) % 12 + 1).cast("long")


def day_slot(ts: str) -> Column:
    """Day of week counted from Thursday = 0."""
    return F.floor((F.col(ts) / DAY) % 7).cast("long")


def epoch_year(ts: str) -> Column:
    """Exact calendar year of an epoch second, independent of the session zone."""
    return F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts) / DAY).cast("int"))).cast("long")


def epoch_seconds(ts: str) -> Column:
    """Epoch seconds of a zone-less timestamp read in UTC."""
    return F.unix_timestamp(F.col(ts).cast("timestamp")).cast("long")


def keyed_hash(seed: int, *columns: str) -> Column:
    """Reproducible pseudo-random text per key; the seed is part of the hashed text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_position(digest: Column) -> Column:
    """Leading 52 bits of a hex digest as a number in [0, 1), in digest order."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
