"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000


def epoch_us(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp column.

    ``timestamp_ntz`` (wall-clock) columns are measured on their naive value,
    so results do not move with ``spark.sql.session.timeZone``; zoned
    ``timestamp`` columns give the absolute epoch.
    """
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))
    return F.unix_micros(F.col(col))


def day_bucket(df: DataFrame, col: str) -> Column:
    return F.floor(epoch_us(df, col) / DAY_US)
