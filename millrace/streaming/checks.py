"""Profile rules and deduplication over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import quality, shape
from millrace.profiles import Profile


def issues(stream: DataFrame, profile: Profile, row_id: str) -> DataFrame:
    """Every issue of a stream's rows: stateless, so no cap on the rows listed."""
    return quality.issues(stream, profile, row_id, limit=None)


def cleaned(stream: DataFrame, profile: Profile) -> DataFrame:
    return shape.repair(shape.coerce_types(shape.rename_aliases(stream, profile), profile), profile)


def distinct(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """First rows of each key; keys are forgotten delay after their time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rates(stream: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, by, n) of tumbling windows."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
