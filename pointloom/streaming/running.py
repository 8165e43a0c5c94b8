"""Running box, count and histogram of a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import bin_of


def running_box(points: DataFrame, *by: str) -> DataFrame:
    """Streaming aggregate: use with output mode complete or update."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[f(k).alias(f"{f.__name__}_{k}") for k in "xyz" for f in (F.min, F.max)])


def running_histogram(points: DataFrame, low: float, high: float, bins: int = 256) -> DataFrame:
    """Counts by bin of a fixed axis."""
    return points.where("z is not null and not isnan(z)").groupBy(bin_of(F.col("z"), F.lit(low), F.lit(high), bins).alias("bin")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by time window; rows later than the watermark no longer count."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
