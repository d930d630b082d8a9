"""Streaming form of the aggregations that merge: per key and time window, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.entityset import q

#: The aggregations whose state is of fixed size.
STREAMED = {
    "count": lambda c: F.count(F.lit(1)), "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "mean": F.avg, "min": F.min, "max": F.max, "num_true": F.count_if,
}


def windowed_features(
    stream: DataFrame, key: str, time: str, spec: dict[str, tuple], window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """name -> (primitive[, column]) per key and window of a stream; rows later than ``lateness`` are left out.

    Works on batch tables too, where nothing is late. Time must be a timestamp with
    zone or be cast to one; null keys are left out as in batch aggregation.
    """
    unknown = {p for p, *_ in spec.values()} - set(STREAMED)
    if unknown:
        raise ValueError(f"not available on streams: {sorted(unknown)}")
    rows = stream.where(q(key).isNotNull()).withColumn("__t", q(time).cast("timestamp"))
    at = F.window("__t", window, slide) if slide else F.window("__t", window)
    aggs = [STREAMED[p](q(c[0]) if c else F.lit(1)).alias(n) for n, (p, *c) in spec.items()]
    out = rows.withWatermark("__t", lateness).groupBy(q(key), at.alias("__w")).agg(*aggs)
    return out.select(key, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *spec)
