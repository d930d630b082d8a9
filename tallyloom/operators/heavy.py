"""Heavy hitters: the few keys whose rows must be split, with a proven bound on their number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Heavy:
    counts: dict
    limit: int


def heavy_keys(profile: DataFrame, key: str, least: int, most_keys: int) -> Heavy:
    """Keys with more rows than ``limit`` = max(least, rows / most_keys).

    By the pigeonhole principle fewer than ``most_keys`` keys can exceed the limit,
    so what reaches the driver is bounded whatever the data. Null keys never count.
    One pass: the rows are counted while they are grouped, and the ``most_keys``
    greatest groups, those of the limit among them, are taken.
    """
    seen = Observation()
    top = (
        profile.observe(seen, F.count(F.lit(1)).alias("n"))
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > least)
        .orderBy(F.desc("n"), key)
        .limit(most_keys)
        .collect()
    )
    limit = max(least, -(-seen.get["n"] // most_keys))
    return Heavy({r[0]: r[1] for r in top if r[1] > limit}, limit)
