"""Readers of the activity tables that apply the reading rules of their rows.

A transaction is one ``transaction_id`` (its row of greatest ``recorded_at``), a
session one ``session_id``, and so on. Rows whose id is null denote nothing and
are left out. Only the columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: that of greatest ``order``; rows that tie are equal.

    A null ``order`` is below every other, a null ``key`` is dropped. Every
    buffer is a fixed-width ``max_by``, so the plan is a hash aggregate with
    map-side combine and a group of copies collapses before the shuffle.
    """
    rank = F.coalesce(F.col(order), F.lit("0001-01-01 00:00:00").cast(df.schema[order].dataType))
    picks = [F.max_by(F.col(c), rank).alias(c) for c in columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*picks)


def transactions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """transaction_id and the given columns of each transaction."""
    return latest_rows(table(spark, folder, "transactions"), "transaction_id", "recorded_at", list(columns))


def copies(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """One row per ``key`` of a table whose copies agree in ``columns``."""
    df = table(spark, folder, name)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in columns])


def customer_ids(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customers")
    return df.select("customer_id").where(F.col("customer_id").isNotNull()).distinct()


def cents(amount: Column) -> Column:
    """Whole cents; null, NaN and infinite amounts are missing (null)."""
    finite = F.abs(amount) < F.lit(9.0e13)
    return F.when(finite, F.rint(amount * 100).cast("long"))
