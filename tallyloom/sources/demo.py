"""Made-up entity sets for trying things out; no network."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.entityset import EntitySet


def mock_customer(spark: SparkSession, n_customers: int = 5, n_sessions: int = 35, n_transactions: int = 500, n_products: int = 5, seed: int = 0) -> EntitySet:
    """customers, sessions, transactions and products; every row follows from its number and the seed."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    later = lambda seconds: start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    c = spark.range(1, n_customers + 1).select(
        F.col("id").alias("customer_id"), F.lpad(pick(99999, 1).cast("string"), 5, "0").alias("zip_code"),
        later(-pick(10**8, 2)).alias("join_date"), later(-pick(10**9, 3) - 600_000_000).alias("birthday"),
    )
    s = spark.range(1, n_sessions + 1).select(
        F.col("id").alias("session_id"), (pick(n_customers, 4) + 1).alias("customer_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("desktop", "mobile", "tablet")]), (pick(3, 5) + 1).cast("int")).alias("device"), later(F.col("id") * 936).alias("session_start"),
    )
    t = spark.range(1, n_transactions + 1).select(
        F.col("id").alias("transaction_id"), (pick(n_sessions, 6) + 1).alias("session_id"), (pick(n_products, 7) + 1).alias("product_id"),
        later(F.col("id") * 65).alias("transaction_time"), (pick(15000, 8) / 100 + 5).alias("amount"),
    )
    p = spark.range(1, n_products + 1).select(F.col("id").alias("product_id"), F.concat(F.lit("brand "), F.char(65 + pick(3, 9))).alias("brand"))
    es = EntitySet("mock_customer")
    es.add_dataframe(c, "customers", "customer_id", "join_date", {"zip_code": "PostalCode"}, {"birthday": "date_of_birth"})
    es.add_dataframe(s, "sessions", "session_id", "session_start")
    es.add_dataframe(t, "transactions", "transaction_id", "transaction_time")
    es.add_dataframe(p, "products", "product_id")
    return es.add_relationships([
        ("products", "product_id", "transactions", "product_id"), ("sessions", "session_id", "transactions", "session_id"), ("customers", "customer_id", "sessions", "customer_id"),
    ])


def from_jdbc(spark: SparkSession, id: str, url: str, tables: dict[str, tuple], relationships: list | None = None, **options) -> EntitySet:
    """Tables of a database: name -> (index[, time index])."""
    es = EntitySet(id)
    for name, (index, *rest) in tables.items():
        df = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
        es.add_dataframe(df, name, index, rest[0] if rest else None)
    return es.add_relationships(relationships or [])
