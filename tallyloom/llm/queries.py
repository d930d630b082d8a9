"""Queries of the operators of this subpackage. Those on texts have no SQL: it cannot express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.mixture import balance
from tallyloom.llm.multiselect import build_runs, select_percentiles
from tallyloom.llm.subjects import assign_subjects, fit
from tallyloom.llm.tokens import encode_corpus, token_counts
from tallyloom.queries.activity import CENTS, CUST, TX
from tallyloom.session import materialize
from tallyloom.sources.activity import cents, customer_ids, transactions

# 4: percentiles of very large numeric columns
PERCENTS = (50, 90, 95, 99)


def _amounts(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return transactions(spark, folder, "customer_id", "amount", *more).withColumn("cents", cents(F.col("amount")))


def _percentiles(runs: DataFrame) -> DataFrame:
    return select_percentiles(materialize(runs, "p4runs"), PERCENTS).withColumnRenamed("group_id", "customer_id")


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _percentiles(build_runs(_amounts(spark, folder), "customer_id", "cents", "transaction_id"))


def p4_combined(spark: SparkSession, folder: str) -> DataFrame:
    """The same percentiles from runs made apart for transactions before 2025 and since; those without a time go with the former."""
    rows = materialize(_amounts(spark, folder, "transaction_time"), "p4rows")
    late = F.coalesce(F.year("transaction_time") >= 2025, F.lit(False))
    runs = [materialize(build_runs(rows.where(side), "customer_id", "cents", "transaction_id"), "p4part") for side in (~late, late)]
    return _percentiles(runs[0].unionByName(runs[1]))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    high = F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.col(f"p{p}").alias("v")) for p in PERCENTS[1:]]))
    out = (
        p4_percentiles(spark, folder)
        .where("n >= 100 and p50 > 0")
        .select("customer_id", "p50", high.alias("h"))
        .where("h.v >= 10 * p50")
        .select("customer_id", F.col("h.pct").alias("pct"))
    )
    return out.join(customer_ids(spark, folder), "customer_id", "left_semi")


P4_RANKS = f"""{TX}, a as (select customer_id, c, row_number() over (partition by customer_id order by c) k,
  count(*) over (partition by customer_id) n
  from (select customer_id, {CENTS} c from tx) where c is not null and customer_id is not null),
p as (select customer_id, n, {', '.join(f'max(case when k = (n * {p} + 99) // 100 then c end) p{p}' for p in PERCENTS)}
  from a group by 1, 2)"""
P4_PERCENTILES_SQL = f"with {P4_RANKS} select customer_id, n, p50, p90, p95, p99 from p"
P4_FOUND_SQL = f"""with {P4_RANKS}, {CUST}
{' union all '.join(f'select customer_id, {p} pct from p where n >= 100 and p50 > 0 and p{p} >= 10 * p50 and customer_id in (select customer_id from cust)' for p in PERCENTS[1:])}"""


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_docs(spark, folder))


def _mixture(spark: SparkSession, folder: str):
    sizes = token_counts(_docs(spark, folder), keep=("doc_id", "source"))
    return balance(sizes, spark.read.parquet(f"{folder}/source_targets.parquet"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).sources.where("not reachable").select("source")


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Rate and copies of every document."""
    m = _mixture(spark, folder)
    return m.rates.unionByName(m.rest)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the mixture."""
    s = _mixture(spark, folder).sources
    total = s.agg(F.sum("mixed_tokens")).first()[0] or 1
    return s.withColumn("actual_share", F.col("mixed_tokens") / F.lit(float(total)))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    names = [r[0] for r in spark.read.parquet(f"{folder}/subjects.parquet").where("subject is not null").select("subject").distinct().orderBy("subject").collect()]
    return assign_subjects(docs, fit(docs, spark.read.parquet(f"{folder}/subject_labels.parquet"), names))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents are about each subject."""
    return _subjects(spark, folder).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))


QUERIES = {
    "p4_found": p4_found, "p4_percentiles": p4_percentiles, "p4_combined": p4_combined, "p6_ids": p6_ids, "p7_found": p7_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_composition": p8_composition,
}
SQL: dict[str, str] = {"p4_found": P4_FOUND_SQL, "p4_percentiles": P4_PERCENTILES_SQL, "p4_combined": P4_PERCENTILES_SQL}
