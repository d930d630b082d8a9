"""Queries of the training-data operators over the activity tables, with their SQL."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.asof import asof_attributes
from tallyloom.operators.bitslice import entity_features
from tallyloom.operators.rolling import rolling_totals
from tallyloom.operators.tree_aggregate import tree_aggregate
from tallyloom.session import materialize
from tallyloom.sources.activity import cents, copies, customer_ids, table, transactions

CALENDAR = (date(2024, 1, 1), date(2025, 6, 30))

TX = """tx as (select * from (select *, row_number() over (partition by transaction_id
  order by recorded_at desc nulls last) rn from transactions where transaction_id is not null) where rn = 1)"""
CENTS = "case when abs(amount) < 9e13 then try_cast(round(amount * 100) as bigint) end"
CUST = "cust as (select distinct customer_id from customers where customer_id is not null)"


# 1: a few keys holding most records
def activity_totals(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, customer_id, n, total_cents of both tables, by the fan-in tree."""
    tx = transactions(spark, folder, "customer_id", "amount").select(
        F.lit("transactions").alias("table_name"),
        "customer_id",
        F.coalesce(cents(F.col("amount")), F.lit(0)).alias("cents"),
        F.col("transaction_id").alias("row_id"),
    )
    se = copies(spark, folder, "sessions", "session_id", "customer_id").select(
        F.lit("sessions").alias("table_name"), "customer_id", F.lit(0).cast("long").alias("cents"),
        F.col("session_id").alias("row_id"),
    )
    rows = table(spark, folder, "transactions").count() + table(spark, folder, "sessions").count()
    return tree_aggregate(
        tx.unionByName(se),
        ["table_name", "customer_id"],
        {"n": (F.lit(1).cast("long"), "sum"), "total_cents": (F.col("cents"), "sum")},
        row_key=["row_id"],
        rows=rows,
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    per_key = materialize(activity_totals(spark, folder), "p1")
    total = {r[0]: r[1] for r in per_key.groupBy("table_name").agg(F.sum("n")).collect()}
    bar = F.lit(None).cast("long")
    for name, n in total.items():
        bar = F.when(F.col("table_name") == name, F.lit(n)).otherwise(bar)
    hot = per_key.where(F.col("n") * 100 >= bar)
    return hot.join(customer_ids(spark, folder), "customer_id", "left_semi").select("table_name", "customer_id")


def p1_totals(spark: SparkSession, folder: str) -> DataFrame:
    of = lambda name, c: F.sum(F.when(F.col("table_name") == name, F.col(c)).otherwise(0))
    per_key = (
        activity_totals(spark, folder)
        .groupBy("customer_id")
        .agg(
            of("transactions", "n").alias("n_transactions"),
            of("transactions", "total_cents").alias("total_cents"),
            of("sessions", "n").alias("n_sessions"),
        )
    )
    names = ["n_transactions", "total_cents", "n_sessions"]
    joined = customer_ids(spark, folder).join(per_key, "customer_id", "left")
    return joined.select("customer_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


P1_FOUND_SQL = f"""with {TX}, {CUST}, se as (select session_id, max(customer_id) customer_id from sessions
  where session_id is not null group by 1),
k as (select 'transactions' table_name, customer_id, count(*) n from tx group by 2
  union all select 'sessions', customer_id, count(*) from se group by 2),
t as (select table_name, sum(n) total from k group by 1)
select table_name, customer_id from k join t using (table_name)
where n * 100 >= total and customer_id in (select customer_id from cust)"""

P1_TOTALS_SQL = f"""with {TX}, {CUST}, se as (select session_id, max(customer_id) customer_id from sessions
  where session_id is not null group by 1),
a as (select customer_id, count(*) n, coalesce(sum({CENTS}), 0) c from tx group by 1),
b as (select customer_id, count(*) n from se group by 1)
select customer_id, cast(coalesce(a.n, 0) as bigint) n_transactions, cast(coalesce(a.c, 0) as bigint) total_cents,
  cast(coalesce(b.n, 0) as bigint) n_sessions
from cust left join a using (customer_id) left join b using (customer_id)"""


# 2: per-entity feature table from events
def customer_product_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with activity: aligned arrays of types, counts, totals and latest session starts."""
    tx = transactions(spark, folder, "session_id", "customer_id", "product_id", "amount").where(
        "customer_id is not null and product_id is not null"
    )
    tx = tx.select(
        "customer_id", "product_id", cents(F.col("amount")).alias("cents"),
        # null sessions match nothing: a key of their own each keeps them spread
        F.coalesce("session_id", -1 - F.abs(F.col("transaction_id"))).alias("session_id"),
        F.col("session_id").isNotNull().alias("known"),
    )
    se = copies(spark, folder, "sessions", "session_id", "session_start").withColumn("known", F.lit(True))
    events = tx.join(se, ["session_id", "known"], "left")
    return entity_features(
        events, F.col("customer_id"), F.col("product_id"), F.col("cents"), F.col("session_start"), rows=table(spark, folder, "transactions").count()
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    f = customer_product_features(spark, folder)
    best = lambda c: F.array_max(c)
    once = lambda c: F.size(F.filter(c, lambda x: x == F.array_max(c))) == 1
    at = F.array_position("counts", best("counts")).cast("int")
    alone = (
        (best("counts") >= 3)
        & best("latest").isNotNull()
        & (F.element_at("totals", at) == best("totals"))
        & (F.element_at("latest", at) == best("latest"))
        & once("counts")
        & once("totals")
        & once("latest")
    )
    found = f.where(alone).select(F.col("entity_id").alias("customer_id"), F.element_at("types", at).alias("product_id"))
    return found.join(customer_ids(spark, folder), "customer_id", "left_semi")


def p2_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer; features as product:count:cents:latest in order of product, absent ones being 0:0:-."""
    f = customer_product_features(spark, folder)
    cell = F.transform(
        F.arrays_zip("types", "counts", "totals", "latest"),
        lambda x: F.concat_ws(
            ":", x["types"], x["counts"], x["totals"],
            F.coalesce(F.date_format(x["latest"], "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-")),
        ),
    )
    f = f.select(F.col("entity_id").alias("customer_id"), F.size("types").cast("long").alias("n_products"), F.array_join(cell, ";").alias("features"))
    out = customer_ids(spark, folder).join(f, "customer_id", "left")
    return out.select("customer_id", F.coalesce("n_products", F.lit(0).cast("long")).alias("n_products"), F.coalesce("features", F.lit("")).alias("features"))


P2_CELLS = f"""{TX}, {CUST}, se as (select session_id, max(session_start) session_start from sessions
  where session_id is not null group by 1),
cell as (select customer_id, product_id, count(*) n, coalesce(sum({CENTS}), 0) c, max(session_start) r
  from tx left join se using (session_id)
  where customer_id in (select customer_id from cust) and product_id is not null group by 1, 2)"""

P2_FOUND_SQL = f"""with {P2_CELLS},
m as (select customer_id, max(n) n, max(c) c, max(r) r from cell group by 1),
u as (select customer_id, sum(case when cell.n = m.n then 1 else 0 end) un,
  sum(case when cell.c = m.c then 1 else 0 end) uc, sum(case when cell.r = m.r then 1 else 0 end) ur
  from cell join m using (customer_id) group by 1)
select customer_id, product_id from cell join m using (customer_id) join u using (customer_id)
where cell.n = m.n and cell.c = m.c and cell.r = m.r and un = 1 and uc = 1 and ur = 1 and cell.n >= 3"""

P2_FEATURES_SQL = f"""with {P2_CELLS},
f as (select customer_id, count(*) n_products, string_agg(product_id || ':' || n || ':' || cast(c as bigint) || ':' ||
  coalesce(strftime(r, '%Y-%m-%d %H:%M:%S.%f'), '-'), ';' order by product_id) features from cell group by 1)
select customer_id, coalesce(n_products, 0) n_products, coalesce(features, '') features
from cust left join f using (customer_id)"""


# 3: attributes as known at event time
def known_versions(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, row_id and the version (or null) of every cutoff and transaction."""
    tx = transactions(spark, folder, "customer_id", "transaction_time").select(
        F.lit("transactions").alias("table_name"), F.col("transaction_id").alias("row_id"), "customer_id",
        F.col("transaction_time").alias("at"),
    )
    cu = copies(spark, folder, "cutoff_time", "cutoff_id", "instance_id", "time").select(
        F.lit("cutoff_time").alias("table_name"), F.col("cutoff_id").alias("row_id"),
        F.col("instance_id").alias("customer_id"), F.col("time").alias("at"),
    )
    profile = (
        table(spark, folder, "transactions").select("customer_id", F.col("transaction_time").alias("at"))
        .unionByName(table(spark, folder, "cutoff_time").select(F.col("instance_id").alias("customer_id"), F.col("time").alias("at")))
    )
    versions = copies(spark, folder, "customer_versions", "version_id", "customer_id", "effective_from", "known_at").join(
        customer_ids(spark, folder), "customer_id", "left_semi"
    )
    return asof_attributes(
        tx.unionByName(cu), versions, "customer_id", "at", "customer_id", "effective_from", "known_at", "version_id",
        profile=profile, version_profile=table(spark, folder, "customer_versions"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    out = known_versions(spark, folder).where("version is not null")
    return out.select("table_name", "row_id", F.col("version.version_id").alias("version_id"))


P3_FOUND_SQL = f"""with {TX}, {CUST},
v as (select version_id, max(customer_id) customer_id, max(effective_from) e, max(known_at) k from customer_versions
  where version_id is not null group by 1
  having max(effective_from) is not null and max(known_at) is not null),
cu as (select cutoff_id, max(instance_id) i, max("time") t from cutoff_time where cutoff_id is not null group by 1),
ev as (select 'transactions' table_name, transaction_id row_id, customer_id, transaction_time t from tx
  union all select 'cutoff_time', cutoff_id, i, t from cu),
j as (select table_name, row_id, version_id, row_number() over (partition by table_name, row_id
    order by e desc, k desc, version_id desc) rn
  from ev join v on ev.customer_id = v.customer_id and e <= t and k <= t
  where ev.customer_id in (select customer_id from cust))
select table_name, row_id, version_id from j where rn = 1"""


# 5: rolling totals over trailing periods
def daily_amounts(spark: SparkSession, folder: str) -> DataFrame:
    tx = transactions(spark, folder, "customer_id", "transaction_time", "amount")
    day = F.datediff(F.col("transaction_time").cast("date"), F.lit(CALENDAR[0]))
    return (
        tx.select(F.col("customer_id").alias("entity"), day.alias("day"), cents(F.col("amount")).alias("c"))
        .where(F.col("entity").isNotNull() & F.col("day").between(0, (CALENDAR[1] - CALENDAR[0]).days))
        .groupBy("entity", "day")
        .agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("c").alias("n"))
    )


def _day(c: str):
    return F.date_format(F.date_add(F.lit(CALENDAR[0]), F.col(c)), "yyyy-MM-dd")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    def burst(day: int, first: np.ndarray, cols: dict) -> np.ndarray:
        week, month = cols["total_7"], cols["total_30"]
        return (day >= first + 29) & (5 * week >= 4 * month) & (month >= 200_000)

    daily = daily_amounts(spark, folder).select("entity", "day", "total")
    ids = customer_ids(spark, folder).withColumnRenamed("customer_id", "entity")
    out = rolling_totals(daily, ids, *CALENDAR, (7, 30), {"total": "sum"}, keep=burst)
    return out.select(F.col("entity").alias("customer_id"), _day("day").alias("activity_day"))


def p5_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer and day of the calendar: totals in cents and averages over the last 7 and 30 days."""
    ids = customer_ids(spark, folder).withColumnRenamed("customer_id", "entity")
    out = rolling_totals(daily_amounts(spark, folder), ids, *CALENDAR, (7, 30), {"total": "sum", "n": "sum"})
    mean = lambda w: F.round(F.expr(f"try_divide(total_{w}, n_{w})"), 3).alias(f"mean_{w}")
    return out.select(
        F.col("entity").alias("customer_id"), _day("day").alias("activity_day"), "total_7", "n_7", mean(7), "total_30", "n_30", mean(30)
    )


def p5_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer and day of the calendar: least and greatest amount in cents over the last 7 and 30 days, null where there is none."""
    tx = transactions(spark, folder, "customer_id", "transaction_time", "amount")
    day = F.datediff(F.col("transaction_time").cast("date"), F.lit(CALENDAR[0]))
    daily = tx.select(F.col("customer_id").alias("entity"), day.alias("day"), cents(F.col("amount")).alias("c")).groupBy("entity", "day").agg(F.min("c").alias("least"), F.max("c").alias("greatest"))
    ids = customer_ids(spark, folder).withColumnRenamed("customer_id", "entity")
    out = rolling_totals(daily, ids, *CALENDAR, (7, 30), {"least": "min", "greatest": "max"})
    return out.select(F.col("entity").alias("customer_id"), _day("day").alias("activity_day"), "least_7", "greatest_7", "least_30", "greatest_30")


P5_DAYS = f"""{TX}, {CUST},
d as (select customer_id, cast(transaction_time as date) dd, sum({CENTS}) c, count({CENTS}) n from tx
  where transaction_time >= timestamp '2024-01-01' and transaction_time < timestamp '2025-07-01'
    and customer_id in (select customer_id from cust) group by 1, 2),
cal as (select cast(unnest(generate_series(date '2024-01-01', date '2025-06-30', interval 1 day)) as date) dd),
g as (select cust.customer_id, cal.dd, coalesce(c, 0) c, coalesce(n, 0) n,
    min(case when d.dd is not null then d.dd end) over (partition by cust.customer_id) f
  from cust cross join cal left join d on d.customer_id = cust.customer_id and d.dd = cal.dd),
w as (select customer_id, dd, f, {', '.join(f'sum({x}) over (partition by customer_id order by dd rows {k - 1} preceding) {y}_{k}' for x, y in (('c', 'total'), ('n', 'n')) for k in (7, 30))} from g)"""
P5_FOUND_SQL = f"""with {P5_DAYS} select customer_id, strftime(dd, '%Y-%m-%d') activity_day from w
where dd >= f + 29 and 5 * total_7 >= 4 * total_30 and total_30 >= 200000"""
P5_DAILY_SQL = f"""with {P5_DAYS} select customer_id, strftime(dd, '%Y-%m-%d') activity_day, cast(total_7 as bigint) total_7, cast(n_7 as bigint) n_7,
  round(case when n_7 > 0 then total_7 / n_7 end, 3) mean_7, cast(total_30 as bigint) total_30, cast(n_30 as bigint) n_30, round(case when n_30 > 0 then total_30 / n_30 end, 3) mean_30 from w"""
P5_EXTREMES_SQL = f"""with {TX}, {CUST},
d as (select customer_id, cast(transaction_time as date) dd, min({CENTS}) a, max({CENTS}) b from tx where customer_id in (select customer_id from cust) group by 1, 2),
cal as (select cast(unnest(generate_series(date '2024-01-01', date '2025-06-30', interval 1 day)) as date) dd)
select customer_id, strftime(dd, '%Y-%m-%d') activity_day, {', '.join(f'{f}({x}) over (partition by customer_id order by dd rows {k - 1} preceding) {y}_{k}' for k in (7, 30) for f, x, y in (('min', 'a', 'least'), ('max', 'b', 'greatest')))}
from (select cust.customer_id, cal.dd, a, b from cust cross join cal left join d on d.customer_id = cust.customer_id and d.dd = cal.dd)"""

QUERIES = {
    "p1_found": p1_found, "p1_totals": p1_totals, "p2_found": p2_found, "p2_features": p2_features, "p3_found": p3_found,
    "p5_found": p5_found, "p5_daily": p5_daily, "p5_extremes": p5_extremes,
}
SQL = {
    "p1_found": P1_FOUND_SQL, "p1_totals": P1_TOTALS_SQL, "p2_found": P2_FOUND_SQL, "p2_features": P2_FEATURES_SQL,
    "p3_found": P3_FOUND_SQL, "p5_found": P5_FOUND_SQL,
    "p5_daily": P5_DAILY_SQL, "p5_extremes": P5_EXTREMES_SQL,
}
