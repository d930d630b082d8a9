"""More queries of the feature engine: planning with options, stored definitions and tables, whole-table windows, recursions, streams."""

from __future__ import annotations

import copy
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.entityset import EntitySet, read_entityset
from tallyloom.features import AggregationFeature as Agg
from tallyloom.features import IdentityFeature, TransformFeature, load_features, save_features
from tallyloom.functions.base import AGGREGATIONS, TRANSFORMS
from tallyloom.plans.discovery import FeatureCollection, generate_features_from_primitives, schema_to_features
from tallyloom.plans.executor import calculate_feature_matrix
from tallyloom.plans.planner import dfs
from tallyloom.queries.synthesis import AT, CUTOFF, ITEMS, W, feats, query, star, stream, trans
from tallyloom.session import shared_dir
from tallyloom.streaming.windows import windowed_features

A, T = AGGREGATIONS, TRANSFORMS
QUERIES: dict = {}  # the decorator registers them with those of synthesis
SQL: dict[str, str] = {}


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tallyloom-{what}-{uuid.uuid4().hex}"


# cutoffs
_TO = "(partition by user_id order by ts range between unbounded preceding and current row)"


@query(f"""select distinct user_id, ts "time", count(*) over {_TO} n, sum(value) over {_TO} total, max(value) over {_TO} hi, avg(value) over {_TO} mean, count_if(value > 20) over {_TO} n_up,
  coalesce(sum(case when value > 20 then value end) over {_TO}, 0) total_up, (epoch_us(ts) - min(epoch_us(ts)) over {_TO}) / 1e6 / 3600 n_hours,
  count(*) over (partition by user_id order by epoch_us(ts) range between 172799999999 preceding and current row) two_days from events""", {"total": 3, "mean": 6, "total_up": 3, "n_hours": 6})
def cutoff_every_event(spark: SparkSession, folder: str) -> DataFrame:
    """Each user at the time of each of their events: as many cutoff times as events; states run on, spans meet by buckets."""
    es = stream(spark, folder)
    value, key = IdentityFeature(es, "events", "value"), IdentityFeature(es, "events", "event_id")
    fs = feats(es, "events", "users", {"n": ("count", "event_id"), "total": ("sum", "value"), "hi": ("max", "value"), "mean": ("mean", "value"), "n_up": ("num_true", "up"),
                                       "n_hours": (A["time_since_first"](unit="hours"), "ts")})
    fs += [Agg([value], "users", "sum", where=IdentityFeature(es, "events", "up") == True).rename("total_up"),  # noqa: E712
           Agg([key], "users", "count", use_previous="2 days").rename("two_days")]
    cuts = es["events"].df.select(F.col("user_id").alias("instance_id"), F.col("ts").alias("time")).distinct()
    return calculate_feature_matrix(fs, es, cuts)


@query("""select o_orderkey, o_orderdate + interval 30 day "time", sum(o_totalprice) over (order by o_orderdate, o_orderkey rows unbounded preceding) running, lag(o_totalprice) over (order by o_orderdate, o_orderkey) before
  from orders""", {"running": 2})
def cutoff_whole_table_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows over a whole table at many cutoffs: a row's value does not change with them, so the table is passed once."""
    es = star(spark, folder)
    price = IdentityFeature(es, "orders", "o_totalprice")
    fs = [TransformFeature([price], "cum_sum").rename("running"), TransformFeature([IdentityFeature(es, "orders", "o_orderdate"), price], "numeric_lag").rename("before")]
    cuts = es["orders"].df.select(F.col("o_orderkey").alias("instance_id"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("time"))
    return calculate_feature_matrix(fs, es, cuts)


@query(f"""select id c_custkey, count(o_orderkey) n, coalesce(sum(o_totalprice), 0) total, r "__row" from (select unnest([7, 3, 900001, 5, 12]) id, unnest([0, 1, 2, 3, 4]) r)
  left join orders on o_custkey = id and o_orderdate <= {AT} group by 1, 4""", {"total": 2})
def cutoff_instances_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Named instances, one of them unknown, with their place in the list."""
    es = star(spark, folder)
    fs = feats(es, "orders", "customer", {"n": ("count", "o_orderkey"), "total": ("sum", "o_totalprice")})
    return calculate_feature_matrix(fs, es, CUTOFF, [7, 3, 900001, 5, 12], keep_order=True)


# planning
@query("""with o as (select o_custkey, count(*) n, max(o_totalprice) hi, count_if(o_orderstatus = 'F') nf, max(case when o_orderstatus = 'F' then o_totalprice end) hif, count_if(o_orderstatus = 'O') no,
   max(case when o_orderstatus = 'O' then o_totalprice end) hio from orders group by 1)
 select c_custkey, c_name, c_acctbal, c_nationkey, c_mktsegment, coalesce(n, 0) "COUNT(orders)", hi "MAX(orders.o_totalprice)", coalesce(nf, 0) "COUNT(orders WHERE o_orderstatus = F)", hif "MAX(orders.o_totalprice WHERE o_orderstatus = F)",
  coalesce(no, 0) "COUNT(orders WHERE o_orderstatus = O)", hio "MAX(orders.o_totalprice WHERE o_orderstatus = O)" from customer left join o on o_custkey = c_custkey""")
def dfs_where_interesting(spark: SparkSession, folder: str) -> DataFrame:
    """All that is planned with two order states as conditions; one grouping serves every condition."""
    es = star(spark, folder)
    es.add_interesting_values(dataframe_name="orders", values={"o_orderstatus": ["F", "O"]})
    return dfs(entityset=es, target_dataframe_name="customer", agg_primitives=["count", "max"], where_primitives=["count", "max"], trans_primitives=[],
               ignore_dataframes=["region", "nation", "lineitem", "part"])[0]


@query("""select o_orderkey, o_custkey, o_totalprice, o_orderstatus, big, urgent, round(sum(o_totalprice) over (partition by o_orderstatus order by o_orderdate, o_orderkey rows unbounded preceding), 2) "CUM_SUM(o_totalprice) by o_orderstatus", o_orderpriority,
  coalesce(x, 0) "SUM(lineitem.l_quantity)", hi "MAX(lineitem.l_extendedprice)", ht "MAX(lineitem.l_tax)" from (select *, o_totalprice > 250000 big, case when o_orderpriority <> '3-MEDIUM' then o_orderpriority in ('1-URGENT', '2-HIGH') end urgent from orders)
  left join (select l_orderkey, sum(l_quantity) x, max(l_extendedprice) hi, max(l_tax) ht from (select distinct on (l_orderkey, l_partkey, l_suppkey, l_linenumber) * from lineitem) group by 1) on l_orderkey = o_orderkey""")
def dfs_options(spark: SparkSession, folder: str) -> DataFrame:
    """Planned with options: columns listed for one primitive, ignored for another, and columns to group by."""
    es = star(spark, folder)
    options = {
        "sum": {"include_columns": {"lineitem": ["l_quantity"]}}, "max": {"ignore_columns": {"lineitem": ["l_quantity", "l_discount", "l_linenumber", "l_suppkey"]}, "ignore_dataframes": ["orders"]},
        "cum_sum": {"include_groupby_columns": {"orders": ["o_orderstatus"]}, "include_columns": {"orders": ["o_totalprice"]}},
    }
    out, _ = dfs(entityset=es, target_dataframe_name="orders", agg_primitives=["sum", "max"], trans_primitives=[], groupby_trans_primitives=["cum_sum"], primitive_options=options, max_depth=1,
                 ignore_dataframes=["customer", "nation", "region", "part"])
    return out.withColumn("CUM_SUM(o_totalprice) by o_orderstatus", F.round(F.col("`CUM_SUM(o_totalprice) by o_orderstatus`"), 2))


@query(f"""with {ITEMS} select o_orderkey, count(l_id) n, coalesce(count_if(bulk), 0) n_bulk, coalesce(count_if(known), 0) in_set, coalesce(sum(case when l_returnflag = 'R' then l_quantity end), 0) returned
  from orders left join (select *, l_returnflag in ('A', 'R') known from li) on l_orderkey = o_orderkey group by 1""", {"returned": 2})
def features_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions with a set, a condition and a flag, written as text and read again, give the values."""
    es = star(spark, folder)
    flag = IdentityFeature(es, "lineitem", "l_returnflag")
    fs = [*feats(es, "lineitem", "orders", {"n": ("count", "l_id"), "n_bulk": ("num_true", "bulk")}),
          Agg([TransformFeature([flag], T["isin"](list_of_outputs={"A", "R"}))], "orders", "num_true").rename("in_set"),
          Agg([IdentityFeature(es, "lineitem", "l_quantity")], "orders", "sum", where=flag == "R").rename("returned")]
    return calculate_feature_matrix(load_features(save_features(fs), es), es)


@query("""select o_orderkey, o_totalprice + o_custkey "o_totalprice + o_custkey", year(o_orderdate)::int "YEAR(o_orderdate)", month(o_orderdate)::int "MONTH(o_orderdate)" from orders""")
def discovery_by_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Features enumerated from names and types alone, stored as text, then bound to a table."""
    es = star(spark, folder)
    cols = schema_to_features({c: es["orders"].schemas[c] for c in ("o_totalprice", "o_custkey", "o_orderdate")})
    cols[1] = schema_to_features({"o_custkey": "Integer"})[0]
    made = FeatureCollection.from_json(FeatureCollection(generate_features_from_primitives(cols, ["add_numeric", "year", "month"])).to_json())
    return calculate_feature_matrix([f for f in made.to_features(es, "orders") if f.primitive is not None], es)


# tables
@query("select n_nationkey, n_name, coalesce(n, 0) customers, total from nation left join (select c_nationkey, count(*) n, max(c_acctbal) total from customer where c_acctbal > 0 group by 1) on c_nationkey = n_nationkey")
def es_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Tables replaced, copied, written as Parquet, read again."""
    es = star(spark, folder)
    es = copy.deepcopy(es.replace_dataframe("customer", es["customer"].df.where("c_acctbal > 0")))
    for name in ("orders", "lineitem", "part", "region"):
        del es.tables[name]
    es.relationships = [r for r in es.relationships if r.parent in es.tables and r.child in es.tables]
    path = _folder(spark, "es")
    es.to_parquet(path)
    again = read_entityset(spark, path)
    fs = [IdentityFeature(again, "nation", "n_name"), *feats(again, "customer", "nation", {"customers": ("count", "c_custkey"), "total": ("max", "c_acctbal")})]
    return calculate_feature_matrix(fs, again)


@query("select unnest(range((select count(*) from part)))::bigint as key")
def es_make_index(spark: SparkSession, folder: str) -> DataFrame:
    """A made index numbers the rows without gaps."""
    part = spark.read.parquet(f"{folder}/part.parquet").repartition(5)
    return EntitySet("i").add_dataframe(part, "part", "key", make_index=True)["part"].df.select("key")


@query("""select 'o_orderpriority' col, o_orderpriority as value from (select o_orderpriority, row_number() over (order by count(*) desc, o_orderpriority) r from orders group by 1) where r <= 3
  union all select 'o_orderstatus', o_orderstatus from (select o_orderstatus, row_number() over (order by count(*) desc, o_orderstatus) r from orders group by 1) where r <= 3""")
def es_interesting_values(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    es.add_interesting_values(3, "orders")
    rows = [(c, v) for c, vs in es["orders"].interesting.items() for v in vs]  # three per column
    return spark.createDataFrame(rows, "col string, value string")


# primitives that the other queries do not hold
@query("""with a as (select o_orderkey, l_quantity q, l_returnflag f, l_shipdate, l_partkey, l_suppkey, l_linenumber from orders join (select distinct on (l_orderkey, l_partkey, l_suppkey, l_linenumber) * from lineitem) on l_orderkey = o_orderkey),
 b as (select *, lag(q) over (partition by o_orderkey order by l_shipdate, o_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber) p from a)
 select o.o_orderkey, coalesce(no_dup, true) no_dup, coalesce(no_dup, false) is_unique, coalesce(inc, false) inc, coalesce(dec, false) dec from orders o left join
 (select o_orderkey, count(*) = count(distinct f) no_dup, bool_and(q >= coalesce(p, q)) inc, bool_and(q <= coalesce(p, q)) dec from b group by 1) x using (o_orderkey)""")
def agg_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinctness and order of an order's items: true for some orders, false for others."""
    es = star(spark, folder)
    spec = {"no_dup": ("has_no_duplicates", "l_returnflag"), "is_unique": ("is_unique", "l_returnflag"), "inc": ("is_monotonically_increasing", "l_quantity"), "dec": ("is_monotonically_decreasing", "l_quantity")}
    return calculate_feature_matrix(feats(es, "lineitem", "orders", spec), es)


@query(f"""select customer_id, floor((epoch_us({AT.replace('1998', '2025')}) - epoch_us(birthday)) / 86400000000) / 365 age, case when join_date is not null then 'UTC' end zone, case when join_date is not null then 'Europe/Paris' end paris
  from (select distinct on (customer_id) * from (select customer_id, max(birthday) birthday, max(join_date) join_date from customers where customer_id is not null group by 1))""", {"age": 9})
def scalar_people(spark: SparkSession, folder: str) -> DataFrame:
    """Age at the cutoff, and the zone of timestamps with and without one."""
    rows = spark.read.parquet(f"{folder}/customers.parquet").where("customer_id is not null").groupBy("customer_id").agg(F.max("birthday").alias("birthday"), F.max("join_date").alias("joined"))
    rows = rows.withColumn("zoned", F.col("joined").cast("timestamp"))
    es = EntitySet("people").add_dataframe(rows, "people", "customer_id", semantic_tags={"birthday": "date_of_birth"})
    spec = {"age": ("age", "birthday"), "zone": (T["date_to_time_zone"](zone="UTC"), "zoned"), "paris": (T["date_to_time_zone"](zone="Europe/Paris"), "joined")}
    return calculate_feature_matrix(trans(es, "people", spec), es, cutoff_time=CUTOFF.replace("1998", "2025"))


@query(f"""select event_id, epoch_us(ts) - epoch_us(lag(ts) over {W}) gap, epoch_us(lag(ts, 2) over {W}) - epoch_us(lag(ts, 3) over {W}) earlier from events""")
def win_time_differences(spark: SparkSession, folder: str) -> DataFrame:
    es = stream(spark, folder)
    out = calculate_feature_matrix(trans(es, "events", {"gap": ("diff_datetime", "ts"), "earlier": (T["diff_datetime"](periods=2), "ts")}, "user_id"), es)
    us = lambda c: F.expr(f"cast(extract(day from {c}) * 86400000000L + extract(hour from {c}) * 3600000000L + extract(minute from {c}) * 60000000L + extract(second from {c}) * 1000000 as bigint)")
    return out.withColumns({c: us(c) for c in ("gap", "earlier")})


def _weights(beta: float) -> str:
    """Weighted sums up to each event as pairs of events of a user: an oracle apart from any recursion."""
    return f"""select b.event_id, count(*) n, sum(pow({beta}, b.r - a.r)) w, sum(pow({beta}, 2 * (b.r - a.r))) w2, sum(pow({beta}, b.r - a.r) * a.value) wx from e a join e b on a.user_id = b.user_id and a.r <= b.r group by 1"""


def _spread(beta: float) -> str:
    return f"""select b.event_id, case when any_value(s.n) > 1 then any_value(s.w * s.w) / nullif(any_value(s.w * s.w - s.w2), 0) * sum(pow({beta}, b.r - a.r) * pow(a.value - s.wx / s.w, 2)) / any_value(s.w) end v
      from e a join e b on a.user_id = b.user_id and a.r <= b.r join ({_weights(beta)}) s on s.event_id = b.event_id group by 1"""


@query(f"""with e as (select *, row_number() over {W} r from events) select event_id, m.wx / m.w ew_mean, sqrt(s.v) ew_std, v.v ew_var from e join ({_weights(1 / 3)}) m using (event_id)
  join ({_spread(0.5)}) s using (event_id) join ({_spread(0.6)}) v using (event_id)""", {"ew_mean": 6, "ew_std": 6, "ew_var": 6})
def win_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Exponentially weighted mean and spread; the SQL sums over pairs of events."""
    es = stream(spark, folder)
    spec = {"ew_mean": (T["exponential_weighted_average"](com=0.5), "value"), "ew_std": (T["exponential_weighted_std"](span=3), "value"), "ew_var": (T["exponential_weighted_variance"](alpha=0.4), "value")}
    return calculate_feature_matrix(trans(es, "events", spec, "user_id"), es)


def _at(k: int) -> str:
    return f"(case when {k} >= 0 then lead(value, {abs(k)}) over {W} else lag(value, {abs(k)}) over {W} end)"


def _fit(places, weights) -> str:
    return "(" + " + ".join(f"{w} * {_at(k)}" for k, w in zip(places, weights)) + ") / 35.0"


@query(f"""with e as (select *, row_number() over {W} r, count(*) over (partition by user_id) n from events)
 select event_id, case when n < 20 then value when r = 1 then {_fit((0, 1, 2, 3, 4), (31, 9, -3, -5, 3))} when r = 2 then {_fit((-1, 0, 1, 2, 3), (9, 13, 12, 6, -5))} when r = n then {_fit((0, -1, -2, -3, -4), (31, 9, -3, -5, 3))}
  when r = n - 1 then {_fit((1, 0, -1, -2, -3), (9, 13, 12, 6, -5))} else {_fit((-2, -1, 0, 1, 2), (-3, 12, 17, 12, -3))} end smooth from e""", {"smooth": 5})
def win_smoothed(spark: SparkSession, folder: str) -> DataFrame:
    """Savitzky-Golay over five values by a parabola; the SQL has the weights written out."""
    es = stream(spark, folder)
    return calculate_feature_matrix(trans(es, "events", {"smooth": (T["savgol_filter"](window_length=5, polyorder=2), "value")}, "user_id"), es)


# streams
@query("""select user_id, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') window_start, count(*) n, sum(value) total, max(value) hi from events where user_id is not null group by 1, 2""", {"total": 4})
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windowed features of a stream of files, read to its end and written through a sink with a checkpoint."""
    source = spark.read.parquet(f"{folder}/events.parquet")
    path = _folder(spark, "stream")
    source.write.parquet(f"{path}/in")
    events = spark.readStream.schema(source.schema).parquet(f"{path}/in")
    spec = {"n": ("count",), "total": ("sum", "value"), "hi": ("max", "value")}
    out = windowed_features(events, "user_id", "ts", spec, window="6 hours")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run = out.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(once=True).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{path}/out")
    last = last.where(F.col("batch") == last.agg(F.max("batch")).first()[0])
    return last.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), *spec)
