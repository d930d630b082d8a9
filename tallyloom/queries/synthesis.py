"""Queries of the feature engine over the star-schema tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.entityset import EntitySet
from tallyloom.features import AggregationFeature as Agg
from tallyloom.features import DirectFeature, Feature, GroupByTransformFeature, IdentityFeature, TransformFeature
from tallyloom.functions.base import AGGREGATIONS, TRANSFORMS
from tallyloom.functions.wordlists import common_words
from tallyloom.operators import postprocess as post
from tallyloom.plans.executor import calculate_feature_matrix
from tallyloom.plans.planner import dfs

A, T = AGGREGATIONS, TRANSFORMS
QUERIES: dict = {}
SQL: dict[str, str] = {}
CUTOFF = "1998-06-01"
AT = f"timestamp '{CUTOFF}'"


def query(sql: str | None = None, rounds: dict[str, int] | None = None):
    """Register a query with its SQL; ``rounds`` cuts floating columns to digits that do not depend on the order of sums."""

    def put(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(spark, folder)
            return out.withColumns({c: F.round(c, n) for c, n in (rounds or {}).items()})

        QUERIES[fn.__name__] = run
        if sql:
            cut = ", ".join(f"round({c}, {n}) as {c}" for c, n in (rounds or {}).items())
            SQL[fn.__name__] = f"select * replace ({cut}) from ({sql})" if cut else sql
        return fn

    return put


def star(spark: SparkSession, folder: str) -> EntitySet:
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    es = EntitySet("star")
    es.add_dataframe(read("region"), "region", "r_regionkey")
    es.add_dataframe(read("nation"), "nation", "n_nationkey")
    es.add_dataframe(read("customer"), "customer", "c_custkey")
    urgent = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))  # null for some
    es.add_dataframe(read("orders").withColumns({"big": F.col("o_totalprice") > 250000, "urgent": urgent}), "orders", "o_orderkey", "o_orderdate")
    es.add_dataframe(read("part"), "part", "p_partkey")
    items = read("lineitem").select(
        "*", (F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("l_id"),
        (F.col("l_quantity") > 25).alias("bulk"),
    )
    es.add_dataframe(items.dropDuplicates(["l_id"]), "lineitem", "l_id", "l_shipdate")
    es.add_relationships([
        ("region", "r_regionkey", "nation", "n_regionkey"), ("nation", "n_nationkey", "customer", "c_nationkey"),
        ("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("part", "p_partkey", "lineitem", "l_partkey"),
    ])
    return es


def stream(spark: SparkSession, folder: str) -> EntitySet:
    es = EntitySet("stream")
    read = spark.read.parquet(f"{folder}/events.parquet")
    centred = read.withColumn("swing", F.round(F.col("value") - 20, 2)).withColumn("up", F.col("value") > 20)
    es.add_dataframe(centred.select("user_id").distinct(), "users", "user_id")
    es.add_dataframe(centred, "events", "event_id", "ts")
    return es.add_relationship("users", "user_id", "events", "user_id")


def feats(es: EntitySet, child: str, target: str, spec: dict[str, tuple]) -> list[Feature]:
    """name -> (primitive, column, ...) as aggregations of child rows for target."""
    out = []
    for name, (prim, *cols) in spec.items():
        out.append(Agg([IdentityFeature(es, child, c) for c in cols], target, prim).rename(name))
    return out


def trans(es: EntitySet, table: str, spec: dict[str, tuple], by: str | None = None) -> list[Feature]:
    out = []
    for name, (prim, *cols) in spec.items():
        bases = [IdentityFeature(es, table, c) for c in cols]
        f = GroupByTransformFeature(bases, prim, IdentityFeature(es, table, by)) if by else TransformFeature(bases, prim)
        out.append(f.rename(name))
    return out


ITEMS = """li as (select distinct on (l_id) * from (select *, l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber l_id,
  l_quantity > 25 bulk from lineitem))"""


# aggregation primitives
@query("""select c_custkey, count(o_orderkey) n, coalesce(sum(o_totalprice), 0) total, avg(o_totalprice) mean, min(o_totalprice) lo, max(o_totalprice) hi,
  coalesce(max(o_totalprice) - min(o_totalprice), 0) span, stddev_samp(o_totalprice) sd, var_samp(o_totalprice) var, median(o_totalprice) med,
  case when count(o_totalprice) >= 3 then skewness(o_totalprice) end skew,
  coalesce(case when count(o_totalprice) > 1 then kurtosis_pop(o_totalprice) end, 0) kurt
  from customer left join orders on o_custkey = c_custkey group by 1""", {"total": 2, "mean": 4, "span": 2, "sd": 3, "var": 1, "med": 3, "skew": 6, "kurt": 6})
def agg_plain(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    c = "o_totalprice"
    spec = {"total": ("sum", c), "mean": ("mean", c), "lo": ("min", c), "hi": ("max", c), "span": ("max_min_delta", c), "sd": ("std", c), "var": ("variance", c),
            "med": ("median", c), "skew": ("skew", c), "kurt": ("kurtosis", c), "n": ("count", "o_orderkey")}
    return calculate_feature_matrix(feats(es, "orders", "customer", spec), es)


@query(f"""with {ITEMS}, o as (select l_orderkey, bool_and(bulk) a, bool_or(bulk) b, count_if(bulk) n, avg(bulk::int) p, max(l_quantity) mx, min(l_quantity) mn,
  median(l_quantity) md, avg(l_quantity) m, stddev_pop(l_quantity) s from li group by 1),
 x as (select l_orderkey, count_if(l_quantity > 10) gt, count_if(l_quantity < 10) lt, count_if(l_quantity between 5 and 30) inside, count_if(l_quantity < 5 or l_quantity > 30) outside,
  count_if(l_quantity > m) above, count_if(l_quantity < m) below, count_if(abs(l_quantity - m) <= s * (1 + 1e-9)) near, count_if(abs(l_quantity - m) > s * (1 + 1e-9)) far,
  count_if(l_quantity = mx) n_max, count_if(l_quantity = mn) n_min, count_if(l_quantity = md) n_med from li join o using (l_orderkey) group by 1)
 select o_orderkey, a all_bulk, b any_bulk, coalesce(n, 0) n_bulk, coalesce(p, 0) p_bulk, coalesce(gt, 0) gt, coalesce(lt, 0) lt, coalesce(inside, 0) inside, coalesce(outside, 0) outside,
  above, below, coalesce(near, 0) near, coalesce(far, 0) far, n_max, n_min, coalesce(n_med, 0) n_med
 from orders left join o on o_orderkey = o.l_orderkey left join x on o_orderkey = x.l_orderkey""", {"p_bulk": 6})
def agg_booleans_and_counts(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    c = "l_quantity"
    spec = {"all_bulk": ("all", "bulk"), "any_bulk": ("any", "bulk"), "n_bulk": ("num_true", "bulk"), "p_bulk": ("percent_true", "bulk"),
            "gt": ("count_greater_than", c), "lt": ("count_less_than", c), "inside": (A["count_inside_range"](lower=5, upper=30), c), "outside": (A["count_outside_range"](lower=5, upper=30), c),
            "above": ("count_above_mean", c), "below": ("count_below_mean", c), "near": ("count_inside_nth_std", c), "far": ("count_outside_nth_std", c),
            "n_max": ("max_count", c), "n_min": ("min_count", c), "n_med": ("median_count", c)}
    return calculate_feature_matrix(feats(es, "lineitem", "orders", spec), es)


@query("""with h as (select user_id, event_type v, count(*) c, min(ts) seen from events group by 1, 2),
 r as (select *, row_number() over (partition by user_id order by c desc, seen) rk, row_number() over (partition by user_id order by c desc, v) mk, sum(c) over (partition by user_id) tot from h)
 select user_id, count(*) n_unique, count(*) / any_value(tot) p_unique, any_value(tot) / count(*) per_unique, any_value(tot) = count(*) no_dup, any_value(tot) = count(*) is_unique,
  max(case when mk = 1 then v end) mode, -sum(c / tot * ln(c / tot)) entropy, max(case when rk = 1 then v end) top0, max(case when rk = 2 then v end) top1,
  cast(max(case when rk = 1 then c end) as bigint) freq0, cast(max(case when rk = 2 then c end) as bigint) freq1 from r group by 1""", {"p_unique": 8, "per_unique": 6, "entropy": 8})
def agg_distinct(spark: SparkSession, folder: str) -> DataFrame:
    es = stream(spark, folder)
    c = "event_type"
    spec = {"n_unique": ("num_unique", c), "p_unique": ("percent_unique", c), "per_unique": ("average_count_per_unique", c), "no_dup": ("has_no_duplicates", c),
            "is_unique": ("is_unique", c), "mode": ("mode", c), "entropy": ("entropy", c)}
    fs = feats(es, "events", "users", spec)
    top = Agg([IdentityFeature(es, "events", c)], "users", A["n_most_common"](n=2))
    freq = Agg([IdentityFeature(es, "events", c)], "users", A["n_most_common_frequency"](n=2))
    fs += [top[0].rename("top0"), top[1].rename("top1"), freq[0].rename("freq0"), freq[1].rename("freq1")]
    return calculate_feature_matrix(fs, es)


@query("""with s as (select *, row_number() over (partition by user_id order by ts, event_id) rn from events),
 t as (select user_id, count(distinct date_trunc('day', ts)) d, count(distinct strftime(ts, '%m%d')) dy, count(distinct day(ts)) dm, count(distinct date_trunc('month', ts)) mo,
  count(distinct date_trunc('week', ts)) wk, min(ts) first_at, epoch_us(max(ts)) - epoch_us(min(ts)) span, count(*) n, arg_min(value, rn) first_v, arg_max(value, rn) last_v,
  epoch_us(timestamp '2024-06-01') - epoch_us(min(ts)) sf, epoch_us(timestamp '2024-06-01') - epoch_us(max(ts)) sl,
  epoch_us(timestamp '2024-06-01') - epoch_us(max(case when value > 20 then ts end)) st, epoch_us(timestamp '2024-06-01') - epoch_us(max(case when value <= 20 then ts end)) sfa,
  epoch_us(timestamp '2024-06-01') - epoch_us(arg_max(ts, {v: value, r: -rn})) smx, epoch_us(timestamp '2024-06-01') - epoch_us(arg_min(ts, {v: value, r: rn})) smn,
  regr_slope(value, epoch_us(ts) / 1e6) slope from s where ts <= timestamp '2024-06-01' group by 1)
 select u.user_id, coalesce(d, 0) n_days, coalesce(dy, 0) days_of_year, coalesce(dm, 0) days_of_month, coalesce(mo, 0) n_months, coalesce(wk, 0) n_weeks, first_at, coalesce(span / 1e6, 0) span,
  case when n > 1 then span / 1e6 / 3600 / (n - 1) end avg_gap, first_v, last_v, sf / 1e6 / 86400 since_first, sl / 1e6 since_last, coalesce(st / 1e6, 0) since_true, coalesce(sfa / 1e6, 0) since_false,
  coalesce(smx / 1e6, 0) since_max, coalesce(smn / 1e6, 0) since_min,
  case when n > 2 then slope * case when epoch_us(first_at) % 86400000000 = 0 then 86400 when epoch_us(first_at) % 3600000000 = 0 then 3600 when epoch_us(first_at) % 60000000 = 0 then 60 else 1 end end trend
 from (select distinct user_id from events) u left join t using (user_id)""", {"span": 6, "avg_gap": 6, "since_first": 6, "since_last": 6, "since_true": 6, "since_false": 6, "since_max": 6, "since_min": 6, "trend": 9})
def agg_times(spark: SparkSession, folder: str) -> DataFrame:
    es = stream(spark, folder)
    t = "ts"
    spec = {"n_days": ("n_unique_days", t), "days_of_year": ("n_unique_days_of_calendar_year", t), "days_of_month": ("n_unique_days_of_month", t), "n_months": ("n_unique_months", t),
            "n_weeks": ("n_unique_weeks", t), "first_at": ("date_first_event", t), "span": ("first_last_time_delta", t), "avg_gap": (A["avg_time_between"](unit="hours"), t),
            "first_v": ("first", "value"), "last_v": ("last", "value"), "since_first": (A["time_since_first"](unit="days"), t), "since_last": ("time_since_last", t),
            "since_true": ("time_since_last_true", t, "up"), "since_false": ("time_since_last_false", t, "up"), "since_max": ("time_since_last_max", t, "value"),
            "since_min": ("time_since_last_min", t, "value"), "trend": ("trend", "value", t)}
    return calculate_feature_matrix(feats(es, "events", "users", spec), es, cutoff_time="2024-06-01")


def _runs(flag: str) -> str:
    return f"""select user_id, max(len) m from (select user_id, count(*) len from (select *, row_number() over (partition by user_id order by ts, event_id)
      - row_number() over (partition by user_id, {flag} order by ts, event_id) isl from e) where {flag} group by user_id, isl) group by 1"""


@query(f"""with e0 as (select *, round(value - 20, 2) swing, value > 20 up from events),
 e as (select *, avg(swing) over (partition by user_id) m, lag(swing) over (partition by user_id order by ts, event_id) pv, row_number() over (partition by user_id order by ts, event_id) rn from e0),
 ch as (select *, lag(swing) over w prv, lead(swing) over w nxt from (select * from e where pv is null or pv <> swing) window w as (partition by user_id order by ts, event_id)),
 z as (select user_id, count_if(sign(swing) <> ps) n from (select *, lag(sign(swing)) over (partition by user_id order by ts, event_id) ps from e where swing <> 0) group by 1),
 q as (select user_id, max(case when up then rn end) lt, max(case when not up then rn end) lf from e group by 1),
 k as (select e.user_id, count_if(rn > lt and not up) f, count_if(rn > lf and up) t, any_value(lt) lt, any_value(lf) lf, bool_and(swing >= coalesce(pv, swing)) inc, bool_and(swing <= coalesce(pv, swing)) dec from e join q using (user_id) group by 1)
 select k.user_id, coalesce(a.m, 0) run_true, coalesce(b.m, 0) run_false, coalesce(c.m, 0) run_neg, coalesce(d.m, 0) run_pos, coalesce(g.m, 0) run_zero, coalesce(h.m, 0) run_above, coalesce(i.m, 0) run_below,
  inc, dec, coalesce(z.n, 0) crossings, coalesce(pk.n, 0) peaks, coalesce(case when lt is not null then f end, 0) false_since, coalesce(case when lf is not null then t end, 0) true_since
 from k left join ({_runs('up')}) a using (user_id) left join ({_runs('(not up)')}) b using (user_id) left join ({_runs('(swing < 0)')}) c using (user_id) left join ({_runs('(swing > 0)')}) d using (user_id)
 left join ({_runs('(swing = 0)')}) g using (user_id) left join ({_runs('(swing > m)')}) h using (user_id) left join ({_runs('(swing < m)')}) i using (user_id) left join z using (user_id)
 left join (select user_id, count_if(swing > prv and swing > nxt) n from ch group by 1) pk using (user_id)""")
def agg_sequences(spark: SparkSession, folder: str) -> DataFrame:
    es = stream(spark, folder)
    c = "swing"
    spec = {"run_true": ("max_consecutive_true", "up"), "run_false": ("max_consecutive_false", "up"), "run_neg": ("max_consecutive_negatives", c), "run_pos": ("max_consecutive_positives", c),
            "run_zero": ("max_consecutive_zeros", c), "run_above": ("num_consecutive_greater_mean", c), "run_below": ("num_consecutive_less_mean", c), "inc": ("is_monotonically_increasing", c),
            "dec": ("is_monotonically_decreasing", c), "crossings": ("num_zero_crossings", c), "peaks": ("num_peaks", c), "false_since": ("num_false_since_last_true", "up"),
            "true_since": ("num_true_since_last_false", "up")}
    return calculate_feature_matrix(feats(es, "events", "users", spec), es)


# window transforms, per user
W = "(partition by user_id order by ts, event_id)"


def _w(frame: str) -> str:
    return f"(partition by user_id order by ts, event_id rows between {frame})"


@query(f"""select event_id, row_number() over {W} cum_count, sum(value) over {_w('unbounded preceding and current row')} cum_sum, max(value) over {_w('unbounded preceding and current row')} cum_max,
  min(value) over {_w('unbounded preceding and current row')} cum_min, avg(value) over {_w('unbounded preceding and current row')} cum_mean,
  (epoch_us(ts) - max(case when value > 20 then epoch_us(ts) end) over {_w('unbounded preceding and current row')}) / 1e6 since_true,
  (epoch_us(ts) - max(case when value <= 20 then epoch_us(ts) end) over {_w('unbounded preceding and current row')}) / 1e6 since_false from events""", {"cum_sum": 4, "cum_mean": 9, "since_true": 6, "since_false": 6})
def win_cumulative(spark: SparkSession, folder: str) -> DataFrame:
    es = stream(spark, folder)
    spec = {"cum_count": ("cum_count", "event_type"), "cum_sum": ("cum_sum", "value"), "cum_max": ("cum_max", "value"), "cum_min": ("cum_min", "value"), "cum_mean": ("cum_mean", "value"),
            "since_true": ("cumulative_time_since_last_true", "ts", "up"), "since_false": ("cumulative_time_since_last_false", "ts", "up")}
    return calculate_feature_matrix(trans(es, "events", spec, "user_id"), es)


@query(f"""select event_id, lag(event_type, 2) over {W} lagged, lag(value) over {W} num_lag, value - lag(value) over {W} diff0,
  lag(value) over {W} - lag(value, 2) over {W} diff1, (epoch_us(ts) - epoch_us(lag(ts) over {W})) / 1e6 / 60 gap,
  (value - lag(value) over {W}) / nullif((epoch_us(ts) - epoch_us(lag(ts) over {W})) / 1e6, 0) rate, coalesce(value = lag(value) over {W}, false) same,
  abs(value - lag(value) over {W}) abs_diff, value / nullif(lag(value) over {W}, 0) - 1 pct,
  (rank() over (partition by user_id order by value) + (count(*) over (partition by user_id, value) - 1) / 2) / count(value) over (partition by user_id) percentile from events""", {"diff0": 4, "diff1": 4, "gap": 6, "rate": 8, "abs_diff": 4, "pct": 6, "percentile": 8})
def win_lag(spark: SparkSession, folder: str) -> DataFrame:
    es = stream(spark, folder)
    spec = {"lagged": (T["lag"](periods=2), "event_type", "ts"), "num_lag": ("numeric_lag", "ts", "value"), "diff0": ("diff", "value"), "diff1": (T["diff"](periods=1), "value"),
            "gap": (T["time_since_previous"](unit="minutes"), "ts"), "rate": ("rate_of_change", "value", "ts"), "same": ("same_as_previous", "value"), "abs_diff": ("absolute_diff", "value"),
            "pct": ("percent_change", "value"), "percentile": ("percentile", "value")}
    return calculate_feature_matrix(trans(es, "events", spec, "user_id"), es)


def _at_least(n: int, agg: str, frame: str) -> str:
    return f"case when count(value) over {_w(frame)} >= {n} then {agg} over {_w(frame)} end"


R3, RNG = "4 preceding and 2 preceding", "(partition by user_id order by ts range between interval '1 day' preceding and interval '1 hour' preceding)"


@query(f"""with q as (select *, array_agg(value) over {_w(R3)} a, quantile_cont(value, 0.25) over {_w(R3)} q1, quantile_cont(value, 0.75) over {_w(R3)} q3 from events)
 select event_id, {_at_least(1, 'max(value)', R3)} r_max, {_at_least(1, 'min(value)', R3)} r_min, {_at_least(2, 'avg(value)', R3)} r_mean, {_at_least(1, 'stddev_samp(value)', R3)} r_std,
  case when row_number() over {W} >= 3 then count(*) over {_w(R3)} end::double r_count, case when count(value) over {_w(R3)} > 2 then regr_slope(value, epoch_us(ts) / 1e6) over {_w(R3)} end r_trend,
  case when len(a) >= 1 then len(list_filter(a, lambda v: v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))) end::double r_out,
  max(value) over (partition by user_id order by epoch_us(ts) range between 89999999999 preceding and 3600000000 preceding) t_max,
  nullif(count(*) over (partition by user_id order by epoch_us(ts) range between 89999999999 preceding and 3600000000 preceding), 0)::double t_count from q""", {"r_mean": 9, "r_std": 6, "r_trend": 9})
def win_rolling(spark: SparkSession, folder: str) -> DataFrame:
    es = stream(spark, folder)
    k = {"window_length": 3, "gap": 2}
    r = lambda n, **kw: (T[n](**{**k, **kw}), "ts", "value")
    spec = {"r_max": r("rolling_max"), "r_min": r("rolling_min"), "r_mean": r("rolling_mean", min_periods=2), "r_std": r("rolling_std"), "r_count": (T["rolling_count"](**k), "ts"),
            "r_trend": r("rolling_trend"), "r_out": r("rolling_outlier_count"), "t_max": r("rolling_max", window_length="1d", gap="1h"),
            "t_count": (T["rolling_count"](window_length="1d", gap="1h"), "ts")}
    return calculate_feature_matrix(trans(es, "events", spec, "user_id"), es)


EX = "unbounded preceding and 1 preceding"


@query(f"""select event_id, nullif(count(ts) over {_w(EX)}, 0) e_count, max(value) over {_w(EX)} e_max, min(value) over {_w(EX)} e_min, avg(value) over {_w(EX)} e_mean, stddev_samp(value) over {_w(EX)} e_std,
  case when count(value) over {_w(EX)} > 2 then regr_slope(value, epoch_us(ts) / 1e6) over {_w(EX)} end e_trend from events""", {"e_mean": 9, "e_std": 6, "e_trend": 9})
def win_expanding(spark: SparkSession, folder: str) -> DataFrame:
    es = stream(spark, folder)
    spec = {"e_count": ("expanding_count", "ts"), **{f"e_{n}": (f"expanding_{n}", "ts", "value") for n in ("max", "min", "mean", "std", "trend")}}
    return calculate_feature_matrix(trans(es, "events", spec, "user_id"), es)


# row-wise transforms
@query("""select o_orderkey, o_totalprice + o_custkey p_add, o_totalprice - o_custkey p_sub, o_totalprice * o_custkey p_mul, o_totalprice / nullif(o_custkey - 5, 0) p_div_raw,
  o_totalprice - o_custkey * floor(o_totalprice / nullif(o_custkey, 0)) p_mod, o_totalprice + 2 s_add, o_totalprice - 2 s_sub, o_totalprice * 2 s_mul, o_totalprice / 2 s_div, 5 - o_totalprice r_sub,
  5 / nullif(o_totalprice, 0) r_div, o_totalprice - 7 * floor(o_totalprice / 7) s_mod, -o_totalprice neg, abs(o_totalprice) absolute, sin(o_totalprice) sine, cos(o_totalprice) cosine, tan(o_totalprice / 1000000) tangent, sqrt(o_totalprice) root,
  ln(o_totalprice) log, o_totalprice > o_custkey gt, o_totalprice >= o_custkey ge, o_totalprice < o_custkey lt, o_totalprice <= o_custkey le, o_totalprice > 100 s_gt, o_totalprice >= 100 s_ge,
  o_totalprice < 100 s_lt, o_totalprice <= 100 s_le, o_totalprice = o_custkey eq, o_totalprice <> o_custkey ne, o_orderstatus = 'F' s_eq, o_orderstatus <> 'F' s_ne, o_orderstatus in ('F', 'P') is_in,
  o_orderstatus is null is_null, big and urgent b_and, big or urgent b_or, not urgent b_not, big and urgent b_mul, o_totalprice * urgent::int nb_mul, 5 - o_totalprice * floor(5 / nullif(o_totalprice, 0)) r_mod
 from (select *, o_totalprice > 250000 big, case when o_orderpriority <> '3-MEDIUM' then o_orderpriority in ('1-URGENT', '2-HIGH') end urgent from orders)""", {"p_add": 3, "p_sub": 3, "p_mul": 2, "p_div_raw": 9, "p_mod": 3, "s_add": 3, "s_sub": 3, "s_mul": 3, "s_div": 4, "r_sub": 3, "r_div": 9, "s_mod": 3, "sine": 5, "cosine": 5, "tangent": 9, "root": 6, "log": 8})
def scalar_numbers(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    price, cust, status, big, urgent = (IdentityFeature(es, "orders", c) for c in ("o_totalprice", "o_custkey", "o_orderstatus", "big", "urgent"))
    one = lambda n: TransformFeature([price], n)
    fs = {"p_add": price + cust, "p_sub": price - cust, "p_mul": price * cust, "p_mod": price % cust, "s_add": price + 2, "s_sub": price - 2, "s_mul": price * 2, "s_div": price / 2, "r_sub": 5 - price,
          "r_div": 5 / price, "s_mod": price % 7, "neg": -price, "absolute": abs(price), "sine": one("sine"), "cosine": one("cosine"), "tangent": TransformFeature([price / 1000000], "tangent"), "root": one("square_root"), "log": one("natural_logarithm"),
          "gt": price > cust, "ge": price >= cust, "lt": price < cust, "le": price <= cust, "s_gt": price > 100, "s_ge": price >= 100, "s_lt": price < 100, "s_le": price <= 100, "eq": price == cust,
          "ne": price != cust, "s_eq": status == "F", "s_ne": status != "F", "is_in": status.isin(["F", "P"]), "is_null": status.is_null(), "b_and": big & urgent, "b_or": big | urgent, "b_not": ~urgent, "b_mul": big * urgent, "nb_mul": price * urgent, "r_mod": 5 % price}
    div = (price / (cust - 5)).rename("p_div")
    out = calculate_feature_matrix([*[f.rename(n) for n, f in fs.items()], div], es)
    # the quotient has infinities, which become nulls
    return post.replace_inf_values(out, columns=["p_div"]).withColumnRenamed("p_div", "p_div_raw")


def _nth(y: str, month: int, dow: int, n: int) -> str:
    first = f"make_date({y}, {month}, 1)"
    if n:
        return f"({first} + cast(((({dow} - isodow({first}) + 1) % 7 + 7) % 7) + {7 * (n - 1)} as integer))"
    last = f"last_day({first})"
    return f"({last} - cast((((isodow({last}) - 1 - {dow}) % 7 + 7) % 7) as integer))"


_HOL = [("New Year''s Day", "make_date(y, 1, 1)"), ("Martin Luther King Jr. Day", _nth("y", 1, 0, 3)), ("Washington''s Birthday", _nth("y", 2, 0, 3)), ("Memorial Day", _nth("y", 5, 0, 0)),
        ("Independence Day", "make_date(y, 7, 4)"), ("Labor Day", _nth("y", 9, 0, 1)), ("Columbus Day", _nth("y", 10, 0, 2)), ("Veterans Day", "make_date(y, 11, 11)"),
        ("Thanksgiving Day", _nth("y", 11, 3, 4)), ("Christmas Day", "make_date(y, 12, 25)")]
_FIX = {"New Year''s Day", "Independence Day", "Veterans Day", "Christmas Day"}
_HOL_SQL = f"""yy as (select unnest(range(1990, 2012)) y),
 h0 as ({' union all '.join(f"select {d} dt, '{n}' nm, 0 o from yy" for n, d in _HOL)}),
 h1 as (select * from h0 union all select case isodow(dt) when 6 then dt - 1 else dt + 1 end, nm || ' (observed)', 1 from h0 where nm in ({', '.join(f"'{n}'" for n in sorted(_FIX))}) and isodow(dt) in (6, 7)),
 h as (select dt, arg_min(nm, o) nm from h1 group by 1)"""


@query(f"""with {_HOL_SQL} select o_orderkey, day(t) d, dayofyear(t) doy, day(last_day(t)) dim, hour(t) h, minute(t) mi, month(t) mo, quarter(t) q, second(t) s, week(t) wk, isodow(t) - 1 wd, year(t) y,
  dayofyear(make_date(year(t), 12, 31)) = 366 leap, day(t) = 1 ms, t::date = last_day(t) me, t::date = date_trunc('quarter', t)::date qs, t::date = last_day(date_trunc('quarter', t) + interval 2 month) qe,
  dayofyear(t) = 1 ys, month(t) = 12 and day(t) = 31 ye, isodow(t) > 5 weekend, ceil((day(t) + dayofweek(date_trunc('month', t))) / 7) = 1 first_week, hour(t) = 12 lunch, hour(t) between 8 and 18 working,
  ceil((day(t) + dayofweek(date_trunc('month', t))) / 7)::double nth_week, (epoch_us(timestamp '2010-01-01') - epoch_us(t)) / 1e6 / 3600 since,
  case when hour(t) <= 3 then 'midnight' when hour(t) <= 5 then 'dawn' when hour(t) <= 7 then 'early morning' when hour(t) <= 10 then 'late morning' when hour(t) <= 13 then 'noon' when hour(t) <= 16 then 'afternoon'
    when hour(t) <= 19 then 'evening' when hour(t) <= 22 then 'night' else 'midnight' end part,
  case when month(t) * 100 + day(t) < 321 then 'winter' when month(t) * 100 + day(t) < 621 then 'spring' when month(t) * 100 + day(t) < 923 then 'summer' when month(t) * 100 + day(t) < 1221 then 'fall' else 'winter' end season,
  nm holiday, nm is not null is_holiday, (select arg_min(datediff('day', t::date, m.dt), {{a: abs(datediff('day', t::date, m.dt)), b: datediff('day', t::date, m.dt)}}) from h0 m where m.nm = 'Labor Day' and year(m.dt) between year(t) - 1 and year(t) + 1) to_labor
 from (select o_orderkey, o_orderdate + to_minutes((o_orderkey % 1440)::int) t from orders) left join h on h.dt = t::date""", {"since": 5})
def scalar_dates(spark: SparkSession, folder: str) -> DataFrame:
    es = EntitySet("dates")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    es.add_dataframe(orders.select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))).alias("t")), "orders", "o_orderkey")
    names = {"d": "day", "doy": "day_of_year", "dim": "days_in_month", "h": "hour", "mi": "minute", "mo": "month", "q": "quarter", "s": "second", "wk": "week", "wd": "weekday", "y": "year",
             "leap": "is_leap_year", "ms": "is_month_start", "me": "is_month_end", "qs": "is_quarter_start", "qe": "is_quarter_end", "ys": "is_year_start", "ye": "is_year_end", "weekend": "is_weekend",
             "first_week": "is_first_week_of_month", "lunch": "is_lunch_time", "working": "is_working_hours", "nth_week": "nth_week_of_month", "since": T["time_since"](unit="hours"), "part": "part_of_day",
             "season": "season", "holiday": "date_to_holiday", "is_holiday": "is_federal_holiday", "to_labor": T["distance_to_holiday"](holiday="Labor Day")}
    return calculate_feature_matrix(trans(es, "orders", {k: (v, "t") for k, v in names.items()}), es, cutoff_time="2010-01-01")


PUNCT = r"""[!-/:-@\[-`{-~]"""
_TOK = r"""list_filter(string_split_regex(text, '[ \n\t]'), lambda w: trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~') <> '')"""


@query(rf"""select doc_id, length(text)::bigint n_chars, len({_TOK})::bigint n_words, len(regexp_extract_all(text, '{PUNCT}'))::bigint punct, len(regexp_extract_all(text, '[A-Z]'))::bigint uppers,
  len(regexp_extract_all(text, ' '))::bigint blanks,
  (contains(text, ' ')::int + contains(text, '.')::int + contains(text, ',')::int + contains(text, '!')::int + contains(text, '?')::int + contains(text, ';')::int + contains(text, chr(10))::int)::bigint seps,
  len(regexp_extract_all(lower(text), 'claim'))::bigint n_claim from documents""")
def text_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of characters and words of every document."""
    spec = {"n_chars": "num_characters", "n_words": "num_words", "punct": "punctuation_count", "uppers": "upper_case_count", "blanks": "whitespace_count",
            "seps": "num_unique_separators", "n_claim": T["count_string"](string="claim")}
    es = _texts(spark, folder)
    return calculate_feature_matrix(trans(es, "documents", {k: (v, "text") for k, v in spec.items()}), es)


def _texts(spark: SparkSession, folder: str) -> EntitySet:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return EntitySet("texts").add_dataframe(docs, "documents", "doc_id", logical_types={"text": "NaturalLanguage"})


#: The SQL's own classes: its dialect has no look-ahead, so a text is cut at blanks and each piece looked at by itself.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_W, _NW, _WL = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_#]", r"[\p{L}\p{Nl}\p{No}_]"
_P = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""
#: Letters whose upper case is two letters; the SQL's upper() leaves them.
_SPECIAL = r"[\x{df}\x{149}\x{1f0}\x{390}\x{3b0}\x{587}\x{1e96}-\x{1e9a}\x{fb00}-\x{fb06}\x{fb13}-\x{fb17}]"
_NO_AT = r"""[!-/:-?\[-`{-~]"""


def _words_sql(known) -> str:
    return rf"""with p as (select doc_id, text, string_split_regex(text, '[ \n\t]') w, string_split_regex(text, '{_BLANK}') b,
   list_filter(string_split_regex(regexp_replace(text, '[!,.:;?]+(\z|[ \n])', ' ', 'g'), '{_BLANK}+'), lambda x: x <> '') m from documents)
 select doc_id, case when text is not null then coalesce(list_avg(list_transform(m, lambda x: length(x))), 0) end mean_length, list_aggregate(list_transform(list_filter(w, lambda x: x <> ''), lambda x: length(x)), 'median') median_length,
  len(list_filter(w, lambda x: list_contains([{', '.join(f"'{k}'" for k in sorted(known))}], trim(lower(x), '{_P}')))) common,
  len(list_filter(b, lambda x: regexp_matches(x, '^#{_W}*{_WL}{_W}*($|{_NW})'))) hashtags, len(list_filter(b, lambda x: regexp_matches(x, '^@{_W}+($|{_NO_AT})'))) mentions,
  len(list_distinct(list_filter(list_transform(b, lambda x: trim(x, '{_P}')), lambda x: x <> ''))) distinct_words,
  len(regexp_extract_all(text, '[A-Z][^{_BLANK[1:]}*')) title_words, length(text) - len(regexp_extract_all(text, '[!-/:-@\[\]^_`{{-~\n\t ]')) word_length,
  len(list_filter(w, lambda x: trim(x, '{_P}') <> '' and upper(x) = x and not regexp_matches(x, '{_SPECIAL}'))) upper_words from p"""


TITLES = {"mean_length": "mean_characters_per_word", "median_length": "median_word_length", "common": "number_of_common_words", "hashtags": "number_of_hashtags", "mentions": "number_of_mentions",
          "distinct_words": "number_of_unique_words", "title_words": "title_word_count", "word_length": "total_word_length", "upper_words": "upper_case_word_count"}


def _known_words():
    """The words that number_of_common_words counts by default; a few where the vocabularies are missing."""
    try:
        return common_words(), {}
    except FileNotFoundError:
        return {"the", "of", "and", "to", "in"}, {"word_set": frozenset({"the", "of", "and", "to", "in"})}


@query(_words_sql(_known_words()[0]), {"mean_length": 9})
def text_words(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of words of every document."""
    es = _texts(spark, folder)
    spec = {**TITLES, "common": T["number_of_common_words"](**_known_words()[1])}
    out = calculate_feature_matrix(trans(es, "documents", {k: (v, "text") for k, v in spec.items()}), es)
    return out.withColumns({c: F.col(c).cast("long") for c in TITLES if not c.endswith("_length") or c == "word_length"})


@query()
def text_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Words between quotation marks of every document; the SQL dialect has no look-ahead, so it is tested against Python."""
    es = _texts(spark, folder)
    return calculate_feature_matrix(trans(es, "documents", {"quoted": ("number_of_words_in_quotes", "text")}), es)


ADDR = """a as (select c_custkey k, 'Ms. ' || chr(65 + (c_custkey % 26)::int) || 'ana ' || chr(65 + (c_custkey % 7)::int) || 'orn' nm, ' user' || c_custkey || '@' || case c_custkey % 3 when 0 then 'gmail.com' else 'example.org' end mail,
  case c_custkey % 2 when 0 then 'https://www.shop' || c_custkey || '.example.co.uk/a?b' else 'no url' end url, '/tmp/f' || c_custkey || case c_custkey % 2 when 0 then '.CSV' else '' end file,
  lpad(c_custkey::varchar, 5, '0') zip, c_custkey % 90 la, c_custkey % 180 lo from customer)"""


@query(f"""with {ADDR} select k, split_part(trim(mail), '@', 2) domain, split_part(trim(mail), '@', 2) = 'gmail.com' free, case when k % 2 = 0 then 'shop' || k || '.example.co.uk' else 'no url' end host,
  case when k % 2 = 0 then 'https' end protocol, case when k % 2 = 0 then 'uk' end tld, case when k % 2 = 0 then '.csv' end ext, zip[1:1] zip1, zip[1:2] zip2, split_part(nm, ' ', 2) first_name, split_part(nm, ' ', 3) last_name, 'Ms' title,
  la::double lat, lo::double lon, la between 0 and 40 and lo between 0 and 60 boxed,
  2 * 3958.7613 * asin(sqrt(sin(radians(10 - la) / 2) ** 2 + cos(radians(la)) * cos(radians(10)) * sin(radians(20 - lo) / 2) ** 2)) far,
  2 * 6371.0088 * (asin(sqrt(cos(radians(la)) ** 2 * sin(radians(20 - lo) / 2) ** 2)) + asin(sqrt(sin(radians(10 - la) / 2) ** 2))) city, (la + 10) / 2 mid_lat, (lo + 20) / 2 mid_lon from a""", {"far": 5, "city": 5})
def scalar_addresses_and_places(spark: SparkSession, folder: str) -> DataFrame:
    c = spark.read.parquet(f"{folder}/customer.parquet")
    k = F.col("c_custkey")
    s = F.concat
    df = c.select(
        k.alias("k"), s(F.lit("Ms. "), F.char(65 + k % 26), F.lit("ana "), F.char(65 + k % 7), F.lit("orn")).alias("nm"),
        s(F.lit(" user"), k, F.lit("@"), F.when(k % 3 == 0, "gmail.com").otherwise("example.org")).alias("mail"),
        F.when(k % 2 == 0, s(F.lit("https://www.shop"), k, F.lit(".example.co.uk/a?b"))).otherwise("no url").alias("url"),
        s(F.lit("/tmp/f"), k, F.when(k % 2 == 0, ".CSV").otherwise("")).alias("file"), F.lpad(k.cast("string"), 5, "0").alias("zip"),
        F.struct((k % 90).cast("double").alias("lat"), (k % 180).cast("double").alias("lon")).alias("here"),
        F.struct(F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon")).alias("there"),
    )
    es = EntitySet("addresses").add_dataframe(df, "a", "k", logical_types={"nm": "PersonFullName", "mail": "EmailAddress", "url": "URL", "file": "Filepath", "zip": "PostalCode"})
    spec = {"domain": ("email_address_to_domain", "mail"), "free": ("is_free_email_domain", "mail"), "host": ("url_to_domain", "url"), "protocol": ("url_to_protocol", "url"), "tld": ("url_to_tld", "url"),
            "ext": ("file_extension", "file"), "zip1": ("one_digit_postal_code", "zip"), "zip2": ("two_digit_postal_code", "zip"), "first_name": ("full_name_to_first_name", "nm"), "last_name": ("full_name_to_last_name", "nm"),
            "title": ("full_name_to_title", "nm"), "lat": ("latitude", "here"), "lon": ("longitude", "here"), "boxed": (T["is_in_geobox"](point1=(0, 0), point2=(40, 60)), "here"), "far": ("haversine", "here", "there"),
            "city": (T["cityblock_distance"](unit="kilometers"), "here", "there"), "mid": ("geomidpoint", "here", "there")}
    out = calculate_feature_matrix(trans(es, "a", spec), es)
    return out.withColumn("mid_lat", F.col("mid.lat")).withColumn("mid_lon", F.col("mid.lon")).drop("mid")


# relationships
@query("""select c_custkey, n_name, r_name, coalesce(cn, 0) n_customers, nb mean_balance from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey
  left join (select c_nationkey k, count(*) cn, avg(c_acctbal) nb from customer group by 1) x on k = c_nationkey""", {"mean_balance": 4})
def rel_direct(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    nation = IdentityFeature(es, "nation", "n_name")
    region = DirectFeature(IdentityFeature(es, "region", "r_name"), "nation")
    count = Agg([IdentityFeature(es, "customer", "c_custkey")], "nation", "count")
    mean = Agg([IdentityFeature(es, "customer", "c_acctbal")], "nation", "mean")
    fs = {"n_name": nation, "r_name": region, "n_customers": count, "mean_balance": mean}
    return calculate_feature_matrix([DirectFeature(f, "customer").rename(n) for n, f in fs.items()], es)


@query(f"""with {ITEMS}, per as (select l_orderkey, count(*) n, sum(l_quantity) q from li group by 1),
 o as (select o_custkey, avg(coalesce(n, 0)) mean_items, max(coalesce(q, 0)) max_quantity, count_if(o_orderstatus = 'F') n_f, coalesce(sum(case when o_orderstatus = 'F' then o_totalprice end), 0) sum_f
   from orders left join per on o_orderkey = l_orderkey group by 1),
 deep as (select o_custkey, count(*) n_items, avg(l_quantity) mean_quantity from li join orders on o_orderkey = l_orderkey group by 1)
 select c_custkey, mean_items, max_quantity, coalesce(n_f, 0) n_f, coalesce(sum_f, 0) sum_f, coalesce(n_items, 0) n_items, mean_quantity
 from customer left join o on o.o_custkey = c_custkey left join deep on deep.o_custkey = c_custkey""", {"mean_items": 6, "sum_f": 2, "mean_quantity": 6})
def rel_stacked_where_multi_hop(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    item, qty, price = IdentityFeature(es, "lineitem", "l_id"), IdentityFeature(es, "lineitem", "l_quantity"), IdentityFeature(es, "orders", "o_totalprice")
    f = IdentityFeature(es, "orders", "o_orderstatus") == "F"
    fs = {
        "mean_items": Agg([Agg([item], "orders", "count")], "customer", "mean"), "max_quantity": Agg([Agg([qty], "orders", "sum")], "customer", "max"),
        "n_f": Agg([IdentityFeature(es, "orders", "o_orderkey")], "customer", "count", where=f), "sum_f": Agg([price], "customer", "sum", where=f),
        "n_items": Agg([item], "customer", "count"), "mean_quantity": Agg([qty], "customer", "mean"),
    }
    return calculate_feature_matrix([x.rename(n) for n, x in fs.items()], es)


#: Every order of every customer is a cutoff.
CUTS = "cut as (select distinct o_custkey id, o_orderdate t, o_orderpriority label from orders)"


def cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select(F.col("o_custkey").alias("instance_id"), F.col("o_orderdate").alias("time"), F.col("o_orderpriority").alias("label")).distinct()


def _asof(cond: str):
    return f"""with {CUTS}, j as (select id, t, label, o.* from cut left join orders o on o_custkey = id and {cond})
 select id c_custkey, t "time", label, count(o_orderkey) n, round(coalesce(sum(o_totalprice), 0), 2) total, max(o_totalprice) hi, round(median(o_totalprice), 3) med from j group by 1, 2, 3"""


def _cutoff_features(es):
    spec = {"n": ("count", "o_orderkey"), "total": ("sum", "o_totalprice"), "hi": ("max", "o_totalprice"), "med": ("median", "o_totalprice")}
    return feats(es, "orders", "customer", spec)


@query(_asof("o_orderdate <= t"), {"total": 2, "med": 3})
def cutoff_table(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    return calculate_feature_matrix(_cutoff_features(es), es, cutoffs(spark, folder))


@query(_asof("o_orderdate < t and o_orderdate >= t - interval 300 day"), {"total": 2, "med": 3})
def cutoff_window_excluded(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    return calculate_feature_matrix(_cutoff_features(es), es, cutoffs(spark, folder), training_window="300 days", include_cutoff_time=False)


@query(_asof("o_orderdate <= t and o_orderdate > t - interval 300 day"), {"total": 2, "med": 3})
def cutoff_window_included(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    return calculate_feature_matrix(_cutoff_features(es), es, cutoffs(spark, folder), training_window="300 days")


@query(f"""with {CUTS}, j as (select id, t, o.*, row_number() over (partition by id, t, label order by o_orderdate desc, o_orderkey desc) r, label from cut left join orders o on o_custkey = id and o_orderdate <= t)
 select id c_custkey, t "time", label, coalesce(sum(case when r <= 3 then o_totalprice end), 0) last3, count(case when o_orderdate >= t - interval 1 year then o_orderkey end) last_year,
  count(case when o_orderdate >= t - interval 60 day and o_orderstatus = 'F' then o_orderkey end) recent_f from j group by 1, 2, 3""", {"last3": 2})
def cutoff_use_previous(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    key, price = IdentityFeature(es, "orders", "o_orderkey"), IdentityFeature(es, "orders", "o_totalprice")
    fs = [Agg([price], "customer", "sum", use_previous="3 observations").rename("last3"), Agg([key], "customer", "count", use_previous="1 year").rename("last_year"),
          Agg([key], "customer", "count", where=IdentityFeature(es, "orders", "o_orderstatus") == "F", use_previous="60 days").rename("recent_f")]
    return calculate_feature_matrix(fs, es, cutoffs(spark, folder))


@query(f"""with {CUTS}, b as (select distinct id, t, label, time_bucket(interval 90 day, t, timestamp '1970-01-01') bt, c_nationkey nk from cut join customer on c_custkey = id),
 n as (select nk, bt, count(o_orderkey) no from (select distinct nk, bt from b) x left join customer c on c.c_nationkey = nk left join orders on o_custkey = c.c_custkey and o_orderdate <= bt group by 1, 2)
 select id c_custkey, t "time", label, n_exact, coalesce(no, 0) n_nation from b left join n using (nk, bt)
 left join (select id, t, count(o_orderkey) n_exact from (select distinct id, t from cut) left join orders on o_custkey = id and o_orderdate <= t group by 1, 2) using (id, t)""")
def cutoff_approximate(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    key = IdentityFeature(es, "orders", "o_orderkey")
    fs = [Agg([key], "customer", "count").rename("n_exact"), DirectFeature(Agg([key], "nation", "count"), "customer").rename("n_nation")]
    return calculate_feature_matrix(fs, es, cutoffs(spark, folder), approximate="90 days")


@query(f"""with {ITEMS} select o_orderkey, greatest(o_orderdate, m) last_time from orders left join (select l_orderkey, max(l_shipdate) m from li group by 1) on l_orderkey = o_orderkey""")
def es_last_time_index(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder).add_last_time_indexes()
    return es["orders"].last_times.withColumnRenamed("_last_time", "last_time")


@query(f"""with j as (select c_custkey, o.* from customer left join orders o on o_custkey = c_custkey and o_orderdate <= {AT})
 select c_custkey, count(o_orderkey) n, coalesce(sum(case when o_orderdate + interval 200 day < {AT} then o_totalprice end), 0) settled from j group by 1""", {"settled": 2})
def cutoff_secondary_time(spark: SparkSession, folder: str) -> DataFrame:
    """A column becomes known at its own later time."""
    es = star(spark, folder)
    orders = es["orders"].df.withColumn("paid_at", F.col("o_orderdate") + F.expr("interval 200 days"))
    es2 = EntitySet("late")
    es2.add_dataframe(es["customer"].df, "customer", "c_custkey")
    es2.add_dataframe(orders, "orders", "o_orderkey", "o_orderdate", secondary_time_index={"paid_at": ["o_totalprice"]})
    es2.add_relationship("customer", "c_custkey", "orders", "o_custkey")
    return calculate_feature_matrix(feats(es2, "orders", "customer", {"n": ("count", "o_orderkey"), "settled": ("sum", "o_totalprice")}), es2, cutoff_time=CUTOFF)


# tables
@query("""select o_custkey cust, arg_min(o_orderpriority, {a: o_orderdate, b: o_orderkey}) o_orderpriority, min(o_orderdate) first_orders_time from orders where o_custkey is not null group by 1""")
def es_normalize(spark: SparkSession, folder: str) -> DataFrame:
    es = EntitySet("n").add_dataframe(spark.read.parquet(f"{folder}/orders.parquet"), "orders", "o_orderkey", "o_orderdate")
    es.normalize_dataframe("orders", "buyers", "o_custkey", additional_columns=["o_orderpriority"])
    return es["buyers"].df.withColumnRenamed("o_custkey", "cust")


@query("select * from customer where c_custkey % 2 = 0 union all select c_custkey, c_name, c_nationkey, 0 - c_acctbal, c_mktsegment from customer where c_custkey % 2 = 1")
def es_concat(spark: SparkSession, folder: str) -> DataFrame:
    c = spark.read.parquet(f"{folder}/customer.parquet")
    a = EntitySet("a").add_dataframe(c.where("c_custkey % 2 = 0"), "customer", "c_custkey")
    b = EntitySet("a").add_dataframe(c.withColumn("c_acctbal", 0 - F.col("c_acctbal")), "customer", "c_custkey")
    return a.concat(b)["customer"].df


@query(f"select o_orderkey, o_totalprice from orders where o_custkey in (1, 2, 3, 5, 8) and o_orderdate <= {AT}")
def es_query_by_values(spark: SparkSession, folder: str) -> DataFrame:
    return star(spark, folder).query_by_values("orders", [1, 2, 3, 5, 8, None], "o_custkey", ["o_orderkey", "o_totalprice"], time_last=CUTOFF)


@query("""select c_custkey instance_id, timestamp '2000-01-01' + to_days((c_custkey % 50)::int) - to_days((7 * k)::int) "time" from customer, (select unnest(range(3)) k)""")
def temporal_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    c = spark.read.parquet(f"{folder}/customer.parquet")
    at = F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 50).cast("int"))
    return post.make_temporal_cutoffs(c.select(F.col("c_custkey").alias("instance_id"), at.alias("cutoff")), window_size="7 days", num_windows=3)


# post-processing
@query("""with t as (select c_mktsegment v, row_number() over (order by count(*) desc, c_mktsegment desc) r from customer group by 1)
 select c_custkey, c_mktsegment = (select v from t where r = 1) top_1, c_mktsegment = (select v from t where r = 2) top_2, c_mktsegment not in (select v from t where r <= 2) unknown from customer""")
def encode(spark: SparkSession, folder: str) -> DataFrame:
    es = star(spark, folder)
    fs = [IdentityFeature(es, "customer", "c_mktsegment")]
    out, _ = post.encode_features(calculate_feature_matrix(fs, es), fs, top_n=2)
    return out.toDF("c_custkey", "top_1", "top_2", "unknown")


@query("select c_custkey, c_acctbal, c_mktsegment from customer")
def select_features(spark: SparkSession, folder: str) -> DataFrame:
    c = spark.read.parquet(f"{folder}/customer.parquet").select(
        "c_custkey", "c_acctbal", (F.col("c_acctbal") * 2 + 1).alias("twice"), F.lit(1).alias("one"), F.lit(None).cast("double").alias("nothing"), "c_mktsegment")
    out = post.remove_low_information_features(c)
    out = post.remove_highly_null_features(post.remove_single_value_features(out))
    return post.remove_highly_correlated_features(out, features_to_keep=["c_custkey"])


# end to end
@query(f"""with {ITEMS} select c_custkey, c_acctbal, c_mktsegment, n_name "nation.n_name", count(o_orderkey) "COUNT(orders)", max(o_totalprice) "MAX(orders.o_totalprice)", round(avg(o_totalprice), 4) "MEAN(orders.o_totalprice)",
  round(coalesce(sum(o_totalprice), 0), 2) "SUM(orders.o_totalprice)", max(coalesce(n, 0)) filter (where o_orderkey is not null) "MAX(orders.COUNT(lineitem))", round(avg(coalesce(n, 0)) filter (where o_orderkey is not null), 6) "MEAN(orders.COUNT(lineitem))",
  max(coalesce(q, 0)) filter (where o_orderkey is not null) "MAX(orders.SUM(lineitem.l_quantity))"
 from customer left join nation on n_nationkey = c_nationkey left join orders on o_custkey = c_custkey and o_orderdate <= {AT}
 left join (select l_orderkey, count(*) n, sum(l_quantity) q from li where l_shipdate <= {AT} group by 1) on l_orderkey = o_orderkey group by 1, 2, 3, 4""")
def dfs_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Planned features of customers as of a date; the flagship."""
    es = star(spark, folder)
    wanted = ["c_acctbal", "c_mktsegment", "nation.n_name", "COUNT(orders)", "MAX(orders.o_totalprice)", "MEAN(orders.o_totalprice)", "SUM(orders.o_totalprice)", "MAX(orders.COUNT(lineitem))",
              "MEAN(orders.COUNT(lineitem))", "MAX(orders.SUM(lineitem.l_quantity))"]
    found = {f.get_name(): f for f in dfs(entityset=es, target_dataframe_name="customer", agg_primitives=["count", "max", "mean", "sum"], trans_primitives=[], features_only=True)}
    out = calculate_feature_matrix([found[n] for n in wanted], es, cutoff_time=CUTOFF)
    digits = {"SUM(orders.o_totalprice)": 2, "MEAN(orders.o_totalprice)": 4, "MEAN(orders.COUNT(lineitem))": 6}
    return out.withColumns({n: F.round(F.col(f"`{n}`"), d) for n, d in digits.items()})
