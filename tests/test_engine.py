"""Entity sets, definitions, the planner, and values as of cutoffs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.entityset import EntitySet, read_entityset
from tallyloom.features import (
    AggregationFeature, DirectFeature, IdentityFeature, TransformFeature, describe_feature, graph_feature, load_features, save_features,
)
from tallyloom.functions.base import AGGREGATIONS, TRANSFORMS
from tallyloom.operators import postprocess as post
from tallyloom.plans.discovery import FeatureCollection, generate_features_from_primitives, schema_to_features
from tallyloom.plans.executor import calculate_feature_matrix
from tallyloom.plans.planner import DeepFeatureSynthesis, dfs, get_valid_primitives, list_primitives, summarize_primitives
from tallyloom.sources.demo import mock_customer
from tallyloom.streaming.windows import windowed_features
from tallyloom.timedelta import Timedelta

T0 = dt.datetime(2024, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def es(spark):
    return mock_customer(spark)


@pytest.fixture(scope="module")
def small(spark):
    es = EntitySet("small")
    es.add_dataframe(spark.createDataFrame([(1, "x", at(0)), (2, "y", at(5)), (3, None, at(0))], "c long, g string, born timestamp_ntz"), "cust", "c", "born")
    rows = [(1, 1, at(1), 5.0, "a"), (2, 1, at(2), float("nan"), "b"), (3, 1, at(9), 7.0, "a"), (4, 2, at(6), 1.0, None), (5, None, at(1), 99.0, "a"), (6, 77, at(1), 98.0, "a")]
    es.add_dataframe(spark.createDataFrame(rows, "i long, c long, t timestamp_ntz, v double, s string"), "log", "i", "t")
    return es.add_relationship("cust", "c", "log", "c")


def matrix(df, key="c"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_names_and_stacking(es):
    names = {f.get_name() for f in dfs(entityset=es, target_dataframe_name="customers", features_only=True)}
    assert {"COUNT(sessions)", "COUNT(transactions)", "MODE(sessions.device)", "SUM(transactions.amount)", "MEAN(sessions.COUNT(transactions))", "DAY(join_date)", "AGE(birthday)"} <= names
    assert "customer_id" not in names and "SUM(sessions.SUM(transactions.amount))" not in names
    plan = DeepFeatureSynthesis("sessions", es, agg_primitives=["sum"], trans_primitives=["month"], max_depth=1, drop_contains=["MONTH"]).build_features()
    assert {f.get_name() for f in plan} == {"device", "customers.zip_code", "SUM(transactions.amount)", "customer_id"} or "SUM(transactions.amount)" in {f.get_name() for f in plan}


def test_options_wheres_groupbys_and_limits(es):
    es["transactions"].interesting["product_id"] = []
    es["sessions"].interesting["device"] = ["mobile"]
    kw = dict(entityset=es, target_dataframe_name="customers", features_only=True, trans_primitives=[], agg_primitives=["count", "sum"])
    names = {f.get_name() for f in dfs(**kw)}
    assert "COUNT(sessions WHERE device = mobile)" in names
    assert "SUM(transactions.amount)" not in {f.get_name() for f in dfs(**kw, primitive_options={"sum": {"ignore_columns": {"transactions": ["amount"]}}})}
    assert not any("sessions" in f.get_name() for f in dfs(**kw, ignore_dataframes=["sessions"]))
    assert len(dfs(**kw, max_features=3)) == 3
    by = dfs(entityset=es, target_dataframe_name="transactions", features_only=True, trans_primitives=[], agg_primitives=[], groupby_trans_primitives=["cum_sum"], max_depth=1)
    assert "CUM_SUM(amount) by session_id" in {f.get_name() for f in by}
    with pytest.raises(KeyError):
        dfs(**kw, primitive_options={"sum": {"nothing": []}})
    with pytest.raises(KeyError):
        DeepFeatureSynthesis("nowhere", es)


def test_valid_and_listed_primitives(es):
    aggs, trans = get_valid_primitives(es, "customers", selected_primitives=["sum", "cum_sum", "haversine", "trend"])
    assert {p.name for p in aggs} == {"sum", "trend"} and {p.name for p in trans} == {"cum_sum"}
    assert len(list_primitives()) == 203 and summarize_primitives()["aggregation_primitives"] == 65


def test_definitions_round_trip(es, tmp_path):
    fs = dfs(entityset=es, target_dataframe_name="customers", features_only=True, agg_primitives=["sum", AGGREGATIONS["n_most_common"](n=2), "count"], trans_primitives=["add_numeric"])
    amount = IdentityFeature(es, "transactions", "amount")
    fs.append(AggregationFeature([amount], "customers", "sum", where=amount > 20, use_previous="3 days").rename("mine"))
    save_features(fs, str(tmp_path / "f.json"))
    again = load_features(str(tmp_path / "f.json"), es)
    assert [f.unique_name() for f in again] == [f.unique_name() for f in fs]
    assert again[-1].use_previous == Timedelta(3, "d") and "WHERE" not in again[-1].get_name()
    assert "Last 3 Days" in AggregationFeature([amount], "customers", "sum", use_previous="3d").get_name()
    assert describe_feature(fs[-2]).endswith(".") and "digraph" in graph_feature(fs[-1])


def test_cutoffs_defaults_and_missing_instances(small, spark):
    v, i = IdentityFeature(small, "log", "v"), IdentityFeature(small, "log", "i")
    fs = [AggregationFeature([v], "cust", "sum").rename("s"), AggregationFeature([v], "cust", "mean").rename("m"), AggregationFeature([i], "cust", "count").rename("n"), IdentityFeature(small, "cust", "g")]
    now = matrix(calculate_feature_matrix(fs, small))
    assert (now[1]["s"], now[1]["m"], now[1]["n"]) == (12.0, 6.0, 3) and (now[3]["s"], now[3]["m"], now[3]["n"]) == (0.0, None, 0)
    early = matrix(calculate_feature_matrix(fs, small, cutoff_time=at(2), instance_ids=[1, 2, 55]))
    assert (early[1]["s"], early[1]["n"]) == (5.0, 2) and early[2] == {"c": 2, "s": 0.0, "m": None, "n": 0, "g": None} and early[55]["n"] == 0
    assert matrix(calculate_feature_matrix(fs, small, cutoff_time=at(2), include_cutoff_time=False))[1]["n"] == 1
    cuts = spark.createDataFrame([(1, at(1), "p"), (1, at(9), "q"), (1, at(9), "r"), (2, at(4), "s"), (None, at(4), "t")], "c long, time timestamp_ntz, label string")
    got = {r["label"]: (r["c"], r["n"], r["s"]) for r in calculate_feature_matrix(fs, small, cuts).collect()}
    assert got == {"p": (1, 1, 5.0), "q": (1, 3, 12.0), "r": (1, 3, 12.0), "s": (2, 0, 0.0), "t": (None, 0, 0.0)}
    with pytest.raises(TypeError):
        calculate_feature_matrix(fs, small, cutoff_time=5)


def test_training_window_uses_last_times(small, spark):
    small.add_last_time_indexes()
    assert {r["c"]: r["_last_time"] for r in small["cust"].last_times.collect()} == {1: at(9), 2: at(6), 3: at(0)}
    n = AggregationFeature([IdentityFeature(small, "log", "i")], "cust", "count").rename("n")
    g = IdentityFeature(small, "cust", "g")
    got = matrix(calculate_feature_matrix([n, g], small, cutoff_time=at(9), training_window="3 hours", instance_ids=[1, 2, 3]))
    assert got[1] == {"c": 1, "n": 1, "g": "x"} and got[3] == {"c": 3, "n": 0, "g": None}
    for t in small.tables.values():
        t.last_times = None


def test_diamond_and_two_roles(spark):
    es = EntitySet("games")
    es.add_dataframe(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string"), "teams", "id")
    es.add_dataframe(spark.createDataFrame([(1, 1, 2, 5), (2, 2, 1, 7), (3, 1, 3, 9)], "g long, home long, away long, score long"), "games", "g")
    es.add_relationships([("teams", "id", "games", "home"), ("teams", "id", "games", "away")])
    fs = dfs(entityset=es, target_dataframe_name="teams", agg_primitives=["sum"], trans_primitives=[], features_only=True, max_depth=1)
    assert {"SUM(games[home].score)", "SUM(games[away].score)"} <= {f.get_name() for f in fs}
    got = matrix(calculate_feature_matrix(fs, es), "id")
    assert (got[1]["SUM(games[home].score)"], got[1]["SUM(games[away].score)"]) == (14, 7)
    direct = [DirectFeature(IdentityFeature(es, "teams", "name"), "games", r) for r in es.relationships]
    assert matrix(calculate_feature_matrix(direct, es), "g")[3] == {"g": 3, "teams[home].name": "a", "teams[away].name": "c"}


def test_division_and_infinities(spark):
    es = EntitySet("d").add_dataframe(spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 0.0), (2, -3.0, 0.0), (3, 4.0, 4.0)], "id long, a double, b double"), "t", "id")
    a, b = IdentityFeature(es, "t", "a"), IdentityFeature(es, "t", "b")
    out = calculate_feature_matrix([(a / b).rename("q")], es)
    inf = float("inf")
    assert {r["id"]: r["q"] for r in out.collect()} == {0: inf, 1: None, 2: -inf, 3: 1.0}
    assert {r["id"]: r["q"] for r in post.replace_inf_values(out, -1.0).collect()} == {0: -1.0, 1: None, 2: -1.0, 3: 1.0}


def test_ordinals_compare_by_level(spark):
    es = EntitySet("o").add_dataframe(
        spark.createDataFrame([(1, "low", "high"), (2, "mid", "low"), (3, None, "low")], "id long, a string, b string"), "t", "id",
        logical_types={"a": "Ordinal", "b": "Ordinal"}, orders={"a": ["low", "mid", "high"], "b": ["low", "mid", "high"]})
    f = (IdentityFeature(es, "t", "a") > IdentityFeature(es, "t", "b")).rename("f")
    assert {r["id"]: r["f"] for r in calculate_feature_matrix([f], es).collect()} == {1: False, 2: True, 3: None}


def test_full_windows_see_rows_that_were_not_asked_for(small):
    v = IdentityFeature(small, "log", "v")
    fs = [TransformFeature([v], "cum_sum").rename("full"), TransformFeature([IdentityFeature(small, "log", "t")], "time_since_previous").rename("own")]
    got = matrix(calculate_feature_matrix(fs, small, instance_ids=[1, 3]), "i")
    assert got[3]["full"] == 5 + 99 + 98 + 1 + 7 and got[3]["own"] == 8 * 3600


def test_entity_set_round_trip(small, spark, tmp_path):
    for kind in ("parquet", "csv", "orc"):
        getattr(small, f"to_{kind}")(str(tmp_path / kind))
        again = read_entityset(spark, str(tmp_path / kind))
        assert again.equals(small), kind
    assert read_entityset(spark, str(tmp_path / "parquet"), metadata_only=True)["log"].df.count() == 0
    assert "digraph" in small.plot()


def test_make_index_interesting_and_errors(small, spark):
    df = spark.range(100, numPartitions=5).toDF("x").withColumn("kind", (F.col("x") % 2).cast("string"))
    es = EntitySet("m").add_dataframe(df, "t", "key", make_index=True)
    assert sorted(r["key"] for r in es["t"].df.collect()) == list(range(100))
    es.add_interesting_values()
    assert es["t"].interesting == {"kind": ["0", "1"]}
    with pytest.raises(ValueError):
        small.add_relationship("log", "t", "cust", "c")
    with pytest.raises(ValueError):
        small.add_dataframe(df, "dup", "kind", check_index=True)
    with pytest.raises(KeyError):
        small["nothing"]


def test_encode_ties_unknown_and_drop_first(spark):
    es = EntitySet("e").add_dataframe(spark.createDataFrame([(i, v) for i, v in enumerate(["a", "b", "b", "a", "c", None])], "id long, v string"), "t", "id")
    fs = [IdentityFeature(es, "t", "v")]
    m = calculate_feature_matrix(fs, es)
    out, new = post.encode_features(m, fs, top_n=2)
    assert out.columns == ["id", "v = b", "v = a", "v is unknown"] == ["id", *[f.get_name() for f in new]]
    assert [list(r)[1:] for r in out.orderBy("id").collect()][4:] == [[False, False, True], [False, False, True]]
    assert matrix(calculate_feature_matrix(new, es), "id") == matrix(out, "id")
    assert post.encode_features(m, fs, top_n={"v": 2}, drop_first=True, include_unknown=False)[0].columns == ["id", "v = a"]


def test_selection(spark):
    rows = [(i, float(i), 2.0 * i, 1, None, i % 2 == 0, None if i else 3.0) for i in range(20)]
    m = spark.createDataFrame(rows, "id long, a double, b double, one int, none double, flag boolean, rare double")
    assert post.remove_low_information_features(m).columns == ["id", "a", "b", "flag", "rare"]
    assert post.remove_highly_null_features(m, pct_null_threshold=0.95).columns == ["id", "a", "b", "one", "flag"]
    assert post.remove_single_value_features(m).columns == ["id", "a", "b", "flag"]
    assert post.remove_highly_correlated_features(m.select("a", "b", "flag")).columns == ["a", "flag"]
    assert post.remove_highly_correlated_features(m.select("a", "b"), features_to_keep=["b"]).columns == ["a", "b"]


def test_discovery():
    cols = schema_to_features({"x": "Double", "y": "Integer", "at": "Datetime"})
    made = FeatureCollection(generate_features_from_primitives(cols, [TRANSFORMS["add_numeric"], "divide_numeric", "year"]))
    assert {f.name for f in made} == {"x", "y", "at", "x + y", "x / y", "y / x", "YEAR(at)"}
    assert FeatureCollection.from_json(made.to_json()) == made
    assert made.by_name("x + y").depth == 1 and len(made.by_tag("numeric")) == 5 and len(made.by_origin("at")) == 2


def test_stream_matches_batch(spark, tmp_path):
    rows = [(1, at(0), 2.0), (1, at(0.5), 3.0), (2, at(2), 4.0), (None, at(2), 9.0)]
    spark.createDataFrame(rows, "k long, t timestamp_ntz, v double").write.parquet(str(tmp_path / "in"))
    spec = {"n": ("count",), "s": ("sum", "v"), "m": ("mean", "v")}
    batch = windowed_features(spark.read.parquet(str(tmp_path / "in")), "k", "t", spec)
    stream = windowed_features(spark.readStream.schema("k long, t timestamp_ntz, v double").parquet(str(tmp_path / "in")), "k", "t", spec)
    q = stream.writeStream.format("memory").queryName("streamed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("streamed")) == key(batch) and batch.count() == 2


def test_timedelta():
    assert Timedelta.parse("2 weeks").seconds == 1209600 and Timedelta.parse("3mo").unit == "mo" and Timedelta(5, "observations").is_observations
    assert Timedelta(1, "d").get_name() == "1 Day"
    with pytest.raises(ValueError):
        Timedelta(1, "fortnights")


def test_temporal_cutoffs(spark):
    df = spark.createDataFrame([(1, at(10), at(4))], "instance_id long, cutoff timestamp_ntz, start timestamp_ntz")
    hours = lambda d, **k: sorted((r["time"] - T0).seconds // 3600 for r in post.make_temporal_cutoffs(d, **k).collect())
    assert hours(df, window_size="2h") == [4, 6, 8, 10] and hours(df, num_windows=3) == [4, 7, 10] and hours(df.drop("start"), window_size="1h", num_windows=2) == [9, 10]
    with pytest.raises(ValueError):
        post.make_temporal_cutoffs(df.drop("start"), window_size="1h")


@pytest.fixture(scope="module")
def visits(spark):
    """A few keys, ties in time, cutoffs before, at and after rows, null flags."""
    import random

    rng = random.Random(3)
    es = EntitySet("visits").add_dataframe(spark.createDataFrame([(k,) for k in range(6)], "k long"), "keys", "k")
    rows = [(i, rng.choice([0, 1, 1, 2, 3, None, 77]), at(rng.randrange(40)), rng.choice([None, *range(-3, 4)]), rng.choice([None, True, False])) for i in range(200)]
    es.add_dataframe(spark.createDataFrame(rows, "i long, k long, t timestamp_ntz, v long, b boolean"), "log", "i", "t")
    es.add_relationship("keys", "k", "log", "k")
    es.cuts = spark.createDataFrame([(k, at(h)) for k in range(6) for h in (-1, 0, 7, 7.5, 20, 39, 90)], "k long, time timestamp_ntz")
    es.rows, es.times = rows, [(k, at(h)) for k in range(6) for h in (-1, 0, 7, 7.5, 20, 39, 90)]
    return es


STATEFUL = {
    "count": ["i"], "sum": ["v"], "mean": ["v"], "min": ["v"], "max": ["v"], "max_min_delta": ["v"], "num_true": ["b"], "percent_true": ["b"], "all": ["b"], "any": ["b"],
    "count_greater_than": ["v"], "count_less_than": ["v"], "count_inside_range": ["v"], "count_outside_range": ["v"], "first": ["v"], "last": ["v"], "date_first_event": ["t"],
    "first_last_time_delta": ["t"], "avg_time_between": ["t"], "time_since_first": ["t"], "time_since_last": ["t"], "time_since_last_true": ["t", "b"], "time_since_last_false": ["t", "b"],
    "time_since_last_max": ["t", "v"], "time_since_last_min": ["t", "v"],
}


@pytest.mark.parametrize("include", [True, False])
def test_running_states_equal_one_cutoff_at_a_time(visits, include):
    """Every aggregation with states, with and without a condition, over a table of cutoffs and over each cutoff by itself."""
    from tallyloom.functions.states import STATES

    assert set(STATEFUL) == set(STATES)
    flag = IdentityFeature(visits, "log", "b") == True  # noqa: E712
    fs = []
    for n, cols in STATEFUL.items():
        bases = [IdentityFeature(visits, "log", c) for c in cols]
        fs += [AggregationFeature(bases, "keys", n).rename(n), AggregationFeature(bases, "keys", n, where=flag).rename(f"{n}_where")]
    many = {(r["k"], r["time"]): r.asDict() for r in calculate_feature_matrix(fs, visits, visits.cuts, include_cutoff_time=include).collect()}
    for time in sorted({t for _, t in visits.times}):
        one = matrix(calculate_feature_matrix(fs, visits, cutoff_time=time, include_cutoff_time=include), "k")
        for k in range(6):
            got = {n: v for n, v in many[k, time].items() if n not in ("k", "time")}
            want = {n: v for n, v in one[k].items() if n != "k"}
            assert got == pytest.approx(want) if not any(isinstance(v, dt.datetime) for v in want.values()) else all(got[n] == want[n] or got[n] == pytest.approx(want[n]) for n in want), (k, time)


@pytest.mark.parametrize("previous", ["9 hours", "3 observations", "1 month"])
def test_rows_near_a_cutoff(visits, previous):
    flag = IdentityFeature(visits, "log", "b") == True  # noqa: E712
    v = IdentityFeature(visits, "log", "v")
    fs = [AggregationFeature([v], "keys", p, use_previous=previous, where=w).rename(f"{p}{i}") for p in ("sum", "median") for i, w in enumerate([None, flag])]
    got = {(r["k"], r["time"]): tuple(r)[2:] for r in calculate_feature_matrix(fs, visits, visits.cuts).collect()}
    span = Timedelta.parse(previous)
    for k, time in visits.times:
        out = []
        for i in (0, 1):
            rows = sorted((t, i_, v_) for i_, k_, t, v_, b in visits.rows if k_ == k and t <= time and (not i or b))
            rows = rows[-3:] if span.is_observations else [r for r in rows if r[0] >= time - dt.timedelta(seconds=span.at_most())]
            out.append(sorted(r[2] for r in rows if r[2] is not None))
        med = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 if x else None
        assert got[k, time] == (sum(out[0]), sum(out[1]), med(out[0]), med(out[1])), (k, time)


def test_windows_over_the_whole_table_at_many_cutoffs(visits):
    """Looking back, a row's value is the same at every cutoff; a percentile is not. No plan has a nested-loop join."""
    v = IdentityFeature(visits, "log", "v")
    fs = [TransformFeature([v], "cum_sum").rename("run"), TransformFeature([v], "percentile").rename("rank")]
    cuts = visits["log"].df.select(F.col("i").alias("instance_id"), (F.col("t") + F.expr("interval 5 hours")).alias("time"))
    out = calculate_feature_matrix(fs, visits, cuts)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted((t, i, v) for i, _, t, v, _ in visits.rows)
    for r in out.collect():
        seen = [(t, i, v) for t, i, v in rows if t <= r["time"]]
        mine = next(x for x in seen if x[1] == r["i"])
        if mine[2] is None:
            assert r["run"] is None and r["rank"] is None
            continue
        known = [v for *_, v in seen if v is not None]
        assert r["run"] == sum(v for *p, v in seen if v is not None and (p[0], p[1]) <= mine[:2])
        assert r["rank"] == pytest.approx((sum(x < mine[2] for x in known) + (sum(x == mine[2] for x in known) + 1) / 2) / len(known))


def test_cutoff_checks_and_order(small, spark):
    fs = [AggregationFeature([IdentityFeature(small, "log", "i")], "cust", "count").rename("n")]
    cuts = spark.createDataFrame([(2, at(9), "x"), (1, at(9), "y"), (2, at(9), "z")], "c long, time timestamp_ntz, label string")
    with pytest.raises(AssertionError):
        calculate_feature_matrix(fs, small, cuts, check_duplicates=True)
    out = calculate_feature_matrix(fs, small, cuts.coalesce(1), keep_order=True)
    assert out.columns == ["c", "time", "label", "n", "__row"] and [r["label"] for r in out.orderBy("__row").collect()] == ["x", "y", "z"]
    said = []
    calculate_feature_matrix(fs, small, cuts, progress_callback=lambda *a: said.append(a))
    assert said == [(0, 1, 1)]


def test_parameters_survive_saving(small):
    g = IdentityFeature(small, "cust", "g")
    fs = [TransformFeature([g], TRANSFORMS["isin"](list_of_outputs={"x", "y"})), TransformFeature([g], TRANSFORMS["isin"](list_of_outputs=("x", at(1))))]
    again = load_features(save_features(fs), small)
    assert again[0].primitive.list_of_outputs == {"x", "y"} and again[1].primitive.list_of_outputs == ("x", at(1))
    with pytest.raises(TypeError):
        save_features([TransformFeature([g], TRANSFORMS["isin"](list_of_outputs=[object()]))])


def test_copies_and_items(small, spark):
    import copy

    other = copy.deepcopy(small)
    other["cust"].interesting["g"] = ["x"]
    assert "g" not in small["cust"].interesting and other.relationships == small.relationships
    other["more"] = spark.range(3).toDF("m")
    other["more"] = spark.range(5).toDF("m")
    assert other["more"].index == "m" and other["more"].df.count() == 5 and "more" not in small


def test_correlations_with_nulls_and_constants(spark):
    import random

    import pandas as pd

    rng = random.Random(4)
    rows = [(rng.choice([None, 1e6 + rng.random()]), rng.random(), 7.0, rng.random() < 0.5) for _ in range(300)]
    rows = [(a, b, None if a is None else a * 2 + b * 0.01, c, d) for a, b, c, d in rows]
    m = spark.createDataFrame(rows, "a double, b double, like_a double, same double, flag boolean").repartition(3)
    got = post._correlations(m, m.columns)
    want = pd.DataFrame(rows, columns=m.columns).astype(float).corr()
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=1e-6, nan_ok=True), (x, y)


def test_recommendations(spark):
    from tallyloom.plans.recommend import get_recommended_primitives

    rows = [(i, at(i * 40), f"word {i % 3}", float(2**i), float(i % 2), i % 2 == 0) for i in range(1, 12)]
    es = EntitySet("one").add_dataframe(spark.createDataFrame(rows, "id long, t timestamp_ntz, s string, big double, flat double, b boolean"), "t", "id", "t", {"s": "NaturalLanguage"})
    got = set(get_recommended_primitives(es))
    assert {"day", "hour", "num_unique_separators", "natural_logarithm"} - got == {"num_unique_separators"}
    assert not {"is_year_end", "square_root", "lag", "rolling_mean", "and", "year"} & got
    assert {"lag", "rolling_mean", "expanding_max", "day"} <= set(get_recommended_primitives(es, True))
    with pytest.raises(IndexError):
        get_recommended_primitives(EntitySet("none"))


def test_info(capsys):
    from tallyloom.info import show_info

    show_info()
    said = capsys.readouterr().out
    assert "pyspark: 4" in said and "python: 3" in said
