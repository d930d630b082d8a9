"""Primitives against plain Python and pandas, with nulls, ties and empty groups."""

import datetime as dt
import re
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.entityset import EntitySet
from tallyloom.features import AggregationFeature, GroupByTransformFeature, IdentityFeature, TransformFeature
from tallyloom.functions import scalars, windows
from tallyloom.functions.wordlists import common_words, names
from tallyloom.functions.base import AGGREGATIONS, TRANSFORMS, lookup
from tallyloom.plans import planner  # noqa: F401
from tallyloom.plans.executor import calculate_feature_matrix

T0 = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def es(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        v = None if rng.random() < 0.15 else float(rng.integers(-4, 5))
        rows.append((i, int(rng.integers(1, 4)) if i % 10 else None, T0 + dt.timedelta(minutes=int(rng.integers(0, 5000))), v, None if v is None else v > 0, None if v is None else f"c{int(v) % 3}"))
    df = spark.createDataFrame(rows, "id long, k long, t timestamp_ntz, v double, b boolean, c string")
    es = EntitySet("x").add_dataframe(spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long"), "keys", "k")
    es.add_dataframe(df, "rows", "id", "t")
    es.pdf = df.toPandas().sort_values(["t", "id"])
    return es.add_relationship("keys", "k", "rows", "k")


def agg(es, prim, *cols):
    f = AggregationFeature([IdentityFeature(es, "rows", c) for c in cols], "keys", prim).rename("f")
    return {r["k"]: r["f"] for r in calculate_feature_matrix([f], es).collect()}


def runs(flags):
    best = now = 0
    for f in flags:
        now = now + 1 if f else 0
        best = max(best, now)
    return best


def skip(s):
    return [x for x in s if x is not None and x == x]


CASES = {
    "count": (["id"], len), "sum": (["v"], lambda s: sum(skip(s))), "max": (["v"], lambda s: max(skip(s))), "min": (["v"], lambda s: min(skip(s))), "mean": (["v"], lambda s: np.mean(skip(s))),
    "median": (["v"], lambda s: np.median(skip(s))), "std": (["v"], lambda s: np.std(skip(s), ddof=1)), "skew": (["v"], lambda s: pd.Series(skip(s)).skew()),
    "num_true": (["b"], lambda s: sum(x is True or x == True for x in s)), "percent_true": (["b"], lambda s: np.mean([x == True for x in s])),  # noqa: E712
    "all": (["b"], lambda s: all(x for x in skip(s))), "any": (["b"], lambda s: any(x for x in skip(s))),
    "first": (["v"], lambda s: s[0]), "last": (["v"], lambda s: s[-1]), "mode": (["c"], lambda s: pd.Series(skip(s)).mode()[0]), "num_unique": (["c"], lambda s: len(set(skip(s)))),
    "count_above_mean": (["v"], lambda s: sum(x > np.mean(skip(s)) for x in skip(s))), "count_inside_nth_std": (["v"], lambda s: sum(abs(x - np.mean(skip(s))) <= np.std(skip(s)) for x in skip(s))),
    "max_consecutive_true": (["b"], lambda s: runs(x is not None and x == True for x in s)),  # noqa: E712
    "max_consecutive_zeros": (["v"], lambda s: runs(x == 0 for x in skip(s))), "max_consecutive_negatives": (["v"], lambda s: runs(x < 0 for x in skip(s))),
    "num_consecutive_greater_mean": (["v"], lambda s: runs(x > np.mean(skip(s)) for x in skip(s))), "is_monotonically_increasing": (["v"], lambda s: skip(s) == sorted(skip(s))),
    "num_zero_crossings": (["v"], lambda s: sum(a * b < 0 for a, b in zip([x for x in skip(s) if x], [x for x in skip(s) if x][1:]))),
    "max_count": (["v"], lambda s: skip(s).count(max(skip(s)))), "median_count": (["v"], lambda s: skip(s).count(np.median(skip(s)))),
    "entropy": (["c"], lambda s: -sum(p * np.log(p) for p in pd.Series(["?" if x is None or x != x else x for x in s]).value_counts(normalize=True))),
    "is_unique": (["c"], lambda s: len(set(map(str, s))) == len(s)), "has_no_duplicates": (["c"], lambda s: len(set(skip(s))) == len(skip(s))),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_aggregation(es, name):
    cols, want = CASES[name]
    got = agg(es, name, *cols)
    for k in (1, 2, 3):
        s = es.pdf[es.pdf.k == k][cols[0]].tolist()
        w = want(s)
        if w is None or w != w:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(w)
    default = lookup(name, "aggregation").default
    assert got[4] == (default if default is not None else None) or name in ("all", "any")


def test_kurtosis_without_bias_and_peaks(spark):
    es = EntitySet("p").add_dataframe(spark.createDataFrame([(1,)], "k long"), "keys", "k")
    vs = [1, 3, 3, 2, 5, 1, 1, 4, 4, 4, 6, 0]
    es.add_dataframe(spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(vs)], "id long, k long, v double"), "rows", "id").add_relationship("keys", "k", "rows", "k")
    assert agg(es, "num_peaks", "v")[1] == 3
    assert agg(es, AGGREGATIONS["kurtosis"](bias=False), "v")[1] == pytest.approx(pd.Series(vs).kurt())


def test_most_common_ties_are_first_seen(spark):
    es = EntitySet("p").add_dataframe(spark.createDataFrame([(1,), (2,)], "k long"), "keys", "k")
    es.add_dataframe(spark.createDataFrame([(i, 1, v) for i, v in enumerate(["b", "a", None, None, "a", "c", "b"])], "id long, k long, v string"), "rows", "id").add_relationship("keys", "k", "rows", "k")
    f = AggregationFeature([IdentityFeature(es, "rows", "v")], "keys", AGGREGATIONS["n_most_common"](n=4))
    got = {r[0]: list(r)[1:] for r in calculate_feature_matrix([f], es).collect()}
    assert got == {1: ["b", "a", "c", None], 2: [None] * 4}


WINDOWS = {
    "cum_sum": (["v"], {}, lambda d: d.v.cumsum()), "cum_max": (["v"], {}, lambda d: d.v.cummax()), "lag": (["v", "t"], {"periods": 2}, lambda d: d.v.shift(2)), "diff": (["v"], {"periods": 1}, lambda d: d.v.shift(1).diff()),
    "absolute_diff": (["v"], {"limit": 1}, lambda d: d.v.ffill(limit=1).diff().abs()), "percentile": (["v"], {}, lambda d: d.v.rank(pct=True)),
    "rolling_mean": (["t", "v"], {"window_length": 4, "gap": 1, "min_periods": 2}, lambda d: d.v.shift(1).rolling(4, min_periods=2).mean()),
    "rolling_max": (["t", "v"], {"window_length": "6h", "gap": 0}, lambda d: d.set_index("t").v.rolling("6h", min_periods=1).max()),
    "rolling_count": (["t"], {"window_length": 3, "gap": 1}, lambda d: pd.Series(1, index=d.index).shift(1).rolling(3, min_periods=0).count().where(np.arange(len(d)) >= 1)),
    "expanding_std": (["t", "v"], {"gap": 2, "min_periods": 1}, lambda d: d.v.shift(2).expanding(1).std()),
    "exponential_weighted_average": (["v"], {"com": 0.5}, lambda d: d.v.ewm(com=0.5).mean()), "exponential_weighted_variance": (["v"], {"alpha": 0.3, "ignore_na": True}, lambda d: d.v.ewm(alpha=0.3, ignore_na=True).var()),
    "exponential_weighted_std": (["v"], {"span": 4}, lambda d: d.v.ewm(span=4).std()),
}


@pytest.mark.parametrize("name", sorted(WINDOWS))
def test_window_transform(es, name):
    cols, kw, want = WINDOWS[name]
    f = GroupByTransformFeature([IdentityFeature(es, "rows", c) for c in cols], TRANSFORMS[name](**kw), IdentityFeature(es, "rows", "k")).rename("f")
    got = {r["id"]: r["f"] for r in calculate_feature_matrix([f], es).collect()}
    assert all(got[i] is None for i in es.pdf[es.pdf.k.isna()].id)
    for k in (1, 2, 3):
        d = es.pdf[es.pdf.k == k]
        for i, w in zip(d.id, want(d).tolist()):
            assert got[i] is None if w != w else got[i] == pytest.approx(w), (name, i)


@pytest.mark.parametrize("kw", [{"com": 0.5}, {"alpha": 0.4, "ignore_na": True}, {"span": 30}, {"halflife": 2}, {"alpha": 0.001}])
def test_weighted_streams_carry_over_batches(kw):
    """Two groups fed in pieces of 7 rows: results are those of pandas over each group, however the rows are cut."""
    rng = np.random.default_rng(2)
    groups = [np.where(rng.random(n) < 0.2, np.nan, 1e4 + rng.normal(size=n)) for n in (300, 41)]
    x, new = np.concatenate(groups), np.zeros(341, bool)
    new[[0, 300]] = True
    for name, what in (("average", "mean"), ("std", "std"), ("variance", "var")):
        p = TRANSFORMS[f"exponential_weighted_{name}"](**kw)
        state = p.stream()
        got = np.concatenate([state.feed(x[i : i + 7], new[i : i + 7]) for i in range(0, 341, 7)])
        want = np.concatenate([getattr(pd.Series(g).ewm(**kw), what)() for g in groups])
        assert got == pytest.approx(want, rel=1e-6, nan_ok=True), name
    with pytest.raises(ValueError):
        p = TRANSFORMS["exponential_weighted_average"](com=1, span=3)
        p.stream()


SEQUENCES = ["max_consecutive_true", "max_consecutive_false", "max_consecutive_negatives", "max_consecutive_positives", "max_consecutive_zeros", "num_consecutive_greater_mean",
             "num_consecutive_less_mean", "is_monotonically_increasing", "is_monotonically_decreasing", "num_zero_crossings", "num_false_since_last_true", "num_true_since_last_false"]


def test_a_hot_key_is_cut_into_segments(spark):
    """One key with nine in ten rows, in many segments, against one segment per key."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(2000):
        k = 1 if i % 10 else int(rng.integers(2, 6))
        v = None if rng.random() < 0.1 else float(i // 400 if k == 2 else rng.integers(-2, 3))
        rows.append((i, k, T0 + dt.timedelta(minutes=int(i // 3)), v, None if v is None else v > 0))
    es = EntitySet("hot").add_dataframe(spark.createDataFrame([(k,) for k in range(1, 7)], "k long"), "keys", "k")
    es.add_dataframe(spark.createDataFrame(rows, "id long, k long, t timestamp_ntz, v double, b boolean").repartition(3), "rows", "id", "t").add_relationship("keys", "k", "rows", "k")
    fs = [AggregationFeature([IdentityFeature(es, "rows", AGGREGATIONS[n].inputs[0][0].logical == "Boolean" and "b" or "v")], "keys", n).rename(n) for n in SEQUENCES]
    got = []
    for parts, coalesce in (("1", "true"), ("13", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got.append(sorted(map(tuple, calculate_feature_matrix(fs, es).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == got[1]
    mine = [r for r in rows if r[1] == 1]
    vs, bs = [r[3] for r in mine], [r[4] for r in mine]
    mean = np.mean(skip(vs))
    signs = [np.sign(v) for v in skip(vs) if v]
    since = lambda mark: sum(b is (not mark) for b in bs[len(bs) - bs[::-1].index(mark) :])
    assert got[0][0][1:] == (
        runs(b is True for b in bs), runs(b is False for b in bs), runs(v < 0 for v in skip(vs)), runs(v > 0 for v in skip(vs)), runs(v == 0 for v in skip(vs)),
        runs(v > mean for v in skip(vs)), runs(v < mean for v in skip(vs)), False, False, sum(a != b for a, b in zip(signs, signs[1:])), since(True), since(False),
    )


def test_savgol_follows_polynomials():
    x = np.linspace(-2, 3, 40)
    y = x**3 - 2 * x
    step = x[1] - x[0]
    assert windows.savgol(y, 9, 3) == pytest.approx(y)
    assert windows.savgol(y, 9, 3, deriv=1, delta=step) == pytest.approx(3 * x**2 - 2)
    assert len(windows.savgol(y, 7, 2, mode="nearest")) == 40


TEXTS = ["", " ", "End.\r\n", "a.\n", "²x m² #² #²x @µ_! 'a' \"b\u2003c d\" #a\u0301", "he said 'no " + "word " * 30_000 + "' end", "Hello, World! It's HE #tag @you", None, "a\tb\nc  d", '"one two" said \'x y\'', "#été ## @a@b", "UPPER lower UPPER", "...!!! ,", "word-word \\ back", "The the THE end."]
PUNCT = string.punctuation
TEXT_CASES = {
    "num_words": lambda t: sum(1 for w in re.split("[ \n\t]", t) if w.strip(PUNCT)), "num_characters": len, "punctuation_count": lambda t: sum(c in PUNCT for c in t),
    "title_word_count": lambda t: len(re.findall(r"([A-Z][^\s]*)", t)), "upper_case_count": lambda t: len(re.findall("[A-Z]", t)), "whitespace_count": lambda t: t.count(" "),
    "number_of_unique_words": lambda t: len({w.strip(PUNCT) for w in t.split() if w.strip(PUNCT)}), "number_of_hashtags": lambda t: len(re.findall(r"((^#)|\s#)(\w*([^\W\d])+\w*)(?![#\w])", t)),
    "upper_case_word_count": lambda t: sum(1 for w in re.split("[ \n\t]", t) if w.strip(PUNCT) and w.upper() == w),
    "number_of_common_words": lambda t: sum(w.lower().strip(PUNCT) in common_words() for w in re.split("[ \n\t]", t)),
    "number_of_mentions": lambda t: len(re.findall(r"((^@)|(\s+@))(\w+)(?=\s|$|[" + re.escape(PUNCT.replace("@", "")) + "])", t)),
    "number_of_words_in_quotes": lambda t: sum(
        bool(w.strip(PUNCT + " ")) for m in re.finditer(r"(((^|\W)'(.)*?'(?!\w))|((^|\W)\"(.)*?\"(?!\w)))", t, re.DOTALL) for w in re.split("[ \n\t]", m[0])),
    "mean_characters_per_word": lambda t: float(np.mean([len(w) for w in re.sub(r"[!,.:;?]+$|[!,.:;?]+ |[!,.:;?]+\n", " ", t).split()] or [0])),
    "total_word_length": lambda t: sum(c not in PUNCT.replace("\\", "") + "\n\t " for c in t),
    "median_word_length": lambda t: float(np.median([len(w) for w in re.split("[ \n\t]", t) if w])) if any(re.split("[ \n\t]", t)) else None,
}


@pytest.mark.parametrize("name", sorted(TEXT_CASES))
def test_text(spark, name):
    es = EntitySet("t").add_dataframe(spark.createDataFrame(list(enumerate(TEXTS)), "id long, s string"), "d", "id", logical_types={"s": "NaturalLanguage"})
    got = {r["id"]: r["f"] for r in calculate_feature_matrix([TransformFeature([IdentityFeature(es, "d", "s")], name).rename("f")], es).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (None if t is None else pytest.approx(TEXT_CASES[name](t))), (name, t[:50])


def test_blank_and_the_rest_share_out_all_characters():
    """Both classes by Python's own engine: every character is in one of them, and blank is what Python calls so."""
    own = lambda c: re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", c))
    blank, rest = own(scalars.BLANK), own(scalars.NOT_BLANK)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert all(bool(blank.match(c)) == c.isspace() == (not rest.match(c)) for c in chars)


def test_lists_of_names(tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("// a comment\n.Com\n\nco.uk\n")
    assert names(str(path)) == ["com", "co.uk"] and names(["A"]) == ["A"]
    with pytest.raises(FileNotFoundError):
        common_words(str(tmp_path))
    assert {"the", "of", "people"} <= common_words() and len(common_words(most=10)) == 10


def test_names_urls_and_places(spark):
    names = ["Spector, Mr. Woolf", "Oliva y Ocana, Dona. Fermina", "Ware, Mr. Frederick", "Peter, Michael J", "Mr. Brown", None]
    df = spark.createDataFrame(list(enumerate(names)), "id long, n string")
    es = EntitySet("n").add_dataframe(df, "d", "id", logical_types={"n": "PersonFullName"})
    got = {}
    for p in ("full_name_to_title", "full_name_to_last_name", "full_name_to_first_name"):
        out = calculate_feature_matrix([TransformFeature([IdentityFeature(es, "d", "n")], p).rename("f")], es)
        got[p] = [r["f"] for r in out.orderBy("id").collect()]
    assert got["full_name_to_title"] == ["Mr", "Dona", "Mr", None, "Mr", None]
    assert got["full_name_to_last_name"] == ["Spector", "Oliva y Ocana", "Ware", "Peter", "Brown", None]
    assert got["full_name_to_first_name"] == ["Woolf", "Oliva", "Frederick", "Michael", None, None]
    urls = spark.createDataFrame([("https://www.google.com/x",), ("http://www.google.co.in",), ("www.facebook.com",), ("mailto:me",), (None,)], "u string")
    u = [F.col("u")]
    assert [r[0] for r in urls.select(TRANSFORMS["url_to_tld"]().column(u, None)).collect()] == ["com", "in", "com", None, None]
    assert [r[0] for r in urls.select(TRANSFORMS["url_to_tld"](tlds=["com", "co", "in"]).column(u, None)).collect()] == ["com", "in", "com", None, None]
    assert [r[0] for r in urls.select(TRANSFORMS["url_to_tld"](tlds=["com", "co.in", "in"]).column(u, None)).collect()] == ["com", "co.in", "com", None, None]


def test_holidays(spark):
    days = {"2021-07-05": "Independence Day (observed)", "2023-01-16": "Martin Luther King Jr. Day", "2024-11-28": "Thanksgiving Day", "2021-12-31": "New Year's Day (observed)", "2022-06-20": "Juneteenth National Independence Day (observed)", "2024-07-09": None}
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", scalars.holiday_name(F.col("d").cast("timestamp_ntz")).alias("n"))
    assert {r[0]: r[1] for r in df.collect()} == days


def test_holidays_of_other_countries(spark):
    known = {1961: (4, 2), 2000: (4, 23), 2008: (3, 23), 2024: (3, 31), 2038: (4, 25)}
    assert {y: (scalars.easter(y).month, scalars.easter(y).day) for y in known} == known
    days = [("2024-03-29", "Karfreitag", None), ("2024-05-09", "Christi Himmelfahrt", "Ascension"), ("2023-04-10", "Ostermontag", "Lundi de Pâques"), ("1989-10-03", None, None), ("2024-07-14", None, "Fête nationale")]
    df = spark.createDataFrame([(d,) for d, *_ in days], "d string").select("d", F.col("d").cast("timestamp_ntz").alias("t"))
    got = df.select("d", scalars.holiday_name(F.col("t"), "DE"), scalars.holiday_name(F.col("t"), "FR")).collect()
    assert [tuple(r) for r in got] == days
    to = TRANSFORMS["distance_to_holiday"](holiday="Karfreitag", country="DE").column([F.col("t")], None)
    assert [r[0] for r in df.select(to).collect()] == [0, -41, -3, 192, -107]
    scalars.add_calendar("XX", {"Only once": lambda y: dt.date(2024, 3, 29) if y == 2024 else None})
    assert [r[0] for r in df.select(TRANSFORMS["is_federal_holiday"](country="XX").column([F.col("t")], None)).collect()] == [True, False, False, False, False]
    del scalars.CALENDARS["XX"]
    with pytest.raises(ValueError):
        scalars.holiday_name(F.col("t"), "XX")


def test_wrong_parameters():
    with pytest.raises(ValueError):
        lookup("no_such", "aggregation")
    with pytest.raises(TypeError):
        AGGREGATIONS["sum"](depth=1)
