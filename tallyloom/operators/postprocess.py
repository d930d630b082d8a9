"""Operators on a finished feature matrix: encoding, selection, infinities, cutoffs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.entityset import q
from tallyloom.features import Feature


def encode_features(
    matrix: DataFrame, features: list[Feature], top_n: int | dict = 10, include_unknown: bool = True, to_encode: list[str] | None = None,
    drop_first: bool = False,
) -> tuple[DataFrame, list[Feature]]:
    """Replace categorical features by one 0/1 column per frequent value, and one for any other.

    The ``top_n`` values (per feature if a dict; those not named take 10) are the most
    frequent, of equals the greater one. One pass counts all columns at once: the rows
    become (column, value) pairs that are combined before the shuffle. Null is no value
    and counts as unknown. Columns that are no feature stay. The new definitions are
    equality features on the old ones.
    """
    names = {f.get_name(): f for f in features}
    chosen = [
        n for n, f in names.items()
        if n in matrix.columns and f.number_output_features == 1 and "category" in f.schema.tags and (to_encode is None or n in to_encode)
    ]
    tops: dict[str, list] = {n: [] for n in chosen}
    if chosen:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), q(n).cast("string").alias("v")) for i, n in enumerate(chosen)])
        counts = matrix.select(F.inline(pairs)).where("v is not null").groupBy("i", "v").count()
        limit = [top_n.get(n, 10) if isinstance(top_n, dict) else top_n for n in chosen]
        from pyspark.sql.window import Window

        kinds = {f.name: f.dataType for f in matrix.schema.fields}
        as_number = [i for i, n in enumerate(chosen) if isinstance(kinds[n], T.NumericType)]
        value = F.when(F.col("i").isin(as_number), F.expr("try_cast(v as double)"))
        rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("count"), value.desc_nulls_last(), F.desc("v")))
        for r in counts.withColumn("r", rank).where(F.col("r") <= max([*limit, 0])).orderBy("i", "r").collect():  # top_n rows per column
            if r["r"] <= limit[r["i"]]:
                tops[chosen[r["i"]]].append(r["v"])
    cols, out = [], []
    known = {n for f in features for n in f.get_feature_names()}
    for c in matrix.columns:
        if c not in known:
            cols.append(q(c))
    for f in features:
        n = f.get_name()
        if n not in tops:
            cols += [q(c) for c in f.get_feature_names() if c in matrix.columns]
            out.append(f)
            continue
        values = tops[n][1:] if drop_first else tops[n]
        kind = matrix.schema[n].dataType
        for v in values:
            typed = int(v) if isinstance(kind, T.IntegralType) else float(v) if isinstance(kind, T.NumericType) else v
            new = f == typed
            cols.append(F.coalesce(q(n).cast("string") == F.lit(v), F.lit(False)).alias(new.get_name()))
            out.append(new)
        if include_unknown:
            new = f.isin([*tops[n]]).NOT().rename(f"{n} is unknown")
            cols.append((~F.coalesce(q(n).cast("string").isin(tops[n]), F.lit(False))).alias(new.get_name()))
            out.append(new)
    return matrix.select(*cols), out


def _only(matrix: DataFrame, gone: list[str], features: list[Feature] | None):
    kept = matrix.select(*[q(c) for c in matrix.columns if c not in gone])
    if features is None:
        return kept
    return kept, [f for f in features if not set(f.get_feature_names()) & set(gone)]


def _checked(matrix: DataFrame) -> list[T.StructField]:
    return [f for f in matrix.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def _spans(matrix: DataFrame, cols: list[T.StructField]) -> list[tuple[bool, bool, bool]]:
    """Of each column: whether it has a value, two different ones, a null. Least and greatest say so: one aggregation, nothing to shuffle."""
    row = matrix.agg(*[x for i, f in enumerate(cols) for x in (F.min(q(f.name)).alias(f"l{i}"), F.max(q(f.name)).alias(f"h{i}"), F.count_if(q(f.name).isNull()).alias(f"n{i}"))]).first()
    return [(row[f"l{i}"] is not None, row[f"l{i}"] != row[f"h{i}"], bool(row[f"n{i}"])) for i in range(len(cols))]


def remove_low_information_features(matrix: DataFrame, features: list[Feature] | None = None):
    """Drop columns that have one value, null being a value, or only nulls; one aggregation for all."""
    cols = _checked(matrix)
    gone = [f.name for f, (some, two, null) in zip(cols, _spans(matrix, cols)) if not (two or some and null)]
    return _only(matrix, gone, features)


def remove_highly_null_features(matrix: DataFrame, features: list[Feature] | None = None, pct_null_threshold: float = 0.95):
    """Drop columns whose share of nulls is at least the threshold (above it if it is 0)."""
    if not 0 <= pct_null_threshold <= 1:
        raise ValueError("pct_null_threshold must be a float between 0 and 1, inclusive.")
    row = matrix.agg(*[F.avg(q(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(matrix.columns)]).first()
    share = [row[f"n{i}"] or 0.0 for i in range(len(matrix.columns))]
    gone = [c for c, s in zip(matrix.columns, share) if (s >= pct_null_threshold if pct_null_threshold else s > 0)]
    return _only(matrix, gone, features)


def remove_single_value_features(matrix: DataFrame, features: list[Feature] | None = None, count_nan_as_value: bool = False):
    """Drop columns with at most one value."""
    cols = _checked(matrix)
    gone = [f.name for f, (some, two, null) in zip(cols, _spans(matrix, cols)) if not (two or some and null and count_nan_as_value)]
    return _only(matrix, gone, features)


def remove_highly_correlated_features(
    matrix: DataFrame, features: list[Feature] | None = None, pct_corr_threshold: float = 0.95, features_to_check: list[str] | None = None,
    features_to_keep: list[str] | None = None,
):
    """Drop the later of two numeric or boolean columns whose correlation is at least the threshold.

    Correlations of a pair skip rows where either is null. The matrix is read twice,
    once for a shift of each column that keeps the sums small, once for the sums of all
    pairs, which are gathered by blocks of columns within each partition.
    """
    if not 0 <= pct_corr_threshold <= 1:
        raise ValueError("pct_corr_threshold must be a float between 0 and 1, inclusive.")
    unknown = set(features_to_check or ()) - set(matrix.columns)
    if unknown:
        raise AssertionError("feature named %s is not in feature matrix" % sorted(unknown)[0])
    keep = set(features_to_keep or ())
    cols = [
        f.name for f in matrix.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and (features_to_check is None or f.name in features_to_check)
    ]
    found = _correlations(matrix, cols)
    gone: list[str] = []
    for j in range(len(cols) - 1, 0, -1):
        b = cols[j]
        if b not in keep and any((r := found.get((cols[i], b))) is not None and r == r and abs(r) >= pct_corr_threshold for i in range(j)):
            gone.append(b)
    return _only(matrix, gone, features)


def _correlations(matrix: DataFrame, cols: list[str]) -> dict[tuple[str, str], float]:
    """Correlation of every pair of columns over the rows where both are known."""
    if len(cols) < 2:
        return {}
    number = [(q(c).cast("int") if isinstance(matrix.schema[c].dataType, T.BooleanType) else q(c)).cast("double") for c in cols]
    row = matrix.agg(*[F.avg(F.when(F.abs(x) < float("inf"), x)).alias(f"m{i}") for i, x in enumerate(number)]).first()
    shift, m = np.array([row[i] or 0.0 for i in range(len(cols))]), len(cols)

    def sums(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float) - shift
                known = np.isfinite(x)
                x, k = np.where(known, x, 0.0), known.astype(float)
                now = np.stack([k.T @ k, x.T @ k, (x * x).T @ k, x.T @ x])
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4)), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), m * m).cast(pa.list_(pa.float64()))], ["part", "vals"])

    got = matrix.select(*[x.alias(f"c{i}") for i, x in enumerate(number)]).mapInArrow(sums, "part long, vals array<double>")
    cells = got.select("part", F.posexplode("vals")).groupBy("part", "pos").agg(F.sum("col").alias("v")).toArrow()  # 4 numbers per pair of columns
    n, sx, sxx, sxy = np.zeros((4, m, m))
    for k, out in enumerate((n, sx, sxx, sxy)):
        use = cells["part"].to_numpy() == k
        out.ravel()[cells["pos"].to_numpy()[use]] = cells["v"].to_numpy()[use]
    with np.errstate(all="ignore"):
        var = n * sxx - sx * sx  # of the row's column where the other is known
        var = np.where(var > 1e-12 * n * sxx, var, 0.0)
        r = (n * sxy - sx * sx.T) / np.sqrt(var * var.T)
    return {(a, b): float(r[i, j]) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j}


def replace_inf_values(matrix: DataFrame, replacement_value=None, columns: list[str] | None = None) -> DataFrame:
    """Infinities become ``replacement_value`` (null by default)."""
    floats = [f.name for f in matrix.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (columns is None or f.name in columns)]
    return matrix.withColumns({c: F.when(F.abs(q(c)) == float("inf"), F.lit(replacement_value).cast("double")).otherwise(q(c)) for c in floats})


def make_temporal_cutoffs(instances: DataFrame, window_size: str | None = None, num_windows: int | None = None) -> DataFrame:
    """Equally spaced cutoffs per instance: (instance_id, time) from (instance_id, cutoff[, start]).

    Of window size, number of windows and start two are needed; the last cutoff is the given one.
    """
    from tallyloom.timedelta import Timedelta

    given = [window_size is not None, num_windows is not None, "start" in instances.columns]
    if sum(given) < 2:
        raise ValueError("Must supply 2 of the 3 optional args, window_size, num_windows and start")
    kind = instances.schema["cutoff"].dataType
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    end = us("cutoff")
    if window_size is not None:
        step = F.lit(int(Timedelta.parse(window_size).seconds * 1_000_000))
    else:
        step = ((end - us("start")) / F.lit(num_windows - 1 if num_windows > 1 else 1)).cast("long")
    first = us("start") if "start" in instances.columns and not (window_size is not None and num_windows is not None) else end - step * (num_windows - 1)
    n = F.lit(num_windows) if num_windows is not None else F.floor((end - first) / step).cast("int") + 1
    begin = first if num_windows is not None else end - step * (n - 1)
    at = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: begin + step * i))
    return instances.where("cutoff is not null").select("instance_id", at.alias("us")).select("instance_id", F.timestamp_micros("us").cast(kind).alias("time"))


def recommended_primitives(df: DataFrame, numeric: list[str]) -> dict[str, list[str]]:
    """Transforms that suit skewed positive columns: square_root for a skew of 0.5 to 1, natural_logarithm above."""
    if not numeric:
        return {}
    row = df.agg(
        *[F.skewness(q(c)).alias(f"s{i}") for i, c in enumerate(numeric)], *[F.min(q(c)).alias(f"m{i}") for i, c in enumerate(numeric)],
        *[F.count_if(q(c).isNull()).alias(f"n{i}") for i, c in enumerate(numeric)],
    ).first()
    out: dict[str, list[str]] = {}
    for i, c in enumerate(numeric):
        s = row[f"s{i}"]
        if s is None or row[f"n{i}"] or row[f"m{i}"] <= 0:
            continue
        if 0.5 < s < 1:
            out[c] = ["square_root"]
        elif s > 1:
            out[c] = ["natural_logarithm"]
    return out
