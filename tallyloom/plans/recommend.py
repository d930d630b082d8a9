"""Which transforms are worth trying on a table, judged by its schema and one pass over it."""

from __future__ import annotations

from tallyloom.entityset import EntitySet
from tallyloom.functions.base import TRANSFORMS
from tallyloom.operators.postprocess import _checked, _spans, recommended_primitives
from tallyloom.plans.executor import calculate_feature_matrix
from tallyloom.plans.planner import DeepFeatureSynthesis, get_valid_primitives

#: Transforms left out by default, as they need a parameter, are doubled by others, depend on an order, or make too many features.
EXCLUDED = [
    "count_string", "distance_to_holiday", "is_in_geobox", "not_equal_scalar", "equal_scalar", "time_since", "isin",
    "multiply_boolean", "numeric_lag",
    "cum_count", "cumulative_time_since_last_false", "cumulative_time_since_last_true", "diff", "diff_datetime", "is_first_occurrence", "is_last_occurrence", "time_since_previous",
    "not", "and", "or", "equal", "not_equal",
]


def time_series_transforms() -> set[str]:
    """Lags, and rolling and expanding windows."""
    return {n for n in TRANSFORMS if n == "lag" or n.startswith(("rolling_", "expanding_"))}


def get_recommended_primitives(entityset: EntitySet, include_time_series_primitives: bool = False, excluded_primitives=tuple(EXCLUDED)) -> list[str]:
    """Names of transforms that suit the only table of an entity set.

    Those on columns that are not numbers are recommended if a feature of theirs has two
    different values, a null counting as one: all such features are computed and judged
    in one pass. Skewed positive numbers get a root or a logarithm. Time-series
    transforms are recommended where they apply, if asked for.
    """
    if len(entityset.tables) != 1:
        raise IndexError("recommendations need an entity set of one table")
    ((name, table),) = entityset.tables.items()
    series = time_series_transforms()
    left_out = set(excluded_primitives) | (set() if include_time_series_primitives else series)
    valid = {p.name for p in get_valid_primitives(entityset, name, 1, [n for n in TRANSFORMS if n not in left_out])[1]}
    numbers = [c for c, s in table.schemas.items() if "numeric" in s.tags]
    plan = DeepFeatureSynthesis(name, entityset, agg_primitives=[], trans_primitives=sorted(valid - series), max_depth=1, ignore_columns={name: numbers})
    features = [f for f in plan.build_features("all") if f.primitive is not None]
    out = valid & series if include_time_series_primitives else set()
    if features:
        matrix = calculate_feature_matrix(features, entityset)
        kept = [c for c in _checked(matrix) if c.name != table.index]
        varied = {c.name for c, (some, two, null) in zip(kept, _spans(matrix, kept)) if two or some and null}
        out |= {f.primitive.name for f in features if varied & set(f.get_feature_names())}
    for names in recommended_primitives(table.df, [c for c in numbers if c != table.index]).values():
        out |= set(names) & valid
    return sorted(out)
