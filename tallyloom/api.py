"""The public names in one place."""

from tallyloom.entityset import EntitySet, Relationship, read_entityset
from tallyloom.features import (
    AggregationFeature, DirectFeature, Feature, GroupByTransformFeature, IdentityFeature, TransformFeature, describe_feature, graph_feature,
    load_features, save_features,
)
from tallyloom.functions.base import AGGREGATIONS, TRANSFORMS, AggregationPrimitive, TransformPrimitive, aggregation, transform
from tallyloom.operators.postprocess import (
    encode_features, make_temporal_cutoffs, recommended_primitives, remove_highly_correlated_features, remove_highly_null_features,
    remove_low_information_features, remove_single_value_features, replace_inf_values,
)
from tallyloom.plans.executor import calculate_feature_matrix
from tallyloom.plans.planner import DeepFeatureSynthesis, dfs, get_valid_primitives, list_primitives, summarize_primitives
from tallyloom.functions.scalars import add_calendar
from tallyloom.info import show_info
from tallyloom.plans.recommend import get_recommended_primitives
from tallyloom.timedelta import Timedelta

__all__ = [n for n in dir() if not n.startswith("_")]
