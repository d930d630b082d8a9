"""Logical types and semantic tags of columns, and how they match the inputs of primitives."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Logical types and the tags that come with each.
STANDARD_TAGS = {
    "Integer": {"numeric"}, "Double": {"numeric"}, "AgeFractional": {"numeric"}, "Boolean": set(), "Datetime": set(),
    "Timedelta": set(), "Categorical": {"category"}, "Ordinal": {"category"}, "CountryCode": {"category"},
    "SubRegionCode": {"category"}, "PostalCode": {"category"}, "NaturalLanguage": set(), "URL": set(),
    "EmailAddress": set(), "Filepath": set(), "IPAddress": set(), "PersonFullName": set(), "PhoneNumber": set(),
    "LatLong": set(), "Unknown": set(),
}


@dataclass(frozen=True)
class Schema:
    """Type of a column, or a template when ``logical`` is None: any type that has the tags."""

    logical: str | None = None
    tags: frozenset = field(default_factory=frozenset)

    def accepts(self, other: Schema) -> bool:
        return (self.logical is None or self.logical == other.logical) and self.tags <= other.tags

    def without(self, *tags: str) -> Schema:
        return Schema(self.logical, self.tags - set(tags))


def column_schema(logical: str, *tags: str) -> Schema:
    if logical not in STANDARD_TAGS:
        raise ValueError(f"unknown logical type {logical}")
    return Schema(logical, frozenset(STANDARD_TAGS[logical] | set(tags)))


def template(logical: str | None = None, *tags: str) -> Schema:
    return Schema(logical, frozenset(tags))


def infer(kind: T.DataType) -> str:
    """Logical type of a Spark type: strings are categories unless said otherwise."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Double"
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "Datetime"
    if isinstance(kind, T.DayTimeIntervalType):
        return "Timedelta"
    if isinstance(kind, T.StringType):
        return "Categorical"
    if isinstance(kind, T.StructType) and [f.name for f in kind.fields] == ["lat", "lon"]:
        return "LatLong"
    return "Unknown"
