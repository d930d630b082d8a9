"""How primitives are declared: inputs, result, rules, and the Spark expression they stand for.

An aggregation is lowered in one of five ways, all over rows keyed by (entity, cutoff):
``plain`` gives an aggregate column; ``segments`` looks at the order of rows through
states that merge; ``layers`` first adds columns by windows that all share one sort;
``histogram`` aggregates counts per (key, value). ``stats`` are values aggregated per
key and joined back before. A transform gives a column; windows
are only used by those that depend on order. What no Spark expression can say takes
sorted columns by Arrow batches: ``stream`` primitives carry on from batch to batch,
``grouped`` ones need a group at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tallyloom.types import Schema, column_schema, template

AGGREGATIONS: dict[str, type] = {}
TRANSFORMS: dict[str, type] = {}

NUM = template(None, "numeric")
CAT = template(None, "category")
ANY = template()
BOOL = template("Boolean")
TIME = template("Datetime")
T_INDEX = template("Datetime", "time_index")
ANY_T_INDEX = template(None, "time_index")
INDEX = template(None, "index")
FOREIGN = template(None, "foreign_key")
TEXT = template("NaturalLanguage")
LATLONG = template("LatLong")
ORDINAL = template("Ordinal")

R_NUM = Schema(None, frozenset({"numeric"}))
R_DOUBLE = column_schema("Double")
R_INT = column_schema("Integer")
R_BOOL = column_schema("Boolean")
R_CAT = column_schema("Categorical")
R_ORD = column_schema("Ordinal")
R_TIME = column_schema("Datetime")


@dataclass
class Ctx:
    """What an expression may refer to beside its inputs."""

    cutoff: Column | None = None
    time: Column | None = None
    order: list[Column] | None = None
    keys: list[Column] | None = None
    schemas: list[Schema] | None = None
    orders: list | None = None
    prefix: str = ""

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def up_to(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def group(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def position(self) -> Column:
        """Sorts rows of a key by time, then index."""
        return F.struct(*self.order)

    def col(self, name: str) -> Column:
        return F.col(self.prefix + name)


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def snake(name: str) -> str:
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name.replace(" ", ""))
    return s.lower()


class Primitive:
    """Base of all primitives. Parameters are keyword arguments with class-wide defaults."""

    name = ""
    inputs: list[list[Schema]] = []
    returns: Schema | None = None  # None: as the input
    params: dict[str, Any] = {}
    default: Any = None
    outputs = 1
    commutative = False
    uses_calc_time = False
    stack_on_self = True
    stack_on: list | None = None
    stack_on_exclude: list | None = None
    base_of: list | None = None
    base_of_exclude: list | None = None
    describes = ""

    def __init__(self, **kwargs):
        unknown = set(kwargs) - set(self.params)
        if unknown:
            raise TypeError(f"{self.name} has no parameter {sorted(unknown)}")
        self.given = kwargs
        for k, v in {**self.params, **kwargs}.items():
            setattr(self, k, v)

    def number_output_features(self) -> int:
        return getattr(self, "n", 1) if self.outputs == "n" else self.outputs

    def args_string(self) -> str:
        return "".join(f", {k}={getattr(self, k)}" for k in self.params if getattr(self, k) != self.params[k])

    def key(self) -> tuple:
        return (type(self).__name__, self.args_string())

    def __eq__(self, other):
        return isinstance(other, Primitive) and self.key() == other.key()

    def __hash__(self):
        return hash(self.key())

    def __repr__(self):
        return f"<Primitive {self.name}{self.args_string()}>"

    def result(self, schemas: list[Schema]) -> Schema:
        if self.returns is None:
            return schemas[0].without("index", "time_index", "foreign_key")
        if self.returns.logical is None:
            return R_DOUBLE
        return self.returns


class AggregationPrimitive(Primitive):
    kind = "plain"

    def feature_name(self, bases: list[str], child: str, where: str, previous: str) -> str:
        inside = ", ".join(bases)
        return f"{self.name.upper()}({child}.{inside}{where}{previous}{self.args_string()})"

    def plain(self, v: list[Column], x: Ctx) -> Column:
        raise NotImplementedError


class TransformPrimitive(Primitive):
    kind = "column"
    full = False
    ordered = False
    looks_back = False  # a row's value depends on no later row

    def feature_name(self, bases: list[str]) -> str:
        return f"{self.name.upper()}({', '.join(bases)}{self.args_string()})"

    def column(self, v: list[Column], x: Ctx) -> Column:
        raise NotImplementedError


def _declare(base, registry, cls_name, inputs, returns, methods, flags):
    if inputs and not isinstance(inputs[0], list):
        inputs = [inputs]
    name = flags.pop("name", None) or snake(cls_name)
    cls = type(cls_name, (base,), {"name": name, "inputs": inputs, "returns": returns, **methods, **flags})
    registry[name] = cls
    return cls


def aggregation(cls_name: str, inputs, returns, plain=None, *, layers=None, stats=None, histogram=None, segments=None, **flags):
    """Declare an aggregation. Functions take (primitive, inputs, context); ``segments`` is (kind, column, result of the merged state)."""
    methods = {"plain": plain or histogram}
    if segments:
        methods.update(kind="segments", segments=segments, **({"stats": stats} if stats else {}))
    elif layers:
        methods.update(kind="layers", layers=layers)
    elif stats:
        methods.update(kind="stats", stats=stats)
    elif histogram:
        methods.update(kind="histogram")
    return _declare(AggregationPrimitive, AGGREGATIONS, cls_name, inputs, returns, methods, flags)


def transform(cls_name: str, inputs, returns, column=None, *, grouped=None, stream=None, **flags):
    """Declare a transform. ``column`` takes (primitive, inputs, context); ``grouped`` (primitive, pandas columns).

    ``stream`` makes, of the primitive, an object whose ``feed(values, new)`` gives the
    results of the next rows of sorted groups; it keeps what it needs between batches.
    """
    methods = {"column": column}
    if stream:
        methods.update(kind="stream", stream=stream, ordered=True)
    if grouped:
        methods.update(kind="grouped", grouped=grouped, ordered=True)
    if flags.get("full"):
        flags["ordered"] = True
    return _declare(TransformPrimitive, TRANSFORMS, cls_name, inputs, returns, methods, flags)


def lookup(primitive, kind: str) -> Primitive:
    """An instance from a name, a class or an instance."""
    registry, base = (TRANSFORMS, TransformPrimitive) if "trans" in kind else (AGGREGATIONS, AggregationPrimitive)
    if isinstance(primitive, str):
        name = snake(primitive)
        if name not in registry:
            raise ValueError(f"Unknown {kind} primitive {primitive}")
        primitive = registry[name]
    if isinstance(primitive, type):
        primitive = primitive()
    if not isinstance(primitive, base):
        raise ValueError(f"{primitive!r} is not a {kind} primitive")
    return primitive


def safe_div(a: Column, b: Column) -> Column:
    """Division as in floating point: x/0 is an infinity of x's sign, 0/0 is null."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when(a == 0, F.lit(None)).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))).otherwise(F.try_divide(a, b))


#: Seconds per unit when spans are reported in a unit.
UNIT_SECONDS = {
    "years": 31540000, "months": 2628000, "days": 86400, "hours": 3600, "minutes": 60, "seconds": 1, "milliseconds": 0.001, "nanoseconds": 1e-9,
}


def in_unit(seconds: Column, unit: str) -> Column:
    if unit not in UNIT_SECONDS:
        raise ValueError(f"Invalid unit given, make sure it is plural: {unit}")
    return seconds / F.lit(float(UNIT_SECONDS[unit]))
