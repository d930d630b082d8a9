"""Feature definitions: a graph of expressions over the columns of an entity set."""

from __future__ import annotations

import json
from datetime import date, datetime

from tallyloom.entityset import EntitySet, Relationship
from tallyloom.functions.base import AggregationPrimitive, Primitive, lookup
from tallyloom.timedelta import Timedelta
from tallyloom.types import Schema


class Feature:
    """A value per row of a table."""

    primitive: Primitive | None = None

    def __init__(self, es: EntitySet, table: str, bases: list[Feature], schema: Schema):
        self.es, self.table, self.base_features, self.schema = es, table, bases, schema
        self._name: str | None = None
        self._made: str | None = None

    # names
    def get_name(self) -> str:
        if self._name:
            return self._name
        if self._made is None:
            self._made = self.generate_name()
        return self._made

    def rename(self, name: str) -> Feature:
        """Set the name; features built on this one before keep theirs."""
        self._name = name
        return self

    def unique_name(self) -> str:
        return f"{self.table}: {self.get_name()}"

    def get_feature_names(self) -> list[str]:
        n = self.number_output_features
        return [self.get_name()] if n == 1 else [f"{self.get_name()}[{i}]" for i in range(n)]

    @property
    def number_output_features(self) -> int:
        return 1

    @property
    def default_value(self):
        return self.primitive.default if self.primitive else None

    def __repr__(self):
        return f"<Feature: {self.get_name()}>"

    def __hash__(self):
        return hash(self.unique_name())

    def same_as(self, other: Feature) -> bool:
        return isinstance(other, Feature) and type(self) is type(other) and self.unique_name() == other.unique_name()

    # graph
    def dependencies(self) -> list[Feature]:
        return list(self.base_features)

    def get_dependencies(self, deep: bool = False) -> list[Feature]:
        out = []
        for d in self.dependencies():
            out.append(d)
            if deep:
                out += d.get_dependencies(deep=True)
        return out

    def get_depth(self, stop_at=()) -> int:
        if any(self.same_as(s) for s in stop_at):
            return 0
        return max((d.get_depth(stop_at) for d in self.dependencies()), default=-1) + 1

    # algebra
    def _apply(self, two: str, one: str, other, reverse: str | None = None, **kw):
        if isinstance(other, Feature):
            return TransformFeature([self, other], two)
        return TransformFeature([self], lookup(reverse or one, "transform").__class__(value=other))

    def __add__(self, o):
        return self._apply("add_numeric", "add_numeric_scalar", o)

    __radd__ = __add__

    def __sub__(self, o):
        return self._apply("subtract_numeric", "subtract_numeric_scalar", o)

    def __rsub__(self, o):
        return self._apply("", "", o, "scalar_subtract_numeric_feature")

    def __mul__(self, o):
        if isinstance(o, Feature):
            bools = [f.schema.logical == "Boolean" for f in (self, o)]
            name = "multiply_boolean" if all(bools) else "multiply_numeric_boolean" if any(bools) else "multiply_numeric"
            return TransformFeature([self, o], name)
        return self._apply("", "multiply_numeric_scalar", o)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._apply("divide_numeric", "divide_numeric_scalar", o)

    def __rtruediv__(self, o):
        return self._apply("", "", o, "divide_by_feature")

    def __mod__(self, o):
        return self._apply("modulo_numeric", "modulo_numeric_scalar", o)

    def __rmod__(self, o):
        return self._apply("", "", o, "modulo_by_feature")

    def __eq__(self, o):
        return self._apply("equal", "equal_scalar", o)

    def __ne__(self, o):
        return self._apply("not_equal", "not_equal_scalar", o)

    def __gt__(self, o):
        return self._apply("greater_than", "greater_than_scalar", o)

    def __ge__(self, o):
        return self._apply("greater_than_equal_to", "greater_than_equal_to_scalar", o)

    def __lt__(self, o):
        return self._apply("less_than", "less_than_scalar", o)

    def __le__(self, o):
        return self._apply("less_than_equal_to", "less_than_equal_to_scalar", o)

    def __and__(self, o):
        return TransformFeature([self, o], "and")

    AND = __and__

    def __or__(self, o):
        return TransformFeature([self, o], "or")

    OR = __or__

    def __invert__(self):
        return TransformFeature([self], "not")

    NOT = __invert__

    def __neg__(self):
        return TransformFeature([self], "negate")

    def __abs__(self):
        return TransformFeature([self], "absolute")

    def isin(self, values: list):
        return TransformFeature([self], lookup("isin", "transform").__class__(list_of_outputs=list(values)))

    def is_null(self):
        return TransformFeature([self], "is_null")

    def __getitem__(self, i: int):
        if not 0 <= i < self.number_output_features:
            raise IndexError(f"{self.get_name()} has {self.number_output_features} outputs")
        return FeatureOutputSlice(self, i)


class IdentityFeature(Feature):
    def __init__(self, es: EntitySet, table: str, column: str):
        if column not in es[table].schemas:
            raise KeyError(f"no column {column} in {table}")
        super().__init__(es, table, [], es[table].schemas[column])
        self.column = column

    def generate_name(self):
        return self.column


class DirectFeature(Feature):
    """A parent's feature as seen from the child."""

    def __init__(self, base: Feature, child: str, relationship: Relationship | None = None):
        es = base.es
        if relationship is None:
            paths = [r for r in es.forward(child) if r.parent == base.table]
            if len(paths) != 1:
                raise RuntimeError(f"{len(paths)} relationships from {child} to {base.table}; give one")
            relationship = paths[0]
        super().__init__(es, child, [base], base.schema.without("index", "time_index"))
        self.relationship = relationship
        self.path = (relationship,)

    @property
    def number_output_features(self):
        return self.base_features[0].number_output_features

    @property
    def default_value(self):
        return self.base_features[0].default_value

    def generate_name(self):
        r = self.relationship
        one = self.es.has_unique_forward_path(self.table, r.parent)
        return f"{r.parent if one else f'{r.parent}[{r.child_column}]'}.{self.base_features[0].get_name()}"

    def get_feature_names(self):
        if self.number_output_features == 1:
            return [self.get_name()]
        head = self.get_name()[: -len(self.base_features[0].get_name())]
        return [head + n for n in self.base_features[0].get_feature_names()]


class AggregationFeature(Feature):
    """Rows of a descendant table aggregated per row of this table."""

    def __init__(self, bases, table: str, primitive, path: tuple | None = None, where: Feature | None = None, use_previous=None):
        bases = list(bases) if isinstance(bases, (list, tuple)) else [bases]
        es, child = bases[0].es, bases[0].table
        self.primitive = lookup(primitive, "aggregation")
        if path is None:
            paths = es.find_backward_paths(table, child)
            if len(paths) != 1:
                raise RuntimeError(f"{len(paths)} backward paths from {table} to {child}; give one")
            path = paths[0]
        if where is not None and where.table != child:
            raise ValueError(f"where must be defined on {child}")
        self.use_previous = None if use_previous is None else Timedelta.parse(use_previous)
        if self.use_previous is not None and es[child].time_index is None:
            raise ValueError("use_previous needs a time index")
        super().__init__(es, table, bases, self.primitive.result([b.schema for b in bases]))
        self.path, self.where, self.child = tuple(path), where, child

    @property
    def number_output_features(self):
        return self.primitive.number_output_features()

    def dependencies(self):
        return [*self.base_features, *([self.where] if self.where is not None else [])]

    def path_name(self) -> str:
        if len(self.es.find_backward_paths(self.table, self.child)) == 1:
            return self.child
        return ".".join(f"{r.child}[{r.child_column}]" for r in self.path)

    def generate_name(self):
        where = f" WHERE {self.where.get_name()}" if self.where is not None else ""
        previous = f", Last {self.use_previous.get_name()}" if self.use_previous is not None else ""
        names = [b.get_name() for b in self.base_features]
        if self.primitive.name == "count":
            return f"COUNT({self.path_name()}{where}{previous})"
        return self.primitive.feature_name(names, self.path_name(), where, previous)


class TransformFeature(Feature):
    def __init__(self, bases, primitive):
        bases = list(bases) if isinstance(bases, (list, tuple)) else [bases]
        if len({b.table for b in bases}) != 1:
            raise ValueError("inputs of a transform come from one table")
        self.primitive = lookup(primitive, "transform")
        super().__init__(bases[0].es, bases[0].table, bases, self.primitive.result([b.schema for b in bases]))

    @property
    def number_output_features(self):
        return self.primitive.number_output_features()

    def generate_name(self):
        names = [b.get_name() for b in self.base_features]
        text = getattr(self.primitive, "named", None)
        return text(names) if text else self.primitive.feature_name(names)


class GroupByTransformFeature(TransformFeature):
    """A transform within each group of another feature's value; rows without a group get the default."""

    def __init__(self, bases, primitive, groupby: Feature):
        super().__init__(bases, primitive)
        if groupby.table != self.table:
            raise ValueError("groupby comes from the same table")
        self.groupby = groupby

    def dependencies(self):
        return [*self.base_features, self.groupby]

    def generate_name(self):
        return f"{super().generate_name()} by {self.groupby.get_name()}"


class FeatureOutputSlice(Feature):
    def __init__(self, base: Feature, n: int):
        super().__init__(base.es, base.table, [base], base.schema)
        self.n, self.primitive = n, base.primitive

    def generate_name(self):
        return self.base_features[0].get_feature_names()[self.n]


def root_primitive(f: Feature) -> Primitive | None:
    return root_primitive(f.base_features[0]) if isinstance(f, DirectFeature) else f.primitive


# serialisation
VERSION = "1"


def told(v):
    """A parameter as JSON can hold it; sets, times and spans are marked so that ``retold`` gives them back."""
    if isinstance(v, (set, frozenset)):
        return {"set": sorted((told(x) for x in v), key=str)}
    if isinstance(v, (datetime, date)):
        return {"datetime" if isinstance(v, datetime) else "date": v.isoformat()}
    if isinstance(v, Timedelta):
        return {"span": v.to_dict()}
    if isinstance(v, (list, tuple)):
        return [told(x) for x in v] if isinstance(v, list) else {"tuple": [told(x) for x in v]}
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if hasattr(v, "item"):
        return v.item()
    raise TypeError(f"a parameter {v!r} cannot be saved")


def retold(v):
    if isinstance(v, list):
        return [retold(x) for x in v]
    if not isinstance(v, dict):
        return v
    ((kind, x),) = v.items()
    return {"set": lambda: frozenset(map(retold, x)), "tuple": lambda: tuple(map(retold, x)), "datetime": lambda: datetime.fromisoformat(x), "date": lambda: date.fromisoformat(x), "span": lambda: Timedelta(**x)}[kind]()


def save_features(features: list[Feature], location: str | None = None) -> str | None:
    """The graph of definitions as JSON text, or written to a file."""
    nodes: dict[str, dict] = {}

    def add(f: Feature) -> str:
        key = f"{type(f).__name__}|{f.unique_name()}"
        if key in nodes:
            return key
        d: dict = {"kind": type(f).__name__, "table": f.table, "name": f._name, "bases": [add(b) for b in f.base_features]}
        if isinstance(f, IdentityFeature):
            d["column"] = f.column
        elif isinstance(f, DirectFeature):
            d["path"] = [_rel(f.relationship)]
        elif isinstance(f, AggregationFeature):
            d["path"] = [_rel(r) for r in f.path]
            d["where"] = add(f.where) if f.where is not None else None
            d["use_previous"] = f.use_previous.to_dict() if f.use_previous else None
        elif isinstance(f, FeatureOutputSlice):
            d["n"] = f.n
        if isinstance(f, GroupByTransformFeature):
            d["groupby"] = add(f.groupby)
        if f.primitive is not None and not isinstance(f, FeatureOutputSlice):
            d["primitive"] = {"name": f.primitive.name, "args": {k: told(v) for k, v in f.primitive.given.items()}}
        nodes[key] = d
        return key

    tops = [add(f) for f in features]
    text = json.dumps({"version": VERSION, "features": tops, "definitions": nodes})
    if location is None:
        return text
    with open(location, "w", encoding="utf-8") as out:
        out.write(text)
    return None


def _rel(r: Relationship) -> list[str]:
    return [r.parent, r.parent_column, r.child, r.child_column]


def load_features(source: str, es: EntitySet) -> list[Feature]:
    """Definitions from JSON text or a file, bound to an entity set of the same schema."""
    if not source.lstrip().startswith("{"):
        source = open(source, encoding="utf-8").read()
    data = json.loads(source)
    if data["version"].split(".")[0] != VERSION:
        raise ValueError(f"definitions of version {data['version']} cannot be read")
    made: dict[str, Feature] = {}

    def get(key: str) -> Feature:
        if key in made:
            return made[key]
        d = data["definitions"][key]
        bases = [get(b) for b in d["bases"]]
        kind = d["kind"]
        if "primitive" in d:
            p = d["primitive"]
            base = lookup(p["name"], "aggregation" if kind == "AggregationFeature" else "transform").__class__(**{k: retold(v) for k, v in p["args"].items()})
        if kind == "IdentityFeature":
            f: Feature = IdentityFeature(es, d["table"], d["column"])
        elif kind == "DirectFeature":
            f = DirectFeature(bases[0], d["table"], Relationship(*d["path"][0]))
        elif kind == "AggregationFeature":
            prev = d["use_previous"]
            f = AggregationFeature(bases, d["table"], base, tuple(Relationship(*r) for r in d["path"]), get(d["where"]) if d["where"] else None, Timedelta(**prev) if prev else None)
        elif kind == "GroupByTransformFeature":
            f = GroupByTransformFeature(bases, base, get(d["groupby"]))
        elif kind == "TransformFeature":
            f = TransformFeature(bases, base)
        else:
            f = FeatureOutputSlice(bases[0], d["n"])
        if d["name"]:
            f.rename(d["name"])
        made[key] = f
        return f

    return [get(k) for k in data["features"]]


def describe_feature(f: Feature) -> str:
    """What a feature is, in a sentence."""

    def text(f: Feature) -> str:
        if f._name:
            return f'"{f._name}"'
        if isinstance(f, IdentityFeature):
            return f'the "{f.column}"'
        if isinstance(f, DirectFeature):
            return f'{text(f.base_features[0])} for the instance of "{f.relationship.parent}" associated with this instance of "{f.table}"'
        if isinstance(f, FeatureOutputSlice):
            return f"output {f.n + 1} of {text(f.base_features[0])}"
        what = f.primitive.name.replace("_", " ")
        inputs = " and ".join(text(b) for b in f.base_features)
        if isinstance(f, AggregationFeature):
            prev = f"the last {f.use_previous.get_name().lower()} of " if f.use_previous else ""
            where = f" where {text(f.where)} is true" if f.where is not None else ""
            of = "" if f.primitive.name == "count" else f" of {inputs}"
            return f'the {what}{of} of {prev}all instances of "{f.child}"{where} for each "{f.es[f.table].index}" in "{f.table}"'
        by = f' for each {text(f.groupby)}' if isinstance(f, GroupByTransformFeature) else ""
        return f"the {what} of {inputs}{by}"

    s = text(f)
    return s[0].upper() + s[1:] + "."


def graph_feature(f: Feature) -> str:
    """The definition's graph in DOT."""
    lines, seen = ["digraph feature {", "  rankdir=LR;"], set()

    def walk(g: Feature):
        if g.unique_name() in seen:
            return
        seen.add(g.unique_name())
        label = g.unique_name().replace('"', "'")
        lines.append(f'  "{label}" [shape={"box" if g.primitive else "ellipse"}];')
        for d in g.dependencies():
            lines.append(f'  "{d.unique_name().replace(chr(34), chr(39))}" -> "{label}";')
            walk(d)

    walk(f)
    return "\n".join([*lines, "}"])


__all__ = [
    "AggregationFeature", "AggregationPrimitive", "DirectFeature", "Feature", "FeatureOutputSlice", "GroupByTransformFeature",
    "IdentityFeature", "TransformFeature", "describe_feature", "graph_feature", "load_features", "save_features",
]
