"""Feature enumeration from a schema alone: no data, one table, depth one."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from itertools import combinations, permutations

from tallyloom.features import retold, told
from tallyloom.functions.base import TRANSFORMS, Primitive, TransformPrimitive, lookup
from tallyloom.types import Schema, column_schema


@dataclass(frozen=True)
class LiteFeature:
    """A column, or a primitive over columns, known by name and type only."""

    name: str
    schema: Schema
    primitive: Primitive | None = None
    bases: tuple[LiteFeature, ...] = ()
    output: int | None = None
    alias: str | None = field(default=None, compare=False)

    @property
    def id(self) -> str:
        parts = [self.name, self.schema.logical, sorted(self.schema.tags), self.primitive and list(self.primitive.key()), [b.id for b in self.bases], self.output]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()

    @property
    def depth(self) -> int:
        return max((b.depth for b in self.bases), default=-1) + 1

    def rename(self, alias: str) -> LiteFeature:
        return LiteFeature(self.name, self.schema, self.primitive, self.bases, self.output, alias)

    def columns(self) -> set[str]:
        return {self.name} if not self.bases else {c for b in self.bases for c in b.columns()}

    def to_dict(self) -> dict:
        return {
            "name": self.name, "alias": self.alias, "logical": self.schema.logical, "tags": sorted(self.schema.tags), "output": self.output,
            "primitive": self.primitive and {"name": self.primitive.name, "args": {k: told(v) for k, v in self.primitive.given.items()}}, "bases": [b.to_dict() for b in self.bases],
        }

    @staticmethod
    def from_dict(d: dict) -> LiteFeature:
        p = d["primitive"]
        made = lookup(p["name"], "transform").__class__(**{k: retold(v) for k, v in p["args"].items()}) if p else None
        return LiteFeature(d["name"], Schema(d["logical"], frozenset(d["tags"])), made, tuple(LiteFeature.from_dict(b) for b in d["bases"]), d["output"], d["alias"])


class FeatureCollection:
    """Features indexed by name, type, tag, primitive and origin."""

    def __init__(self, features):
        self.features = list(dict.fromkeys(features))

    def __len__(self):
        return len(self.features)

    def __iter__(self):
        return iter(self.features)

    def __eq__(self, other):
        return isinstance(other, FeatureCollection) and set(self.features) == set(other.features)

    __hash__ = None

    def by_name(self, name: str) -> LiteFeature:
        for f in self.features:
            if name in (f.name, f.alias):
                return f
        raise KeyError(name)

    def by_logical_type(self, logical: str) -> list[LiteFeature]:
        return [f for f in self.features if f.schema.logical == logical]

    def by_tag(self, tag: str) -> list[LiteFeature]:
        return [f for f in self.features if tag in f.schema.tags]

    def by_primitive(self, name: str) -> list[LiteFeature]:
        return [f for f in self.features if f.primitive is not None and f.primitive.name == name]

    def by_origin(self, column: str) -> list[LiteFeature]:
        return [f for f in self.features if column in f.columns()]

    def matching(self, wanted: Schema) -> list[LiteFeature]:
        return [f for f in self.features if wanted.accepts(f.schema)]

    def to_json(self) -> str:
        return json.dumps([f.to_dict() for f in self.features])

    @staticmethod
    def from_json(text: str) -> FeatureCollection:
        return FeatureCollection([LiteFeature.from_dict(d) for d in json.loads(text)])

    def to_features(self, es, table: str):
        """Definitions bound to a table of an entity set."""
        from tallyloom.features import Feature, IdentityFeature, TransformFeature

        def make(f: LiteFeature) -> Feature:
            if f.primitive is None:
                return IdentityFeature(es, table, f.name)
            g: Feature = TransformFeature([make(b) for b in f.bases], f.primitive)
            g = g[f.output] if f.output is not None else g
            return g.rename(f.alias) if f.alias else g

        return [make(f) for f in self.features]


def schema_to_features(columns: dict[str, Schema | str]) -> list[LiteFeature]:
    return [LiteFeature(c, s if isinstance(s, Schema) else column_schema(s)) for c, s in columns.items()]


def generate_features_from_primitives(origin: list[LiteFeature], primitives) -> list[LiteFeature]:
    """All features of the primitives over the given ones; one order for commutative primitives."""
    pool = FeatureCollection(origin)
    out = list(origin)
    for given in primitives:
        p = lookup(given, "transform")
        seen = set()
        for templates in p.inputs:
            choose = combinations if p.commutative and len(set(templates)) == 1 else permutations
            for bases in choose([f for f in pool if any(t.accepts(f.schema) for t in templates)], len(templates)):
                if not all(t.accepts(b.schema) for t, b in zip(templates, bases)) or any("index" in b.schema.tags for b in bases):
                    continue
                key = frozenset(bases) if p.commutative else bases
                if key in seen:
                    continue
                seen.add(key)
                names = [b.alias or b.name for b in bases]
                text = getattr(p, "named", None)
                name = text(names) if text else p.feature_name(names)
                schema = p.result([b.schema for b in bases])
                n = p.number_output_features()
                out += [LiteFeature(name, schema, p, tuple(bases))] if n == 1 else [LiteFeature(f"{name}[{i}]", schema, p, tuple(bases), i) for i in range(n)]
    return out


__all__ = ["FeatureCollection", "LiteFeature", "TRANSFORMS", "TransformPrimitive", "generate_features_from_primitives", "schema_to_features"]
