"""Lowering of feature definitions to one lazy DataFrame with a row per (instance, cutoff).

Rows of every table carry ``__ctx``, the cutoff they are seen from. With one cutoff
it is a literal, and the visibility of rows a filter on the scan. With a table of
cutoffs no pass per cutoff is made:

- aggregations whose states merge take each row once, at the first cutoff of its
  instance that sees it, and a running window adds the states up;
- within a span of time, or the last n rows, rows meet the cutoffs of their instance
  through a join on the instance and a bucket of the span, so few pairs are made that
  the span does not hold;
- other aggregations over all of the past need, and make, a pair of each row and
  cutoff of an instance that sees it.

Aggregations with mergeable states share one grouping, whatever their conditions.
"""

from __future__ import annotations

import warnings
from collections import defaultdict
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyloom.entityset import LTI, EntitySet, dense_index, q
from tallyloom.features import (
    AggregationFeature, DirectFeature, Feature, FeatureOutputSlice, GroupByTransformFeature, IdentityFeature, TransformFeature,
)
from tallyloom.functions.base import Ctx, micros
from tallyloom.functions.segments import merged, segment_states
from tallyloom.functions.states import MERGES, has_states, parts_of, result_of
from tallyloom.timedelta import Timedelta

ID, CTX, KEY, APPROX = "__id", "__ctx", "__key", "__actx"
ORDINAL = "__row"
CHUNKS = 32


def _kind(f: Feature) -> type:
    for k in (IdentityFeature, DirectFeature, AggregationFeature, FeatureOutputSlice, GroupByTransformFeature, TransformFeature):
        if isinstance(f, k):
            return k
    raise TypeError(f)


def _same_table_deps(f: Feature) -> list[Feature]:
    return [] if isinstance(f, (IdentityFeature, DirectFeature, AggregationFeature)) else f.dependencies()


class Lowering:
    def __init__(self, es: EntitySet, target: str, at: Column | None, training_window, include: bool, approximate, restricted: bool):
        self.es, self.target, self.at, self.include = es, target, at, include
        self.window = None if training_window is None else Timedelta.parse(training_window)
        self.approximate = None if approximate is None else Timedelta.parse(approximate)
        self.restricted = restricted
        self.names: dict[tuple, str] = {}
        self.contexts: DataFrame | None = None

    def name(self, f: Feature) -> str:
        key = (_kind(f).__name__, f.unique_name())
        return self.names.setdefault(key, f"__f{len(self.names)}")

    # rows
    def visible(self, table: str, df: DataFrame) -> DataFrame:
        """Rows of the table seen from their context, with secondary columns masked."""
        t = self.es[table]
        if t.time_index:
            time, ctx = q(t.time_index), F.col(CTX)
            seen = time <= ctx if self.include else time < ctx
            if self.window is not None:
                since = self.window.before(ctx, t.time_is_number)
                later = (lambda c: c > since) if self.include else (lambda c: c >= since)
                fresh = later(time)
                if t.last_times is not None:
                    last = t.last_times.select(q(t.index).alias("__lid"), F.col(LTI).alias("__lti"))
                    df = df.join(last, q(t.index) == F.col("__lid"), "left").drop("__lid")
                    fresh = fresh | F.coalesce(later(F.col("__lti")), F.lit(False))
                else:
                    warnings.warn("Using training_window but last_time_index is not set", stacklevel=2)
                seen = seen & fresh
            df = df.where(seen)
            if "__lti" in df.columns:
                df = df.drop("__lti")
        for s, cols in t.secondary.items():
            early = q(s) < F.col(CTX)
            df = df.withColumns({c: F.when(early, q(c)) for c in [*cols, s]})
        return df.withColumn(ID, q(t.index))

    def rows(self, table: str, ids: DataFrame | None) -> DataFrame:
        """The table's rows for (id, context) pairs, or all of them for every context."""
        t = self.es[table]
        if self.at is not None:
            df = self.visible(table, t.df.withColumn(CTX, self.at))
            return df if ids is None else df.join(ids.select(ID).distinct(), ID, "left_semi")
        if ids is None:
            return self.visible(table, self.at_every_context(t))
        pairs = ids.select(F.col(ID).alias("__pid"), CTX).distinct()
        return self.visible(table, t.df.join(pairs, q(t.index) == F.col("__pid")).drop("__pid"))

    def at_every_context(self, t) -> DataFrame:
        """The table's rows once per cutoff time that sees them, for windows over the whole table that each cutoff changes.

        The cutoff times are dealt into CHUNKS, every row is sent to each chunk, and the
        rest is a join on the chunk: neither side has to fit a broadcast.
        """
        rows = t.df.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))
        times = self.contexts.select(F.col(CTX), F.pmod(F.hash(CTX), F.lit(CHUNKS)).alias("__tchunk"))
        on = F.col("__chunk") == F.col("__tchunk")
        if t.time_index:
            on = on & (q(t.time_index) <= F.col(CTX) if self.include else q(t.time_index) < F.col(CTX))
        return rows.join(times, on).drop("__chunk", "__tchunk")

    def free(self, f: Feature) -> bool:
        """Whether the feature is a plain expression of its row, the same at every cutoff."""
        if isinstance(f, IdentityFeature):
            return not self.es[f.table].secondary
        if type(f) is not TransformFeature:
            return False
        p = f.primitive
        return p.kind == "column" and not (p.full or p.ordered or p.uses_calc_time) and all(self.free(b) for b in f.base_features)

    def steady(self, table: str, f: Feature) -> bool:
        """Whether a window over the whole table gives a row the same value at every cutoff that sees it.

        So it is if no row comes or goes: in a table without times, or where the window
        looks back only and a cutoff hides a tail of the order.
        """
        p, t = f.primitive, self.es[table]
        inputs = [*f.base_features, *([f.groupby] if isinstance(f, GroupByTransformFeature) else [])]
        if p.uses_calc_time or not all(self.free(b) for b in inputs):
            return False
        return t.time_index is None or self.window is None and p.looks_back

    # features
    def evaluate(self, table: str, frame: DataFrame, feats: list[Feature], full: bool = False) -> DataFrame:
        """Append a column per feature (an array for those of several outputs)."""
        todo: dict[str, Feature] = {}

        def visit(f: Feature):
            if self.name(f) in todo:
                return
            for dep in _same_table_deps(f):
                visit(dep)
            todo[self.name(f)] = f

        for f in feats:
            visit(f)
        done: set[str] = set(frame.columns)
        while todo:
            ready = {n: f for n, f in todo.items() if n in done or all(self.name(x) in done for x in _same_table_deps(f))}
            by: dict = defaultdict(dict)
            for n, f in ready.items():
                if n not in done:
                    by[_kind(f)][n] = f
            if by[IdentityFeature]:
                frame = frame.withColumns({n: q(f.column) for n, f in by[IdentityFeature].items()})
            if by[FeatureOutputSlice]:
                frame = frame.withColumns({n: F.get(F.col(self.name(f.base_features[0])), f.n) for n, f in by[FeatureOutputSlice].items()})
            paths: dict = defaultdict(list)
            for f in by[AggregationFeature].values():
                paths[f.path].append(f)
            for path, fs in paths.items():
                frame = self.aggregate(frame, path, fs)
            rels: dict = defaultdict(list)
            for f in by[DirectFeature].values():
                late = self.approximate is not None and table == self.target and isinstance(f.base_features[0], AggregationFeature)
                rels[f.relationship, late].append(f)
            for (rel, late), fs in rels.items():
                frame = self.direct(frame, rel, fs, late)
            trans = {**by[TransformFeature], **by[GroupByTransformFeature]}
            wide = {n: f for n, f in trans.items() if f.primitive.full and not full and self.differs(table)}
            steady = {n: f for n, f in wide.items() if self.at is None and self.steady(table, f)}
            if steady:
                t = self.es[table]
                once = t.df.withColumn(CTX, F.lit(None).cast(self.contexts.schema[CTX].dataType)).withColumn(ID, q(t.index))
                side = self.evaluate(table, once, list(steady.values()), full=True).select(F.col(ID).alias("__wid"), *steady)
                frame = frame.join(side, F.col(ID) == F.col("__wid"), "left").drop("__wid")
                wide = {n: f for n, f in wide.items() if n not in steady}
            trans = {n: f for n, f in trans.items() if n not in steady}
            if wide:
                got = self.evaluate(table, self.rows(table, None), list(wide.values()), full=True)
                side = got.select(F.col(ID).alias("__wid"), F.col(CTX).alias("__wctx"), *wide)
                on = F.col(ID) == F.col("__wid")
                if self.at is None:
                    on = on & (F.col(CTX) == F.col("__wctx"))
                frame = frame.join(side, on, "left").drop("__wid", "__wctx")
            frame = self.transforms(table, frame, {n: f for n, f in trans.items() if n not in wide})
            for n in ready:
                done.add(n)
                del todo[n]
        return frame

    def differs(self, table: str) -> bool:
        """Whether a frame of this table may lack rows that are visible at its cutoffs."""
        return self.restricted or self.at is None or table != self.target

    def transforms(self, table: str, frame: DataFrame, feats: dict[str, Feature]) -> DataFrame:
        t = self.es[table]
        plain: dict[str, Column] = {}
        for n, f in feats.items():
            p = f.primitive
            grouped = isinstance(f, GroupByTransformFeature)
            group = [F.col(self.name(f.groupby))] if grouped else []
            keys = ([F.col(CTX)] if self.at is None or not group else []) + group
            order = ([q(t.time_index)] if t.time_index else []) + [q(t.index)]
            v = [F.col(self.name(b)) for b in f.base_features]
            levels = [t.orders.get(getattr(b, "column", None)) for b in f.base_features]
            x = Ctx(F.col(CTX), order[0] if t.time_index else None, order, keys or [F.lit(0)], [b.schema for b in f.base_features], levels, f"{n}_")
            if p.kind in ("grouped", "stream"):
                frame = self.by_group(frame, n, f, keys, order, v)
            else:
                before = p.before(v, x) if hasattr(p, "before") else {}
                if before:
                    frame = frame.withColumns({x.prefix + k: c for k, c in before.items()})
                plain[n] = p.column(v, x)
            if grouped:
                base = plain.get(n, F.col(n))
                rest = F.lit(None) if p.default is None else F.lit(p.default)
                plain[n] = F.when(group[0].isNotNull(), base).otherwise(rest)
        return frame.withColumns(plain) if plain else frame

    def by_group(self, frame: DataFrame, name: str, f: Feature, keys, order, v) -> DataFrame:
        """A function of each group's sorted column: fed batch by batch, or, where it needs the group at once, group by group."""
        p, k = f.primitive, len(keys)
        names = [f"k{i}" for i in range(k)] + ["o0", "o1"][: len(order)] + [f"v{i}" for i in range(len(v))]
        cols = [c.alias(a) for c, a in zip([*keys, *order, *v], names)]
        part = frame.select(F.col(ID).alias("__gid"), F.col(CTX).alias("__gctx"), *cols)
        kinds = part.select("__gid", "__gctx").schema
        schema = T.StructType([*kinds.fields, T.StructField(name, T.DoubleType())])
        orders = [a for a in names if a.startswith("o")]
        values = [a for a in names if a.startswith("v")]

        def run(pdf):
            pdf = pdf.sort_values(orders, kind="stable")
            pdf[name] = p.grouped([pdf[c].reset_index(drop=True) for c in values]).to_numpy()
            return pdf[["__gid", "__gctx", name]]

        if p.kind == "stream":
            part = part.withColumns({a: F.col(a).cast("double") for a in values})
            got = part.repartition(*names[:k]).sortWithinPartitions(*names[:k], *orders).mapInArrow(_fed(p, k, name, len(orders)), schema)
        else:
            got = part.groupBy(*names[:k]).applyInPandas(run, schema)
        on = F.col(ID) == F.col("__gid")
        if self.at is None:
            on = on & (F.col(CTX) == F.col("__gctx"))
        return frame.join(got, on, "left").drop("__gid", "__gctx")

    def direct(self, frame: DataFrame, rel, feats: list[DirectFeature], late: bool) -> DataFrame:
        """Left join of the parents that the rows need."""
        ctx = APPROX if late else CTX
        bases = [f.base_features[0] for f in feats]
        narrow = self.at is None or late or self.restricted and self.order_matters(bases)
        ids = frame.select(q(rel.child_column).alias(ID), F.col(ctx).alias(CTX)).where(F.col(ID).isNotNull()) if narrow else None
        if late:
            inner = Lowering(self.es, rel.parent, None, self.window, self.include, None, True)
            inner.window, inner.contexts, inner.names = self.window, ids.select(CTX).distinct(), self.names
            got = inner.evaluate(rel.parent, inner.rows(rel.parent, ids), bases)
        else:
            got = self.evaluate(rel.parent, self.rows(rel.parent, ids), bases)
        side = got.select(F.col(ID).alias("__did"), F.col(CTX).alias("__dctx"), *[F.col(self.name(b)).alias(self.name(f)) for f, b in zip(feats, bases)])
        on = q(rel.child_column) == F.col("__did")
        if self.at is None or late:
            on = on & (F.col(ctx) == F.col("__dctx"))
        return self.fill(frame.join(side, on, "left").drop("__did", "__dctx"), feats)

    def order_matters(self, feats: list[Feature]) -> bool:
        return any(getattr(g.primitive, "ordered", False) for f in feats for g in [f, *f.get_dependencies(deep=True)])

    def fill(self, frame: DataFrame, feats: list[Feature], only: Column | None = None) -> DataFrame:
        """Defaults for nulls, or for the rows where ``only`` holds."""
        cols = {}
        kinds = {c.name: c.dataType for c in frame.schema.fields} if any(f.default_value is not None for f in feats) else {}
        for f in feats:
            n = self.name(f)
            kind = kinds.get(n)
            if f.default_value is not None and not isinstance(kind, T.ArrayType):
                default = F.lit(f.default_value).cast(kind)
                cols[n] = F.coalesce(F.col(n), default) if only is None else F.when(only, default).otherwise(F.col(n))
        return frame.withColumns(cols) if cols else frame

    def aggregate(self, frame: DataFrame, path: tuple, feats: list[AggregationFeature]) -> DataFrame:
        """Group the rows at the end of the path by the ancestor and join the results to it."""
        plans: dict = defaultdict(list)
        for f in feats:
            plans[self.how(path, f)].append(f)
        for (how, previous), fs in plans.items():
            if how == "running":
                frame = self.joined(frame, self.running(frame, path[0], fs))
                continue
            rows, last = self.related(frame, path, how, previous, fs[0].where if how == "latest" else None)
            needed = {self.name(d): d for f in fs for d in f.dependencies()}
            rows = self.evaluate(path[-1].child, rows, list(needed.values()))
            keys = [KEY] if self.at is not None else [KEY, CTX]
            together = [f for f in fs if has_states(f.primitive) and not (f.use_previous and f.use_previous.is_observations)]
            if together:
                frame = self.joined(frame, self.conditional(path[-1].child, rows, keys, together))
            kinds: dict = defaultdict(list)
            done = {self.name(f) for f in together}
            for f in fs:
                if self.name(f) not in done:
                    kinds[self.name(f.where) if f.where is not None else None, f.use_previous].append(f)
            for (where, span), group in sorted(kinds.items(), key=str):
                part = rows.where(F.col(where)) if where else rows
                part = part if last else self.recent(path[-1].child, part, span, keys)
                for got in self.group(path[-1].child, part, keys, group):
                    frame = self.joined(frame, got)
        return self.fill(frame, feats)

    def joined(self, frame: DataFrame, got: DataFrame) -> DataFrame:
        """The frame with the columns of a table by KEY and, if it has it, CTX."""
        on = F.col(ID) == F.col("__akey")
        if CTX in got.columns:
            got = got.withColumnRenamed(CTX, "__actx2")
            on = on & (F.col(CTX) == F.col("__actx2"))
        return frame.join(got.withColumnRenamed(KEY, "__akey"), on, "left").drop("__akey", "__actx2")

    def how(self, path: tuple, f: AggregationFeature) -> tuple:
        """How rows meet cutoffs: ("running", None), ("latest", span), ("near", span) or ("pairs", None)."""
        t, span = self.es[path[0].child], f.use_previous
        if self.at is not None or len(path) > 1 or t.time_index is None:
            return "pairs", None
        free = all(self.free(b) for b in [*f.base_features, *([f.where] if f.where is not None else [])])
        if span is None:
            return ("running" if free and self.window is None and has_states(f.primitive) else "pairs"), None
        if not span.is_observations:
            return "near", span
        return ("latest", (span, f.where.unique_name() if f.where is not None else None)) if free and self.window is None else ("pairs", None)

    def related(self, frame: DataFrame, path: tuple, how: str, previous, where: Feature | None) -> tuple[DataFrame, bool]:
        """The rows at the end of the path with the KEY and CTX they belong to, and whether they are the last n already."""
        first = path[0]
        t = self.es[first.child]
        child = t.df.where(q(first.child_column).isNotNull())
        if how == "latest":
            return self.latest(frame, first, int(previous[0].value), where), True
        if self.at is not None:
            rows = child.withColumn(CTX, self.at).withColumn(KEY, q(first.child_column))
            if self.restricted:
                rows = rows.join(frame.select(F.col(ID).alias("__pid")), F.col(KEY) == F.col("__pid"), "left_semi")
        else:
            pairs = frame.select(F.col(ID).alias(KEY), CTX)
            spans = [x for x in (self.window if t.last_times is None else None, previous) if x is not None]
            if t.time_index and spans:
                rows = self.near(child, first.child_column, t, pairs, min(spans, key=lambda x: x.at_most()))
            else:
                rows = child.join(pairs, q(first.child_column) == F.col(KEY))
        rows = self.visible(first.child, rows)
        for r in path[1:]:
            above = rows.select(F.col(ID).alias("__mid"), KEY, CTX)
            rows = self.visible(r.child, self.es[r.child].df.join(above, q(r.child_column) == F.col("__mid")).drop("__mid"))
        return rows, False

    def near(self, child: DataFrame, column: str, t, pairs: DataFrame, span: Timedelta) -> DataFrame:
        """Rows with the cutoffs of their key less than about two spans later, by a join on key and bucket."""
        width = max(1, int(-(-span.at_most() // 1))) if t.time_is_number else max(1, int(span.at_most() * 1_000_000))
        place = lambda c: F.floor((c if t.time_is_number else micros(c)) / F.lit(width))
        here = place(F.col(CTX))
        pairs = pairs.withColumn("__bucket", F.explode(F.array(here - 1, here)))
        rows = child.withColumn("__rbucket", place(q(t.time_index)))
        return rows.join(pairs, (q(column) == F.col(KEY)) & (F.col("__rbucket") == F.col("__bucket"))).drop("__bucket", "__rbucket")

    def timeline(self, frame: DataFrame, rows: DataFrame, t, cols: list[Column]) -> tuple[DataFrame, list[Column]]:
        """Rows and cutoffs of all keys in one table, and the order in which each cutoff stands right after the last row it sees."""
        events = rows.select(KEY, q(t.time_index).alias("__at"), F.lit(False).alias("__cut"), q(t.index).alias("__idx"), *cols)
        cuts = frame.select(F.col(ID).alias(KEY), F.col(CTX).alias("__at"), F.lit(True).alias("__cut")).distinct()
        tie = F.col("__cut") if self.include else ~F.col("__cut")
        return events.unionByName(cuts, allowMissingColumns=True), [F.col("__at"), tie, F.col("__idx")]

    def child_rows(self, rel, needed: list[Feature]) -> DataFrame:
        """The child's rows with plain features, seen from no cutoff in particular."""
        t = self.es[rel.child]
        rows = t.df.where(q(rel.child_column).isNotNull() & q(t.time_index).isNotNull())
        rows = rows.withColumn(CTX, F.lit(None).cast(self.contexts.schema[CTX].dataType)).withColumn(KEY, q(rel.child_column)).withColumn(ID, q(t.index))
        return self.evaluate(rel.child, rows, needed)

    def running(self, frame: DataFrame, rel, feats: list[AggregationFeature]) -> DataFrame:
        """States by (KEY, CTX): every row counts at the first cutoff of its key that sees it, then cutoffs add up in order.

        One shuffle by key; a key with n rows and k cutoffs is n + k rows sorted, then k states.
        """
        t = self.es[rel.child]
        rows = self.child_rows(rel, list({self.name(d): d for f in feats for d in f.dependencies()}.values()))
        parts, use = self.parts(rel.child, feats)
        both, order = self.timeline(frame, rows, t, [c.alias(k) for k, (c, _) in parts.items()])
        backwards = Window.partitionBy(KEY).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = both.withColumn(CTX, F.last(F.when(F.col("__cut"), F.col("__at")), ignorenulls=True).over(backwards)).where(F.col(CTX).isNotNull())
        steps = seen.groupBy(KEY, CTX).agg(*[MERGES[how](k).alias(k) for k, (_, how) in parts.items()])
        so_far = Window.partitionBy(KEY).orderBy(CTX).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return steps.select(KEY, CTX, *[MERGES[how](k).over(so_far).alias(k) for k, (_, how) in parts.items()]).select(KEY, CTX, *use)

    def conditional(self, table: str, rows: DataFrame, keys: list[str], feats: list[AggregationFeature]) -> DataFrame:
        """All features with mergeable states in one grouping, their conditions inside the states."""
        parts, use = self.parts(table, feats)
        got = rows.groupBy(*keys).agg(*[MERGES[how](c).alias(k) for k, (c, how) in parts.items()])
        return got.select(*keys, *use)

    def parts(self, table: str, feats: list[AggregationFeature]) -> tuple[dict, list[Column]]:
        """The states' parts of the features by column name, and the features' columns over merged parts."""
        t = self.es[table]
        order = ([q(t.time_index)] if t.time_index else []) + [q(t.index)]
        parts, use = {}, []
        for f in feats:
            n = self.name(f)
            x = Ctx(self.at if self.at is not None else F.col(CTX), order[0], order, None, [b.schema for b in f.base_features], None, f"{n}_")
            conditions = [F.col(self.name(f.where))] if f.where is not None else []
            if f.use_previous is not None:
                conditions.append(q(t.time_index) >= f.use_previous.before(x.cutoff, t.time_is_number))
            condition = None
            for c in conditions:
                condition = c if condition is None else condition & c
            own = parts_of(f.primitive, [F.col(self.name(b)) for b in f.base_features], x, condition)
            parts.update({x.prefix + k: c for k, c in own.items()})
            use.append(result_of(f.primitive, {k: x.col(k) for k in own}, x).alias(n))
        return parts, use

    def latest(self, frame: DataFrame, rel, n: int, where: Feature | None) -> DataFrame:
        """The last n rows that each cutoff sees (and that pass the condition): rows are numbered, a cutoff takes the numbers up to its own."""
        t = self.es[rel.child]
        rows = self.child_rows(rel, [where] if where is not None else [])
        rows = rows.where(F.col(self.name(where))) if where is not None else rows
        both, order = self.timeline(frame, rows, t, [F.struct(*[q(c).alias(c) for c in t.df.columns]).alias("__row")])
        so_far = Window.partitionBy(KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("__n", F.sum(F.when(F.col("__cut"), 0).otherwise(1)).over(so_far))
        bucket = lambda c: F.floor((c - 1) / F.lit(n))
        cuts = both.where("__cut").select(
            F.col(KEY).alias("__ckey"), F.col("__at").alias(CTX), F.col("__n").alias("__upto"), F.explode(F.array(bucket(F.col("__n")) - 1, bucket(F.col("__n")))).alias("__bucket")
        )
        numbered = both.where("not __cut").select(KEY, "__n", bucket(F.col("__n")).alias("__rbucket"), "__row")
        on = (F.col(KEY) == F.col("__ckey")) & (F.col("__bucket") == F.col("__rbucket")) & (F.col("__n") <= F.col("__upto")) & (F.col("__n") > F.col("__upto") - n)
        got = numbered.join(cuts, on).select(KEY, CTX, *[F.col("__row").getField(c).alias(c) for c in t.df.columns])
        return got.withColumn(ID, q(t.index))

    def recent(self, table: str, rows: DataFrame, previous: Timedelta | None, keys: list[str]) -> DataFrame:
        if previous is None:
            return rows
        t = self.es[table]
        if previous.is_observations:
            w = Window.partitionBy(*keys).orderBy(q(t.time_index).desc(), q(t.index).desc())
            return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= int(previous.value)).drop("__n")
        return rows.where(q(t.time_index) >= previous.before(F.col(CTX), t.time_is_number))

    def group(self, table: str, rows: DataFrame, keys: list[str], feats: list[AggregationFeature]) -> list[DataFrame]:
        t = self.es[table]
        order = ([q(t.time_index)] if t.time_index else []) + [q(t.index)]
        out, plain = [], []
        stats: dict[str, Column] = {}
        more: dict[str, Column] = {}
        ordered: dict[str, tuple] = {}
        layers: list[dict[str, Column]] = []
        for f in feats:
            n, p = self.name(f), f.primitive
            v = [F.col(self.name(b)) for b in f.base_features]
            x = Ctx(F.col(CTX), order[0], order, [F.col(k) for k in keys], [b.schema for b in f.base_features], None, f"{n}_")
            if p.kind == "histogram":
                out.append(self.histogram(rows, keys, n, p, self.name(f.base_features[0]), x))
                continue
            if hasattr(p, "stats"):
                stats.update({x.prefix + k: c for k, c in p.stats(v).items()})
                if hasattr(p, "more_stats"):
                    more.update({x.prefix + k: c for k, c in p.more_stats(v, x).items()})
            if p.kind == "layers":
                for i, layer in enumerate(p.layers(v, x)):
                    if len(layers) <= i:
                        layers.append({})
                    layers[i].update({x.prefix + k: c for k, c in layer.items()})
            if p.kind == "segments":
                kind, column, result = p.segments
                ordered[n] = (kind, column(p, v, x), result)
                continue
            plain.append(p.plain(v, x).alias(n))
        for of in (stats, more):
            if of:
                side = rows.groupBy(*keys).agg(*[c.alias(k) for k, c in of.items()])
                rows = rows.join(side, keys)
        if ordered:
            out.append(self.segments(rows, keys, order, ordered))
        if plain:
            for layer in layers:
                rows = rows.withColumns(layer)
            out.append(rows.groupBy(*keys).agg(*plain))
        return out

    def segments(self, rows: DataFrame, keys: list[str], order: list[Column], cols: dict[str, tuple]) -> DataFrame:
        """Aggregations over the order of rows: ranges of (key, order) as partitions, a state per key and range, then the states merged in order."""
        ks, os, vs = ([f"{a}{i}" for i in range(len(b))] for a, b in (("k", keys), ("o", order), ("v", cols)))
        picked = rows.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], *[c.alias(a) for c, a in zip(order, os)], *[c.alias(a) for (_, c, _), a in zip(cols.values(), vs)])
        spread = picked.repartitionByRange(*ks, *os).sortWithinPartitions(*ks, *os)
        states = [f"s{i}" for i in range(len(cols))]
        schema = T.StructType([*picked.select(*ks, *os).schema.fields, *[T.StructField(a, T.ArrayType(T.DoubleType())) for a in states]])
        parts = spread.mapInArrow(segment_states(len(ks), len(os), [k for k, _, _ in cols.values()]), schema)
        # as many segments of a key as partitions that hold it, each a few numbers
        got = parts.groupBy(*ks).agg(F.sort_array(F.collect_list(F.struct(*os, *states))).alias("__segments"))
        return got.select(
            *[F.col(a).alias(k) for a, k in zip(ks, keys)],
            *[result(merged(kind, F.col("__segments"), a)).alias(n) for (n, (kind, _, result)), a in zip(cols.items(), states)],
        )

    def histogram(self, rows: DataFrame, keys: list[str], name: str, p, value: str, x: Ctx) -> DataFrame:
        """Counts per (key, value), combined before the shuffle, then one more aggregation."""
        counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(x.prefix + "c"), F.min(x.position).alias(x.prefix + "seen"))
        if getattr(p, "ranked", False):
            skip = getattr(p, "skip_nulls", False) or getattr(p, "skipna", False)
            known = F.when(F.col(value).isNull(), 1).otherwise(0) if skip else F.lit(0)
            w = Window.partitionBy(*keys).orderBy(known, F.desc(x.prefix + "c"), F.col(x.prefix + "seen"))
            counts = counts.withColumn(x.prefix + "rank", F.row_number().over(w)).where(F.col(x.prefix + "rank") <= p.n)
        return counts.groupBy(*keys).agg(p.plain([F.col(value)], x).alias(name))


def _fed(p, keys: int, name: str, orders: int):
    """Arrow function over (id, ctx, keys, orders, value) sorted by keys and orders, that feeds a stream primitive."""

    def run(batches):
        state, last = p.stream(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = batch.columns[2 : 2 + keys]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                same = pc.equal(c.slice(1), c.slice(0, len(c) - 1))
                both = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, len(c) - 1)))
                new[1:] |= ~pc.or_(pc.fill_null(same, False), both).to_numpy(zero_copy_only=False)
            first = [c[0].as_py() for c in cols]
            new[0] = first != last
            last = [c[-1].as_py() for c in cols]
            x = batch.column(2 + keys + orders).to_numpy(zero_copy_only=False).astype(float)
            out = state.feed(x, new)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, mask=np.isnan(out))], ["__gid", "__gctx", name])

    return run


def _floor(ctx: Column, span: Timedelta, numeric: bool) -> Column:
    if numeric:
        return (F.floor(ctx / span.value) * span.value).cast("long")
    us = int(span.seconds * 1_000_000)
    return F.timestamp_micros((F.floor(micros(ctx) / us) * us).cast("long"))


def calculate_feature_matrix(
    features: list[Feature], entityset: EntitySet | None = None, cutoff_time=None, instance_ids: list | None = None,
    cutoff_time_in_index: bool = False, training_window=None, approximate=None, include_cutoff_time: bool = True, chunk_size=None,
    n_jobs: int = 1, verbose: bool = False, save_progress: str | None = None, check_duplicates: bool = False, keep_order: bool = False,
    progress_callback=None,
) -> DataFrame:
    """Feature values of instances as of their cutoffs.

    ``cutoff_time`` is None (now), one time, or a DataFrame of instance ids and times
    (columns instance_id or the target's index, and time or its time index; else the
    first two) whose other columns ride along. The result has the target's index,
    ``time`` if there is a table of cutoffs or cutoff_time_in_index, the extra columns,
    then the features. Rows are not ordered; there is one per instance, or per row of
    the cutoff table. Instances that do not exist or are not yet visible get defaults.

    With ``check_duplicates`` a job looks whether rows of the cutoff table repeat an
    instance and time, which is an error then. With ``keep_order`` the last column,
    __row, numbers the rows of the cutoff table (or the instance ids) as they came.
    ``progress_callback(done, total, features)`` is called when the plan stands and,
    with save_progress, when the matrix is written.

    chunk_size and n_jobs have no effect: Spark splits the work.
    """
    if not features:
        raise ValueError("features must not be empty")
    for f in features:
        if not isinstance(f, Feature):
            raise TypeError("features must be Feature objects")
    es = entityset or features[0].es
    target = features[0].table
    if any(f.table != target for f in features):
        raise ValueError("features must be of one table")
    if n_jobs != 1 or chunk_size is not None:
        warnings.warn("chunk_size and n_jobs are left to Spark", stacklevel=2)
    t = es[target]
    numeric = es.time_is_number
    kind = es._time_type()
    frame_of_cutoffs = isinstance(cutoff_time, DataFrame)
    extra: list[str] = []
    if frame_of_cutoffs:
        if keep_order:
            cutoff_time = dense_index(cutoff_time, ORDINAL).select(*[q(c) for c in cutoff_time.columns], ORDINAL)
        cols = cutoff_time.columns
        idc = next((c for c in ("instance_id", t.index) if c in cols), cols[0])
        tc = next((c for c in ("time", t.time_index) if c and c in cols and c != idc), None) or next(c for c in cols if c != idc)
        extra = [c for c in cols if c not in (idc, tc)]
        have = cutoff_time.schema[tc].dataType
        if numeric != isinstance(have, T.NumericType):
            raise TypeError("cutoff_time times must be of the time type of the entity set")
        cut = cutoff_time.select(q(idc).cast(t.df.schema[t.index].dataType).alias(ID), q(tc).cast(kind).alias(CTX), *[q(c).alias(f"__x{i}") for i, c in enumerate(extra)])
        if check_duplicates and not cut.groupBy(ID, CTX).count().where("count > 1").isEmpty():
            raise AssertionError("Duplicated rows in cutoff time dataframe.")
        low = Lowering(es, target, None, training_window, include_cutoff_time, approximate, True)
        pairs = cut.select(ID, CTX).where(F.col(ID).isNotNull() & F.col(CTX).isNotNull()).distinct()
        low.contexts = pairs.select(CTX).distinct()
        frame = low.rows(target, pairs)
        if approximate is not None:
            frame = frame.withColumn(APPROX, _floor(F.col(CTX), low.approximate, numeric).cast(kind))
    else:
        if cutoff_time is None:
            cutoff_time = 2**62 if numeric else datetime.now(timezone.utc).replace(tzinfo=None)
        elif numeric != isinstance(cutoff_time, (int, float)):
            raise TypeError("cutoff_time must be of the time type of the entity set")
        if approximate is not None:
            warnings.warn("approximate has no effect with a single cutoff time", stacklevel=2)
        at = F.lit(cutoff_time).cast(kind)
        low = Lowering(es, target, at, training_window, include_cutoff_time, None, instance_ids is not None)
        cut = None
        if instance_ids is not None:
            spark = t.df.sparkSession
            ids_kind = T.StructType([T.StructField(ID, t.df.schema[t.index].dataType)])
            cut = spark.createDataFrame([(i,) for i in dict.fromkeys(instance_ids)], ids_kind)
            if keep_order:
                extra = [ORDINAL]
                ids_kind = T.StructType([*ids_kind.fields, T.StructField("__x0", T.LongType())])
                cut = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(instance_ids))], ids_kind)
        elif t.time_index:
            cut = t.df.select(q(t.index).alias(ID))
        frame = low.rows(target, cut if instance_ids is not None else None)
    frame = low.evaluate(target, frame, features, full=not low.restricted and low.at is not None)
    values = frame.select(ID, CTX, *dict.fromkeys(low.name(f) for f in features))
    if frame_of_cutoffs:
        side = values.withColumnRenamed(ID, "__vid").withColumnRenamed(CTX, "__vctx")
        values = low.fill(cut.join(side, (F.col(ID) == F.col("__vid")) & (F.col(CTX) == F.col("__vctx")), "left"), features, F.col("__vid").isNull())
    elif cut is not None:
        values = cut.join(values.drop(CTX).withColumnRenamed(ID, "__vid"), F.col(ID) == F.col("__vid"), "left").withColumn(CTX, low.at)
        values = low.fill(values, features, F.col("__vid").isNull())
    cols = [F.col(ID).alias(t.index)]
    if frame_of_cutoffs or cutoff_time_in_index:
        cols.append(F.col(CTX).alias("time"))
    cols += [F.col(f"__x{i}").alias(c) for i, c in enumerate(extra) if c != ORDINAL]
    for f in features:
        if f.number_output_features == 1:
            cols.append(F.col(low.name(f)).alias(f.get_name()))
        else:
            cols += [F.get(F.col(low.name(f)), i).alias(n) for i, n in enumerate(f.get_feature_names())]
    cols += [F.col(f"__x{i}").alias(c) for i, c in enumerate(extra) if c == ORDINAL]
    out = values.select(*cols)
    if progress_callback:
        progress_callback(0, 1, len(features))
    if save_progress:
        out.write.mode("overwrite").parquet(save_progress)
        out = t.df.sparkSession.read.parquet(save_progress)
        if progress_callback:
            progress_callback(1, 1, len(features))
    return out
