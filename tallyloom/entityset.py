"""Keyed, time-stamped tables and the relationships between them."""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyloom.session import materialize
from tallyloom.types import Schema, column_schema, infer

LTI = "_last_time"


def q(name: str):
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Relationship:
    """N child rows to one parent row; the parent column is the parent's index."""

    parent: str
    parent_column: str
    child: str
    child_column: str


@dataclass
class Table:
    name: str
    df: DataFrame
    index: str
    time_index: str | None = None
    schemas: dict[str, Schema] = field(default_factory=dict)
    secondary: dict[str, list[str]] = field(default_factory=dict)
    interesting: dict[str, list] = field(default_factory=dict)
    orders: dict[str, list] = field(default_factory=dict)
    last_times: DataFrame | None = None  # index and LTI

    @property
    def columns(self) -> list[str]:
        return list(self.schemas)

    @property
    def time_is_number(self) -> bool:
        return self.time_index is not None and self.schemas[self.time_index].logical in ("Integer", "Double")


def dense_index(df: DataFrame, name: str) -> DataFrame:
    """Add a column 0..n-1 without bringing rows together.

    The rows are written first; a row's number is its place in its file after those of
    the files before, so numbers stay the same however often or with whatever
    partitioning the table is read.
    """
    kept = materialize(df, "indexed")
    marked = kept.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = marked.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).orderBy("__file").collect()  # one row per file
    starts, at = [], 0
    for r in files:
        starts.append((r[0], at))
        at += r["n"]
    side = df.sparkSession.createDataFrame(starts or [("", 0)], "__file string, __start long")
    return marked.join(F.broadcast(side), "__file").select((F.col("__row") + F.col("__start")).alias(name), *[q(c) for c in df.columns])


class EntitySet:
    def __init__(self, id: str = "es", dataframes: dict | None = None, relationships: list | None = None):
        self.id = id
        self.tables: dict[str, Table] = {}
        self.relationships: list[Relationship] = []
        for name, parts in (dataframes or {}).items():
            df, index, *rest = parts
            self.add_dataframe(df, name, index=index, time_index=rest[0] if rest else None,
                               logical_types=rest[1] if len(rest) > 1 else None, semantic_tags=rest[2] if len(rest) > 2 else None)
        for r in relationships or []:
            self.add_relationship(*r)

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            raise KeyError(f"{name} does not exist in {self.id}")
        return self.tables[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        """A new table whose index is its first column, or new rows of a known one."""
        if name in self.tables:
            self.replace_dataframe(name, df)
        else:
            self.add_dataframe(df, name)

    def __deepcopy__(self, memo) -> EntitySet:
        """Own metadata over the same rows: DataFrames never change."""
        out = EntitySet(self.id)
        out.relationships = list(self.relationships)
        for n, t in self.tables.items():
            copied = {k: deepcopy(getattr(t, k), memo) for k in ("schemas", "secondary", "interesting", "orders")}
            out.tables[n] = Table(t.name, t.df, t.index, t.time_index, last_times=t.last_times, **copied)
        return out

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    # tables
    def add_dataframe(
        self, dataframe: DataFrame, dataframe_name: str, index: str | None = None, time_index: str | None = None,
        logical_types: dict | None = None, semantic_tags: dict | None = None, make_index: bool = False,
        secondary_time_index: dict | None = None, orders: dict | None = None, check_index: bool = False,
    ) -> EntitySet:
        """Add a table. NaN becomes null; the index is the first column if none is given.

        ``orders`` lists the levels of ordinal columns. Uniqueness of the index is
        checked by a job only if ``check_index`` is set.
        """
        if not dataframe.columns:
            raise ValueError("a table needs columns")
        index = index or dataframe.columns[0]
        if make_index:
            if index in dataframe.columns:
                raise ValueError(f"cannot make index, {index} exists")
            dataframe = dense_index(dataframe, index)
        if index not in dataframe.columns:
            raise ValueError(f"no column {index} in {dataframe_name}")
        kinds = {f.name: f.dataType for f in dataframe.schema.fields}
        dataframe = dataframe.select(
            *[
                (F.when(~F.isnan(q(c)), q(c)).alias(c) if isinstance(k, (T.DoubleType, T.FloatType)) else q(c))
                for c, k in kinds.items()
            ]
        )
        schemas = {}
        for c, k in kinds.items():
            tags = (semantic_tags or {}).get(c, set())
            tags = {tags} if isinstance(tags, str) else set(tags)
            logical = (logical_types or {}).get(c) or infer(k)
            if c == index:
                schemas[c] = Schema(logical, frozenset({"index"} | tags))
            else:
                schemas[c] = column_schema(logical, *(tags | ({"time_index"} if c == time_index else set())))
        if time_index is not None and time_index not in kinds:
            raise ValueError(f"no column {time_index} in {dataframe_name}")
        table = Table(dataframe_name, dataframe, index, time_index, schemas, dict(secondary_time_index or {}), {}, dict(orders or {}))
        numbers = {t.time_is_number for t in self.tables.values() if t.time_index}
        if time_index and numbers and numbers != {table.time_is_number}:
            raise TypeError("time indexes are all numbers or all times")
        if check_index and dataframe.groupBy(q(index)).count().where("count > 1").limit(1).count():
            raise ValueError(f"index {index} of {dataframe_name} is not unique")
        self.tables[dataframe_name] = table
        return self

    def replace_dataframe(self, dataframe_name: str, df: DataFrame, recalculate_last_time_indexes: bool = True) -> EntitySet:
        table = self[dataframe_name]
        if set(df.columns) != set(table.columns):
            raise ValueError("the new table must have the same columns")
        kinds = dict(df.dtypes)
        table.df = df.select(*[F.when(~F.isnan(q(c)), q(c)).alias(c) if kinds[c] in ("double", "float") else q(c) for c in table.columns])
        if recalculate_last_time_indexes and table.last_times is not None:
            self.add_last_time_indexes()
        return self

    def set_secondary_time_index(self, dataframe_name: str, secondary: dict[str, list[str]]) -> None:
        for t, cols in secondary.items():
            for c in [t, *cols]:
                if c not in self[dataframe_name].schemas:
                    raise ValueError(f"no column {c} in {dataframe_name}")
        self[dataframe_name].secondary = dict(secondary)

    # relationships
    def add_relationship(self, parent: str, parent_column: str, child: str, child_column: str) -> EntitySet:
        p, c = self[parent], self[child]
        if p.index != parent_column:
            raise ValueError(f"{parent_column} is not the index of {parent}")
        if child_column not in c.schemas:
            raise ValueError(f"no column {child_column} in {child}")
        kind, have = p.df.schema[parent_column].dataType, c.df.schema[child_column].dataType
        if kind != have:
            c.df = c.df.withColumn(child_column, q(child_column).cast(kind))
        rel = Relationship(parent, parent_column, child, child_column)
        if rel not in self.relationships:
            self.relationships.append(rel)
            s = c.schemas[child_column]
            c.schemas[child_column] = Schema(s.logical, s.tags | {"foreign_key"})
        return self

    def add_relationships(self, relationships) -> EntitySet:
        for r in relationships:
            self.add_relationship(*r) if not isinstance(r, Relationship) else self.add_relationship(r.parent, r.parent_column, r.child, r.child_column)
        return self

    def forward(self, name: str) -> list[Relationship]:
        return [r for r in self.relationships if r.child == name]

    def backward(self, name: str) -> list[Relationship]:
        return [r for r in self.relationships if r.parent == name]

    def find_forward_paths(self, start: str, goal: str, seen: frozenset = frozenset()) -> list[tuple]:
        """Chains of relationships from a child up to an ancestor, without cycles."""
        if start == goal and not seen:
            return [()]
        out = []
        for r in self.forward(start):
            if r.parent == goal:
                out.append((r,))
            elif r.parent not in seen and r.parent != start:
                out += [(r, *rest) for rest in self.find_forward_paths(r.parent, goal, seen | {start}) if rest]
        return out

    def find_backward_paths(self, start: str, goal: str) -> list[tuple]:
        return [tuple(reversed(p)) for p in self.find_forward_paths(goal, start)]

    def get_forward_dataframes(self, name: str, deep: bool = False) -> list[tuple[str, tuple]]:
        return self._walk(name, deep, True)

    def get_backward_dataframes(self, name: str, deep: bool = False) -> list[tuple[str, tuple]]:
        return self._walk(name, deep, False)

    def _walk(self, name, deep, up, before=(), seen=frozenset()):
        out = []
        for r in self.forward(name) if up else self.backward(name):
            nxt = r.parent if up else r.child
            if nxt in seen or nxt == name:
                continue
            path = (*before, r)
            out.append((nxt, path))
            if deep:
                out += self._walk(nxt, True, up, path, seen | {name})
        return out

    def has_unique_forward_path(self, start: str, end: str) -> bool:
        return len(self.find_forward_paths(start, end)) == 1

    # derived tables
    def normalize_dataframe(
        self, base_dataframe_name: str, new_dataframe_name: str, index: str, additional_columns=(), copy_columns=(),
        make_time_index: bool | str | None = None, make_secondary_time_index: dict | None = None,
        new_dataframe_time_index: str | None = None, new_dataframe_secondary_time_index: str | None = None,
    ) -> EntitySet:
        """Split out a parent table: for each non-null key its first row in time order.

        With a secondary time index the columns named there come from the last row.
        One aggregation with map-side combine; no window over a hot key.
        """
        base = self[base_dataframe_name]
        order = F.struct(*[q(c) for c in ([base.time_index] if base.time_index else []) + [base.index]])
        moved, copied = list(additional_columns), list(copy_columns)
        for c in [*moved, *copied, index]:
            if c not in base.schemas:
                raise ValueError(f"no column {c} in {base_dataframe_name}")
        late = {c for cols in (make_secondary_time_index or {}).values() for c in cols}
        picks = [(F.max_by if c in late else F.min_by)(q(c), order).alias(c) for c in dict.fromkeys([*moved, *copied])]
        time_name = None
        if make_time_index is None:
            make_time_index = base.time_index is not None
        if make_time_index:
            source = base.time_index if make_time_index is True else make_time_index
            if make_time_index is True:
                time_name = new_dataframe_time_index or f"first_{base_dataframe_name}_time"
                picks.append(F.min_by(q(source), order).alias(time_name))
            else:
                time_name = source
                if source not in moved + copied:
                    picks.append(F.min_by(q(source), order).alias(source))
        secondary = {}
        for t, cols in (make_secondary_time_index or {}).items():
            new = new_dataframe_secondary_time_index or f"second_{base_dataframe_name}_time"
            picks.append(F.max_by(q(t), order).alias(new))
            secondary[new] = list(cols)
        keyed = base.df.where(q(index).isNotNull()).groupBy(q(index))
        df = keyed.agg(*picks) if picks else base.df.select(q(index)).where(q(index).isNotNull()).distinct()
        logical = {c: base.schemas[c].logical for c in df.columns if c in base.schemas}
        tags = {c: base.schemas[c].tags - {"foreign_key", "index", "time_index"} for c in df.columns if c in base.schemas and c != index}
        self.add_dataframe(df, new_dataframe_name, index=index, time_index=time_name, logical_types=logical, semantic_tags=tags, secondary_time_index=secondary)
        keep = [c for c in base.columns if c not in moved]
        base.df = base.df.select(*[q(c) for c in keep])
        base.schemas = {c: base.schemas[c] for c in keep}
        for r in [r for r in self.relationships if r.child == base_dataframe_name and r.child_column in moved]:
            self.relationships[self.relationships.index(r)] = Relationship(r.parent, r.parent_column, new_dataframe_name, r.child_column)
            s = self[new_dataframe_name].schemas[r.child_column]
            self[new_dataframe_name].schemas[r.child_column] = Schema(s.logical, s.tags | {"foreign_key"})
        return self.add_relationship(new_dataframe_name, index, base_dataframe_name, index)

    def concat(self, other: EntitySet) -> EntitySet:
        """Union of the rows; of rows with one index value those of this set come first."""
        if set(self.tables) != set(other.tables):
            raise ValueError("the sets have different tables")
        out = EntitySet(self.id)
        out.relationships = [*self.relationships]
        for name, t in self.tables.items():
            both = t.df.withColumn("__side", F.lit(0)).unionByName(other[name].df.withColumn("__side", F.lit(1)))
            rest = [c for c in t.columns if c != t.index]
            row = both.groupBy(q(t.index)).agg(F.min_by(F.struct(*[q(c) for c in rest]), "__side").alias("__r")) if rest else both.select(q(t.index)).distinct()
            df = row.select(q(t.index), *[F.col("__r").getField(c).alias(c) for c in rest]).select(*[q(c) for c in t.columns])
            out.tables[name] = Table(name, df, t.index, t.time_index, dict(t.schemas), dict(t.secondary), dict(t.interesting), dict(t.orders))
        return out

    def add_last_time_indexes(self, updated_dataframes=None) -> EntitySet:
        """For each row the greatest time of itself and of all its descendants; null when there is none."""
        done: dict[str, DataFrame] = {}

        def last(name: str, above: tuple) -> DataFrame:
            if name in done:
                return done[name]
            t = self[name]
            own = q(t.time_index) if t.time_index else F.lit(None).cast(self._time_type())
            out = t.df.select(q(t.index).alias("__id"), own.alias(LTI))
            for i, r in enumerate(self.backward(name)):
                if r.child in above or r.child == name:
                    continue
                child = last(r.child, (*above, name))
                c = self[r.child]
                by = (
                    c.df.select(q(c.index).alias("__c"), q(r.child_column).alias("__id"))
                    .join(child.withColumnRenamed("__id", "__c"), "__c")
                    .groupBy("__id").agg(F.max(LTI).alias(f"__l{i}"))
                )
                out = out.join(by, "__id", "left").withColumn(LTI, F.greatest(LTI, F.col(f"__l{i}"))).drop(f"__l{i}")
            done[name] = out
            return out

        for name in self.tables:
            self.tables[name].last_times = last(name, ()).withColumnRenamed("__id", self[name].index)
        return self

    def _time_type(self) -> T.DataType:
        for t in self.tables.values():
            if t.time_index:
                return t.df.schema[t.time_index].dataType
        return T.TimestampNTZType()

    @property
    def time_is_number(self) -> bool:
        return any(t.time_is_number for t in self.tables.values())

    def add_interesting_values(self, max_values: int = 5, dataframe_name: str | None = None, values: dict | None = None) -> None:
        """Values worth a where clause: the most frequent of each categorical column.

        All of the ``max_values`` most frequent if a column has fewer than 25 values;
        otherwise those with a share between 5 % and 95 %, up to the first that has not.
        """
        if values is not None:
            self[dataframe_name].interesting.update({c: list(v) for c, v in values.items()})
            return
        for t in [self[dataframe_name]] if dataframe_name else self.tables.values():
            cols = [c for c, s in t.schemas.items() if "category" in s.tags and not s.tags & {"index", "foreign_key"}]
            if not cols:
                continue
            kinds = dict(t.df.dtypes)
            pairs = F.array(*[F.struct(F.lit(i).alias("i"), q(c).cast("string").alias("v")) for i, c in enumerate(cols)])
            counts = t.df.select(F.inline(pairs)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
            best = Window.partitionBy("i").orderBy(F.col("v").isNull(), F.desc("n"), "v")
            all_rows = F.sum("n").over(Window.partitionBy("i"))
            top = counts.select("i", "v", "n", all_rows.alias("rows"), F.row_number().over(best).alias("r")).where("r <= 25 and v is not null")
            typed = [F.col("v").cast(kinds[c]).alias(f"v{i}") for i, c in enumerate(cols)]
            found: dict[int, list] = {}
            for r in top.select("i", "n", "rows", *typed).orderBy("i", "r").collect():  # at most 25 rows per column
                found.setdefault(r["i"], []).append(r)
            for i, rows in found.items():
                picked = []
                for r in rows[:max_values]:
                    if len(rows) >= 25 and not 0.05 < r["n"] / r["rows"] < 0.95:
                        break
                    picked.append(r[f"v{i}"])
                if picked:
                    t.interesting[cols[i]] = picked

    def query_by_values(
        self, dataframe_name: str, instance_vals: DataFrame | list | None = None, column_name: str | None = None,
        columns: list[str] | None = None, time_last=None, training_window=None, include_cutoff_time: bool = True,
    ) -> DataFrame:
        """Rows whose column has one of the values, visible at a time; null values select nothing."""
        from tallyloom.timedelta import Timedelta

        t = self[dataframe_name]
        df, column = t.df, column_name or t.index
        if instance_vals is not None:
            if isinstance(instance_vals, DataFrame):
                ids = instance_vals.toDF("__v").where("__v is not null").distinct()
                df = df.join(ids, q(column) == F.col("__v"), "left_semi")
            else:
                df = df.where(q(column).isin([v for v in instance_vals if v is not None]))
        if time_last is not None and t.time_index:
            at = F.lit(time_last).cast(df.schema[t.time_index].dataType)
            now = q(t.time_index)
            df = df.where(now <= at if include_cutoff_time else now < at)
            if training_window is not None:
                since = Timedelta.parse(training_window).before(at, t.time_is_number)
                df = df.where(now > since if include_cutoff_time else now >= since)
            for c, cols in t.secondary.items():
                for x in [c, *cols]:
                    df = df.withColumn(x, F.when(q(c) < at, q(x)))
        return df.select(*[q(c) for c in columns]) if columns else df

    # sinks and sources
    def to_dictionary(self) -> dict:
        return {
            "id": self.id,
            "tables": {
                n: {
                    "index": t.index, "time_index": t.time_index, "secondary": t.secondary, "orders": t.orders,
                    "interesting": {c: [str(v) if isinstance(v, datetime) else v for v in vs] for c, vs in t.interesting.items()},
                    "columns": {c: {"logical": s.logical, "tags": sorted(s.tags)} for c, s in t.schemas.items()},
                    "schema": json.loads(t.df.schema.json()),
                }
                for n, t in self.tables.items()
            },
            "relationships": [[r.parent, r.parent_column, r.child, r.child_column] for r in self.relationships],
        }

    def _write(self, path: str, kind: str, **options) -> None:
        for n, t in self.tables.items():
            df = t.df
            if kind == "csv":  # structs as text
                df = df.select(*[F.to_json(q(f.name)).alias(f.name) if isinstance(f.dataType, T.StructType) else q(f.name) for f in df.schema.fields])
            getattr(df.write.mode("overwrite").options(**options), kind)(f"{path}/{n}.{kind}")
        spark = next(iter(self.tables.values())).df.sparkSession
        spark.createDataFrame([(json.dumps(self.to_dictionary() | {"format": kind}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/data_description")

    def to_parquet(self, path: str) -> None:
        self._write(path, "parquet")

    def to_csv(self, path: str) -> None:
        self._write(path, "csv", header="true", timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", quote='"', escape='"')

    def to_orc(self, path: str) -> None:
        self._write(path, "orc")

    def __eq__(self, other) -> bool:
        return isinstance(other, EntitySet) and self.to_dictionary() == other.to_dictionary()

    def equals(self, other: EntitySet) -> bool:
        """Equal metadata and equal rows, repeated ones included."""
        return self == other and all(
            t.df.exceptAll(other[n].df).isEmpty() and other[n].df.exceptAll(t.df).isEmpty() for n, t in self.tables.items()
        )

    __hash__ = None

    def plot(self) -> str:
        """The tables and relationships as a DOT graph."""
        lines = [f'digraph "{self.id}" {{', "  node [shape=record];"]
        for n, t in self.tables.items():
            cols = "\\l".join(f"{c} : {s.logical}{'; ' + ', '.join(sorted(s.tags)) if s.tags else ''}" for c, s in t.schemas.items())
            lines.append(f'  "{n}" [label="{{{n}|{cols}\\l}}"];')
        lines += [f'  "{r.child}" -> "{r.parent}" [label="{r.child_column}"];' for r in self.relationships]
        return "\n".join([*lines, "}"])


def empty_dataframe(spark: SparkSession, schema: dict) -> DataFrame:
    """A table without rows from the schema of a description."""
    return spark.createDataFrame([], T.StructType.fromJson(schema))


def read_entityset(spark: SparkSession, path: str, metadata_only: bool = False) -> EntitySet:
    """Read what to_parquet, to_csv or to_orc wrote; any path Spark can read, object stores included."""
    text = "".join(r[0] for r in spark.read.text(f"{path}/data_description").collect())
    d = json.loads(text)
    es = EntitySet(d["id"])
    for n, t in d["tables"].items():
        schema = T.StructType.fromJson(t["schema"])
        if metadata_only:
            df = empty_dataframe(spark, t["schema"])
        elif d["format"] == "csv":
            flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.StructType) else f.dataType) for f in schema.fields])
            df = spark.read.schema(flat).options(header="true", timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", quote='"', escape='"').csv(f"{path}/{n}.csv")
            df = df.select(*[F.from_json(q(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, T.StructType) else q(f.name) for f in schema.fields])
        else:
            df = getattr(spark.read.schema(schema), d["format"])(f"{path}/{n}.{d['format']}")
        es.tables[n] = Table(n, df, t["index"], t["time_index"], {c: Schema(s["logical"], frozenset(s["tags"])) for c, s in t["columns"].items()},
                             t["secondary"], t["interesting"], t["orders"])
    es.relationships = [Relationship(*r) for r in d["relationships"]]
    return es
