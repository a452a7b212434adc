"""The engine: a catalog of streams, tables and views, and their statements."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SqlError
from tidemark.operators import joins, keyed
from tidemark.operators.windows import SEQ, TS, Frame
from tidemark.plans import ast as A
from tidemark.plans.parser import parse, parse_many
from tidemark.plans.planner import AGGREGATES, RESAMPLERS, Planned, Scope, Stages, aggregates, expand_aliases, plan_events, scope_of, stateful
from tidemark.sources.events import as_events, from_rows, shared_path, time_column

TIME = "time"


#: Rows given one by one that are kept here before they become a file.
BUFFER_ROWS = 10_000
#: Reads of a materialized view after which its rows are kept.
KEEP_FROM = 2


@dataclass
class Rows:
    """Rows of a source: a DataFrame, files of rows that came one by one, and
    the latest of these, which are still here."""

    schema: T.StructType
    base: DataFrame | None = None
    folder: str | None = None
    buffer: list[tuple] = field(default_factory=list)

    def add(self, spark: SparkSession, rows: list[tuple]) -> None:
        self.buffer += rows
        if len(self.buffer) >= BUFFER_ROWS:
            self.folder = self.folder or shared_path(spark, "rows")
            spark.createDataFrame(self.buffer, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
            self.buffer = []

    def add_frame(self, df: DataFrame) -> None:
        self.base = df if self.base is None else self.base.unionByName(df, allowMissingColumns=True)

    def frame(self, spark: SparkSession) -> DataFrame:
        parts = [] if self.base is None else [self.base]
        if self.folder:
            parts.append(spark.read.schema(self.schema).parquet(self.folder))
        if self.buffer or not parts:
            parts.append(spark.createDataFrame(self.buffer, self.schema))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


@dataclass
class Stream:
    name: str
    columns: tuple[str, ...]
    rows: Rows
    watchers: list[Callable] = field(default_factory=list)
    #: Events, counted when first asked for.
    size: int | None = None


@dataclass
class Table:
    name: str
    columns: tuple[str, ...]
    key: str
    changes: Rows
    #: Whether all rows are there before any event.
    fixed: bool = False


@dataclass
class View:
    name: str
    select: A.Select
    materialized: bool
    text: str
    reads: frozenset[str]
    #: The plan, made again after a source has changed.
    plan: Planned | None = None
    watchers: list[Watcher] = field(default_factory=list)
    times_read: int = 0
    kept: DataFrame | None = None


@dataclass
class Watcher:
    """A callback and the last event that it was given."""

    callback: Callable[[DataFrame], None]
    mark: tuple | None = None


def literal(value: object) -> Column:
    """A value as it came in a row, which may be a struct."""
    if isinstance(value, Row):
        return F.struct(*[literal(v).alias(k) for k, v in value.asDict().items()])
    return F.lit(value)


class Engine:
    """Runs statements over DataFrames. Views are plans: Catalyst sees a whole
    chain of views at once, and a plan is made when a result is asked for. A
    materialized view that is read again is kept in the executors' storage until
    a source changes; lost parts are computed anew."""

    def __init__(self, spark: SparkSession, block_rows: int | None = 2_000_000, hot_keys: bool = False) -> None:
        """block_rows: windows without a key over more events than this run in
        blocks of so many; None runs them in one task. Whether there are more is
        counted once for each stream, and only for such windows. hot_keys: keys
        with more events are split likewise; it costs a count of each keyed
        view's events."""
        self.spark = spark
        self.block_rows = block_rows
        self.hot_keys = hot_keys
        self.catalog: dict[str, Stream | Table | View] = {}
        self._clock = 0
        self._sequence = 0
        self._format: tuple[str, Callable | None, str] | None = None

    # statements

    def execute(self, sql: str) -> DataFrame | None:
        """Runs one statement; a SELECT gives a DataFrame, time first."""
        return self._run(parse(sql))

    def script(self, sql: str) -> list[DataFrame | None]:
        return [self._run(s) for s in parse_many(sql)]

    def explain(self, sql: str, mode: str = "formatted") -> str:
        """The physical plan of a SELECT."""
        statement = parse(sql)
        select = statement.select if isinstance(statement, A.Explain) else statement
        if not isinstance(select, A.Select):
            raise SqlError("EXPLAIN takes a SELECT")
        df = self._select(select)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def _run(self, s: object) -> DataFrame | None:
        if isinstance(s, A.Select):
            return self._select(s)
        if isinstance(s, A.Explain):
            return self.spark.createDataFrame([(self.explain_select(s.select),)], "plan string")
        if isinstance(s, A.CreateStream):
            return self._create(s)
        if isinstance(s, A.CreateView):
            return self._create_view(s)
        if isinstance(s, A.Insert):
            return self._insert(s)
        if isinstance(s, A.Delete):
            return self._delete(s)
        if isinstance(s, A.Drop):
            return self._drop(s)
        raise SqlError(f"cannot run {type(s).__name__}")

    def explain_select(self, select: A.Select) -> str:
        df = self._select(select)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def _new(self, name: str) -> str:
        if name in self.catalog:
            raise SqlError(f"{name} exists already")
        return name

    def _get(self, name: str) -> Stream | Table | View:
        if name not in self.catalog:
            raise SqlError(f"unknown source {name}")
        return self.catalog[name]

    def _create(self, s: A.CreateStream) -> None:
        if len(set(s.columns)) != len(s.columns):
            raise SqlError(f"{s.name} repeats a column")
        if s.keys:
            if len(s.keys) > 1:
                raise SqlError("a table has one PRIMARY KEY column")
            if s.keys[0] not in s.columns:
                raise SqlError(f"unknown column {s.keys[0]}")
            self.catalog[self._new(s.name)] = Table(s.name, s.columns, s.keys[0], Rows(self._change_schema(s.columns)))
        else:
            self.catalog[self._new(s.name)] = Stream(s.name, s.columns, Rows(self._schema(s.columns)))

    def _create_view(self, s: A.CreateView) -> None:
        self._new(s.name)
        # planned now, so that errors are the statement's
        plan = self._plan(s.select, for_view=True)
        reads = frozenset([x.name for x in s.select.sources] + [j.source.name for j in s.select.joins])
        self.catalog[s.name] = View(s.name, s.select, s.materialized, s.text, reads, plan)

    def _planned(self, view: View) -> Planned:
        if view.plan is None:
            view.plan = self._plan(view.select, for_view=True)
        return view.plan

    def _below(self, names: Iterable[str]) -> list[View]:
        """The views that a query over some sources reads, lowest first."""
        found: list[View] = []
        for name in names:
            source = self.catalog.get(name)
            if isinstance(source, View) and source not in found:
                found += [v for v in self._below(sorted(source.reads)) if v not in found]
                found.append(source)
        return found

    def _keep(self, names: Iterable[str]) -> None:
        """Counts a read of the materialized views below, and keeps those that
        were read before."""
        for view in self._below(names):
            if not view.materialized:
                continue
            view.times_read += 1
            if view.times_read >= KEEP_FROM and view.kept is None:
                view.kept = self._planned(view).df.persist(StorageLevel.MEMORY_AND_DISK)

    def _forget(self, view: View) -> None:
        if view.kept is not None:
            view.kept.unpersist()
        view.plan, view.kept, view.times_read = None, None, 0

    def _drop(self, s: A.Drop) -> None:
        if s.name not in self.catalog:
            if s.if_exists:
                return
            raise SqlError(f"unknown source {s.name}")
        users = sorted(v.name for v in self.catalog.values() if isinstance(v, View) and s.name in v.reads)
        if users:
            raise SqlError(f"{s.name} is used by {', '.join(users)}")
        if isinstance(self.catalog[s.name], View):
            self._forget(self.catalog[s.name])
        del self.catalog[s.name]

    # data

    def register(self, name: str, df: DataFrame, ts: str, order: Iterable[str] = (), columns: Iterable[str] | None = None) -> None:
        """A stream over a DataFrame: ts is a column of long times (or of
        timestamps, taken in microseconds), order further columns that make the
        order total; without them equal times are in no fixed order."""
        rows = as_events(df, ts, order, columns)
        self.catalog[self._new(name)] = Stream(name, tuple(columns or [c for c in df.columns]), Rows(rows.schema, rows))

    def register_table(self, name: str, df: DataFrame, key: str, ts: int | None = None) -> None:
        """A keyed table whose rows all are there from time ts on; None is
        before any event."""
        at = -(1 << 62) if ts is None else ts
        rows = df.select(F.lit(at).cast("long").alias(TS), F.lit(0).cast("long").alias(SEQ), F.lit(False).alias("_deleted"), *[F.col(f"`{c}`") for c in df.columns])
        self.catalog[self._new(name)] = Table(name, tuple(df.columns), key, Rows(rows.schema, rows), ts is None)

    def insert(self, name: str, data, column_map: Mapping[str, str] | None = None, ts: str | None = None) -> int | None:
        """Appends a DataFrame of Spark or pandas, or an iterable of dicts or
        sequences. column_map names the data's column of each of the stream's;
        the time is column ts, or time, timestamp or ts, else the clock's.
        Returns the rows, unless data is a Spark DataFrame."""
        stream = self._get(name)
        if not isinstance(stream, Stream):
            raise SqlError(f"{name} is not a stream")
        count = None
        if not isinstance(data, DataFrame):
            rows, count = from_rows(data, stream.columns, column_map)
            times = [r[0] if r[0] is not None else self._now() for r in rows]
            values = [(t, self._next(), *r[1:]) for t, r in zip(times, rows, strict=True)]
            self._append(stream, values)
            return count
        at = ts or time_column(data.columns)
        source = {c: (column_map or {}).get(c, c) for c in stream.columns}
        first = self._sequence + 1
        self._sequence += 1 << 40
        new = data.select(F.col(f"`{at}`").cast("long").alias(TS), (F.monotonically_increasing_id() + first).alias(SEQ), *[F.col(f"`{v}`").alias(c) for c, v in source.items()])
        stream.rows.add_frame(new)
        self._changed(stream, new)
        return count

    def _schema(self, columns: Iterable[str]) -> T.StructType:
        return T.StructType([T.StructField(TS, T.LongType()), T.StructField(SEQ, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

    def _now(self) -> int:
        self._clock = max(self._clock + 1, int(time.time() * 1000))
        return self._clock

    def _next(self) -> int:
        self._sequence += 1
        return self._sequence

    def _change_schema(self, columns: Iterable[str]) -> T.StructType:
        return T.StructType([T.StructField(TS, T.LongType()), T.StructField(SEQ, T.LongType()), T.StructField("_deleted", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

    def _append(self, stream: Stream, values: list[tuple]) -> None:
        stream.rows.add(self.spark, values)
        self._changed(stream, self.spark.createDataFrame(values, self._schema(stream.columns)) if stream.watchers else None)

    def _changed(self, source: Stream | Table, new: DataFrame | None = None) -> None:
        """Forgets the plans of the views that read a source, and tells those
        who watch it or them."""
        if isinstance(source, Stream):
            source.size = None
            for watcher in source.watchers:
                watcher.callback(new)
        stale = {source.name}
        for view in self.catalog.values():
            if isinstance(view, View) and view.reads & stale:
                self._forget(view)
                stale.add(view.name)
        for view in self.catalog.values():
            if isinstance(view, View) and view.name in stale:
                for watcher in view.watchers:
                    self._send(view, watcher)

    def _send(self, view: View, watcher: Watcher, silent: bool = False) -> None:
        """Gives a watcher the rows of a view after those it was given last."""
        df = self._planned(view).df
        if watcher.mark is not None:
            ts, seq = watcher.mark
            df = df.filter((F.col(TS) > ts) | ((F.col(TS) == ts) & (F.col(SEQ) > literal(seq))))
        last = df.agg(F.max(F.struct(TS, SEQ)).alias("last")).first()["last"]
        if last is None:
            return
        watcher.mark = (last[TS], last[SEQ])
        if not silent:
            watcher.callback(self._timed(df))

    def _insert(self, s: A.Insert) -> None:
        target = self._get(s.name)
        if isinstance(target, View):
            raise SqlError(f"{s.name} is a view")
        columns = s.columns or target.columns
        if unknown := set(columns) - set(target.columns):
            raise SqlError(f"unknown column {sorted(unknown)[0]}")
        rows = []
        for row in s.rows:
            if len(row) != len(columns):
                raise SqlError(f"{s.name} takes {len(columns)} values")
            given = dict(zip(columns, map(self._constant, row), strict=True))
            rows.append([given.get(c) for c in target.columns])
        if isinstance(target, Table):
            self._change(target, rows, False)
            return
        self._append(target, [(self._now(), self._next(), *row) for row in rows])

    def _constant(self, e: A.Expr) -> float | None:
        if isinstance(e, A.Num):
            return e.value
        if isinstance(e, A.Null):
            return None
        if isinstance(e, A.Unary) and e.op == "-":
            return -self._constant(e.arg)
        if isinstance(e, A.Binary) and e.op in "+-*/":
            a, b = self._constant(e.left), self._constant(e.right)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[e.op]()
        raise SqlError("VALUES takes constants")

    def _change(self, table: Table, rows: list[list], deleted: bool) -> None:
        table.changes.add(self.spark, [(self._now(), self._next(), deleted, *row) for row in rows])
        table.fixed = False
        self._changed(table)

    def _delete(self, s: A.Delete) -> None:
        table = self._get(s.name)
        if not isinstance(table, Table):
            raise SqlError(f"{s.name} is not a table with a key")
        if s.column != table.key:
            raise SqlError(f"DELETE takes the key {table.key}")
        key = self._constant(s.value)
        self._change(table, [[key if c == table.key else None for c in table.columns]], True)

    def change(self, name: str, rows: DataFrame, ts: str) -> None:
        """Rows of a table from the times in column ts on: new ones, and others
        in place of those of the same key."""
        table = self._get(name)
        if not isinstance(table, Table):
            raise SqlError(f"{name} is not a table with a key")
        seq = F.monotonically_increasing_id() + self._next()
        self._sequence += 1 << 40
        table.changes.add_frame(rows.select(F.col(f"`{ts}`").cast("long").alias(TS), seq.alias(SEQ), F.lit(False).alias("_deleted"), *[F.col(f"`{c}`") for c in table.columns]))
        table.fixed = False
        self._changed(table)

    def delete_where(self, name: str, keys: DataFrame, ts: int | None = None) -> None:
        """Deletes the table's rows whose keys are in a DataFrame of one column,
        from time ts on; None is before any event."""
        table = self._get(name)
        at = -(1 << 61) if ts is None else ts
        table.changes.add_frame(keys.select(F.lit(at).cast("long").alias(TS), F.lit(self._next()).cast("long").alias(SEQ), F.lit(True).alias("_deleted"), F.col(keys.columns[0]).alias(table.key)))
        table.fixed = table.fixed and ts is None
        self._changed(table)

    def clear(self, name: str) -> None:
        """Removes all events of a stream, or all rows of a table."""
        source = self._get(name)
        if isinstance(source, View):
            raise SqlError(f"{name} is a view")
        schema = self._schema(source.columns) if isinstance(source, Stream) else self._change_schema(source.columns)
        if isinstance(source, Stream):
            source.rows = Rows(schema)
        else:
            source.changes = Rows(schema)
        empty = self.spark.createDataFrame([], schema) if isinstance(source, Stream) and source.watchers else None
        self._changed(source, empty)

    # what there is

    def get_catalog(self) -> dict[str, dict]:
        """Kind, columns and, of a view, text and keys of each name."""
        out = {}
        for name, x in self.catalog.items():
            columns = list(x.columns) if not isinstance(x, View) else self._planned(x).columns
            kind = "materialized view" if isinstance(x, View) and x.materialized else type(x).__name__.lower()
            out[name] = {"kind": kind, "columns": columns}
            if isinstance(x, View):
                out[name] |= {"text": x.text, "keys": list(self._planned(x).keys), "reads": sorted(x.reads)}
            if isinstance(x, Table):
                out[name]["key"] = x.key
        return out

    def get_store(self, name: str) -> DataFrame:
        """All events of a source, time first."""
        return self._timed(self.events(name))

    def debug(self, sql: str) -> dict:
        """What a statement is: its error, or its columns, the views it goes
        through, and the plan."""
        try:
            statement = parse(sql)
            select = getattr(statement, "select", statement)
            if not isinstance(select, A.Select):
                return {"statement": type(statement).__name__, "errors": []}
            df = self._plan(select, True).df if isinstance(statement, A.CreateView) else self._select(select)
        except SqlError as e:
            return {"statement": None, "errors": [str(e)]}
        names = [x.name for x in select.sources] + [j.source.name for j in select.joins]
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        fields = {c: i for i, c in enumerate(c for c in df.columns if c not in (TS, SEQ))}
        return {"statement": type(statement).__name__, "errors": [], "fields": fields, "views": [v.name for v in self._below(names)], "plan": plan}

    def export(self) -> str:
        """The statements that make the catalog, for another engine."""
        lines = []
        for x in self.catalog.values():
            if isinstance(x, View):
                lines.append(f"CREATE {'MATERIALIZED ' if x.materialized else ''}VIEW {x.name} AS {x.text};")
            else:
                kind = "TABLE" if isinstance(x, Table) else "STREAM"
                columns = ", ".join(f"{c} DOUBLE PRECISION{' PRIMARY KEY' if isinstance(x, Table) and c == x.key else ''}" for c in x.columns)
                lines.append(f"CREATE {kind} {x.name} ({columns});")
        return "\n".join(lines)

    def show_graph(self) -> str:
        """The sources and what reads them, as a Mermaid graph."""
        lines = ["graph LR"]
        for x in self.catalog.values():
            lines.append(f'  {x.name}["{type(x).__name__.lower()} {x.name}"]')
            lines += [f"  {r} --> {x.name}" for r in sorted(getattr(x, "reads", ()))]
        return "\n".join(lines)

    def subscribe(self, name: str, callback: Callable[[DataFrame], None]) -> None:
        """Calls back with the new rows of a stream, or of a view: those whose
        time and sequence come after all that were there before."""
        target = self._get(name)
        if isinstance(target, Table):
            raise SqlError(f"{name} is a table")
        watcher = Watcher(callback)
        if isinstance(target, View):
            self._send(target, watcher, silent=True)
        target.watchers.append(watcher)

    # reading

    def events(self, name: str) -> DataFrame:
        """All events of a source with _ts and _seq."""
        source = self._get(name)
        if isinstance(source, Stream):
            return source.rows.frame(self.spark)
        if isinstance(source, View):
            return self._planned(source).df
        return joins.current(self._changes(source), source.key).drop("_deleted")

    def _changes(self, table: Table) -> DataFrame:
        return table.changes.frame(self.spark)

    def _size(self, names: Iterable[str]) -> int:
        """Events of the streams below some sources, counted once each: a view
        has no more, unless it resamples."""
        total = 0
        for name in names:
            source = self._get(name)
            if isinstance(source, Stream):
                if source.size is None:
                    source.size = source.rows.frame(self.spark).count()
                total += source.size
            elif isinstance(source, View):
                grid = any(isinstance(i.expr, A.Call) and i.expr.name in RESAMPLERS for i in source.select.items)
                total += self._planned(source).df.count() if grid else self._size(x.name for x in source.select.sources)
        return total

    def latest(self, name: str, n: int) -> DataFrame:
        """The last n events of a source, in order."""
        return self._timed(keyed.latest(self.events(name), n).orderBy(TS, SEQ))

    def latest_before(self, name: str, ts: int) -> DataFrame:
        """The last event of a source at or before a time."""
        return self._timed(keyed.latest_before(self.events(name), ts))

    def read_range(self, name: str, low: int, high: int, limit: int | None = None) -> DataFrame:
        """Events of a source in an inclusive range of time, in order, the first
        `limit` of them."""
        return self._timed(keyed.between(self.events(name), low, high, limit).orderBy(TS, SEQ))

    def latest_per_key(self, name: str, *keys: str) -> DataFrame:
        """The latest event of each key; the keys of a keyed view are its own."""
        source = self._get(name)
        by = keys or (self._planned(source).keys if isinstance(source, View) else ())
        if not by:
            raise SqlError(f"{name} has no keys")
        return self._timed(keyed.latest_per_key(self.events(name), by).orderBy(*[f"`{k}`" for k in by]))

    def configure_time_format(self, unit: str = "ms", formatter: Callable | None = None, column_name: str = TIME) -> None:
        """Times of results as a timestamp of the unit (s, ms, us or ns), or as
        the formatter makes of the long column."""
        self._format = (unit, formatter, column_name)

    def _timed(self, df: DataFrame) -> DataFrame:
        name, column = TIME, F.col(TS)
        if self._format is not None:
            unit, formatter, name = self._format
            scale = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0.001}[unit]
            column = formatter(F.col(TS)) if formatter else F.timestamp_micros((F.col(TS) * scale).cast("long"))
        rest = [c for c in df.columns if c not in (TS, SEQ)]
        return df.select(column.alias(name), *[F.col(f"`{c}`") for c in rest])

    def _select(self, s: A.Select) -> DataFrame:
        if not s.sources:
            stages = Stages(self.spark.range(1).select(F.lit(0).cast("long").alias(TS), F.lit(0).cast("long").alias(SEQ)), Scope({}), Frame(), "_s")
            items, _ = expand_aliases(s.items, set())
            return stages.df.select(*[stages.column(i.expr).alias(i.alias) for i in items])
        source = self._get(s.sources[0].name)
        self._keep([x.name for x in s.sources])
        single = len(s.sources) == 1 and not s.joins
        plain = not s.group_by and s.having is None and not any(stateful(i.expr) for i in s.items) and not stateful(s.where)
        if single and isinstance(source, View) and self._planned(source).keys and not s.group_by and any(aggregates(i.expr) for i in s.items):
            return self._over_keys(s, source)
        if s.order_by and s.limit is None and any(isinstance(self._get(x.name), Stream) for x in s.sources):
            raise SqlError("ORDER BY over a stream needs LIMIT")
        if single and isinstance(source, Stream) and plain and s.limit is None:
            raise SqlError("a SELECT from a stream needs LIMIT")
        if single and plain and isinstance(source, View) and self._planned(source).keys:
            rows = keyed.latest_per_key(self._planned(source).df, self._planned(source).keys)
            planned = plan_events(s, rows, scope_of(rows, s.sources[0].label), None)
            keys = [k for k in self._planned(source).keys if k in planned.columns]
            return self._finish(s, planned, first=True, by=keys)
        planned = self._plan(s, for_view=False)
        raw = single and plain and s.where is None and not isinstance(source, Table) and all(isinstance(i.expr, (A.Star, A.Col)) for i in s.items)
        return self._finish(s, planned, first=not raw, by=[])

    def _finish(self, s: A.Select, planned: Planned, first: bool, by: list[str]) -> DataFrame:
        """ORDER BY and LIMIT: a raw read takes the latest rows, others the
        first ones."""
        df = planned.df
        if s.order_by:
            return self._timed(self._ordered(df, s))
        if s.limit is not None:
            if not first:
                df = keyed.latest(df, s.limit)
            else:
                df = df.orderBy(*([f"`{k}`" for k in by] or [TS, SEQ])).limit(s.limit)
        order = [f"`{k}`" for k in by] or [TS, SEQ]
        return self._timed(df.orderBy(*order) if s.limit is not None or by else df)

    def _ordered(self, df: DataFrame, s: A.Select) -> DataFrame:
        order = []
        for o in s.order_by:
            if not isinstance(o.expr, A.Col) or o.expr.name not in df.columns:
                raise SqlError("ORDER BY takes columns of the result")
            column = F.col(f"`{o.expr.name}`")
            order.append(column.desc() if o.descending else column.asc())
        rows = df.orderBy(*order, TS, SEQ)
        return rows if s.limit is None else rows.limit(s.limit)

    def _over_keys(self, s: A.Select, view: View) -> DataFrame:
        """Aggregates over the latest row of each key, 0 if there is none."""
        rows = keyed.latest_per_key(self._planned(view).df, self._planned(view).keys)
        scope = scope_of(rows, s.sources[0].label)
        stages = Stages(rows, scope, Frame(), "_s")
        if s.where is not None:
            if stateful(s.where):
                raise SqlError("windows are not allowed here")
            rows = rows.filter(stages.truth(s.where))
        items, _ = expand_aliases(s.items, scope.names)
        out, found = [], {}

        def aggregate(e: A.Expr) -> A.Expr:
            if isinstance(e, A.Call) and e.name in AGGREGATES:
                if e not in found:
                    x = None if e.name == "COUNT" else stages.column(e.args[0]).cast("double")
                    value = F.count(F.lit(1)).cast("double") if x is None else {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[e.name](x)
                    found[e] = F.coalesce(value, F.lit(0.0)).alias(f"_g{len(found)}")
                return A.Col(f"_g{list(found).index(e)}")
            return A.rebuild(e, aggregate)

        rewritten = [(i, aggregate(i.expr)) for i in items]
        totals = rows.agg(*found.values())
        after = Stages(totals, Scope({(None, c): c for c in totals.columns}), Frame(), "_s")
        for item, e in rewritten:
            out.append(after.column(e).alias(item.alias))
        return totals.select(*out)

    def _plan(self, s: A.Select, for_view: bool) -> Planned:
        if not s.sources:
            raise SqlError("a view needs FROM")
        if s.order_by and s.limit is None and for_view:
            raise SqlError("ORDER BY needs LIMIT")
        df, scope = self._from(s)
        planned = plan_events(s, df, scope, self.block_rows, self.hot_keys, lambda: self._size(x.name for x in s.sources))
        if for_view and s.limit is not None:
            rows = self._ordered(planned.df, s) if s.order_by else planned.df.orderBy(TS, SEQ).limit(s.limit)
            planned = Planned(rows, planned.keys)
        return planned

    def _from(self, s: A.Select) -> tuple[DataFrame, Scope]:
        first = s.sources[0]
        if len(s.sources) == 1:
            df, scope = self.events(first.name), None
            scope = scope_of(df, first.label)
        else:
            if len({x.label for x in s.sources}) != len(s.sources):
                raise SqlError("sources need distinct names")
            for x in s.sources:
                if isinstance(self._get(x.name), Table):
                    raise SqlError("a source list takes streams and views")
            sources = [(x.label, self.events(x.name)) for x in s.sources]
            if all(isinstance(self._get(x.name), View) for x in s.sources):
                df = joins.at_equal_times(sources)
            else:
                total = self._size(x.name for x in s.sources) if self.block_rows else 0
                df = joins.as_of(sources, total=total, block_rows=self.block_rows, streams=[x.name for x in s.sources])
            columns = {}
            for x in s.sources:
                for c in self.events(x.name).columns:
                    if c not in (TS, SEQ):
                        columns[x.label, c] = f"{x.label}.{c}"
            scope = Scope(columns, tuple(x.label for x in s.sources))
        for j in s.joins:
            table = self._get(j.source.name)
            if not isinstance(table, Table):
                raise SqlError("JOIN takes a table with a key")
            if isinstance(self._get(first.name), Table):
                raise SqlError("the left side of JOIN is a stream or a view")
            if j.right.name != table.key:
                raise SqlError(f"JOIN takes the key {table.key} of {table.name}")
            if j.kind not in ("inner", "left"):
                raise SqlError(f"{j.kind.upper()} JOIN is not supported")
            on = scope.resolve(j.left)
            rest = [c for c in table.columns if c != table.key]
            before = [c for c in df.columns if c not in (TS, SEQ)]
            if table.fixed:
                df = joins.with_table(df, joins.current(self._changes(table), table.key), on, table.key, rest, j.kind == "left")
            else:
                df = joins.at_time(df, self._changes(table), on, table.key, rest, j.kind == "left")
            df = df.select(TS, SEQ, *[F.col(f"`{c}`") for c in before], *[F.col(f"`_t.{c}`").alias(f"{j.source.label}.{c}") for c in rest])
            columns = dict(scope.columns)
            for c in rest:
                columns[j.source.label, c] = f"{j.source.label}.{c}"
            columns[j.source.label, table.key] = on
            scope = Scope(columns, (*scope.labels, j.source.label))
        return df, scope
