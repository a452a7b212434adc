"""Views over live events by Structured Streaming.

A view's query runs as a stateful processor: each key's state holds the parts of
windows its functions need, events of a micro-batch are taken in the order of
time and sequence, and each one that fills all windows emits a row, as in the
batch plan. A chain of views is a chain of processors. Several sources are first
combined, and events first meet a table that changes, by processors of their own,
which emit rows to the view's. Late events are held back until the watermark has
passed them, so that order holds over micro-batches; those behind it are dropped
and counted by Spark.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.errors import SqlError
from tidemark.operators import joins
from tidemark.operators.windows import SEQ, TS
from tidemark.plans import ast as A
from tidemark.plans.parser import parse, parse_many
from tidemark.plans.planner import RESAMPLERS, STATEFUL, Scope, coefficients, default_name, expand_aliases, positive, shift, velocity
from tidemark.sources.events import shared_path

#: The count of a velocity filter, beside the columns of an event.
VELOCITY = "_velocity"
#: Which doubles of a row are NaN, a 1 or 0 for each, or NULL if none is: in
#: pandas they cannot be told from NULLs.
NANS = "_nans"


def _merged(kind: str, a: list, b: list) -> list:
    """Two parts of a window as one: a sum, a least or greatest value, or count,
    mean and sum of squares about it."""
    if kind != "STD":
        return [{"MIN": min, "MAX": max}.get(kind, lambda x, y: x + y)(a[0], b[0])]
    n, apart = a[0] + b[0], b[1] - a[1]
    return [n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n]


def moved(kind: str, n: int, s: list, x: float) -> float | None:
    """A moving function of the last n events, one more being x; None before
    there are n. Values are in blocks of n: state s is the last parts of the
    block before, by length, and the own block's values and first part. What has
    left leaves no trace, and an event costs the same for all n."""
    if not s:
        s[:] = [[], [], []]
    own = [1, x, 0.0] if kind == "STD" else [x]
    s[1].append(x)
    s[2] = _merged(kind, s[2], own) if s[2] else own
    found = None
    if len(s[1]) == n:
        found = s[2]
    elif s[0]:
        found = _merged(kind, s[0][n - len(s[1]) - 1], s[2])
    if len(s[1]) == n:
        tails, part = [], []
        for v in reversed(s[1]):
            one = [1, v, 0.0] if kind == "STD" else [v]
            part = _merged(kind, one, part) if part else one
            tails.append(part)
        s[:] = [tails, [], []]
    if found is None:
        return None
    if kind == "STD":
        return math.sqrt(max(found[2], 0.0) / (n - 1)) if n > 1 else 0.0
    return found[0] / n if kind == "AVERAGE" else found[0]


class Machine:
    """A query's functions over the events of one key, one at a time. Its state
    is lists of numbers, so it can be kept between micro-batches."""

    def __init__(self, select: A.Select, columns: list[str]) -> None:
        items, expand = expand_aliases(select.items, set(columns))
        self.items = items
        self.where = None if select.where is None else expand(select.where)
        self.having = None if select.having is None else expand(select.having)
        self.fast = velocity(self.having)
        if self.fast is not None:
            self.having = None
        if self.where is not None and any(isinstance(x, A.Call) and x.name in STATEFUL for x in A.walk(self.where)):
            raise SqlError("windows in WHERE span all keys: they run on batches only")
        self.calls: list[A.Call] = []
        for e in [i.expr for i in items] + ([self.having] if self.having is not None else []):
            self._collect(e)
        self.grid = [i for i in items if isinstance(i.expr, A.Call) and i.expr.name == "RESAMPLE"]
        if any(isinstance(x, A.Call) and x.name in RESAMPLERS and x not in [i.expr for i in self.grid] for c in self.calls for x in A.walk(c)):
            raise SqlError("RESAMPLE runs live as an item of SELECT, RESAMPLE_HERMITE on batches only")
        if len({positive(i.expr, 1, 2) for i in self.grid}) > 1:
            raise SqlError("RESAMPLE takes one interval in a query")
        self.calls = [c for c in self.calls if c.name not in RESAMPLERS]
        self.peaks = [c for c in self.calls if c.name == "PEAK_DETECT"]
        self.shift = sum({shift(x) for i in items for x in A.walk(i.expr) if isinstance(x, A.Call) and x.name == "TIME_SHIFT"})
        self.state: dict[str, list] = {}

    def _collect(self, e: A.Expr) -> None:
        for child in A.children(e):
            self._collect(child)
        if isinstance(e, A.Call) and e.name in STATEFUL and e not in self.calls:
            self.calls.append(e)

    def step(self, ts: int, seq: int, row: dict) -> list[list]:
        """The rows that one event emits: time, sequence and values."""
        done: dict[A.Call, float | None] = {}
        value = lambda e: evaluate(e, row, done)
        if self.fast is not None:
            done[A.Call("MOVING_COUNT", (A.Num(float(self.fast[0])),))] = row[VELOCITY]
        if self.where is not None and not value(self.where):
            return []
        for i, call in enumerate(self.calls):
            if call not in done:
                done[call] = self._call(str(i), call, value, ts)
        if self.grid:
            return self._on_grid(ts, [value(i.expr.args[0] if i in self.grid else i.expr) for i in self.items])
        if any(v is None for v in done.values()) or (self.having is not None and not value(self.having)):
            return []
        out = [value(i.expr) for i in self.items]
        if any(v is None for v in out):
            return []
        if len(self.peaks) == 1:
            ts = self.state[f"{self.calls.index(self.peaks[0])}t"][0]
        return [[ts + self.shift, seq, *out]]

    def _on_grid(self, ts: int, values: list) -> list[list]:
        """The points of the grid since the event before, with its values, and
        the event's own time, if it is one."""
        if any(v is None for v in values):
            return []
        step = positive(self.grid[0].expr, 1, 2)
        s = self.state.setdefault("grid", [])
        if not s:
            s[:] = [ts, 0, values]
        first, nth, before = s
        out = []
        while first + nth * step < ts:
            out.append([first + nth * step, nth, *before])
            nth += 1
        if first + nth * step == ts:
            out.append([ts, nth, *values])
            nth += 1
        s[:] = [first, nth, values]
        return out

    def _call(self, name: str, e: A.Call, value: Callable, ts: int) -> float | None:
        s = self.state.setdefault(name, [])
        if e.name == "COUNT":
            s[:] = [(s[0] if s else 0.0) + 1.0]
            return s[0]
        if e.name == "MOVING_COUNT":
            n = positive(e, 0, 1)
            s[:] = [min((s[0] if s else 0) + 1, n)]
            return float(n) if s[0] == n else None
        x = value(e.args[0])
        if x is None:
            return None
        x = float(x)
        if e.name in ("SUM", "AVG", "MIN", "MAX"):
            total, n, low, high = s or (0.0, 0, math.inf, -math.inf)
            s[:] = [total + x, n + 1, min(low, x), max(high, x)]
            return {"SUM": s[0], "AVG": s[0] / s[1], "MIN": s[2], "MAX": s[3]}[e.name]
        if e.name == "DIFFERENCE":
            before = s[0] if s else None
            s[:] = [x]
            return None if before is None else x - before
        if e.name == "IIR":
            a, b = coefficients(e, 1, 3), coefficients(e, 2, 3)
            xs, ys = s or ([0.0] * len(b), [0.0] * (len(a) - 1))
            xs = [x, *xs[:-1]]
            y = (sum(c * v for c, v in zip(b, xs, strict=True)) - sum(c * v for c, v in zip(a[1:], ys, strict=True))) / a[0]
            s[:] = [xs, [y, *ys][: len(a) - 1]]
            return y
        if e.name == "FIR":
            taps = coefficients(e, 1, 2)
            s.append(x)
            del s[: -len(taps)]
            return sum(c * v for c, v in zip(taps, reversed(s), strict=True)) if len(s) == len(taps) else None
        n = positive(e, 1, 2)
        if e.name == "PEAK_DETECT":
            times = self.state.setdefault(f"{name}times", [])
            s.append(x)
            times.append(ts)
            del s[:-n], times[:-n]
            if len(s) < n:
                return None
            at = n - 1 - n // 2
            self.state[f"{name}t"] = [times[at]]
            return s[at] if all(s[at] > v for i, v in enumerate(s) if i != at) else None
        kind = "STD" if e.name == "STDDEV" else e.name.removeprefix("MOVING_")
        return moved(kind, n, s, x)


def _divide(a: float, b: float) -> float:
    if b == 0:
        return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1.0, b)
    return a / b


def _finite(f: Callable, other: Callable = lambda x: x) -> Callable:
    return lambda x: float(f(x)) if math.isfinite(x) else other(x)


def _log(f: Callable) -> Callable:
    return lambda x: f(x) if x > 0 else -math.inf if x == 0 else math.nan


_SCALARS: dict[str, Callable] = {
    "ABS": abs, "FLOOR": _finite(math.floor), "CEIL": _finite(math.ceil), "CEILING": _finite(math.ceil),
    "ROUND": _finite(lambda x: math.copysign(math.floor(abs(x) + 0.5), x)), "LN": _log(math.log), "LOG": _log(math.log), "LOG10": _log(math.log10), "LOG2": _log(math.log2),
    "SQRT": lambda x: math.sqrt(x) if x >= 0 else math.nan, "EXP": math.exp, **{n: _finite(f, lambda x: math.nan) for n, f in (("SIN", math.sin), ("COS", math.cos), ("TAN", math.tan))},
    "SIGN": lambda x: float((x > 0) - (x < 0)), "POWER": pow, "POW": pow,
}
_COMPARE: dict[str, Callable] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_ARITHMETIC: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divide, "%": lambda a, b: math.fmod(a, b) if b and math.isfinite(a) else math.nan,
}


_LOGICAL: dict[str, Callable] = {"XOR": lambda a, b: a != b, "NOR": lambda a, b: not (a or b), "NAND": lambda a, b: not (a and b), "IMPLIES": lambda a, b: not a or b}


def evaluate(e: A.Expr, row: dict, done: dict) -> object:
    """An expression over one event; None where nothing was emitted."""
    if isinstance(e, A.Call) and e in done:
        return done[e]
    if isinstance(e, (A.Num, A.Str)):
        return e.value
    if isinstance(e, A.Null):
        return None
    if isinstance(e, A.Col):
        if e.name not in row:
            raise SqlError(f"unknown column {e.name}")
        return row[e.name]
    if isinstance(e, A.Case):
        for test, then in e.whens:
            if evaluate(test, row, done):
                return evaluate(then, row, done)
        return None if e.default is None else evaluate(e.default, row, done)
    if isinstance(e, A.IsNull):
        return (evaluate(e.arg, row, done) is None) != e.negated
    if isinstance(e, A.Call) and e.name == "TIME_SHIFT":
        return evaluate(e.args[0], row, done)
    values = [evaluate(x, row, done) for x in A.children(e)]
    if any(v is None for v in values):
        return None
    if isinstance(e, A.Unary):
        return (not values[0]) if e.op == "not" else -values[0]
    if isinstance(e, A.Binary):
        if e.op in ("and", "or"):
            return (bool(values[0]) and bool(values[1])) if e.op == "and" else (bool(values[0]) or bool(values[1]))
        return (_COMPARE.get(e.op) or _ARITHMETIC[e.op])(*values)
    if isinstance(e, A.Between):
        return (values[1] <= values[0] <= values[2]) != e.negated
    if isinstance(e, A.InList):
        return (values[0] in values[1:]) != e.negated
    if isinstance(e, A.Call) and e.name in _LOGICAL:
        return _LOGICAL[e.name](*map(bool, values))
    if isinstance(e, A.Call) and e.name in _SCALARS:
        return _SCALARS[e.name](*map(float, values))
    raise SqlError(f"{getattr(e, 'name', type(e).__name__)} runs on batches only")


class Ordered(StatefulProcessor):
    """Events of a key in the order of time and sequence, those ahead of the
    watermark held back. State is JSON: that of work(), and what is held."""

    def __init__(self, given: list[str], out: list[str], delay: int | None) -> None:
        self.given, self.out, self.delay = given, out, delay
        #: Names of the doubles among the given columns, and places of those
        #: among the output's, as NANS has them.
        self.given_doubles: list[str] = []
        self.out_doubles: list[int] = []

    def work(self, state: dict, events: list[list]) -> list[list]:
        """Output rows of events in order, each a list of the given columns
        without _time; state may be changed."""
        raise NotImplementedError

    def order(self, event: list) -> tuple:
        return event[0], event[1]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("state", T.StringType()), T.StructField("held", T.StringType())]))
        self.columns = [TS, SEQ, *[c for c in self.given if c not in (TS, SEQ, "_time", "_one")]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, held = {}, []
        if self.kept.exists():
            state, held = map(json.loads, self.kept.get())
        for frame in rows:
            # names of computed columns may be lost on the way; places are not
            frame = frame.set_axis([*self.given, NANS], axis=1)
            marks = frame.pop(NANS)
            frame = frame.astype(object).where(frame.notna(), None)
            events = frame[self.columns].to_numpy().tolist()
            places = [self.columns.index(c) if c in self.columns else None for c in self.given_doubles]
            for i in marks.notna().to_numpy().nonzero()[0].tolist():
                for place, mark in zip(places, marks.iloc[i], strict=True):
                    if mark == "1" and place is not None:
                        events[i][place] = math.nan
            held += events
        held.sort(key=self.order)
        ready, later = self._split(held, timerValues)
        out = self.work(state, ready)
        self.kept.update((json.dumps(state), json.dumps(later)))
        if later and self.delay is not None:
            self.handle.registerTimer(later[0][0] // 1000 + self.delay)
        if out:
            yield pd.DataFrame([[*row, self._nans(row)] for row in out], columns=[TS, SEQ, *self.out, NANS])

    def _nans(self, row: list) -> str | None:
        marks = "".join("1" if row[i + 2] is not None and row[i + 2] != row[i + 2] else "0" for i in self.out_doubles)
        return marks if "1" in marks else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.handleInputRows(key, iter(()), timerValues)

    def _split(self, held: list, timers) -> tuple[list, list]:
        """Events behind the watermark are in order; without one all are."""
        if self.delay is None:
            return held, []
        mark = timers.getCurrentWatermarkInMs() * 1000
        cut = sum(r[0] <= mark for r in held)
        return held[:cut], held[cut:]

    def close(self) -> None:
        pass


class ViewProcessor(Ordered):
    """A Machine for each key."""

    def __init__(self, select: A.Select, given: list[str], out: list[str], delay: int | None) -> None:
        super().__init__(given, out, delay)
        self.select = select

    def work(self, state: dict, events: list[list]) -> list[list]:
        machine = Machine(self.select, self.columns[2:])
        machine.state = state
        out = []
        for ts, seq, *values in events:
            out += machine.step(ts, seq, dict(zip(self.columns[2:], values, strict=True)))
        return out


class LatestProcessor(Ordered):
    """The latest values of several sources for each event of any, once all have
    emitted. Events have their source's rank and, of its own columns, values;
    those of one time go by the stream's first place, and those of one stream by
    their sequence. The rows are numbered in this order."""

    def __init__(self, given: list[str], out: list[str], delay: int | None, places: list[list[int]], first: list[int]) -> None:
        super().__init__(given, out, delay)
        #: For each source the places of its columns among the output's, and the
        #: first source of its stream.
        self.places, self.first = places, first

    def order(self, event: list) -> tuple:
        return event[0], self.first[event[2]], event[1], event[2]

    def work(self, state: dict, events: list[list]) -> list[list]:
        latest = state.setdefault("latest", [None] * len(self.places))
        out = []
        for ts, _, rank, *values in events:
            latest[rank] = [values[i] for i in self.places[rank]]
            if None in latest:
                continue
            row = [None] * len(self.out)
            for places, own in zip(self.places, latest, strict=True):
                for i, v in zip(places, own, strict=True):
                    row[i] = v
            state["rows"] = state.get("rows", 0) + 1
            out.append([ts, state["rows"], *row])
        return out


class TableProcessor(Ordered):
    """Events of a key with the table's row of their time. A change, which has
    rank 0, comes before an event of its time."""

    def __init__(self, given: list[str], out: list[str], delay: int | None, events: list[int], table: list[int], keep: bool) -> None:
        super().__init__(given, out, delay)
        self.events, self.table, self.keep = events, table, keep

    def order(self, event: list) -> tuple:
        return event[0], event[2], event[1]

    def work(self, state: dict, events: list[list]) -> list[list]:
        out = []
        for ts, seq, rank, deleted, *values in events:
            if rank == 0:
                state["row"] = None if deleted else [values[i] for i in self.table]
            elif state.get("row") is not None or self.keep:
                out.append([ts, seq, *[values[i] for i in self.events], *(state.get("row") or [None] * len(self.table))])
        return out


class VelocityProcessor(Ordered):
    """Events of all keys whose key is among the last n of them as often as a
    comparison asks, with that count."""

    def __init__(self, given: list[str], out: list[str], delay: int | None, keys: list[int], n: int, op: str, bound: float) -> None:
        super().__init__(given, out, delay)
        self.keys, self.n, self.op, self.bound = keys, n, op, bound

    def work(self, state: dict, events: list[list]) -> list[list]:
        last, at = state.get("last", []), 0
        counts = state.get("counts", {})
        out = []
        for ts, seq, *values in events:
            key = json.dumps([values[i] for i in self.keys])
            last.append(key)
            counts[key] = counts.get(key, 0) + 1
            if len(last) - at > self.n:
                gone = last[at]
                at += 1
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
            if _COMPARE[self.op](counts[key], self.bound):
                out.append([ts, seq, *values, float(counts[key])])
        state["last"], state["counts"] = last[at:], counts
        return out


def output_fields(select: A.Select, source: T.StructType) -> tuple[list[str], T.StructType]:
    """Names and schema of a view's rows: columns keep their types, all else
    is double."""
    items, _ = expand_aliases(select.items, {f.name for f in source.fields})
    kinds = {f.name: f.dataType for f in source.fields}
    names = [i.alias or default_name(i.expr) for i in items]
    fields = [T.StructField(TS, T.LongType()), T.StructField(SEQ, T.LongType())]
    fields += [T.StructField(n, kinds[i.expr.name] if isinstance(i.expr, A.Col) else T.DoubleType()) for n, i in zip(names, items, strict=True)]
    return names, T.StructType(fields)


def _keyed(events: DataFrame, keys: list[str], make: Callable[[list[str]], Ordered], schema: T.StructType, delay: int | None) -> DataFrame:
    """Events through a processor for each key, or one for all of them."""
    if not keys:
        events, keys = events.withColumn("_one", F.lit(1)), ["_one"]
    mode = "None" if delay is None else "EventTime"
    # names may hold a dot, which the operator takes for a field of a struct
    given = events.columns
    plain = events.toDF(*[f"_c{i}" for i in range(len(given))])
    real = (T.DoubleType, T.FloatType)
    doubles = [i for i, f in enumerate(events.schema.fields) if isinstance(f.dataType, real)]
    processor = make(given)
    processor.given_doubles = [processor.given[i] for i in doubles]
    processor.out_doubles = [i for i, f in enumerate(schema.fields[2:]) if isinstance(f.dataType, real)]
    marks = F.concat(F.lit(""), *[F.when(F.isnan(f"_c{i}"), "1").otherwise("0") for i in doubles])
    plain = plain.withColumn(NANS, F.when(marks.contains("1"), marks))
    marked = T.StructType([*schema.fields, T.StructField(NANS, T.StringType())])
    out = plain.groupBy(*[f"_c{given.index(k)}" for k in keys]).transformWithStateInPandas(processor, marked, "Append", mode)
    at = {2 + i: nth + 1 for nth, i in enumerate(processor.out_doubles)}
    # names may repeat, places do not
    named = out.toDF(*[f"_o{i}" for i in range(len(marked.fields))])
    nan = lambda i, f: F.when(F.substring(f"_o{len(schema.fields)}", at[i], 1) == "1", F.lit(math.nan).cast(f.dataType)).otherwise(F.col(f"_o{i}"))
    return named.select(*[(nan(i, f) if i in at else F.col(f"_o{i}")).alias(f.name) for i, f in enumerate(schema.fields)])


def _fields(events: DataFrame) -> list[T.StructField]:
    return [f for f in events.schema.fields if f.name not in (TS, SEQ, "_time")]


def _event_schema(fields: Iterable[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField(TS, T.LongType()), T.StructField(SEQ, T.LongType()), *fields])


def live_view(events: DataFrame, sql: str | A.Select, watermark: str | None = None, delay_ms: int | None = None) -> DataFrame:
    """A streaming DataFrame of a view's rows over a streaming DataFrame of
    events (_ts in microseconds, _seq, columns; _time if there is a watermark).
    Without GROUP BY all events are of one key."""
    select = parse(sql) if isinstance(sql, str) else sql
    if not isinstance(select, A.Select) or len(select.sources) != 1 or select.joins or select.order_by or select.limit is not None:
        raise SqlError("a live view is a SELECT from one source, without ORDER BY and LIMIT")
    fields = _fields(events)
    if any(isinstance(i.expr, A.Star) for i in select.items):
        select = replace(select, items=tuple(x for i in select.items for x in ([A.Item(A.Col(f.name)) for f in fields] if isinstance(i.expr, A.Star) else [i])))
    if not all(isinstance(k, A.Col) for k in select.group_by):
        raise SqlError("a live view groups by columns")
    delay = None if watermark is None else delay_ms or 0
    held = events.withWatermark("_time", watermark) if watermark is not None else events
    keys = [k.name for k in select.group_by]
    if (fast := velocity(expand_aliases(select.items, {f.name for f in fields})[1](select.having) if select.having is not None else None)) is not None:
        if delay is not None:
            raise SqlError("a velocity filter runs without a watermark")
        names = [f.name for f in fields]
        passed = [*fields, T.StructField(VELOCITY, T.DoubleType())]
        held = _keyed(held, [], lambda given: VelocityProcessor(given, [*names, VELOCITY], None, [names.index(k) for k in keys], *fast), _event_schema(passed), None)
    names, schema = output_fields(select, T.StructType(fields))
    return _keyed(held, keys, lambda given: ViewProcessor(select, given, names, delay), schema, delay)


def live_as_of(sources: list[tuple[str, DataFrame]], streams: list[str] | None = None) -> DataFrame:
    """Streams of events combined in event time, in each micro-batch: for each
    event of any, the latest of all, in columns label.column. `streams` names
    the sources' streams, if one may be there twice."""
    first = joins.first_places(streams or [label for label, _ in sources])
    fields, places, tagged = [], [], []
    for label, df in sources:
        own = [T.StructField(f"{label}.{f.name}", f.dataType) for f in _fields(df)]
        places.append(list(range(len(fields), len(fields) + len(own))))
        fields += own
    for rank, (label, df) in enumerate(sources):
        values = {f"{label}.{f.name}": F.col(f"`{f.name}`") for f in _fields(df)}
        tagged.append(df.select(TS, SEQ, F.lit(rank).alias("_rank"), *[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]))
    union = reduce(DataFrame.unionByName, tagged)
    return _keyed(union, [], lambda given: LatestProcessor(given, [f.name for f in fields], None, places, first), _event_schema(fields), None)


def live_table_join(events: DataFrame, changes: DataFrame, on: str, key: str, label: str, keep: bool = False) -> DataFrame:
    """Events with the columns of a table as of their time, as label.column.
    Changes are a stream (_ts, _seq, _deleted, columns) or, if they are all there
    before the events, a batch of rows, which is joined as it is."""
    rest = [f for f in _fields(changes) if f.name not in ("_deleted", key)]
    if not changes.isStreaming:
        found = joins.with_table(events, changes, on, key, [f.name for f in rest], keep)
        return found.select(*events.columns, *[F.col(f"`_t.{f.name}`").alias(f"{label}.{f.name}") for f in rest])
    own = _fields(events)
    table = [T.StructField(f"{label}.{f.name}", f.dataType) for f in rest]
    left = events.select(F.col(f"`{on}`").alias("_on"), TS, SEQ, F.lit(1).alias("_rank"), F.lit(False).alias("_deleted"), *[F.col(f"`{f.name}`") for f in own], *[F.lit(None).cast(f.dataType).alias(f.name) for f in table])
    kind = events.schema[on].dataType
    right = changes.select(F.col(f"`{key}`").cast(kind).alias("_on"), TS, SEQ, F.lit(0).alias("_rank"), "_deleted", *[F.lit(None).cast(f.dataType).alias(f.name) for f in own], *[F.col(f"`{f.name}`").alias(t.name) for f, t in zip(rest, table, strict=True)])
    fields = [*own, *table]

    def make(given: list[str]) -> Ordered:
        # the key is a column too: it does not go on
        return TableProcessor([c if c != "_on" else "_one" for c in given], [f.name for f in fields], None, list(range(len(own))), list(range(len(own), len(fields))), keep)

    return _keyed(left.unionByName(right), ["_on"], make, _event_schema(fields), None)


def live_script(streams: Mapping[str, DataFrame], sql: str, tables: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """The rows of the last SELECT of a script as a streaming DataFrame; before
    it, statements make views, of streams, of tables (rows or changes, and the
    key) and of each other."""
    live = dict(streams)
    out: DataFrame | None = None
    for statement in parse_many(sql):
        select = statement.select if isinstance(statement, A.CreateView) else statement
        if not isinstance(select, A.Select):
            raise SqlError("a live script has CREATE VIEW and SELECT only")
        out = _live_select(live, tables or {}, select)
        if isinstance(statement, A.CreateView):
            if statement.name in live:
                raise SqlError(f"{statement.name} exists already")
            live[statement.name] = out
    if out is None:
        raise SqlError("a live script ends in SELECT")
    return out


def _live_select(live: Mapping[str, DataFrame], tables: Mapping[str, tuple[DataFrame, str]], select: A.Select) -> DataFrame:
    for source in select.sources:
        if source.name not in live:
            raise SqlError(f"unknown source {source.name}")
    one = len(select.sources) == 1
    label = select.sources[0].label
    df = live[select.sources[0].name] if one else live_as_of([(s.label, live[s.name]) for s in select.sources], [s.name for s in select.sources])
    if one:
        columns = {(label, f.name): f.name for f in _fields(df)}
    else:
        columns = {(s.label, f.name): f"{s.label}.{f.name}" for s in select.sources for f in _fields(live[s.name])}
    for join in select.joins:
        if join.source.name not in tables or join.kind not in ("inner", "left"):
            raise SqlError(f"no table {join.source.name} for a {join.kind} join")
        changes, key = tables[join.source.name]
        if join.right.name != key:
            raise SqlError(f"JOIN takes the key {key} of {join.source.name}")
        on = Scope(columns).resolve(join.left)
        df = live_table_join(df, changes, on, key, join.source.label, join.kind == "left")
        columns |= {(join.source.label, f.name): f"{join.source.label}.{f.name}" for f in _fields(changes) if f.name not in ("_deleted", key)}
        columns[join.source.label, key] = on
    scope = Scope(columns)
    aliases = {i.alias for i in select.items if i.alias}

    def resolved(e: A.Expr) -> A.Expr:
        if isinstance(e, A.Col) and not (e.table is None and e.name not in scope.names and e.name in aliases):
            return A.Col(scope.resolve(e))
        return A.rebuild(e, resolved)

    items = tuple(A.Item(resolved(i.expr), i.alias or default_name(i.expr)) if not isinstance(i.expr, A.Star) else i for i in select.items)
    plain = replace(
        select, items=items, sources=select.sources[:1], joins=(), where=None if select.where is None else resolved(select.where),
        group_by=tuple(map(resolved, select.group_by)), having=None if select.having is None else resolved(select.having))
    return live_view(df, plain)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, ts: str, seq: str, files: int | None = None) -> DataFrame:
    """The Parquet files of a path as a stream of events, so many `files` in a
    micro-batch: the events of a key and batch are in memory at once. Without it
    all new files are one batch, in which order is that of time."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    found = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    return found.select(F.unix_micros(F.col(ts).cast("timestamp")).alias(TS), F.col(seq).cast("long").alias(SEQ), *[c for c in found.columns if c != ts])


def run_live(spark: SparkSession, make: Callable[[], DataFrame], checkpoint: str | None = None) -> DataFrame:
    """Runs a streaming DataFrame over all that its sources have now, and gives
    the rows that it has written; a run with the same checkpoint goes on. Files
    are taken in one micro-batch each run."""
    place = checkpoint or shared_path(spark, "live")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = make().writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{place}/rows")
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{place}/rows").drop(TS, SEQ)


def stream_view(spark: SparkSession, path: str, ts: str, seq: str, sql: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a view over the Parquet files of a path as a stream, until all are
    read, and gives the rows that it has written."""
    return run_live(spark, lambda: live_view(read_stream(spark, path, ts, seq), sql), checkpoint)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
