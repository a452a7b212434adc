"""Plans of SELECT over ordered events: syntax tree to DataFrame stages.

Every input and output has _ts and _seq, a total order. Each stateful call
becomes one column, innermost first; equal calls share it. NULL in a column
stands for nothing emitted, and a row appears only if all its columns emitted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.errors import SqlError
from tidemark.functions import scalars as S
from tidemark.operators import blocks, signal, windows
from tidemark.operators.windows import SEQ, TS, Frame
from tidemark.plans import ast as A

#: Fixed choices where the semantics are open.
FIR_NEEDS_ALL_TAPS = True
PEAK_AT_CENTRE = True

CUMULATIVE = {"SUM": windows.cumulative_sum, "AVG": windows.cumulative_avg, "MIN": windows.cumulative_min, "MAX": windows.cumulative_max}
MOVING = {
    "MOVING_AVERAGE": windows.moving_average, "MOVING_SUM": windows.moving_sum, "MOVING_STD": windows.moving_std,
    "STDDEV": windows.moving_std, "MOVING_MIN": windows.moving_min, "MOVING_MAX": windows.moving_max,
}
AGGREGATES = frozenset((*CUMULATIVE, "COUNT"))
RESAMPLERS = ("RESAMPLE", "RESAMPLE_HERMITE")
STATEFUL = AGGREGATES | frozenset((*MOVING, *RESAMPLERS, "MOVING_COUNT", "FIR", "IIR", "PEAK_DETECT", "DIFFERENCE"))
#: Functions of two conditions.
LOGICAL = {"XOR": lambda a, b: a != b, "NOR": lambda a, b: ~(a | b), "NAND": lambda a, b: ~(a & b), "IMPLIES": lambda a, b: ~a | b}


def stateful(e: A.Expr | None) -> bool:
    return any(isinstance(x, A.Call) and x.name in STATEFUL for x in A.walk(e))


def aggregates(e: A.Expr | None) -> bool:
    return any(isinstance(x, A.Call) and x.name in AGGREGATES for x in A.walk(e))


def sparse(e: A.Expr) -> bool:
    """Whether an expression may emit nothing between events that emit."""
    return any((isinstance(x, A.Case) and x.default is None) or (isinstance(x, A.Call) and x.name == "PEAK_DETECT") or isinstance(x, A.Null) for x in A.walk(e))


def over_deviations(*exprs: A.Expr | None) -> frozenset[A.Expr]:
    """Moving sums and averages that a moving deviation divides. In a constant
    window that is 0, and whether NaN or an infinity comes out is what rounding
    leaves above it: these are added in the SQL's order."""
    quotients = [q for e in exprs for q in A.walk(e) if isinstance(q, A.Binary) and q.op == "/" and any(isinstance(x, A.Call) and x.name in ("MOVING_STD", "STDDEV") for x in A.walk(q.right))]
    return frozenset(x for q in quotients for x in A.walk(q.left) if isinstance(x, A.Call) and x.name in ("MOVING_AVERAGE", "MOVING_SUM"))


def reach(*exprs: A.Expr | None) -> int | None:
    """Events before the current one that the expressions look at; None if it
    may be all of them."""
    most = 0
    for e in exprs:
        if e is None:
            continue
        below = reach(*A.children(e))
        if below is None:
            return None
        own = 0
        if isinstance(e, A.Call) and e.name in STATEFUL:
            if e.name in AGGREGATES or e.name in ("IIR", *RESAMPLERS) or any(map(sparse, e.args)):
                return None
            own = 1 if e.name == "DIFFERENCE" else (len(coefficients(e, 1, 2)) if e.name == "FIR" else positive(e, 0, 1) if e.name == "MOVING_COUNT" else positive(e, 1, 2)) - 1
        most = max(most, own + below)
    return most


def default_name(e: A.Expr) -> str:
    if isinstance(e, A.Col):
        return e.name
    if isinstance(e, A.Call):
        arg = next((x for x in e.args if isinstance(x, A.Col)), None)
        return f"{e.name.lower()}_{arg.name}" if arg and e.args and e.args[0] == arg else e.name.lower()
    return "expr"


def expand_aliases(items: tuple[A.Item, ...], columns: set[str]) -> tuple[tuple[A.Item, ...], Callable[[A.Expr], A.Expr]]:
    """Items with earlier aliases replaced, and the replacement for clauses.
    Source columns win over aliases, and an item sees only those before it."""
    known: dict[str, A.Expr] = {}

    def expand(e: A.Expr) -> A.Expr:
        if isinstance(e, A.Col) and e.table is None and e.name not in columns and e.name in known:
            return known[e.name]
        return A.rebuild(e, expand)

    out = []
    for item in items:
        e = expand(item.expr)
        out.append(A.Item(e, item.alias or default_name(item.expr)))
        if item.alias:
            known[item.alias] = e
    return tuple(out), expand


@dataclass
class Scope:
    """Columns a name can mean: by name, and by label and name."""

    columns: dict[tuple[str | None, str], str]
    labels: tuple[str, ...] = ()

    def resolve(self, c: A.Col) -> str:
        if c.table is not None:
            if (c.table, c.name) in self.columns:
                return self.columns[c.table, c.name]
            raise SqlError(f"unknown column {c.table}.{c.name}")
        hits = {v for (_, name), v in self.columns.items() if name == c.name}
        if not hits:
            raise SqlError(f"unknown column {c.name}")
        if len(hits) > 1:
            raise SqlError(f"ambiguous column {c.name}")
        return hits.pop()

    @property
    def names(self) -> set[str]:
        return {name for _, name in self.columns}

    def all(self) -> list[tuple[str, str]]:
        """Name and physical column of each column once, in order."""
        seen, out = set(), []
        for (_, name), v in self.columns.items():
            if v not in seen:
                seen.add(v)
                out.append((name, v))
        return out


def scope_of(df: DataFrame, *labels: str) -> Scope:
    names = [c for c in df.columns if c not in (TS, SEQ)]
    return Scope({(label, c): c for label in labels for c in names}, labels)


@dataclass
class Stages:
    """A DataFrame to which stateful calls are added as columns, once each."""

    df: DataFrame
    scope: Scope
    frame: Frame
    prefix: str
    made: dict[A.Expr, str] = field(default_factory=dict)
    in_nodes: frozenset[A.Expr] = frozenset()

    def column(self, e: A.Expr) -> Column:
        """The expression as a column, its stateful calls staged first."""
        if isinstance(e, A.Num):
            return F.lit(float(e.value))
        if isinstance(e, A.Str):
            return F.lit(e.value)
        if isinstance(e, A.Null):
            return F.lit(None).cast("double")
        if isinstance(e, A.Col):
            return F.col(f"`{self.scope.resolve(e)}`")
        if isinstance(e, A.Call):
            return self.stage(e) if e.name in STATEFUL else self.scalar(e)
        if isinstance(e, A.Unary):
            x = self.column(e.arg)
            return ~x if e.op == "not" else -S.number(x)
        if isinstance(e, A.Binary):
            return self.binary(e)
        if isinstance(e, A.Between):
            x, low, high = self.column(e.arg), self.column(e.low), self.column(e.high)
            inside = S.compare(">=", x, low) & S.compare("<=", x, high)
            return ~inside if e.negated else inside
        if isinstance(e, A.InList):
            x = self.column(e.arg)
            hit = F.lit(False)
            for item in e.items:
                hit = hit | self.equals("=", x, self.column(item), item)
            return ~hit if e.negated else hit
        if isinstance(e, A.IsNull):
            x = self.column(e.arg)
            return x.isNotNull() if e.negated else x.isNull()
        if isinstance(e, A.Case):
            out = None
            for test, then in e.whens:
                t, v = self.truth(test), self.column(then)
                out = F.when(t, v) if out is None else out.when(t, v)
            return out if e.default is None else out.otherwise(self.column(e.default))
        if isinstance(e, A.Cast):
            return self.column(e.arg).cast("double" if e.kind in ("double", "float", "real", "numeric", "decimal") else e.kind)
        raise SqlError(f"{type(e).__name__} is not an expression here")

    def truth(self, e: A.Expr) -> Column:
        """A condition; a number is true unless 0."""
        if isinstance(e, A.Binary) and e.op in ("and", "or"):
            a, b = self.truth(e.left), self.truth(e.right)
            return a & b if e.op == "and" else a | b
        if isinstance(e, A.Unary) and e.op == "not":
            return ~self.truth(e.arg)
        x = self.column(e)
        if isinstance(e, A.Call) and e.name in LOGICAL:
            return x
        return x if isinstance(e, (A.Binary, A.Between, A.InList, A.IsNull)) and getattr(e, "op", "=") not in "+-*/%" else S.number(x) != 0

    def equals(self, op: str, a: Column, b: Column, *exprs: A.Expr) -> Column:
        if any(isinstance(x, A.Str) for x in exprs):
            return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return S.compare(op, a, b)

    def binary(self, e: A.Binary) -> Column:
        if e.op in ("and", "or"):
            return self.truth(e)
        a, b = self.column(e.left), self.column(e.right)
        if e.op in ("=", "<>", "<", "<=", ">", ">="):
            return self.equals(e.op, a, b, e.left, e.right)
        if e.op == "/":
            return S.divide(a, b)
        if e.op == "%":
            return S.remainder(a, b)
        a, b = S.number(a), S.number(b)
        return {"+": a + b, "-": a - b, "*": a * b}[e.op]

    def scalar(self, e: A.Call) -> Column:
        if e.name in S.UNARY:
            if len(e.args) != 1:
                raise SqlError(f"{e.name} takes one argument")
            return S.UNARY[e.name](self.column(e.args[0]))
        if e.name in ("POWER", "POW"):
            if len(e.args) != 2:
                raise SqlError("POWER takes two arguments")
            return S.power(self.column(e.args[0]), self.column(e.args[1]))
        if e.name in LOGICAL:
            if len(e.args) != 2:
                raise SqlError(f"{e.name} takes two conditions")
            return LOGICAL[e.name](self.truth(e.args[0]), self.truth(e.args[1]))
        if e.name == "TIME_SHIFT":
            shift(e)
            return self.column(e.args[0])
        if self.df.sparkSession.catalog.functionExists(e.name.lower()):
            return F.call_function(e.name.lower(), *[self.column(a) for a in e.args])
        raise SqlError(f"unknown function {e.name}")

    def stage(self, e: A.Call) -> Column:
        if e not in self.made:
            name = f"{self.prefix}{len(self.made)}"
            self.df = self._staged(e, name)
            self.made[e] = name
        return F.col(self.made[e])

    def _argument(self, e: A.Expr) -> Column:
        """An argument as a column of its own, if windows are below it."""
        x = S.number(self.column(e))
        if isinstance(e, A.Col):
            return x
        name = f"{self.prefix}a{len(self.df.columns)}"
        self.df = self.df.withColumn(name, x)
        return F.col(name)

    def _staged(self, e: A.Call, name: str) -> DataFrame:
        if e.name == "COUNT":
            if e.args and not isinstance(e.args[0], A.Star):
                raise SqlError("COUNT takes *")
            return self.df.withColumn(name, windows.cumulative_count(self.frame))
        if e.name == "MOVING_COUNT":
            return self.df.withColumn(name, windows.moving_count(positive(e, 0, 1), self.frame))
        if not e.args or isinstance(e.args[0], A.Star):
            raise SqlError(f"{e.name} takes a column")
        if e.name in CUMULATIVE:
            if len(e.args) != 1:
                raise SqlError(f"{e.name} takes one argument")
            x = self._argument(e.args[0])
            return self.df.withColumn(name, CUMULATIVE[e.name](x, self.frame, sparse(e.args[0])))
        if e.name in MOVING:
            n = positive(e, 1, 2)
            x = self._argument(e.args[0])
            kind = "STD" if e.name == "STDDEV" else e.name.removeprefix("MOVING_")
            if n >= windows.LARGE:
                return windows.in_two_parts(self.df, name, kind, x, n, self.frame)
            if e in self.in_nodes and n > windows.NODE:
                return windows.in_nodes(self.df, name, kind, x, n, self.frame, sparse(e.args[0]))
            return self.df.withColumn(name, MOVING[e.name](x, n, self.frame, sparse(e.args[0])))
        if e.name == "DIFFERENCE":
            if len(e.args) != 1:
                raise SqlError("DIFFERENCE takes one argument")
            x = self._argument(e.args[0])
            return self.df.withColumn(name, windows.difference(x, self.frame, sparse(e.args[0])))
        if e.name == "FIR":
            taps = coefficients(e, 1, 2)
            x = self._argument(e.args[0])
            return self.df.withColumn(name, signal.fir(x, taps, self.frame, sparse(e.args[0])))
        if e.name == "IIR":
            a, b = coefficients(e, 1, 3), coefficients(e, 2, 3)
            x = self._argument(e.args[0])
            self.df = self.df.withColumn(f"{name}x", x)
            return signal.iir(self.df, f"{name}x", a, b, self.frame.keys, name)
        if e.name == "PEAK_DETECT":
            n = positive(e, 1, 2)
            x = self._argument(e.args[0])
            value, ts, _ = signal.peak(x, n, self.frame, sparse(e.args[0]))
            df = self.df.withColumn(name, value)
            return df.withColumn(f"{name}t", ts) if PEAK_AT_CENTRE else df
        raise SqlError(f"{e.name} is not allowed here")

    def emitted(self, *exprs: A.Expr | None) -> Column:
        """Whether all stateful calls of some expressions emitted."""
        ok = F.lit(True)
        for e in exprs:
            for x in A.walk(e):
                if isinstance(x, A.Call) and x.name in STATEFUL:
                    ok = ok & self.stage(x).isNotNull()
        return ok


def only_totals(exprs: list[A.Expr]) -> bool:
    """Whether all stateful calls are running totals of plain values, and there
    is one."""
    calls = [x for e in exprs for x in A.walk(e) if isinstance(x, A.Call) and x.name in STATEFUL]
    return bool(calls) and all(c.name in AGGREGATES and not any(stateful(a) or sparse(a) for a in c.args) for c in calls)


class RangedTotals(Stages):
    """Running totals over ranges of time: those within a range, and what all
    ranges before it add up to, one row for each range. What is before them is
    found for all calls at once, so that the events are read twice, however many
    calls there are."""

    def before_ranges(self, exprs: list[A.Expr]) -> None:
        """Adds to each event the totals of the ranges before its own."""
        calls = list(dict.fromkeys(x for e in exprs for x in A.walk(e) if isinstance(x, A.Call) and x.name in STATEFUL))
        self.past = {call: f"{self.prefix}p{i}" for i, call in enumerate(calls)}
        own, all_before = [], []
        before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
        for call, name in self.past.items():
            total, x = self._total(call), self._added(call)
            own += [total(x).alias(f"{name}t"), F.count(x).cast("double").alias(f"{name}n")]
            all_before += [total(f"{name}t").over(before).alias(f"{name}t"), F.sum(f"{name}n").over(before).alias(f"{name}n")]
        sums = self.df.groupBy(F.col("_range").alias("_of")).agg(*own).select("_of", *all_before)
        # at most blocks.MOST_RANGES rows
        self.df = self.df.join(F.broadcast(sums), F.col("_range") == F.col("_of")).drop("_of")

    def _total(self, e: A.Call) -> Callable[[Column], Column]:
        return {"MIN": F.min, "MAX": F.max}.get(e.name, F.sum)

    def _added(self, e: A.Call) -> Column:
        if e.name == "COUNT":
            if e.args and not isinstance(e.args[0], A.Star):
                raise SqlError("COUNT takes *")
            return F.lit(1.0)
        if len(e.args) != 1 or isinstance(e.args[0], A.Star):
            raise SqlError(f"{e.name} takes one argument")
        return S.number(self.column(e.args[0]))

    def _staged(self, e: A.Call, name: str) -> DataFrame:
        x, within = self._added(e), self.frame.running()
        own, past = self._total(e)(x).over(within), F.col(f"{self.past[e]}t")
        both = {"MIN": F.least(own, past), "MAX": F.greatest(own, past)}.get(e.name, F.coalesce(past, F.lit(0.0)) + own)
        if e.name == "AVG":
            both = both / (F.coalesce(F.col(f"{self.past[e]}n"), F.lit(0.0)) + F.count(x).over(within).cast("double"))
        return self.df.withColumn(name, both)


def positive(e: A.Call, at: int, size: int) -> int:
    n = e.args[at] if len(e.args) == size else None
    if not isinstance(n, A.Num) or n.value < 1 or n.value != int(n.value):
        raise SqlError(f"{e.name} takes a positive integer as argument {at + 1} of {size}")
    return int(n.value)


def shift(e: A.Call) -> int:
    """The units of time by which TIME_SHIFT(x, k) moves a row."""
    k = e.args[1] if len(e.args) == 2 else None
    sign = 1
    if isinstance(k, A.Unary) and k.op == "-":
        sign, k = -1, k.arg
    if not isinstance(k, A.Num) or k.value != int(k.value):
        raise SqlError("TIME_SHIFT takes a whole number as argument 2 of 2")
    return sign * int(k.value)


def coefficients(e: A.Call, at: int, size: int) -> list[float]:
    array = e.args[at] if len(e.args) == size else None
    if not isinstance(array, A.Array) or not all(isinstance(x, A.Num) for x in array.items):
        raise SqlError(f"{e.name} takes an ARRAY of numbers as argument {at + 1} of {size}")
    return [x.value for x in array.items]


def velocity(having: A.Expr | None) -> tuple[int, str, float] | None:
    """N, comparison and bound of HAVING MOVING_COUNT(N) op c, which filters
    the events of all keys before they reach the keys."""
    if isinstance(having, A.Binary) and having.op in ("<", "<=", ">", ">=", "=", "<>"):
        for call, bound, op in ((having.left, having.right, having.op), (having.right, having.left, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(having.op, having.op))):
            if isinstance(call, A.Call) and call.name == "MOVING_COUNT" and isinstance(bound, A.Num):
                return positive(call, 0, 1), op, bound.value
    return None


@dataclass
class Planned:
    """Rows with _ts, _seq and the columns of a query; keys are theirs."""

    df: DataFrame
    keys: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (TS, SEQ)]


def spread(df: DataFrame, block_rows: int | None, size: Callable[[], int], *exprs: A.Expr | None) -> tuple[DataFrame, Frame] | None:
    """Events in blocks, and the frame of a block, for windows without a key
    that reach back a bounded number of events; None if one task will do, or
    must: running totals and recursive filters need all that was before."""
    back = reach(*exprs)
    if not block_rows or not back or (total := size()) <= block_rows:
        return None
    return blocks.in_blocks(blocks.with_rank(df, total, block_rows), back, block_rows), Frame((blocks.BLOCK,), (blocks.RANK,), blocks.RANK)


def plan_events(select: A.Select, df: DataFrame, scope: Scope, block_rows: int | None = None, hot_keys: bool = False, size: Callable[[], int] | None = None) -> Planned:
    """A query over events, without ORDER BY and LIMIT. Windows without a key
    go in blocks of block_rows events, if there are more by size(), which is
    asked only for those; with hot_keys, so do those of keys that have more.
    Running totals without a key go by ranges of time."""
    size = size or df.count
    items = select.items
    if any(isinstance(i.expr, A.Star) for i in items):
        if any(i.alias for i in items if isinstance(i.expr, A.Star)):
            raise SqlError("* takes no alias")
        labels = {v: label for (label, _), v in reversed(list(scope.columns.items()))}
        items = tuple(x for i in items for x in ([A.Item(A.Col(name, labels[v]), name) for name, v in scope.all()] if isinstance(i.expr, A.Star) else [i]))
    items, expand = expand_aliases(items, scope.names)
    where = None if select.where is None else expand(select.where)
    having = None if select.having is None else expand(select.having)
    if aggregates(where):
        raise SqlError("aggregates are not allowed in WHERE")
    resampled = [i for i in items if isinstance(i.expr, A.Call) and i.expr.name in RESAMPLERS]

    # WHERE sees the events of all keys, before any other state
    parts = spread(df, block_rows, size, where) if stateful(where) else None
    before = Stages(*((parts[0], scope, parts[1]) if parts else (df, scope, Frame())), "_w")
    if where is not None:
        condition = before.truth(where) & before.emitted(where)
        before.df = blocks.own(before.df, condition) if parts else before.df.filter(condition)
    df = before.df.drop(*[c for c in before.df.columns if c.startswith("_w")])

    keys, key_names = [], []
    for i, e in enumerate(select.group_by):
        e = expand(e)
        if stateful(e):
            raise SqlError("GROUP BY takes no windows")
        name = scope.resolve(e) if isinstance(e, A.Col) else f"_k{i}"
        if not isinstance(e, A.Col):
            df = df.withColumn(name, Stages(df, scope, Frame(), "_g").column(e))
        keys.append(name)
        key_names.append((e, e.name if isinstance(e, A.Col) else default_name(e)))
    frame = Frame(tuple(keys))

    if resampled:
        return _resampled(items, df, scope, frame, key_names)

    fast = velocity(having)
    if fast is not None:
        n, op, bound = fast
        if block_rows and (total := size()) > block_rows:
            df = blocks.with_rank(df, total, block_rows)
        else:
            df = df.withColumn(blocks.RANK, F.row_number().over(Window.orderBy(TS, SEQ)))
        df = df.withColumn("_velocity", windows.moving_key_count(n, F.col(blocks.RANK), frame.keys))
        df = df.filter(S.compare(op, F.col("_velocity"), F.lit(float(bound))))
        having = None

    parts = spread(df, block_rows, size, having, *[i.expr for i in items]) if not keys else None
    back = reach(having, *[i.expr for i in items]) if keys and hot_keys and block_rows else None
    if back and (split := blocks.hot_keys_in_blocks(df, keys, back, block_rows)) is not None:
        parts = split, Frame((*keys, blocks.BLOCK), number=blocks.RANK)
    if parts:
        df, frame = parts
    exprs = [x for x in (having, *[i.expr for i in items]) if x is not None]
    if not keys and not parts and block_rows and only_totals(exprs) and (total := size()) > block_rows:
        placed, _ = blocks.in_ranges(df, total, block_rows)
        stages = RangedTotals(placed, scope, Frame(("_range",)), "_s")
        stages.before_ranges(exprs)
    else:
        stages = Stages(df, scope, frame, "_s", in_nodes=over_deviations(*exprs))
    if fast is not None:
        stages.made[A.Call("MOVING_COUNT", (A.Num(float(fast[0])),))] = "_velocity"
    columns = [(item, stages.column(item.expr)) for item in items]
    ok = stages.emitted(*[i.expr for i in items])
    for item, column in columns:
        if sparse(item.expr):
            ok = ok & column.isNotNull()
    if having is not None:
        ok = ok & stages.emitted(having)
        ok = stages.truth(having) & ok
    out = stages.df.filter(ok & F.col(blocks.OWN) if parts else ok)

    shown = {item.expr: item.alias for item in items if item.expr in [e for e, _ in key_names]}
    names: list[str] = []
    picked: list[Column] = []

    def add(name: str, column: Column) -> str:
        base, n = name, 1
        while name in names or name in (TS, SEQ):
            n += 1
            name = f"{base}_{n}"
        names.append(name)
        picked.append(column.alias(name))
        return name

    final_keys = []
    for (e, name), physical in zip(key_names, keys, strict=True):
        final_keys.append(add(shown.get(e) or name, F.col(f"`{physical}`")))
    for item, column in columns:
        if item.expr in shown and any(item.expr == e for e, _ in key_names):
            continue
        add(item.alias or default_name(item.expr), column)
    peaks = [x for i in items for x in A.walk(i.expr) if isinstance(x, A.Call) and x.name == "PEAK_DETECT"]
    time = F.col(f"{stages.made[peaks[0]]}t") if peaks and PEAK_AT_CENTRE and len(set(peaks)) == 1 else F.col(TS)
    shifts = {shift(x) for i in items for x in A.walk(i.expr) if isinstance(x, A.Call) and x.name == "TIME_SHIFT"}
    if len(shifts) > 1:
        raise SqlError("TIME_SHIFT takes one shift in a query")
    time = time + F.lit(shifts.pop()) if shifts else time
    return Planned(out.select(time.alias(TS), SEQ, *picked), tuple(final_keys))


def _resampled(items: tuple[A.Item, ...], df: DataFrame, scope: Scope, frame: Frame, key_names: list) -> Planned:
    """RESAMPLE and RESAMPLE_HERMITE items, all of one interval, on a grid of
    each key; other items are plain columns, which keep their last value too."""
    stages = Stages(df, scope, frame, "_s")
    intervals, values, smooth = set(), [], []
    for item in items:
        e = item.expr
        if isinstance(e, A.Call) and e.name in RESAMPLERS:
            intervals.add(positive(e, 1, 2))
            if e.name == "RESAMPLE_HERMITE":
                smooth.append(f"_v.{item.alias or default_name(item.expr)}")
            e = e.args[0]
        if any(e == k for k, _ in key_names):
            continue
        values.append((item.alias or default_name(item.expr), S.number(stages.column(e)), e))
    if len(intervals) > 1:
        raise SqlError("RESAMPLE takes one interval in a query")
    ok = stages.emitted(*[e for *_, e in values])
    ready = stages.df.filter(ok)
    for name, column, _ in values:
        ready = ready.withColumn(f"_v.{name}", column)
    grid = signal.resample(ready, [f"_v.{name}" for name, *_ in values], intervals.pop(), frame.keys, smooth)
    keys = [F.col(f"`{k}`").alias(name) for k, (_, name) in zip(frame.keys, key_names, strict=True)]
    return Planned(grid.select(TS, SEQ, *keys, *[F.col(f"`_v.{n}`").alias(n) for n, *_ in values]), tuple(name for _, name in key_names))
