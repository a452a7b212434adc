"""Running aggregates and count-based moving windows over ordered events.

All take a column and the ordering of its rows, and give a column with a value
for each event. Moving functions emit from the N-th event on; before it they are
NULL, which stands for nothing emitted. NULL inputs at the beginning of a key,
as another moving function leaves them, do not count; inputs with NULLs between
must be partitioned by whether they are NULL (see Frame.of)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

TS, SEQ = "_ts", "_seq"
#: Sizes from which moving functions are made of two parts of blocks, whose
#: cost does not grow with the size.
LARGE = 512
#: Rows of a node of the tree in which DuckDB adds a frame's values.
NODE = 16


@dataclass(frozen=True)
class Frame:
    """Partition and total order of events; number is the column that numbers
    events from 0, if a partition holds only a part of them."""

    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = (TS, SEQ)
    number: str | None = None

    def spec(self, sparse: Column | None = None) -> WindowSpec:
        keys = [F.col(f"`{k}`") for k in self.keys]
        parts = keys + ([sparse.isNotNull()] if sparse is not None else [])
        return Window.partitionBy(*parts).orderBy(*self.order)

    def running(self, sparse: Column | None = None) -> WindowSpec:
        return self.spec(sparse).rowsBetween(Window.unboundedPreceding, 0)

    def last(self, n: int, sparse: Column | None = None) -> WindowSpec:
        return self.spec(sparse).rowsBetween(-(n - 1), 0)


def _only(value: Column, x: Column, sparse: bool) -> Column:
    return F.when(x.isNotNull(), value) if sparse else value


def cumulative_sum(x: Column, frame: Frame, sparse: bool = False) -> Column:
    return _only(F.sum(x).over(frame.running(x if sparse else None)), x, sparse)


def cumulative_count(frame: Frame) -> Column:
    return F.count(F.lit(1)).over(frame.running()).cast("double")


def cumulative_avg(x: Column, frame: Frame, sparse: bool = False) -> Column:
    return _only(F.avg(x).over(frame.running(x if sparse else None)), x, sparse)


def cumulative_min(x: Column, frame: Frame, sparse: bool = False) -> Column:
    return _only(F.min(x).over(frame.running(x if sparse else None)), x, sparse)


def cumulative_max(x: Column, frame: Frame, sparse: bool = False) -> Column:
    return _only(F.max(x).over(frame.running(x if sparse else None)), x, sparse)


def _full(value: Column, x: Column, n: int, frame: Frame, sparse: bool) -> Column:
    full = F.count(x).over(frame.last(n, x if sparse else None)) == n
    return F.when(full & x.isNotNull(), value)


def moving_sum(x: Column, n: int, frame: Frame, sparse: bool = False) -> Column:
    return _full(F.sum(x).over(frame.last(n, x if sparse else None)), x, n, frame, sparse)


def moving_average(x: Column, n: int, frame: Frame, sparse: bool = False) -> Column:
    return _full(F.avg(x).over(frame.last(n, x if sparse else None)), x, n, frame, sparse)


def moving_count(n: int, frame: Frame) -> Column:
    return F.when(F.row_number().over(frame.spec()) >= n, F.lit(float(n)))


def moving_std(x: Column, n: int, frame: Frame, sparse: bool = False) -> Column:
    """Sample standard deviation; 0 for one event."""
    value = F.coalesce(F.stddev_samp(x).over(frame.last(n, x if sparse else None)), F.lit(0.0))
    return _full(value, x, n, frame, sparse)


def moving_min(x: Column, n: int, frame: Frame, sparse: bool = False) -> Column:
    return _full(F.min(x).over(frame.last(n, x if sparse else None)), x, n, frame, sparse)


def moving_max(x: Column, n: int, frame: Frame, sparse: bool = False) -> Column:
    return _full(F.max(x).over(frame.last(n, x if sparse else None)), x, n, frame, sparse)


def in_two_parts(df: DataFrame, name: str, kind: str, x: Column, n: int, frame: Frame) -> DataFrame:
    """Adds name: a moving function of the last n events at a cost that does not
    grow with n. NULL inputs are passed over.

    Events that emit are cut into blocks of n; the last n events are the first
    part of the own block and the last part of the one before, whose value is
    read n - 1 events back. Nothing is subtracted, so a value that has left, were
    it infinite or large, leaves no trace."""
    x_, flag, nth, block, head, tail = (f"{name}{c}" for c in "xfrbht")
    keys = [F.col(f"`{k}`") for k in frame.keys]
    df = df.withColumn(x_, x).withColumn(flag, F.col(x_).isNotNull())
    own = Window.partitionBy(*keys, flag).orderBy(*frame.order)
    df = df.withColumn(nth, F.row_number().over(own) - 1)
    df = df.withColumn(block, F.floor(F.col(nth) / n))
    value = F.col(x_)
    def part(order: list[Column]) -> Column:
        spec = Window.partitionBy(*keys, flag, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        if kind == "STD":
            return F.struct(F.avg(value).over(spec).alias("mean"), F.var_pop(value).over(spec).alias("var"))
        return {"MIN": F.min, "MAX": F.max}.get(kind, F.sum)(value).over(spec)

    df = df.withColumn(head, part([F.col(c).asc() for c in frame.order])).withColumn(tail, part([F.col(c).desc() for c in frame.order]))
    df = df.withColumn(tail, F.lag(tail, n - 1).over(own))
    a, b = F.col(head), F.col(tail)
    whole = (F.col(nth) + 1) % n == 0
    if kind == "STD":
        n1 = (F.col(nth) % n + 1).cast("double")
        n2 = n - n1
        apart = b["mean"] - a["mean"]
        both = a["var"] * n1 + b["var"] * n2 + apart * apart * n1 * n2 / float(n)
        found = F.sqrt(F.when(whole, a["var"] * float(n)).otherwise(both) / float(max(1, n - 1)))
    else:
        both = {"SUM": a + b, "AVERAGE": a + b, "MIN": F.least(a, b), "MAX": F.greatest(a, b)}[kind]
        found = F.when(whole, a).otherwise(both) / (float(n) if kind == "AVERAGE" else 1.0)
    return df.withColumn(name, F.when(F.col(flag) & (F.col(nth) + 1 >= n), found)).drop(x_, flag, nth, block, head, tail)


def _added(values: Column, start: Column) -> Column:
    return F.aggregate(values, start, lambda total, v: total + v)


def _added_in_nodes(values: Column, first: Column, most: int, start: Column) -> Column:
    """start and up to `most` values, of which the first has number `first`,
    added in DuckDB's order: one by one up to the first node, then whole nodes,
    which are added in the same way, then the rest one by one."""
    if most <= NODE:
        return _added(values, start)
    left = F.pmod(-first, F.lit(NODE)).cast("int")
    whole = F.greatest(F.lit(0), F.floor((F.size(values) - left) / NODE).cast("int"))
    places = F.slice(F.array(*[F.lit(i * NODE) for i in range(most // NODE)]), 1, whole)
    nodes = F.transform(places, lambda at: _added(F.slice(values, left + at + 1, F.lit(NODE)), F.lit(0.0)))
    inner = _added_in_nodes(nodes, F.floor((first + left) / NODE), most // NODE, _added(F.slice(values, F.lit(1), left), start))
    return _added(F.slice(values, left + whole * NODE + 1, F.lit(most)), inner)


def in_nodes(df: DataFrame, name: str, kind: str, x: Column, n: int, frame: Frame, sparse: bool = False) -> DataFrame:
    """Adds name: a moving SUM or AVERAGE that equals DuckDB's to the last bit.
    Nodes are counted from the first event of the key. The plain one, which
    costs less, differs by rounding only, and not at all where no whole node
    comes after other values."""
    values, nth, plain = f"{name}v", f"{name}n", f"{name}p"
    own = x if sparse else None
    number = F.row_number().over(frame.spec(own)) - 1
    if frame.number:
        number = number + F.first(frame.number).over(frame.running(own))
    df = df.withColumn(values, F.collect_list(x).over(frame.last(n, own))).withColumn(plain, F.sum(x).over(frame.last(n, own))).withColumn(nth, number.cast("long"))
    first = F.col(nth) - (n - 1)
    left = F.pmod(-first, F.lit(NODE))
    nodes = (left + NODE <= n) & ((left > 0) | F.lit(n >= 2 * NODE))
    total = F.when(nodes, _added_in_nodes(F.col(values), first, n, F.lit(0.0))).otherwise(F.col(plain))
    found = F.when((F.size(values) == n) & x.isNotNull(), total / (float(n) if kind == "AVERAGE" else 1.0))
    return df.withColumn(name, found).drop(values, nth, plain)


def moving_key_count(n: int, rank: Column, keys: tuple[str, ...]) -> Column:
    """Events of the own key among the last n events of all keys; rank numbers
    the events of all keys."""
    window = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(rank).rangeBetween(-(n - 1), 0)
    return F.count(F.lit(1)).over(window).cast("double")


def difference(x: Column, frame: Frame, sparse: bool = False) -> Column:
    """Change since the event before that emitted."""
    return x - F.lag(x, 1).over(frame.spec(x if sparse else None))
