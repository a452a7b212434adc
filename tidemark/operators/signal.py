"""Signal functions: filters, peaks and resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tidemark.operators.windows import SEQ, TS, Frame


def fir(x: Column, taps: Sequence[float], frame: Frame, sparse: bool = False) -> Column:
    """Sum of taps[i] * x[n-i], from the event on that fills all taps."""
    spec = frame.spec(x if sparse else None)
    terms = [F.lit(float(c)) * (F.lag(x, i).over(spec) if i else x) for i, c in enumerate(taps)]
    return reduce(lambda a, b: a + b, terms)


def peak(x: Column, n: int, frame: Frame, sparse: bool = False) -> tuple[Column, Column, Column]:
    """The centre of the last n events, if strictly greater than the others,
    with the centre's time and sequence."""
    spec = frame.spec(x if sparse else None)
    half = n // 2
    centre, after = F.lag(x, half).over(spec) if half else x, None
    sides = []
    if n - 1 - half > 0:
        sides.append(F.max(x).over(spec.rowsBetween(-(n - 1), -half - 1)))
    if half:
        sides.append(F.max(x).over(spec.rowsBetween(-half + 1, 0)))
    full = (F.count(x).over(spec.rowsBetween(-(n - 1), 0)) == n) & x.isNotNull()
    found = reduce(lambda a, side: a & (centre > side), sides, full)
    del after
    back = lambda c: F.lag(F.col(c), half).over(spec) if half else F.col(c)
    return F.when(found, centre), F.when(found, back(TS)), F.when(found, back(SEQ))


def iir(df: DataFrame, column: str, a: Sequence[float], b: Sequence[float], keys: Sequence[str], out: str) -> DataFrame:
    """Adds out: y[n] = (sum b[i] x[n-i] - sum a[j] y[n-j], j >= 1) / a[0], from a
    zero state, in the order of events of each key. NULL inputs are passed over.

    The recursion needs a key's events in order, but never all at once: sorted
    partitions stream through, and only the filter's state is held."""
    if not a or not b or a[0] == 0:
        raise ValueError("a needs a first coefficient other than 0, b at least one")
    fields = [*df.schema.fields, T.StructField(out, T.DoubleType())]
    keys = list(keys)
    held = df.repartition(*[F.col(f"`{k}`") for k in keys]) if keys else df.coalesce(1)
    ordered = held.sortWithinPartitions(*keys, TS, SEQ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Recurrence(a, b)
        last: tuple | None = None
        for batch in batches:
            n = batch.num_rows
            x = batch.column(column).cast(pa.float64())
            there = x.is_valid().to_numpy(zero_copy_only=False)
            x = x.fill_null(0.0).to_numpy()
            y = np.zeros(n)
            new = np.arange(n) == 0
            for k in keys:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new |= np.append(True, codes[1:] != codes[:-1])[:n]
            starts = np.flatnonzero(new).tolist()
            for start, end in zip(starts, [*starts[1:], n], strict=False):
                key = tuple(batch.column(k)[start].as_py() for k in keys)
                if key != last:
                    last = key
                    filter_.reset()
                at = start + np.flatnonzero(there[start:end])
                y[at] = filter_(x[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64(), mask=~there)], names=[*batch.schema.names, out])

    return ordered.mapInArrow(run, T.StructType(fields))


class Recurrence:
    """A recursive filter over parts of a signal. The recursion runs in blocks:
    a block's outputs are its inputs and the outputs before it times matrices
    that depend on the coefficients only."""

    BLOCK = 64

    def __init__(self, a: Sequence[float], b: Sequence[float]) -> None:
        self.a, self.b, self.order = np.array(a, np.float64), np.array(b, np.float64), len(a) - 1
        self.reset()
        n, p = self.BLOCK, self.order
        impulse = self._loop(np.eye(1, n)[0], np.zeros(p)) if p else np.eye(1, n)[0]
        self.own = sum(np.diag(np.full(n - i, v), -i) for i, v in enumerate(impulse))
        self.past = np.stack([self._loop(np.zeros(n), np.eye(p)[i]) for i in range(p)], axis=1) if p else np.zeros((n, 0))
        self.blocked = bool(np.isfinite(self.own).all() and np.isfinite(self.past).all())

    def reset(self) -> None:
        """A zero state."""
        self.inputs, self.outputs = np.zeros(len(self.b) - 1), np.zeros(self.order)

    def _loop(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        """y[n] = x[n] - sum of a[j] y[n-j] / a[0]; before holds the oldest first."""
        y = before.tolist()
        weights = (self.a[1:] / self.a[0]).tolist()
        for v in x.tolist():
            y.append(v - sum(w * y[-1 - j] for j, w in enumerate(weights)))
        return np.array(y[len(before) :])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        every = np.concatenate([self.inputs, x])
        with np.errstate(invalid="ignore", over="ignore"):
            y = np.convolve(every, self.b)[len(self.b) - 1 : len(every)] / self.a[0] if len(x) else x
            for at in range(0, len(y) if self.order else 0, self.BLOCK):
                part = y[at : at + self.BLOCK]
                n = len(part)
                if self.blocked and np.isfinite(part).all() and np.isfinite(self.outputs).all():
                    part = self.own[:n, :n] @ part + self.past[:n] @ self.outputs
                else:
                    part = self._loop(part, self.outputs)
                y[at : at + n] = part
                self.outputs = np.concatenate([self.outputs, part])[-self.order :]
        self.inputs = every[len(every) - len(self.b) + 1 :]
        return y


def resample(df: DataFrame, columns: Sequence[str], interval: int, keys: Sequence[str] = (), smooth: Sequence[str] = ()) -> DataFrame:
    """Rows of each key on a grid of the interval that begins at its first
    event, each with the values of the last event at or before it; the columns
    `smooth` are interpolated to the next one by a cubic. Result: keys, _ts, _seq
    (number on the grid) and the columns."""
    keys = list(keys)
    k = [F.col(f"`{x}`") for x in keys]
    # each event fills the grid from its time to the next event's: no grid is joined
    spec = Window.partitionBy(*k).orderBy(TS, SEQ)
    first = F.min(TS).over(Window.partitionBy(*k))
    follows = F.lead(TS).over(spec)
    step = F.lit(int(interval))
    low = F.ceil((F.col(TS) - first) / step).cast("long")
    high = F.when(follows.isNull(), F.floor((F.col(TS) - first) / step).cast("long")).otherwise(F.ceil((follows - first) / step).cast("long") - 1)
    made = {c: cubic(F.col(f"`{c}`"), spec) for c in smooth}
    spans = df.select(*k, F.col(TS).alias("_at"), *[F.col(f"`{c}`") for c in columns], *[v.alias(f"_cubic.{c}") for c, v in made.items()], first.alias("_first"), low.alias("_low"), high.alias("_high")).filter("_high >= _low")
    grid = spans.withColumn(SEQ, F.explode(F.sequence("_low", "_high")))
    time = F.col("_first") + F.col(SEQ) * step

    def value(c: str) -> Column:
        if c not in made:
            return F.col(f"`{c}`")
        p = F.col(f"`_cubic.{c}`")
        t = (time - F.col("_at")) / p["width"]
        t = F.coalesce(t, F.lit(0.0))
        curve = (2 * t * t * t - 3 * t * t + 1) * F.col(f"`{c}`") + (t * t * t - 2 * t * t + t) * p["width"] * p["slope"] + (3 * t * t - 2 * t * t * t) * p["next"] + (t * t * t - t * t) * p["width"] * p["next_slope"]
        return F.when(t == 0, F.col(f"`{c}`")).otherwise(curve).alias(c)

    return grid.select(*k, time.alias(TS), SEQ, *[value(c) for c in columns])


def cubic(x: Column, spec: WindowSpec) -> Column:
    """What a cubic from an event to the next needs: the width in time, the next
    value, and the slopes at both, each of the straight line between the events
    around it, or to the only one beside it."""
    at = F.col(TS).cast("double")

    def slope(i: int) -> Column:
        back, ahead, own = (lambda c, j=i + d: c if j == 0 else F.lead(c, j).over(spec) if j > 0 else F.lag(c, -j).over(spec) for d in (-1, 1, 0))
        x0, t0 = F.coalesce(back(x), own(x)), F.coalesce(back(at), own(at))
        x1, t1 = F.coalesce(ahead(x), own(x)), F.coalesce(ahead(at), own(at))
        return F.when(t1 > t0, (x1 - x0) / F.nullif(t1 - t0, F.lit(0.0))).otherwise(0.0)

    width = F.lead(at, 1).over(spec) - at
    return F.struct(F.nullif(width, F.lit(0.0)).alias("width"), F.lead(x, 1).over(spec).alias("next"), slope(0).alias("slope"), slope(1).alias("next_slope"))
