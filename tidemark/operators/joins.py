"""Joins in event time: as-of combination of streams, and lookups in tables
that change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators import blocks
from tidemark.operators.windows import SEQ, TS


#: Bytes of a table that is broadcast to the events.
BROADCAST_BYTES = 48 << 20
#: Order of the events of several sources: _place is the first at which the
#: source's stream is named, _rank the source's own.
AS_OF_ORDER = (TS, "_place", SEQ, "_rank")


def as_of(sources: Sequence[tuple[str, DataFrame]], by: Sequence[str] = (), total: int = 0, block_rows: int | None = None, streams: Sequence[str] | None = None) -> DataFrame:
    """One row for each event of any source, once all have emitted, with the
    latest values of all: columns label.column, _ts and _seq. Events of one time
    go by the order of the sources; sources of one stream, named by `streams`,
    take each event in turn, before the stream's next. _seq numbers the rows of
    one time in this order. With `by`, streams are combined per key, each source
    having these columns; without, more than block_rows events go by ranges of
    time, each beginning with what the ranges before it ended with."""
    places = first_places(streams or [label for label, _ in sources])
    tagged = []
    columns = [(label, c) for label, df in sources for c in df.columns if c not in (TS, SEQ) and c not in by]
    for rank, (label, df) in enumerate(sources):
        values = [F.struct(F.col(f"`{c}`").alias("v")).alias(f"{own}.{c}") if own == label else F.lit(None).alias(f"{own}.{c}") for own, c in columns]
        tagged.append(df.select(*[F.col(f"`{k}`") for k in by], TS, SEQ, F.lit(rank).alias("_rank"), F.lit(places[rank]).alias("_place"), *values))
    # a null literal takes the type of the source's own struct
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    if block_rows and total > block_rows and not by:
        return _combined(_filled_by_range(union, columns, total, block_rows), columns, by)
    ordered = Window.partitionBy(*[F.col(f"`{k}`") for k in by]).orderBy(*AS_OF_ORDER)
    # keys have no order among them but that of their events
    number = F.row_number().over(Window.partitionBy(TS).orderBy(*AS_OF_ORDER) if by else ordered)
    window = ordered.rowsBetween(Window.unboundedPreceding, 0)
    filled = union.select(*[F.col(f"`{k}`") for k in by], TS, number.cast("long").alias(SEQ), *[F.last(F.col(f"`{a}.{c}`"), ignorenulls=True).over(window).alias(f"{a}.{c}") for a, c in columns])
    return _combined(filled, columns, by)


def first_places(streams: Sequence[str]) -> list[int]:
    """For each source the first place at which its stream is named."""
    return [list(streams).index(s) for s in streams]


def _filled_by_range(union: DataFrame, columns: list[tuple[str, str]], total: int, block_rows: int) -> DataFrame:
    """The latest values, range by range; one row for each range, of at most
    blocks.MOST_RANGES, holds what it ends with."""
    placed, _ = blocks.in_ranges(union, total, block_rows)
    order = F.struct(*AS_OF_ORDER)
    ends = placed.groupBy(F.col("_range").alias("_of")).agg(*[F.max_by(F.col(f"`{a}.{c}`"), F.when(F.col(f"`{a}.{c}`").isNotNull(), order)).alias(f"_e{i}") for i, (a, c) in enumerate(columns)])
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    past = ends.select("_of", *[F.last(f"_e{i}", ignorenulls=True).over(before).alias(f"_p{i}") for i in range(len(columns))])
    ordered = Window.partitionBy("_range").orderBy(*AS_OF_ORDER)
    window = ordered.rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(past), F.col("_range") == F.col("_of"))
    return joined.select(TS, F.row_number().over(ordered).cast("long").alias(SEQ), *[F.coalesce(F.last(F.col(f"`{a}.{c}`"), ignorenulls=True).over(window), F.col(f"_p{i}")).alias(f"{a}.{c}") for i, (a, c) in enumerate(columns)])


def _combined(filled: DataFrame, columns: list[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """The rows from the time on at which all sources have emitted."""
    for a, c in columns:
        filled = filled.filter(F.col(f"`{a}.{c}`").isNotNull())
    return filled.select(*[F.col(f"`{k}`") for k in by], TS, SEQ, *[F.col(f"`{a}.{c}`")["v"].alias(f"{a}.{c}") for a, c in columns])


def at_equal_times(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row for each time at which all sources have an event, with the values
    of all: columns label.column, _ts and _seq. Of several events of one time in
    a source the n-th goes with the n-th of the others."""
    out: DataFrame | None = None
    for label, df in sources:
        nth = F.row_number().over(Window.partitionBy(TS).orderBy(SEQ))
        # the sequence becomes the number within the time
        own = df.select(TS, nth.cast("long").alias("_nth"), *[F.col(f"`{c}`").alias(f"{label}.{c}") for c in df.columns if c not in (TS, SEQ)])
        out = own if out is None else out.join(own, [TS, "_nth"])
    return out.withColumnRenamed("_nth", SEQ)


def with_table(stream: DataFrame, rows: DataFrame, on: str, key: str, columns: Sequence[str], left: bool = False) -> DataFrame:
    """Events with the columns of a table that does not change; with `left` also
    those whose key is not in it. A table of few bytes is broadcast."""
    size = rows.agg(F.count(F.lit(1)), F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in rows.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))), F.lit(0)))).first()
    found = rows.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").alias(f"_t.{c}") for c in columns])
    if size[0] * (8 * len(rows.columns) + 32) + (size[1] or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    return stream.join(found, F.col(f"`{on}`") == F.col("_key"), "left" if left else "inner").drop("_key")


def current(changes: DataFrame, key: str) -> DataFrame:
    """The rows of a table now: the latest change of each key, without the
    deleted ones."""
    rest = [c for c in changes.columns if c != key]
    latest = changes.groupBy(F.col(f"`{key}`")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(TS, SEQ)).alias("_row"))
    rows = latest.select(F.col(f"`{key}`"), *[F.col("_row")[c].alias(c) for c in rest])
    return rows.filter(~F.col("_deleted"))


def at_time(stream: DataFrame, changes: DataFrame, on: str, key: str, columns: Sequence[str], keep: bool = False) -> DataFrame:
    """Events whose key is in the table at their time, with the table's columns
    as then; with `keep` also the others, without them. A change at the same
    time as an event comes first."""
    width = [c for c in stream.columns if c not in (TS, SEQ)]
    left = stream.select(F.col(f"`{on}`").alias("_on"), TS, SEQ, F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in width]).alias("_event"), F.lit(None).alias("_table"))
    right = changes.select(F.col(f"`{key}`").alias("_on"), TS, SEQ, F.lit(0).alias("_side"), F.lit(None).alias("_event"), F.struct("_deleted", *[F.col(f"`{c}`") for c in columns]).alias("_table"))
    window = Window.partitionBy("_on").orderBy(TS, "_side", SEQ).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_now", F.last("_table", ignorenulls=True).over(window))
    there = F.coalesce(~F.col("_now._deleted"), F.lit(False))
    hit = both.filter("_event is not null") if keep else both.filter(F.col("_event").isNotNull() & there)
    return hit.select(TS, SEQ, *[F.col("_event")[c].alias(c) for c in width], *[F.when(there, F.col("_now")[c]).alias(f"_t.{c}") for c in columns])
