"""Windows over one long sequence of events in many tasks.

A window without a key, or over a key that holds a large part of all events,
would sort all of them in one task. Here events are numbered in their order by
ranges of time, cut into blocks of equal numbers, and each block takes along the
events before it that its windows reach back to. Those only serve as history and
are dropped after the windows are made."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.windows import SEQ, TS

RANK, BLOCK, OWN = "_rank", "_block", "_own"
#: Ranges of time for each block of rows; each range is sorted in one task.
RANGES = 4
#: Ranges at most: their bounds are literals of the plan.
MOST_RANGES = 2_000


def in_ranges(df: DataFrame, total: int, block_rows: int) -> tuple[DataFrame, int]:
    """Adds _range, the range of time of each event, and tells how many there
    are. Ranges come from quantiles; only these reach the driver. Events of one
    time are in one range."""
    n = min(MOST_RANGES, max(1, math.ceil(total / block_rows) * RANGES))
    cuts = sorted(set(df.select(F.col(TS).cast("double").alias("t")).approxQuantile("t", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    return df.withColumn("_range", place_of(F.col(TS).cast("double"), cuts)), len(cuts) + 1


def place_of(x: Column, cuts: Sequence[float]) -> Column:
    """How many of the rising cuts are not above x, by halving steps: an event
    costs the logarithm of their number."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    # beyond the last cut the bound is null, and the step is not taken
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= x, at + step).otherwise(at))


def with_rank(df: DataFrame, total: int, block_rows: int) -> DataFrame:
    """Adds _rank, the number of each event from 0. The ranges' counts reach
    the driver, at most MOST_RANGES."""
    placed, ranges = in_ranges(df, total, block_rows)
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    before, starts = 0, []
    for i in range(ranges):
        starts.append(before)
        before += counts.get(i, 0)
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_range") + 1)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(TS, SEQ))
    return placed.withColumn(RANK, first + within - 1).drop("_range")


def with_key_rank(df: DataFrame, keys: Sequence[str], total: int, block_rows: int) -> DataFrame:
    """Adds _rank, the number of each event of its key from 0: a key is sorted
    in ranges of time, and the counts of its earlier ranges are added."""
    placed, _ = in_ranges(df, total, block_rows)
    own = [F.col(f"`{k}`") for k in keys]
    counts = placed.groupBy(*own, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[c.alias(f"_b{i}") for i, c in enumerate(own)], F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [c.eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(own)] + [F.col("_range") == F.col("_at")]
    joined = placed.join(starts, reduce(lambda a, b: a & b, same))
    within = F.row_number().over(Window.partitionBy(*own, "_range").orderBy(TS, SEQ))
    return joined.withColumn(RANK, F.col("_before") + within - 1).drop("_range", "_before", "_at", *[f"_b{i}" for i in range(len(own))])


def hot_keys_in_blocks(df: DataFrame, keys: Sequence[str], reach: int, block_rows: int) -> DataFrame | None:
    """Events with _block and _own, those of keys with more than block_rows
    events in blocks; None if no key has as many. The keys with more are found
    by a count, and there are at most total / block_rows of them."""
    counts = df.groupBy(*[F.col(f"`{k}`").alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most <= block_rows:
        return None
    hot = counts.filter(F.col("_n") > block_rows).drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
    many = df.join(hot, same, "left_semi")
    blocked = in_blocks(with_key_rank(many, keys, total, block_rows), reach, block_rows)
    few = df.join(hot, same, "left_anti").withColumns({RANK: F.lit(0).cast("long"), BLOCK: F.lit(0).cast("long"), OWN: F.lit(True)})
    return few.unionByName(blocked)


def in_blocks(ranked: DataFrame, reach: int, block_rows: int) -> DataFrame:
    """Adds _block, and _own: whether the event is the block's own, not one of
    the `reach` events before it."""
    size = max(block_rows, 2 * reach, 1)
    block = F.floor(F.col(RANK) / size).cast("long")
    both = F.when(F.col(RANK) % size >= size - reach, F.array(block, block + 1)).otherwise(F.array(block))
    out = ranked.withColumn(BLOCK, F.explode(both))
    return out.withColumn(OWN, F.floor(F.col(RANK) / size) == F.col(BLOCK))


def own(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """The blocks' own events, without the helper columns."""
    kept = df.filter(F.col(OWN) if condition is None else F.col(OWN) & condition)
    return kept.drop(RANK, BLOCK, OWN)
