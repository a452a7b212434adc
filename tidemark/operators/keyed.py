"""Reads of keyed views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import SEQ, TS


def latest_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(TS, SEQ)).alias("_row"))
    return rows.select(*[F.col(f"`{k}`") if c in keys and (k := c) else F.col("_row")[c].alias(c) for c in df.columns])


def latest(df: DataFrame, n: int) -> DataFrame:
    """The last n events, in order."""
    return df.orderBy(F.desc(TS), F.desc(SEQ)).limit(n)


def latest_before(df: DataFrame, ts: int) -> DataFrame:
    """The last event at or before a time."""
    return latest(df.filter(F.col(TS) <= ts), 1)


def between(df: DataFrame, low: int, high: int, limit: int | None = None) -> DataFrame:
    """Events of an inclusive range of time, the first `limit` of them."""
    rows = df.filter(F.col(TS).between(low, high))
    return rows if limit is None else rows.orderBy(TS, SEQ).limit(limit)
