"""A SQL dialect over ordered event streams. The functions here work on one
engine of the active Spark session; make an Engine for more."""

from __future__ import annotations

_engine = None


def default_engine():
    """The engine of this module, made when first asked for, and again if its
    session has ended."""
    global _engine
    from pyspark.sql import SparkSession

    from tidemark.engine import Engine

    spark = SparkSession.builder.getOrCreate()
    if _engine is None or _engine.spark is not spark:
        _engine = Engine(spark)
    return _engine


def execute(sql: str):
    """Runs a statement; see Engine.execute."""
    return default_engine().execute(sql)


def insert(stream: str, data, column_map=None):
    """Appends rows to a stream; see Engine.insert."""
    return default_engine().insert(stream, data, column_map)


def reset() -> None:
    """Forgets the engine with all that is in it."""
    global _engine
    _engine = None
