"""Events from DataFrames, files and Python rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SqlError
from tidemark.operators.windows import SEQ, TS

#: Names under which the time of an event is looked for.
TIME_NAMES = ("time", "timestamp", "ts")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see, spark.checkpoint.dir; on
    one machine, where it is unset, in a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise SqlError("set spark.checkpoint.dir to a folder that all executors see")
        at = getattr(spark, "_tidemark_rows", None)
        if at is None:
            at = spark._tidemark_rows = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def time_column(columns: Iterable[str]) -> str:
    lower = {c.lower(): c for c in columns}
    for name in TIME_NAMES:
        if name in lower:
            return lower[name]
    raise SqlError(f"no time column: one of {', '.join(TIME_NAMES)}")


def as_events(df: DataFrame, ts: str, order: Iterable[str] = (), columns: Iterable[str] | None = None) -> DataFrame:
    """_ts, _seq and the columns. A timestamp is taken in microseconds. _seq is
    the one order column if it is a whole number, else a struct of them all."""
    kind = df.schema[ts].dataType
    time = F.unix_micros(F.col(f"`{ts}`").cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(f"`{ts}`").cast("long")
    order = list(order)
    if len(order) == 1 and isinstance(df.schema[order[0]].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        seq = F.col(f"`{order[0]}`").cast("long")
    elif order:
        seq = F.struct(*[F.col(f"`{c}`") for c in order])
    else:
        seq = F.lit(0).cast("long")
    return df.select(time.alias(TS), seq.alias(SEQ), *[F.col(f"`{c}`") for c in (columns or df.columns)])


def from_rows(data, columns: tuple[str, ...], column_map: Mapping[str, str] | None) -> tuple[list[tuple], int]:
    """(time or None, values...) of pandas rows, dicts or sequences, in order."""
    if hasattr(data, "to_dict") and hasattr(data, "columns"):
        data = data.to_dict("records")
    names = {c: (column_map or {}).get(c, c) for c in columns}
    rows = []
    for row in data:
        if isinstance(row, Mapping):
            lower = {str(k).lower(): v for k, v in row.items()}
            at = next((lower[n] for n in TIME_NAMES if n in lower), None)
            rows.append((None if at is None else int(at), *[None if row[names[c]] is None else float(row[names[c]]) for c in columns]))
        elif len(row) == len(columns):
            rows.append((None, *map(float, row)))
        elif len(row) == len(columns) + 1:
            rows.append((int(row[0]), *map(float, row[1:])))
        else:
            raise SqlError(f"a row takes {len(columns)} values")
    return rows, len(rows)


def read_events(spark: SparkSession, path: str, ts: str, order: Iterable[str] = (), format: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Events of files in any format Spark reads; give a schema for text."""
    reader = spark.read.format(format).options(**options)
    return as_events((reader.schema(schema) if schema else reader).load(path), ts, order)


def write_events(df: DataFrame, path: str, format: str = "parquet", mode: str = "append", partition_by: Iterable[str] = ()) -> None:
    """Appends rows to files."""
    df.write.format(format).mode(mode).partitionBy(*partition_by).save(path)


def catalog_from_json(text: str) -> dict[str, tuple[str, ...]]:
    """Streams of a JSON catalog: name to a list of columns, or to an object
    with columns as names or as objects with a name."""
    import json

    out = {}
    for name, entry in json.loads(text).items():
        columns = entry["columns"] if isinstance(entry, dict) else entry
        out[name] = tuple(c["name"] if isinstance(c, dict) else c for c in columns)
    return out
