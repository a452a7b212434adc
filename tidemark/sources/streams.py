"""Live sources and sinks: events as JSON messages of any streaming format that
Spark has, such as files or a broker's topics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.windows import SEQ, TS

#: A message: time, sequence and the values in the order of the columns.
MESSAGE = T.StructType([T.StructField("time", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])


def decoded(messages: DataFrame, columns: Sequence[str], value: str = "value") -> DataFrame:
    """Events of messages, strings or bytes, in a column. What is no message,
    has no time, or has another number of values is passed over; a message
    without a sequence has 0."""
    message = F.from_json(F.col(value).cast("string"), MESSAGE)
    rows = messages.select(message.alias("m")).filter((F.size("m.values") == len(columns)) & F.col("m.time").isNotNull())
    return rows.select(F.col("m.time").alias(TS), F.coalesce("m.seq", F.lit(0)).alias(SEQ), *[F.col("m.values")[i].alias(c) for i, c in enumerate(columns)])


def encoded(events: DataFrame, value: str = "value") -> DataFrame:
    """One message for each event; columns that are no numbers are not sent."""
    names = [f.name for f in events.schema.fields if f.name not in (TS, SEQ) and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in names]) if names else F.array().cast("array<double>")
    seq: Column = F.col(SEQ).cast("long") if isinstance(events.schema[SEQ].dataType, T.NumericType) else F.lit(None).cast("long")
    return events.select(F.to_json(F.struct(F.col(TS).alias("time"), seq.alias("seq"), values.alias("values"))).alias(value))


def source(spark: SparkSession, columns: Sequence[str], format: str = "kafka", **options) -> DataFrame:
    """A stream of events from a streaming format with a column `value`: a
    broker's topics (kafka.bootstrap.servers, subscribe), or text files (path)."""
    return decoded(spark.readStream.format(format).options(**options).load(), columns)


def sink(events: DataFrame, checkpoint: str, format: str = "kafka", **options) -> DataStreamWriter:
    """A writer of a live view's rows as messages, to be started; with a folder
    for its progress that outlives the job."""
    return encoded(events).writeStream.format(format).options(**options).option("checkpointLocation", checkpoint).outputMode("append")


def watch(events: DataFrame, callback: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """A writer that gives the new rows of a live view to a function."""
    return events.writeStream.foreachBatch(lambda rows, _: callback(rows)).option("checkpointLocation", checkpoint).outputMode("append")
