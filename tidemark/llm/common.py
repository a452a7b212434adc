"""Helpers shared by the corpus operators: shared folder, tables that cut
lineage, row ranks without a single-task sort, and text hashing in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows and bytes of a side that may be broadcast; beyond either the joins shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48 << 20
#: Rows of one file of a written table, so that no file outgrows a task.
FILE_ROWS = 500_000
#: Target bytes of one batch of texts in numpy, where each byte takes some 50.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own
    where it is unset, as in tests on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        at = getattr(spark, "_tidemark_dir", None)
        if at is None:
            at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark._tidemark_dir = at
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: cuts the
    lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""

    def fixed(kind: T.DataType) -> int | None:
        if isinstance(kind, T.StructType):
            parts = [fixed(f.dataType) for f in kind.fields]
            return None if None in parts else 16 + sum(parts)
        return None if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.VariantType)) else 8

    def size(name: str, kind: T.DataType) -> Column:
        column = F.col(f"`{name}`")
        if (known := fixed(kind)) is not None:
            return F.lit(known).cast("long")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            found = F.octet_length(column)
        elif isinstance(kind, T.ArrayType) and (known := fixed(kind.elementType)) is not None:
            found = F.size(column) * known
        else:
            found = 2 * F.octet_length(F.to_json(F.struct(column)))
        return F.coalesce(found.cast("long"), F.lit(0)) + 24

    return reduce(lambda a, b: a + b, [size(f.name, f.dataType) for f in df.schema.fields], F.lit(16).cast("long"))


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast if its counted rows, and their bytes, are within
    the bounds; df should be a written table, as this reads it."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def utf8(text: str | Column) -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def global_rank(df: DataFrame, by: list[str], out: str, name: str, within: str | None = None) -> DataFrame:
    """Adds out: the gapless rank from 0 of each row in the order of `by`
    (in each value of the non-null column `within`, if given). Rows equal in `by` are in any order.

    Range partitions are sorted on their own, written with their number, and
    shifted by the rows before them; no group meets in one task, as equal rows
    are told apart by a salt."""
    spark = df.sparkSession
    order = [F.col(c).asc_nulls_last() for c in by] + [F.col("_salt")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    ranged = (
        salted.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_salt")
    )
    table = written(ranged, name)
    keys = ["_part"] + ([within] if within else [])
    counts = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*([within] if within else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys).orderBy("_at")
    ranked = table.withColumn("_in", F.row_number().over(local) - 1)
    joined = ranked.join(offsets, keys)
    return joined.withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_at", "_before", "_in")


def clear_of(df: DataFrame, names: list[str]) -> DataFrame:
    """df with only the named columns, so that extra columns cannot clash."""
    return df.select(*[df[c] for c in names])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two rounds of xor-shift and odd multiplication."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    base = 0x9E3779B97F4A7C55

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base & (2**64 - 1), np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


#: Bytes whose words are hashed at once.
WORDS_AT_ONCE = 1 << 18


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words of a buffer, words being
    runs of bytes other than 0x20 and 0x09-0x0D. The buffer is taken in parts
    that end between words, so memory beside the result does not grow with it."""
    raw = np.frombuffer(buffer, np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + WORDS_AT_ONCE)
        while end < len(raw):
            # the last break of the part, or the next one if it is one word
            breaks = np.flatnonzero(_is_break(raw[at:end]))
            if len(breaks):
                end = at + int(breaks[-1]) + 1
                break
            end = min(len(raw), end + (end - at))
        h, start = _hash_words(raw[at:end])
        found.append((h, start + at))
        at = end
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])


def _is_break(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff((~_is_break(raw)).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = POWERS.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    value = (sums[end] - sums[start]) * down[start]
    return mix64(value + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), start


def batches_by_bytes(batches: Iterable[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches of about limit bytes in a column of text or
    binary; a longer value is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def release_memory() -> None:
    """Gives memory that Arrow and the C library hold unused back to the system.
    Python workers are used again by later tasks, beside which it would lie."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, with its unused memory given back at its end."""

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return then_release


#: DuckDB SQL of the CRC-32 table, one row with the list t.
CRC_TABLE_SQL = """(SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8, given t."""
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
