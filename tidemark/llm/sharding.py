"""Sharding by jump consistent hashing.

A stable 64-bit key and the number of shards alone give the shard: the key
seeds a linear congruential sequence of jump targets, and the last target below
the number of shards wins. No ring table exists, and one more shard takes rows
only into itself, 1/(n+1) of them in the mean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import CRC_TABLE_SQL, clear_of, crc_sql, global_rank, utf8

#: Keys of rows without an id.
NULL_KEY = -0x5B3C_11D7_4E2A_9F01
#: Constants of the key mixing and of the jump sequence.
MIX = 0xD6E8FEB86659FD93
STEP = 2862933555777941757


def mixed_keys(ids: np.ndarray) -> np.ndarray:
    key = ids.astype(np.int64).view(np.uint64)
    for _ in range(2):
        key = key ^ (key >> np.uint64(32))
        key = key * np.uint64(MIX)
    return key ^ (key >> np.uint64(32))


def jump(ids: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0 to shards-1 of 64-bit ids, all rows at once."""
    key = mixed_keys(ids)
    shard = np.zeros(len(key), np.int64)
    target = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = target[live]
        key[live] = key[live] * np.uint64(STEP) + np.uint64(1)
        span = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target[live] = ((shard[live] + 1).astype(np.float64) * (2147483648.0 / span)).astype(np.int64)
        live = live[target[live] < shards]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key column; null keys share one fixed key."""

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(ids.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(NULL_KEY)))


def shard_rows(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard under the law `key`, its slot there, and its shard if
    there were one more.

    Null ids share one shard; equal ids share theirs; a null text has size 16
    and checksum 0. Slots of a shard run gapless from 0 in the order of id,
    size and checksum, rows equal in all three in any order. Of docs only the
    key and text columns are read, so others cannot clash. An empty table
    gives no rows. The slots come from range partitions shifted by the rows
    before them, so a shard is never gathered in a task."""
    rows = clear_of(docs, [key, text]).select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(utf8(text)) + 16).cast("long").alias("size"),
        F.crc32(utf8(text)).cast("long").alias("text_crc32"),
    )
    rows = rows.withColumns({
        "law": F.lit("key"),
        "shard": jump_shard(F.col("doc_id"), shards),
        "grown_shard": jump_shard(F.col("doc_id"), shards + 1),
    })
    ranked = global_rank(rows, ["doc_id", "size", "text_crc32"], "slot", "shards", within="shard")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


TWO64 = "18446744073709551616::HUGEINT"


def _times_mix(k: str) -> str:
    """SQL of k * MIX modulo 2**64, in halves that fit 128 bits."""
    return f"((({k}) % 4294967296) * {MIX}::HUGEINT + ((({k}) >> 32) * {MIX}::HUGEINT % 4294967296) * 4294967296) % {TWO64}"


#: DuckDB SQL of shard_rows over documents with 40 shards.
ORACLE = f"""
WITH RECURSIVE k0 AS (
  SELECT DISTINCT doc_id, (COALESCE(doc_id, {NULL_KEY})::HUGEINT + {TWO64}) % {TWO64} AS k FROM documents),
k1 AS (SELECT doc_id, xor(k, k >> 32) AS k FROM k0),
k2 AS (SELECT doc_id, {_times_mix('k')} AS k FROM k1),
k3 AS (SELECT doc_id, xor(k, k >> 32) AS k FROM k2),
k4 AS (SELECT doc_id, {_times_mix('k')} AS k FROM k3),
k5 AS (SELECT doc_id, xor(k, k >> 32) AS k FROM k4),
walk(doc_id, n, k, shard, target) AS (
  SELECT doc_id, n, k, 0::BIGINT, 0::BIGINT FROM k5, (VALUES (40), (41)) v(n)
  UNION ALL
  SELECT doc_id, n, nk, target,
    CAST(floor((target + 1)::DOUBLE * (2147483648.0::DOUBLE / ((nk >> 33) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT *, (k * {STEP}::HUGEINT + 1) % {TWO64} AS nk FROM walk WHERE target < n)),
ends AS (
  SELECT doc_id, max(shard) FILTER (n = 40)::INTEGER AS shard, max(shard) FILTER (n = 41)::INTEGER AS grown_shard
  FROM walk GROUP BY doc_id),
sized AS (
  SELECT doc_id, strlen(COALESCE(text, '')) + 16 AS size, {crc_sql("COALESCE(text, '')")} AS text_crc32
  FROM documents, {CRC_TABLE_SQL})
SELECT sized.doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY sized.doc_id NULLS LAST, size, text_crc32) - 1 AS slot, grown_shard
FROM sized JOIN ends ON sized.doc_id IS NOT DISTINCT FROM ends.doc_id
"""
