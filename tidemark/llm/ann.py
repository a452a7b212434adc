"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are lengthened by one coordinate so that the largest inner product is
the smallest distance, then turned by a random rotation, so that the first d
coordinates are a fair sample of all. Every row is in one list of the nearest
centroid; a query probes the nearest lists. Within a list the coordinates are
scanned in column blocks: after each block a hypothesis test abandons the
candidates whose distance, judged by the coordinates seen, is above the query's
bound. Scores of the others are exact.

Vectors are sorted by list once and stay where they are: tasks over them read the
queries from files of the shared folder, in blocks, and only ids and scores go
through a shuffle. The nearest of a query's lists are searched first, and its
k-th score there bounds it in the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import clear_of, fresh_path, written

#: Rows of the sample that fits centroids and bounds, at most.
SAMPLE_ROWS = 65_536
LEAST_SAMPLE = 8_192
MOST_LISTS = 4_096
#: Rows of the sample, at most and as a part of the table, whose scores bound
#: each query's: the part keeps the candidates of a query as many at each size.
BOUND_ROWS, BOUND_PART = 16_384, 4
#: Recall at which the number of probed lists is set, measured on the sample.
AIM = 0.97
#: Of the hypothesis test: a candidate within the bound is lost with a chance
#: falling as exp(-EPSILON ** 2).
EPSILON = 2.1
#: Coordinates of one column block.
BLOCK = 16
#: Vectors that a task holds at once, and queries of one file.
LIST_ROWS, QUERY_ROWS = 32_768, 2_048
#: Part of the probed lists that is searched first.
FIRST = 8


@dataclass
class Index:
    """What tasks need of a fit: its size does not grow with the table."""

    radius2: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    bounds: np.ndarray

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Rows lengthened to one norm and rotated."""
        rest = np.sqrt(np.maximum(0.0, self.radius2 - (x.astype(np.float64) ** 2).sum(1)))
        return (np.concatenate([x, rest[:, None]], axis=1) @ self.rotation).astype(np.float32)

    def turned_queries(self, q: np.ndarray) -> np.ndarray:
        return (np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ self.rotation).astype(np.float32)

    def lists(self, turned: np.ndarray) -> np.ndarray:
        return np.argmax(self._near(turned), axis=1)

    def _near(self, turned: np.ndarray) -> np.ndarray:
        return turned @ self.centroids.T - (self.centroids**2).sum(1) / 2

    def nearest_lists(self, turned: np.ndarray, low: int, high: int) -> np.ndarray:
        """The lists of each query from the low-th nearest to before the high-th."""
        return np.argsort(-self._near(turned), axis=1, kind="stable")[:, low:high]

    def least_score(self, q: np.ndarray, k: int) -> np.ndarray:
        """A score that k candidates reach for sure: that of the k-th in the
        sample, one more being the query itself, less rounding."""
        if len(self.bounds) <= k:
            return np.full(len(q), -np.inf)
        scores = q @ self.bounds.T
        kth = np.partition(scores, len(self.bounds) - k - 1, axis=1)[:, len(self.bounds) - k - 1]
        return kth - 1e-6 * (1 + np.abs(kth))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list array of one length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(rows: DataFrame, n: int, radius2: float, seed: int = 8) -> Index:
    """Centroids, probes and bounds from the rows of the smallest hashes."""
    lists = int(min(MOST_LISTS, max(1, math.sqrt(n) / 2)))
    bounds = min(BOUND_ROWS, n // BOUND_PART)
    size = min(n, SAMPLE_ROWS, max(LEAST_SAMPLE, 16 * lists, bounds))
    rate = min(1.0, 1.3 * size / n)
    near = rows.withColumn("h", F.xxhash64("vec_id", F.lit(seed)))
    if rate < 1:
        near = near.filter(F.col("h") <= F.lit(int((rate - 0.5) * 2**64)))
    sample = matrix(near.select("vec").orderBy("h").limit(size).toArrow().column(0).combine_chunks())
    rng = np.random.default_rng(seed)
    wide = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((wide, wide)))[0]
    index = Index(radius2, rotation, np.zeros((1, wide), np.float32), 1, sample[:bounds])
    turned = index.turned(sample)
    centroids = turned[rng.choice(len(turned), lists, replace=False)]
    for _ in range(8):
        index.centroids = centroids
        at = index.lists(turned)
        sums = np.zeros((lists, wide))
        np.add.at(sums, at, turned)
        counts = np.bincount(at, minlength=lists)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids).astype(np.float32)
    index.centroids = centroids
    index.probes = _probes(index, sample, turned, lists)
    return index


def _probes(index: Index, sample: np.ndarray, turned: np.ndarray, lists: int, k: int = 20) -> int:
    """The least number of lists that finds AIM of the sample's own nearest."""
    if len(sample) <= 4 * k:
        return lists
    queries = np.arange(0, len(sample), max(1, len(sample) // 256))
    scores = sample[queries] @ sample.T
    scores[np.arange(len(queries)), queries] = -np.inf
    top = np.argpartition(-scores, k, axis=1)[:, :k]
    order = np.argsort(-index._near(index.turned_queries(sample[queries])), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
    of = index.lists(turned)[top]
    found = np.sort(np.take_along_axis(place, of, axis=1).ravel())
    return int(found[min(len(found) - 1, math.ceil(AIM * len(found)) - 1)]) + 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec of the rows that take part: those with an id and a
    vector of the commonest length, all finite and not all zero."""
    rows = clear_of(vectors, ["vec_id", "embedding"]).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vec") == (size["n"] if size else 0))


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties going to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[rank < k], ids[rank < k], scores[rank < k]


def scan(index: Index, ids: np.ndarray, x: np.ndarray, turned: np.ndarray, query_ids: np.ndarray, q: np.ndarray, asked: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of the rows x that reach its floor for each query: places of
    the queries, vec_ids and exact scores."""
    wide = turned.shape[1]
    # |x' - q'|^2 = radius2 + |q|^2 - 2 <x, q>
    bound2 = index.radius2 + (q**2).sum(1) - 2 * floor
    bound2 = np.where(np.isfinite(bound2), np.maximum(bound2, 0), np.inf)
    columns = np.ascontiguousarray(turned.T)
    step = max(1, (1 << 21) // max(1, len(x)))
    found = []
    for at in range(0, len(q), step):
        some = asked[at : at + step]
        limit = bound2[at : at + step]
        who: np.ndarray | None = None
        for low in range(0, wide, BLOCK):
            high = min(wide, low + BLOCK)
            if who is None:
                part = columns[low:high]
                seen = (part**2).sum(0)[None, :] + (some[:, low:high] ** 2).sum(1)[:, None] - 2 * (some[:, low:high] @ part)
            else:
                seen = seen + ((columns[low:high].T[what] - some[who, low:high]) ** 2).sum(1)
            slack = (1 + EPSILON / math.sqrt(high)) ** 2 if high < wide else 1 + 1e-4
            # judged by the coordinates so far: seen * wide / high
            most = limit * slack * high / wide
            if who is None:
                who, what = np.nonzero(seen <= most[:, None] + 1e-6)
                seen = seen[who, what]
            else:
                keep = seen <= most[who] + 1e-6
                who, what, seen = who[keep], what[keep], seen[keep]
        scores = np.empty(len(who))
        for b in range(0, len(who), 1 << 15):
            scores[b : b + (1 << 15)] = np.einsum("ij,ij->i", x[what[b : b + (1 << 15)]], q[at + who[b : b + (1 << 15)]])
        other = ids[what] != query_ids[at + who]
        found.append(best_of(at + who[other], ids[what[other]], scores[other], k))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def listed(rows: DataFrame, index: Index) -> DataFrame:
    """All vectors with their list, sorted by it, written."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"))
            yield pa.RecordBatch.from_arrays([pa.array(held.value.lists(held.value.turned(x)) if len(x) else [], pa.int32()), *batch.columns], names=["list", "vec_id", "vec"])

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    # rows of a large list may go to several parts
    lists = rows.mapInArrow(run, "list int, vec_id long, vec array<double>")
    return written(lists.repartitionByRange(parts, "list", "vec_id").sortWithinPartitions("list", "vec_id"), "ann-lists")


def query_files(queries: DataFrame, index: Index, low: int, high: int, bounded: bool, k: int) -> list[str]:
    """Files of queries (vec_id, vec, floor, lists) with their low-th to high-th
    nearest lists, those of near lists in one file. A query's floor is the given
    one or, if bounded, that of the sample, whichever is greater."""
    spark = queries.sparkSession
    held = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                q = matrix(some.column("vec"))
                lists = held.value.nearest_lists(held.value.turned_queries(q), low, high)
                floor = some.column("floor").fill_null(-math.inf).to_numpy(zero_copy_only=False)
                if bounded:
                    floor = np.maximum(floor, held.value.least_score(q, k))
                yield pa.RecordBatch.from_arrays([pa.array(lists[:, 0], pa.int32()), some.column("vec_id"), some.column("vec"), pa.array(floor), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], names=["home", "vec_id", "vec", "floor", "lists"])

    asked = queries.select("vec_id", "vec", "floor").mapInArrow(run, "home int, vec_id long, vec array<double>, floor double, lists array<int>")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    path = fresh_path(spark, "ann-queries")
    asked.repartitionByRange(parts, "home", "vec_id").write.option("maxRecordsPerFile", QUERY_ROWS).parquet(path)
    return sorted(spark.read.parquet(path).inputFiles())


def search(lists: DataFrame, files: list[str], index: Index, k: int) -> DataFrame:
    """The best k of each list-sorted part for each query that probes its lists."""
    held = lists.sparkSession.sparkContext.broadcast(index)
    size = LIST_ROWS

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                parts.append((some.column("list").to_numpy(), some.column("vec_id").to_numpy(), matrix(some.column("vec"))))
                rows += some.num_rows
                if rows >= size:
                    yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))
                    parts, rows = [], 0
        if rows:
            yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for own, ids, x in chunks(batches):
            turned = index.turned(x)
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            segments = list(zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True))
            for uri in files:
                fs, path = pafs.FileSystem.from_uri(uri)
                block = pq.read_table(path, filesystem=fs, columns=["vec_id", "vec", "floor", "lists"])
                if not block.num_rows:
                    continue
                query_ids, q, floor = block.column("vec_id").to_numpy(), matrix(block.column("vec").combine_chunks()), block.column("floor").to_numpy()
                probes = block.column("lists").combine_chunks()
                of = np.repeat(np.arange(len(q)), np.diff(probes.offsets.to_numpy()))
                probed = probes.flatten().to_numpy()
                asked = index.turned_queries(q)
                found = []
                for name, low, high in segments:
                    who = of[probed == name]
                    if len(who):
                        place, vec_ids, scores = scan(index, ids[low:high], x[low:high], turned[low:high], query_ids[who], q[who], asked[who], floor[who], k)
                        found.append((who[place], vec_ids, scores))
                if not found:
                    continue
                place, vec_ids, scores = best_of(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
                yield pa.RecordBatch.from_pydict({"query_id": query_ids[place], "vec_id": vec_ids, "score": scores})

    return lists.mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by `every`.

    Rows with the query's own vec_id are not its candidates; repeated queries
    are one, that of the smallest vector; repeated rows with other ids all are candidates, ties going to the
    smaller id. Null, zero or non-finite vectors, other lengths than the
    commonest and null ids take no part. Fewer than k candidates are all
    returned; a query whose probed lists hold fewer than k is searched again in
    all lists. Extra columns are not read; an empty table gives no rows."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "ann-vectors")
    n, norm2 = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(rows, n, norm2)
    # of several vectors of one id the smallest, whatever the order of rows
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("floor", F.lit(None).cast("double"))
    queries = written(queries, "ann-asked")
    if not queries.head(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = listed(rows, index)
    at_first = max(1, -(-index.probes // FIRST))
    found = written(_ranked(search(lists, query_files(queries, index, 0, at_first, True, k), index, k), k), "ann-first")
    if at_first < index.probes:
        kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("_kth"))
        bound = queries.join(kth, F.col("vec_id") == F.col("_id"), "left").select("vec_id", "vec", F.col("_kth").alias("floor"))
        more = search(lists, query_files(bound, index, at_first, index.probes, True, k), index, k)
        found = written(_ranked(found.drop("rank").unionByName(more), k), "ann-found")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("_id"))
    short = written(queries.join(full, F.col("vec_id") == F.col("_id"), "left_anti"), "ann-short")
    if not short.head(1):
        return found
    again = _ranked(search(lists, query_files(short, index, 0, len(index.centroids), False, k), index, k), k)
    return found.join(full, F.col("query_id") == F.col("_id"), "left_semi").select("query_id", "rank", "vec_id", "score").unionByName(again)
