"""Jaccard join of word n-gram sets with a token-group matrix.

Texts with one set are one class. Each class puts its rarest tokens, as many as
a partner of the least similarity cannot all miss, into a table by token.
Similar classes are grouped first: a class is compared with the leader of its
tokens, and the links found make groups, large ones being cut to BLOCK members.
The table with groups in place of classes is the matrix: a group's column is the
union of its members' rarest tokens, a class without a link being a group of its
own. A class is a query to the groups of other components; the tokens it shares
with a group's union bound those it shares with any member, and only groups
whose bound suffices are opened: there the union of the members' whole sets is
a second bound, and what passes is compared exactly. Tokens of more than ROW
classes have no entry in the matrix; their classes are opened in blocks with a
union each. Every bound is safe, so no link between components is lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_by_bytes, clear_of, mix64, releasing, small_or_not, utf8, written
from tidemark.llm.shingles import shingle_sets

#: Similarity as a fraction: links have PER * intersection >= LEAST * union.
LEAST, PER = 75, 100
#: Classes of a token's row up to which it is in the matrix; longer rows are opened in blocks.
ROW = 64
#: Members of a group, or of one block of a longer row.
BLOCK = 256
#: Rows of the token table that are worked on at once.
AT_ONCE = 1 << 17
#: Neighbours from which a vertex of the links is a hub, joined by broadcast.
HUB = 512
#: Queries of one group that meet in a task; a group with more is copied.
QUERIES = 512
#: Postings that one task sorts.
POSTINGS = 1_000_000
#: Cells of the frequency sketch: one for so many bytes of text, within bounds.
CELL_BYTES, LEAST_BITS, MOST_BITS, PIECES = 64, 18, 25, 16
#: A token is common if its cell counts twice the mean and this many more.
COMMON = 48

SIGNED = "kind int, doc_id long, h long, n int, c long, c2 long, piece int, counts binary"


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Rarest tokens of which a similar set must hold one."""
    return np.where(n > 0, n - -(-LEAST * n // PER) + 1, 0)


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least intersection of linked sets of these sizes."""
    return -(-LEAST * (a + b) // (PER + LEAST))


def least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of common tokens in the prefixes of linked sets: beyond the
    prefix that ends first, no more than its set's other tokens are common."""
    rest = np.maximum(a - prefix_size(a), b - prefix_size(b))
    return np.maximum(1, least_overlap(a, b) - rest)


def _class_of(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever the order of its tokens."""
    n = np.diff(bounds)
    out = []
    for salt in (0x51ED270B, 0x2F0B4C47):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix64(h ^ np.uint64(salt)), out=sums[1:])
        out.append(mix64(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def sign(rows: DataFrame, seed: int, bits: int) -> DataFrame:
    """Class and size of each document (kind 0), and counts of all classes'
    tokens in cells of a sketch (kind 1), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches_by_bytes(batches, 1):
            h, bounds = shingle_sets(batch.column("payload").to_pylist(), seed)
            n = np.diff(bounds)
            c, c2 = _class_of(h, bounds)
            new = np.zeros(len(n), bool)
            for i, x in enumerate(c.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            cells = (h[np.repeat(new, n)] >> np.uint64(64 - bits)).astype(np.int64)
            np.add.at(counts, cells, np.uint32(1))
            yield pa.RecordBatch.from_pydict({
                "kind": np.zeros(len(n), np.int32), "doc_id": batch.column("doc_id"), "h": batch.column("h"), "n": n.astype(np.int32), "c": c, "c2": c2,
                "piece": np.zeros(len(n), np.int32), "counts": pa.nulls(len(n), pa.binary()),
            })
        blobs = [zlib.compress(np.minimum(x, 255).astype(np.uint8).tobytes(), 1) for x in np.split(counts, PIECES)]
        yield pa.RecordBatch.from_pydict({
            "kind": np.ones(PIECES, np.int32), "doc_id": pa.nulls(PIECES, pa.int64()), "h": pa.nulls(PIECES, pa.int64()), "n": np.zeros(PIECES, np.int32), "c": np.zeros(PIECES, np.int64),
            "c2": np.zeros(PIECES, np.int64), "piece": np.arange(PIECES, dtype=np.int32), "counts": pa.array(blobs, pa.binary()),
        })

    return written(rows.mapInArrow(releasing(run), SIGNED), "join-signed")


def common_cells(signed: DataFrame, bits: int, tokens: int) -> np.ndarray:
    """Whether each cell of the sketch is common; a bit for each cell reaches
    the driver, at most 2**MOST_BITS."""
    least = COMMON + 2 * tokens // (1 << bits)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), np.uint8)
                if piece not in sums:
                    sums[piece] = np.zeros(len(x), np.uint32)
                sums[piece] += x
        for piece, x in sums.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "bits": pa.array([np.packbits(x > least).tobytes()], pa.binary())})

    rows = signed.filter("kind = 1").select("piece", "counts").repartition(PIECES, "piece").mapInArrow(releasing(total), "piece int, bits binary").collect()
    out = np.zeros(1 << bits, bool)
    size = (1 << bits) // PIECES
    for r in rows:
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out


def token_rows(rows: DataFrame, seed: int, bits: int, common: np.ndarray, tokens: int) -> DataFrame:
    """Rows of the table with two classes or more, written: h, c, n, m (classes
    of the token, ROW + 1 for all that have more) and lead (the first class of
    fitting size)."""
    held = rows.sparkSession.sparkContext.broadcast(np.packbits(common))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rare = ~np.unpackbits(held.value).astype(bool)
        for batch in batches_by_bytes(batches, 1):
            h, bounds = shingle_sets(batch.column("payload").to_pylist(), seed)
            n = np.diff(bounds)
            c, _ = _class_of(h, bounds)
            new = np.zeros(len(n), bool)
            for i, x in enumerate(c.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = n[i] > 0
            doc = np.repeat(np.arange(len(n)), n)
            late = ~rare[(h >> np.uint64(64 - bits)).astype(np.int64)]
            # h is sorted within each text; the sort is stable
            order = np.argsort(doc * 2 + late, kind="stable")
            h, doc = h[order], doc[order]
            keep = (np.arange(len(doc)) - bounds[:-1][doc] < prefix_size(n)[doc]) & new[doc]
            h, doc = h[keep], doc[keep]
            for at in range(0, len(h), 1 << 18):
                d = doc[at : at + (1 << 18)]
                yield pa.RecordBatch.from_pydict({"h": h[at : at + (1 << 18)].view(np.int64), "c": c[d], "n": n[d].astype(np.int32)})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, before, more in token_runs(([b.column(i).to_numpy() for i in ("h", "n", "c")] for b in batches if b.num_rows), AT_ONCE):
            out = with_leads(*x, before, more, ROW)
            if len(out["h"]):
                yield pa.RecordBatch.from_pydict(out)

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-tokens // (4 * POSTINGS)))
    posted = rows.mapInArrow(releasing(post), "h long, c long, n int").repartition(parts, "h").sortWithinPartitions("h", "n", "c")
    return written(posted.mapInArrow(releasing(gather), "h long, c long, n int, m int, lead long, lead_n int"), "join-rows")


def token_runs(parts: Iterator[list[np.ndarray]], size: int) -> Iterator[tuple[list[np.ndarray], int, bool]]:
    """Arrays h, n, c sorted by all three, about size rows at a time and cut
    between tokens; with each the number of leading rows that came before and
    whether its last token goes on. A token of more rows comes in parts, each
    led by what with_leads needs of the one before."""
    held: list[list[np.ndarray]] = []
    rows, before = 0, 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows < size:
            continue
        x = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(x[0], x[0][-1]))
        if cut:
            yield [c[:cut] for c in x], before, False
            x, before = [c[cut:] for c in x], 0
        if len(x[0]) >= size:
            yield x, before, True
            h, n, c = x
            # what later sizes may be led by, and the last row, which may repeat
            keep = np.append(True, n[1:] != n[:-1]) & (PER * n.astype(np.int64) >= LEAST * int(n[-1]))
            keep[-1] = True
            x = [h[keep], n[keep], c[keep]]
            before = len(x[0])
        held, rows = [x], len(x[0])
    if rows > before:
        yield [np.concatenate(c) for c in zip(*held, strict=True)], before, False


def with_leads(h: np.ndarray, n: np.ndarray, c: np.ndarray, before: int, more: bool, most: int) -> dict[str, np.ndarray]:
    """Rows of tokens with two classes or more, each with the number of classes,
    at most `most` + 1, and the first class of at least LEAST / PER of its size."""
    # copies of a class came from several tasks
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
    own = (np.arange(len(h)) >= before)[new]
    h, n, c = h[new], n[new], c[new]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    row = np.repeat(np.arange(len(first)), size)
    if before:
        size[0] = most + 1
    if more:
        size[-1] = most + 1
    m = np.minimum(size, most + 1)[row]
    wide = int(n.max()) + 1
    lead = np.searchsorted(row * wide + n, row * wide + -(-LEAST * n.astype(np.int64) // PER))
    keep = np.flatnonzero((m > 1) & own)
    return {"h": h[keep], "c": c[keep], "n": n[keep], "m": m[keep].astype(np.int32), "lead": c[lead[keep]], "lead_n": n[lead[keep]]}


def shared_enough(pairs: DataFrame, k: str, part: float = 1.0) -> DataFrame:
    """Pairs (a_n, b_n) that share at least `part` of least_shared."""
    need = F.greatest(F.lit(1), _need(F.col("a_n").cast("long"), F.col("b_n").cast("long")))
    return pairs.filter(F.col(k) >= need * part)


def _need(a: Column, b: Column) -> Column:
    up = lambda x: F.ceil(x.cast("double") - 1e-9)
    rest = F.greatest(up(a * LEAST / PER), up(b * LEAST / PER)) - 1
    return up((a + b) * LEAST / (PER + LEAST)) - rest


def open_groups(probes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links found by probing groups. probes: g, role (0 member, 1 query), c,
    comp; classes of one comp are not compared. Result: a, b (classes)."""
    parts = max(1, int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    filled = dealt(probes).join(sets, "c").repartition(parts, "g").sortWithinPartitions("g", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, closed = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            data = batch.column("tokens")
            for i, (g, role, c, comp) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("g", "role", "c", "comp")), strict=True)):
                if g != group:
                    group, members, closed = g, [], None
                tokens = np.frombuffer(data[i].as_buffer(), np.uint64)
                if role == 0:
                    members.append((c, comp, tokens.copy()))
                    continue
                if closed is None:
                    closed = Group(members)
                out += [(c, other) for other in closed.linked(c, comp, tokens)]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return filled.select("g", "role", "c", "comp", "tokens").mapInArrow(releasing(run), "a long, b long").distinct()


def dealt(probes: DataFrame) -> DataFrame:
    """Probes with the queries of each large group dealt to copies of it, so
    that the leader of many near copies is not one task's."""
    size = probes.filter("role = 1").groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > QUERIES)
    large = written(size.select("_g", F.ceil(F.col("n") / QUERIES).cast("int").alias("copies")), "join-large")
    if not large.head(1):
        return probes
    marked = probes.join(small_or_not(large), F.col("g") == F.col("_g"), "left")
    own = F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("c"), F.col("copies")).cast("int")))
    few = marked.filter("copies is null").select("g", "role", "c", "comp")
    many = marked.filter("copies is not null").select("g", "role", "c", "comp", F.explode(own).alias("copy"))
    return few.unionByName(many.select(F.xxhash64("g", "copy").alias("g"), "role", "c", "comp"))


class Group:
    """An opened group: the union of the members' whole sets, and which member
    holds which token."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]) -> None:
        self.classes = np.array([c for c, _, _ in members], np.int64)
        #: groups as joined so far by the links found here
        self.labels = np.array([x for _, x, _ in members], np.int64)
        self.up: dict[int, int] = {}
        self.sizes = np.array([len(t) for *_, t in members], np.int64)
        flat = np.concatenate([t for *_, t in members]) if members else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.of = np.repeat(np.arange(len(members)), self.sizes)[order]
        new = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
        self.union = flat[new]
        self.starts = np.append(np.flatnonzero(new), len(flat))

    def linked(self, c: int, comp: int, tokens: np.ndarray) -> list[int]:
        if not len(self.union):
            return []
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        hit = at[self.union[at] == tokens]
        if PER * len(hit) < LEAST * len(tokens):
            return []  # the bound fails for every member
        own = self.root(comp)
        if not (self.labels != own).any():
            return []
        starts, sizes = self.starts[hit], self.starts[hit + 1] - self.starts[hit]
        where = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        both = np.bincount(self.of[where], minlength=len(self.classes))
        ok = (PER * both >= LEAST * (self.sizes + len(tokens) - both)) & (self.labels != own) & (self.classes != c)
        at = np.flatnonzero(ok)
        if not len(at):
            return []
        # one link joins the query's group with another: more tell nothing
        labels, first = np.unique(self.labels[at], return_index=True)
        for label in labels.tolist():
            self.up[label] = own
        self.labels[np.isin(self.labels, labels)] = own
        return self.classes[at[first]].tolist()

    def root(self, comp: int) -> int:
        while (up := self.up.get(comp, comp)) != comp:
            comp = up
        return comp


def token_sets(rows: DataFrame, reps: DataFrame, needed: DataFrame, seed: int) -> DataFrame:
    """c and tokens (sorted 64-bit) of the needed classes, written; the text
    of one document of each class is read."""
    wanted = needed.join(reps, "c").select(F.col("rep").alias("_rep"))
    some = rows.join(small_or_not(wanted), F.col("doc_id") == F.col("_rep")).select("payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, 0):
            h, bounds = shingle_sets(batch.column("payload").to_pylist(), seed)
            c, _ = _class_of(h, bounds)
            yield pa.RecordBatch.from_pydict({"c": c, "tokens": pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    return written(some.mapInArrow(releasing(run), "c long, tokens binary").dropDuplicates(["c"]), "join-sets")


def beside_least(edges: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """edges with least: of the rows of one key the least of other. Keys with
    many rows get it by broadcast, so that their rows need not meet."""
    found = edges.groupBy(F.col(key).alias("w")).agg(F.min(other).alias("least"), F.count(F.lit(1)).alias("n"))
    hubs = written(found.filter(F.col("n") > HUB).select(F.col("w").alias("hub"), F.col("least").alias("hub_least")), name)
    if not hubs.head(1):
        return edges.join(found.drop("n"), F.col(key) == F.col("w")).drop("w")
    marked = edges.join(small_or_not(hubs), F.col(key) == F.col("hub"), "left")
    hot = marked.filter("hub is not null").select(*edges.columns, F.col("hub_least").alias("least"))
    cold = marked.filter("hub is null").select(*edges.columns)
    few = found.filter(F.col("n") <= HUB).drop("n")
    return hot.unionByName(cold.join(few, F.col(key) == F.col("w")).select(*edges.columns, "least"))


def components(links: DataFrame, name: str) -> DataFrame:
    """c and comp (the smallest class reachable) of all classes in links,
    by alternating stars: neighbours move to the smallest, larger ones first."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), name)
    state = None
    while True:
        # large star: larger neighbours of u go to the least around u
        large = beside_least(both(edges), "u", "v", name).filter("v > u").select(F.least("u", "least").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        large = written(large, name)
        # small star: smaller neighbours of u, and u, go to the least of them
        moved = beside_least(large, "b", "a", name).select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        edges = written(moved, name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if now == state:
            return edges.select(F.col("b").alias("c"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("c"), F.col("a").alias("comp")).distinct())
        state = now


def cut_groups(comps: DataFrame) -> DataFrame:
    """c, comp and g: the group of each class of a component, one for the
    component, or parts of about BLOCK members of a large one."""
    sizes = comps.groupBy(F.col("comp").alias("_comp")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    large = written(sizes.select("_comp", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "join-parts")
    marked = comps.join(small_or_not(large), F.col("comp") == F.col("_comp"), "left")
    part = F.xxhash64("comp", F.pmod(F.xxhash64("c"), F.col("parts")))
    return written(marked.select("c", "comp", F.when(F.col("parts").isNull(), F.col("comp")).otherwise(part).alias("g")), "join-groups")


CROSS = "kind int, c long, g long, n int, low int, high int, comp long, k int"


def token_columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], size: int) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by h, size rows or more at a time, each
    token's rows together."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(x).to_numpy() for x in names])
        rows += batch.num_rows
        if rows < size:
            continue
        x = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(x[0], x[0][-1]))
        if cut:
            yield [c[:cut] for c in x]
        held, rows = [[c[cut:] for c in x]], len(x[0]) - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def cross_probes(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries c to groups g of other components, with the number k of matrix
    rows that they share and the least and greatest size of the members met
    there; and probes of the blocks of longer rows."""
    held = groups.select(F.col("c").alias("_c"), "comp", "g")
    marked = rows.select("h", "c", "n", "m").join(small_or_not(held), F.col("c") == F.col("_c"), "left")
    marked = marked.select("h", "c", "n", "m", F.coalesce("comp", "c").alias("comp"), F.coalesce("g", "c").alias("g"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, n, m, comp, g in token_columns(batches, ("h", "c", "n", "m", "comp", "g"), AT_ONCE):
            n = n.astype(np.int64)
            start = np.append(True, h[1:] != h[:-1])
            first = np.flatnonzero(start)
            size = np.diff(np.append(first, len(h)))
            mixed = np.logical_or.reduceat(np.append(False, comp[1:] != comp[:-1]) & ~start, first)
            yield from _short_rows(first[mixed & (size <= ROW)], size[mixed & (size <= ROW)], c, n, comp, g)
            for at, s in zip(first[mixed & (size > ROW)].tolist(), size[mixed & (size > ROW)].tolist(), strict=True):
                yield from _long_row(h[at], slice(at, at + s), c, n, comp, BLOCK)

    found = written(marked.repartition(parts, "h").sortWithinPartitions("h", "comp", "g", "n", "c").mapInArrow(releasing(run), CROSS), "join-cross")
    queries = found.filter("kind = 0").groupBy("c", "g", "n", "comp").agg(F.sum("k").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"))
    blocks = found.filter("kind > 0").select("g", (F.col("kind") - 1).alias("role"), "c", "comp")
    return queries, blocks


def _short_rows(first: np.ndarray, size: np.ndarray, c: np.ndarray, n: np.ndarray, comp: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of the matrix rows at first: each class a query to the groups of smaller
    components whose members' sizes fit, counted by query and group."""
    for s in np.unique(size).tolist():
        i, j = np.triu_indices(s, 1)
        at = first[size == s]
        step = max(1, (1 << 20) // len(i))
        for low in range(0, len(at), step):
            some = at[low : low + step]
            # sorted by component: the later class is of the greater one
            a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
            row = np.repeat(some, len(i))
            ok = (comp[a] != comp[b]) & (PER * np.minimum(n[a], n[b]) >= LEAST * np.maximum(n[a], n[b]))
            a, b, row = a[ok], b[ok], row[ok]
            if not len(a):
                continue
            order = np.lexsort((row, g[a], c[b]))
            a, b, row = a[order], b[order], row[order]
            new = np.append(True, (c[b][1:] != c[b][:-1]) | (g[a][1:] != g[a][:-1]))
            once = new | np.append(True, row[1:] != row[:-1])
            starts = np.flatnonzero(new)
            q, of = b[starts], a[starts]
            yield pa.RecordBatch.from_pydict({
                "kind": np.zeros(len(starts), np.int32), "c": c[q], "g": g[of], "n": n[q].astype(np.int32),
                "low": np.minimum.reduceat(n[a], starts).astype(np.int32), "high": np.maximum.reduceat(n[a], starts).astype(np.int32),
                "comp": comp[q], "k": np.add.reduceat(once.astype(np.int32), starts).astype(np.int32),
            })


def _long_row(h: int, where: slice, c: np.ndarray, n: np.ndarray, comp: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a longer row as groups of their own (kind 1), each asked by
    the classes of it and after it (kind 2)."""
    for i, low in enumerate(range(where.start, where.stop, block)):
        high = min(where.stop, low + block)
        asked = np.arange(low, where.stop)
        # a query of the block's only component has nothing to find there
        asked = asked[(comp[low] != comp[high - 1]) | (comp[asked] != comp[low])]
        if not len(asked):
            continue
        who = np.concatenate([np.arange(low, high), asked])
        g = mix64(np.array([h], np.int64).view(np.uint64) + np.uint64(i)).view(np.int64)[0]
        z = np.zeros(len(who), np.int32)
        yield pa.RecordBatch.from_pydict({
            "kind": np.repeat([1, 2], [high - low, len(asked)]).astype(np.int32), "c": c[who], "g": np.full(len(who), g), "n": n[who].astype(np.int32),
            "low": z, "high": z, "comp": comp[who], "k": z,
        })


def bounded_enough(queries: DataFrame) -> DataFrame:
    """Queries whose overlap with the group's union does not rule out a link
    with any member of the sizes met. The least number of common tokens is that
    of the least or of the greatest size, to one."""
    n = F.col("n").cast("long")
    return queries.filter(F.col("k") >= F.greatest(F.lit(1), F.least(_need(n, F.col("low").cast("long")), _need(n, F.col("high").cast("long"))) - 1))


def text_hash(text: str | Column) -> Column:
    """With doc_id the identity of a row in component_labels."""
    return F.xxhash64(utf8(text))


def component_labels(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash h, shingles n and the component's label of every
    document, written; the label is null for an empty set. Rows of one
    component, and no others, have one label, with or without an id."""
    rows = clear_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("payload"), text_hash("text").alias("h"))
    size = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, size / CELL_BYTES)))))
    for seed in range(8):
        signed = sign(rows, seed, bits)
        own = signed.filter("kind = 0").select("doc_id", "h", "n", "c", "c2")
        classes = written(own.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("c2").alias("top"), F.min("c2").alias("low")), "join-classes")
        if not classes.filter("top <> low").head(1):
            break
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    # classes all of whose documents lack an id are read by their text alone
    keyed = rows if not classes.filter("rep is null").head(1) else rows.withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("payload")))
    reps = classes.select("c", F.coalesce("rep", F.lit(None)).alias("rep"))
    if keyed is not rows:
        signed_keyed = written(sign(keyed, seed, bits).filter("kind = 0 and n > 0").groupBy("c").agg(F.min("doc_id").alias("rep")), "join-reps")
        reps = signed_keyed
    table = token_rows(keyed, seed, bits, common_cells(signed, bits, tokens), tokens)

    stars = table.filter("lead <> c").groupBy(F.col("lead").alias("a"), F.col("c").alias("b"), F.col("lead_n").alias("a_n"), F.col("n").alias("b_n")).agg(F.count(F.lit(1)).alias("k"))
    stars = written(shared_enough(stars, "k", 0.5).select("a", "b"), "join-stars")
    # first the leaders, each a group of one, then the groups that they make
    links = _opened(stars.select(F.col("a").alias("g"), F.lit(0).alias("role"), F.col("a").alias("c"), F.col("a").alias("comp")).distinct()
                    .unionByName(stars.select(F.col("a").alias("g"), F.lit(1).alias("role"), F.col("b").alias("c"), F.col("b").alias("comp"))), keyed, reps, seed)
    groups = cut_groups(written(components(links, "join-first"), "join-grouped"))

    queries, blocks = cross_probes(table, groups)
    queries = written(bounded_enough(queries).select("c", "g", "comp"), "join-queries")
    wanted = queries.select(F.col("g").alias("_g")).distinct()
    # a group without a row in groups is a class of its own
    members = wanted.join(groups, F.col("g") == F.col("_g"), "left").select(F.col("_g").alias("g"), F.lit(0).alias("role"), F.coalesce("c", "_g").alias("c"), F.coalesce("comp", "_g").alias("comp"))
    asked = queries.select("g", F.lit(1).alias("role"), "c", "comp")
    links = links.unionByName(_opened(members.unionByName(asked).unionByName(blocks), keyed, reps, seed))
    comps = written(components(links, "join-second"), "join-components").withColumnRenamed("c", "_c")

    return written(own.join(small_or_not(comps), F.col("c") == F.col("_c"), "left").select("doc_id", "h", "n", F.when(F.col("n") > 0, F.coalesce("comp", "c")).alias("label")), "join-labels")


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A null text, or one without words, has an empty set and is linked with
    nothing; texts with equal sets are linked. The component's id is its
    smallest doc_id; null ids are not smallest, and a component of them alone
    has a null id. Repeated rows keep a row each; extra columns are not read;
    an empty table gives no rows."""
    labelled = component_labels(docs)
    least = written(labelled.filter("label is not null").groupBy(F.col("label").alias("_label")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "join-least")
    found = labelled.join(small_or_not(least), F.col("label") == F.col("_label"), "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("_label").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _opened(probes: DataFrame, rows: DataFrame, reps: DataFrame, seed: int) -> DataFrame:
    """Links found in the groups of the probes, written."""
    needed = written(probes.select("c").distinct(), "join-needed")
    return written(open_groups(probes, token_sets(rows, reps, needed, seed)), "join-links")


#: DuckDB SQL of join_components over documents; for small tables.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * LEAST(a.n, b.n) >= 75 * GREATEST(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, shared.y FROM reach JOIN shared ON reach.y = shared.x)
SELECT sets.doc_id, len(s) AS n_shingles, component_id
FROM sets JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = sets.doc_id
"""
