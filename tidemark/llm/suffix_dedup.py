"""Removal of repeated passages with a sparse suffix array.

A byte goes if a string of LENGTH bytes over it also starts anywhere else.
Strings are found from anchors: of the positions in a string, that whose next
GRAM bytes have the smallest hash, so equal strings have their anchors at the
same place. Each anchor is a suffix of the array; with it go the strings that it
anchors, which start in a row, and a fingerprint of all they cover.

The suffixes are range-partitioned by their leading tokens with sampled
splitters and sorted: eight bytes, a fingerprint of GRAM bytes, one of all that
the anchor's strings cover, and the place, so that no token, however frequent,
must fit one bucket. Neighbours of equal tokens are repeated. Where the GRAM
bytes are equal and the rest is not, or a bucket's border hides the neighbour,
the bytes around are fetched, and the strings themselves are sorted by a multikey
quicksort whose characters are fingerprints of quarter strings; a string is
repeated if its first difference from a neighbour lies beyond its end. Anchors of
one GRAM that are too many for a bucket are dealt to several; one of each string
there goes on to buckets by ranges of its first character, where strings of all
of them are sorted again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import POWERS, batches_by_bytes, clear_of, mix64, small_or_not, utf8, written

LENGTH = 400
#: Leading bytes of a suffix that choose and identify anchors.
GRAM = 128
#: Bytes of a text that are scanned at once.
CHUNK = 1 << 20
#: Open anchors of one GRAM that are sorted together, and buckets of strings, at
#: most, for those that are more.
HOT, MOST_BUCKETS = 2048, 1 << 14

ANCHORS = "kind int, key binary, lead long, h long, span long, a int, lo int, hi int, n int"
MARKS = "kind int, key binary, lead long, h long, a int, lo int, hi int"
#: Kinds of marks: a repeated stretch; strings to be looked at; strings that
#: others may equal, already known as repeated.
REPEATED, OPEN, SHOWN = 1, 2, 3


class Fingerprints:
    """64-bit fingerprints of the substrings of a buffer."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = POWERS.to(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by running minima in blocks of it."""
    n = len(x)
    pad = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    blocks = pad.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray] | None:
    """Anchors of all strings within the texts raw[starts:ends], each at least
    LENGTH bytes: doc, h, lead, span, a, lo, hi (in the buffer)."""
    if not len(starts):
        return None
    n = len(raw)
    prints = Fingerprints(raw)
    h = prints.of(slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    bits = np.uint64(24 if n < 1 << 24 else 31)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    least = sliding_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
    at = (least & mask).astype(np.int64)
    counts = ends - starts - LENGTH + 1
    doc = np.repeat(np.arange(len(starts)), counts)
    where = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    own = at[where]
    first = np.flatnonzero(np.diff(own, prepend=-1) | np.diff(doc, prepend=-1))
    last = np.append(first[1:], len(own)) - 1
    a, lo, hi = own[first], where[first], where[last]
    span = prints.of(lo, hi + LENGTH)
    span = mix64(span ^ ((hi - lo).astype(np.uint64) << np.uint64(20)) ^ (a - lo).astype(np.uint64))
    lead = np.zeros(len(a), np.uint64)
    for i in range(8):
        lead = (lead << np.uint64(8)) | raw[a + i].astype(np.uint64)
    return {"doc": doc[first], "h": h[a].view(np.int64), "lead": (lead ^ np.uint64(1 << 63)).view(np.int64), "span": span.view(np.int64), "a": a, "lo": lo, "hi": hi}


def _chunks(texts: list[bytes], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of texts or of parts of long ones, overlapping so that each
    string lies in one: buffer, starts, ends, text numbers, places in the text."""
    pieces = [(i, at, t[at : at + chunk + LENGTH - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - LENGTH + 1), chunk) if len(t) >= LENGTH]
    group: list[tuple[int, int, bytes]] = []
    total = 0

    def buffer() -> tuple:
        sizes = np.array([len(p) for *_, p in group], np.int64)
        ends = np.cumsum(sizes)
        return np.frombuffer(b"".join(p for *_, p in group), np.uint8), ends - sizes, ends, np.array([i for i, *_ in group]), np.array([a for _, a, _ in group])

    for piece in pieces:
        if group and total + len(piece[2]) > chunk + LENGTH:
            yield buffer()
            group, total = [], 0
        group.append(piece)
        total += len(piece[2])
    if group:
        yield buffer()


def find_anchors(rows: DataFrame) -> DataFrame:
    """Anchors of key and payload rows, written. Of texts with one key a task
    takes the first. Strings repeated within a buffer are marked there, and one
    of them goes on for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches_by_bytes(batches, 1):
            keys, texts = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if len(text) >= LENGTH and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(text)
            for raw, starts, ends, number, place in _chunks(texts, CHUNK):
                x = anchors(raw, starts, ends)
                if x is None:
                    continue
                shift = (place - starts)[x["doc"]]
                order = np.lexsort((x["span"], x["h"]))
                h, span = x["h"][order], x["span"][order]
                new = np.append(True, (h[1:] != h[:-1]) | (span[1:] != span[:-1]))
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(order)))
                kind = np.full(len(order), 0, np.int32)
                kind[order] = np.where(new, 0, REPEATED)
                n = np.ones(len(order), np.int32)
                n[order[first]] = np.minimum(size, 2)
                yield pa.RecordBatch.from_pydict({
                    "kind": kind, "key": pa.array(keys, pa.binary()).take(pa.array(number[x["doc"]])),
                    "lead": x["lead"], "h": x["h"], "span": x["span"],
                    **{c: (x[c] + shift).astype(np.int32) for c in ("a", "lo", "hi")}, "n": n,
                })

    return written(rows.mapInArrow(run, ANCHORS), "suffix-anchors")


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], size: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of at least size rows, but the last, from sorted batches; rows
    equal in the columns `names` stand in one."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def differ(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return any(a.column(c)[i].as_py() != b.column(c)[j].as_py() for c in names)

    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= size:
            # the first row of another value, in this batch or before it
            columns = [batch.column(c).to_numpy() for c in names]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
            cut = 0 if differ(held[-1], -1, batch, 0) else int(change[0]) + 1 if len(change) else batch.num_rows
            if cut < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the distinct rows of some columns, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _key_numbers(keys: pa.ChunkedArray) -> np.ndarray:
    return keys.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def settle(anchor_rows: DataFrame) -> DataFrame:
    """Marks from the anchors in sorted buckets, written. An anchor is repeated
    if a neighbour has equal tokens; it is open if a neighbour has an equal GRAM
    only, or none can be seen beyond the bucket's border."""
    parts = max(1, int(anchor_rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = ["lead", "h", "span", "key", "a", "lo"]
    ordered = anchor_rows.filter("kind = 0").drop("kind").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one table is held back, to know the bucket's last
        before, first = None, True
        for table in _runs(batches, ("lead", "h")):
            if before is not None:
                yield from _marks(before, first, False)
                first = False
            before = table
        if before is not None:
            yield from _marks(before, first, True)

    return written(ordered.mapInArrow(run, MARKS), "suffix-marks")


def _marks(table: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Marks of whole groups of one GRAM, but that the first may have begun and
    the last may go on beyond the bucket."""
    table = pa.Table.from_batches([table.combine_chunks().to_batches()[0]])
    lead, h, span, a, lo, n = (table.column(c).to_numpy() for c in ("lead", "h", "span", "a", "lo", "n"))
    key = _key_numbers(table.column("key"))
    differ = lambda *columns: np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
    # copies of a text came from several tasks: one row for each place
    place = differ(lead, h, span, key, a, lo)
    at = np.flatnonzero(place)
    n = np.maximum.reduceat(n, at)
    lead, h, span = lead[at], h[at], span[at]
    new_group, new_run = differ(lead, h), differ(lead, h, span)
    group, run = np.cumsum(new_group) - 1, np.cumsum(new_run) - 1
    same = ~new_run
    repeated = same | np.append(same[1:], False) | (n > 1)
    # a run has one answer, whichever of its rows stands for several
    repeated = np.logical_or.reduceat(repeated, np.flatnonzero(new_run))[run]
    edge = ((group == 0) & first) | ((group == group[-1]) & last)
    runs = np.bincount(group[new_run])[group]
    lone = (np.bincount(group, weights=~repeated) > 0)[group]
    kind = np.where(repeated, REPEATED, np.where((runs > 1) | edge, OPEN, 0))
    shown = np.flatnonzero(repeated & new_run & (lone | edge))
    keep = np.flatnonzero(kind > 0)
    take = np.concatenate([keep, shown])
    if len(take):
        out = table.take(pa.array(at[take])).combine_chunks().to_batches()[0]
        kinds = np.concatenate([kind[keep], np.full(len(shown), SHOWN)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), *(out.column(c) for c in ("key", "lead", "h", "a", "lo", "hi"))], names=["kind", "key", "lead", "h", "a", "lo", "hi"])


def multikey_quicksort(group: np.ndarray, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings by group, then by their characters (one row for each
    character), and of each in this order the number of leading characters that
    it shares with the one before it, -1 for one of another group.

    All segments are partitioned in three at once, by their middle string's
    character: less, equal, and greater; those equal go on to the next."""
    k, n = characters.shape
    order = np.argsort(group, kind="stable")
    shared = np.full(n, -1, np.int64)
    sorted_group = group[order]
    start = np.flatnonzero(np.append(True, sorted_group[1:] != sorted_group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    depth = np.zeros(len(start), np.int64)
    while True:
        done = depth == k
        whole, more = start[done & (size > 1)], size[done & (size > 1)] - 1
        shared[np.repeat(whole + 1, more) + np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)] = k
        live = ~done & (size > 1)
        start, size, depth = start[live], size[live], depth[live]
        if not len(start):
            return order, shared
        ends = np.cumsum(size)
        seg = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(seg)) - np.repeat(ends - size, size) + start[seg]
        row = order[place]
        value = characters[depth[seg], row]
        pivot = characters[depth, order[start + size // 2]][seg]
        side = (value >= pivot).astype(np.int64) + (value > pivot)
        counts = np.bincount(seg * 3 + side, minlength=3 * len(start)).reshape(-1, 3)
        low = start[:, None] + np.cumsum(counts, axis=1) - counts
        rank = np.empty(len(seg), np.int64)
        for i in range(3):
            mine = side == i
            seen = np.cumsum(mine)
            rank[mine] = (seen - np.append(0, seen[ends[:-1] - 1])[seg])[mine] - 1
        order[low[seg, side] + rank] = row
        # a string that begins a side shares only what its segment shares
        for i in (1, 2):
            new = (counts[:, i] > 0) & (low[:, i] > start)
            shared[low[new, i]] = depth[new]
        start, size = low.ravel(), counts.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
        some = size > 0
        start, size, depth = start[some], size[some], depth[some]


def look_closer(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Repeated stretches among the open marks, found in the texts: key, lo, hi
    with hi the last start."""
    asked = marks.filter(f"kind in ({OPEN}, {SHOWN})")
    lists = asked.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("kind", "lead", "h", "a", "lo", "hi")).alias("asked"))
    lists = written(lists, "suffix-asked")
    joined = rows.join(small_or_not(lists), F.col("key") == F.col("_key")).drop("_key")
    contexts = "kind int, key binary, lead long, h long, a int, lo int, hi int, context binary"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches_by_bytes(batches, 1):
            out: list[tuple] = []
            for key, text, marks in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    out += [(m["kind"], key, m["lead"], m["h"], m["a"], m["lo"], m["hi"], text[m["lo"] : m["hi"] + LENGTH]) for m in marks]
            for at in range(0, len(out), 4096):
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 4096], strict=True), kinds, strict=True)], names=["kind", "key", "lead", "h", "a", "lo", "hi", "context"])

    fetched = written(joined.mapInArrow(fetch, contexts), "suffix-contexts")
    sizes = fetched.groupBy(F.col("lead").alias("_lead"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    hot = written(sizes.select("_lead", "_h", F.ceil(F.col("n") / HOT).cast("int").alias("copies")), "suffix-hot")
    dealt = fetched.join(small_or_not(hot), (F.col("lead") == F.col("_lead")) & (F.col("h") == F.col("_h")), "left").drop("_lead", "_h")
    # the rows of one place stand together, so that they are one
    dealt = dealt.withColumn("deal", F.coalesce(F.pmod(F.xxhash64("key", "a", "lo"), F.col("copies")).cast("int"), F.lit(0)))
    dealt = dealt.withColumn("buckets", F.least(F.coalesce("copies", F.lit(0)), F.lit(MOST_BUCKETS))).drop("copies")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = ["lead", "h", "deal"]
    ordered = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ("lead", "h", "deal"), HOT):
            yield from _repeats(table, CHUNK)

    found = written(ordered.mapInArrow(run, STRINGS), "suffix-strings")
    return found.filter("strings is null").select("key", "lo", "hi").unionByName(across_deals(found.filter("strings is not null"), parts))


#: Repeated stretches, or strings of a hot group that are still to be compared,
#: those of one bucket in one value.
STRINGS = "key binary, lo int, hi int, lead long, h long, bucket int, strings binary"
#: One such string: its characters, the text's key, its start, and whether it is
#: not known to be repeated.
STRING = np.dtype([("c", "<u8", 4), ("key", "<u8", 2), ("lo", "<i4"), ("open", "?")])


def across_deals(strings: DataFrame, parts: int) -> DataFrame:
    """Repeated ones among the strings of hot groups, each bucket sorted whole:
    it holds one of each string from each deal."""
    keys = ["lead", "h", "bucket"]
    ordered = strings.select(*keys, "strings").repartition(parts, *keys).sortWithinPartitions(*keys)

    def repeated(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(b"".join(held), STRING)
        order, shared = multikey_quicksort(np.zeros(len(x), np.int64), np.ascontiguousarray(x["c"].T))
        same = shared == 4
        found = np.zeros(len(x), bool)
        found[order] = same | np.append(same[1:], False)
        x = x[found & x["open"]]
        if not len(x):
            return
        x = x[np.lexsort((x["lo"], x["key"][:, 1], x["key"][:, 0]))]
        new = np.append(True, (x["key"][1:] != x["key"][:-1]).any(axis=1) | (np.diff(x["lo"]) != 1))
        first, last = x[new], x[np.append(new[1:], True)]
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in first["key"]], pa.binary()), pa.array(first["lo"].astype(np.int32)), pa.array(last["lo"].astype(np.int32))], names=["key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for *own, data in zip(*(batch.column(c).to_pylist() for c in (*keys, "strings")), strict=True):
                if own != bucket and held:
                    yield from repeated(held)
                    held = []
                bucket = own
                held.append(data)
        if held:
            yield from repeated(held)

    return ordered.mapInArrow(run, "key binary, lo int, hi int")


def _repeats(table: pa.Table, chunk: int) -> Iterator[pa.RecordBatch]:
    """Stretches of repeated strings of the open rows of whole groups, and the
    strings of hot groups that others, elsewhere, may equal."""
    table = pa.Table.from_batches([table.combine_chunks().to_batches()[0]])
    key, a, lo, hi = _key_numbers(table.column("key")), *(table.column(c).to_numpy() for c in ("a", "lo", "hi"))
    once = np.sort(np.unique(_codes(key, a, lo), return_index=True)[1])
    table = table.take(pa.array(once))
    lead, h, deal, a, lo, hi, kind = (table.column(c).to_numpy() for c in ("lead", "h", "deal", "a", "lo", "hi", "kind"))
    buckets = table.column("buckets").to_numpy()
    counts = hi.astype(np.int64) - lo + 1
    row = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    # strings at one distance before equal leading bytes
    distance = (a - lo)[row] - nth
    group = _codes(lead, h, deal)[row] * (LENGTH + 1) + distance
    characters = _characters(table.column("context").combine_chunks(), counts, chunk)
    order, shared = multikey_quicksort(group, characters)
    whole = shared == len(characters)
    repeated = np.zeros(len(row), bool)
    repeated[order] = whole | np.append(whole[1:], False)
    is_open = (kind == OPEN)[row]
    keys = table.column("key").combine_chunks()

    names = [x.split()[0] for x in STRINGS.split(", ")]
    where = np.flatnonzero(repeated & is_open)
    if len(where):
        new = np.append(True, (np.diff(row[where]) != 0) | (np.diff(nth[where]) != 1))
        first, last = where[new], where[np.append(new[1:], True)]
        of = row[first]
        yield pa.RecordBatch.from_arrays([
            keys.take(pa.array(of)), pa.array((lo[of] + nth[first]).astype(np.int32)), pa.array((lo[of] + nth[last]).astype(np.int32)),
            *(pa.nulls(len(of), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=names)
    # one of equal strings goes on, open if it alone is not yet known
    firsts = np.zeros(len(row), bool)
    firsts[order] = ~whole
    rest = np.flatnonzero(firsts & (buckets[row] > 0))
    if not len(rest):
        return
    of = row[rest]
    wide = np.uint64(2**64 - 1) // buckets[of].astype(np.uint64) + np.uint64(1)
    wide[buckets[of] == 1] = np.uint64(2**64 - 1)
    bucket = np.minimum(characters[0, rest] // wide, buckets[of].astype(np.uint64) - np.uint64(1)).astype(np.int32)
    x = np.empty(len(rest), STRING)
    x["c"], x["lo"], x["open"] = characters[:, rest].T, lo[of] + nth[rest], is_open[rest] & ~repeated[rest]
    x["key"] = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)[of]
    order = np.lexsort((bucket, h[of], lead[of]))
    x, of, bucket = x[order], of[order], bucket[order]
    new = np.flatnonzero(np.append(True, (lead[of][1:] != lead[of][:-1]) | (h[of][1:] != h[of][:-1]) | (bucket[1:] != bucket[:-1])))
    ends = [*new[1:].tolist(), len(x)]
    for at in range(0, len(new), 256):
        some = new[at : at + 256]
        n = len(some)
        yield pa.RecordBatch.from_arrays([
            *(pa.nulls(n, k) for k in (pa.binary(), pa.int32(), pa.int32())), pa.array(lead[of[some]]), pa.array(h[of[some]]), pa.array(bucket[some]),
            pa.array([x[i:j].tobytes() for i, j in zip(some.tolist(), ends[at : at + 256], strict=True)], pa.binary())], names=names)


def _characters(contexts: pa.Array, counts: np.ndarray, chunk: int) -> np.ndarray:
    """Fingerprints of the four quarters of each string of the contexts, of
    some contexts at a time: only they are kept of the bytes."""
    quarter = LENGTH // 4
    sizes = counts + LENGTH - 1
    ends = np.cumsum(sizes)
    out = np.empty((4, int(counts.sum())), np.uint64)
    at, to = 0, 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + chunk, side="right")))
        prints = Fingerprints(np.frombuffer(b"".join(contexts.slice(at, end - at).to_pylist()), np.uint8))
        own, n = sizes[at:end], counts[at:end]
        total = int(n.sum())
        first = np.repeat(np.cumsum(own) - own, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        for i in range(4):
            out[i, to : to + total] = prints.of(first + i * quarter, first + (i + 1) * quarter)
        at, to = end, to + total
    return out


def union_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the intervals [lo, hi), touching ones joined."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """key (of the text) and spans (64-bit pairs, in order) to remove."""
    rows = docs.select(F.unhex(F.sha2("payload", 256)).substr(1, 16).alias("key"), "payload")
    long = rows.filter(F.octet_length("payload") >= LENGTH)
    found = find_anchors(long)
    marks = settle(found)
    closer = look_closer(long, marks)
    wholes = long.select("key", F.octet_length("payload").alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).filter("c > 1")
    stretches = (
        found.filter(f"kind = {REPEATED}").select("key", "lo", "hi")
        .unionByName(marks.filter(f"kind = {REPEATED}").select("key", "lo", "hi"))
        .unionByName(closer)
        .unionByName(wholes.select("key", F.lit(0).alias("lo"), (F.col("n") - LENGTH).alias("hi")))
    )
    lists = stretches.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spans = batch.column("key"), []
            for runs in batch.column("runs"):
                pairs = runs.values
                lo, hi = union_of(pairs.field("lo").to_numpy().astype(np.int64), pairs.field("hi").to_numpy().astype(np.int64) + LENGTH)
                spans.append(np.stack([lo, hi], axis=1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([keys, pa.array(spans, pa.binary())], names=["key", "spans"])

    return written(lists.mapInArrow(run, "key binary, spans binary"), "suffix-spans")


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Each document's removed bytes, runs, digest of what is left, and text:
    what is left, without characters of which a part is gone.

    A null text is empty; texts shorter than LENGTH keep all; a text that
    occurs twice or more is removed wholly, if it is not shorter. Cuts may fall
    within a character. Repeated rows and null ids keep a row each; extra
    columns are not read; an empty table gives no rows."""
    rows = clear_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("payload"))
    spans = repeated_spans(rows).withColumnRenamed("key", "_key")
    keyed = rows.withColumn("key", F.unhex(F.sha2("payload", 256)).substr(1, 16))
    joined = keyed.join(small_or_not(spans), F.col("key") == F.col("_key"), "left").select("doc_id", "payload", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, 1):
            out = []
            for doc_id, text, cut in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "payload", "spans")), strict=True):
                pairs = np.frombuffer(cut, "<i8").reshape(-1, 2).tolist() if cut else []
                at, parts = 0, []
                for lo, hi in pairs:
                    parts.append(text[at:lo])
                    at = hi
                parts.append(text[at:])
                digest = hashlib.sha256()
                for part in parts:
                    digest.update(part)
                left = "".join(part.decode("utf-8", "ignore") for part in parts)
                out.append((doc_id, len(text), len(text) - sum(map(len, parts)), len(pairs), digest.hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return joined.mapInArrow(run, KEPT)


#: DuckDB SQL of op4 over documents: every string of every text, for small tables.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
strings AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(len(h) // 2 - 399)) AS i FROM docs WHERE len(h) >= 800)),
repeated AS (SELECT r, i FROM strings WHERE k IN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1)),
numbered AS (
  SELECT r, i, sum(CASE WHEN i - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) AS before FROM repeated)),
runs AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM numbered GROUP BY r, g),
gaps AS (
  SELECT r, lo, COALESCE(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since, hi FROM runs),
kept AS (
  SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed,
    list_append(list(substr(h, 2 * since + 1, 2 * (lo - since)) ORDER BY lo), substr(any_value(h), 2 * max(hi) + 1)) AS k
  FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0) AS n_spans,
  sha256(unhex(COALESCE(array_to_string(k, ''), h))) AS kept_sha256,
  decode(unhex(CASE WHEN k IS NULL THEN h ELSE array_to_string(list_transform(k, lambda x: regexp_replace(regexp_replace(x, '^([89AB].)+', ''),
    '([CDEF].|[EF].[89AB].|F.[89AB].[89AB].)$', '')), '') END)) AS text
FROM docs LEFT JOIN kept USING (r)
"""
