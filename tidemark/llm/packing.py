"""Packing token sequences by linear grouping and best fit.

Lengths are counted, so the plan is made over at most `capacity` distinct
sizes, however many documents there are. Large lengths are put in groups of
equal cardinality and rounded up to their group's largest; for these few sizes
the configurations and how often each is used come from a linear programme, its
columns generated by a knapsack over the duals, rounded down, and what that
leaves is filled fullest first; then actual documents take the places of the
rounded ones, and small documents go best-fit into what is left. A plan
row holds a run of equal places, so placing a document is a binary search by
its length and its rank among documents of that length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import batches_by_bytes, clear_of, release_memory, releasing, written

CAPACITY = 4096
END_ID = 1
#: Numbers of groups of equal cardinality into which large lengths are rounded.
GROUPS = (48, 160)
#: Lengths of at least capacity / small are large, for the smalls tried; 1 is
#: best fit alone.
SMALLS = (3, 4, 2, 1)
#: Columns generated at most for one programme.
COLUMNS = 3000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, smalls: tuple[int, ...] = SMALLS) -> list[tuple[int, int, int, int, int, int]]:
    """The plan with the fewest sequences over the given numbers of groups and
    bounds of large lengths. Each takes time by distinct lengths only."""
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best, fewest = [], -1
    for small in smalls:
        for g in groups if small > 1 else groups[:1]:
            rows = plan(counts, capacity, g, small)
            used = max((first + -(-n // per) for _, _, n, per, first, _ in rows), default=0)
            if fewest < 0 or used < fewest:
                best, fewest = rows, used
            if fewest <= least:
                return best
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 48, small: int = 8) -> list[tuple[int, int, int, int, int, int]]:
    """Places for counts of lengths: rows (length, first rank, ranks, per
    sequence, first sequence, offset). Rank r of a length is in the row with
    first <= r < first + ranks, in sequence first_sequence + k // per at
    offset + k % per * length, with k = r - first."""
    counts = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths are 1 to capacity")
    used = dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    #: runs of equally filled sequences: (room, first sequence, sequences)
    open_runs: list[tuple[int, int, int]] = []
    sequences = 0

    def take(length: int, n: int, per: int, first: int, offset: int) -> None:
        rows.append((length, used[length], n, per, first, offset))
        used[length] += n
        counts[length] -= n

    large = sorted((n for n in counts if n * small >= capacity), reverse=True)
    grouped = _groups(large, counts, groups)
    for sizes, times in _configurations([(g[0][0], sum(c for _, c in g)) for g in grouped], capacity, small):
        # a slot for each document of the configuration; each group is consumed in falling order
        left, at = times, sequences
        while left:
            n = left
            heads: list[tuple[int, int]] = []
            need: dict[int, int] = {}
            for g in sizes:
                need[g] = need.get(g, 0) + 1
            # one run: every slot of a group takes the same actual length
            for g, k in need.items():
                length, c = grouped[g][0]
                n = min(n, c // k)
            if n == 0:
                n = 1
            offset, room = 0, capacity
            for g, k in need.items():
                for _ in range(k):
                    length, c = grouped[g][0]
                    m = min(n, c)
                    if m < n:
                        raise AssertionError("a run spans lengths")
                    heads.append((length, offset))
                    grouped[g][0] = (length, c - n)
                    if c == n:
                        grouped[g].pop(0)
                    offset += length
                    room -= length
            for length, place in heads:
                take(length, n, 1, at, place)
            insort(open_runs, (room, at, n))
            at += n
            left -= n
        sequences += times
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        while counts[length]:
            i = bisect_left(open_runs, (length, -1, -1))
            if i == len(open_runs):
                per = capacity // length
                need_seqs = -(-counts[length] // per)
                open_runs.append((capacity, sequences, need_seqs))
                sequences += need_seqs
                continue
            room, first, n = open_runs.pop(i)
            per = room // length
            whole = min(n, counts[length] // per)
            if whole:
                take(length, whole * per, per, first, capacity - room)
                insort(open_runs, (room - per * length, first, whole))
                if whole < n:
                    insort(open_runs, (room, first + whole, n - whole))
            else:
                some = counts[length]
                take(length, some, some, first, capacity - room)
                insort(open_runs, (room - some * length, first, 1))
                if n > 1:
                    insort(open_runs, (room, first + 1, n - 1))
    return rows


def _groups(large: list[int], counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths with counts, falling, in groups of equal cardinality."""
    total = sum(counts[n] for n in large)
    if not total:
        return []
    each = -(-total // groups)
    out: list[list[tuple[int, int]]] = [[]]
    room = each
    for n in large:
        c = counts[n]
        while c:
            m = min(c, room)
            out[-1].append((n, m))
            c, room = c - m, room - m
            if not room:
                out.append([])
                room = each
    return [g for g in out if g]


def _configurations(sizes: list[tuple[int, int]], capacity: int, most: int) -> Iterator[tuple[list[int], int]]:
    """Configurations of at most `most` items (indices of sizes) with how often
    each is used: first the whole parts of the optimum, then the largest size
    left, filled up as far as the others can, as often as the counts allow."""
    left = [c for _, c in sizes]

    def used(config: list[int], times: int) -> tuple[list[int], int]:
        for j in config:
            left[j] -= times
        return config, times

    for config, times in _optimum(sizes, capacity, most):
        yield used(config, times)
    for i, (size, _) in enumerate(sizes):
        while left[i]:
            room = capacity - size
            fill = _fullest(room, [(j, s, left[j] - (j == i)) for j, (s, _) in enumerate(sizes) if j >= i and s <= room and left[j] - (j == i) > 0])
            config = [i, *fill]
            yield used(config, min(left[j] // config.count(j) for j in set(config)))


def _optimum(sizes: list[tuple[int, int]], capacity: int, most: int) -> list[tuple[list[int], int]]:
    """Configurations of the programme that covers the counts with the fewest
    sequences, as often as the whole part of its solution says. The basis
    starts with each size alone; a column enters if its items are worth more
    than a sequence at the duals."""
    if not sizes:
        return []
    size = np.array([s for s, _ in sizes])
    count = np.array([c for _, c in sizes], np.float64)
    basis = np.diag((capacity // size).astype(np.float64))
    for _ in range(COLUMNS):
        column, worth = _worthiest(size, np.linalg.solve(basis.T, np.ones(len(size))), capacity, most)
        if worth <= 1 + 1e-9:
            break
        change, now = np.linalg.solve(basis, np.stack([column, count], axis=1)).T
        steps = np.where(change > 1e-9, np.maximum(now, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(steps))] = column
    times = np.floor(np.linalg.solve(basis, count) + 1e-6).astype(np.int64)
    return [(np.repeat(np.arange(len(size)), basis[:, j].astype(np.int64)).tolist(), int(t)) for j, t in enumerate(times.tolist()) if t > 0]


def _worthiest(size: np.ndarray, worth: np.ndarray, capacity: int, most: int) -> tuple[np.ndarray, float]:
    """How many of each size make up the configuration of the greatest worth,
    and that worth: a knapsack by number of items."""
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(most):
        more, pick = best.copy(), np.full(capacity + 1, -1)
        for i in np.flatnonzero(worth > 0).tolist():
            with_i = best[: capacity + 1 - size[i]] + worth[i]
            better = with_i > more[size[i] :]
            more[size[i] :][better] = with_i[better]
            pick[size[i] :][better] = i
        best = more
        picks.append(pick)
    column, room = np.zeros(len(size)), capacity
    for pick in reversed(picks):
        if (i := pick[room]) >= 0:
            column[i] += 1
            room -= size[i]
    return column, float(best[capacity])


def _fullest(room: int, items: list[tuple[int, int, int]]) -> list[int]:
    """Items (index, size, count) with the largest total up to room; of equal
    totals that with larger items."""
    best: dict[int, tuple[int, ...]] = {0: ()}
    for index, size, count in items:
        for total, chosen in list(best.items()):
            for k in range(1, min(count, (room - total) // size) + 1):
                best.setdefault(total + k * size, chosen + (index,) * k)
        if room in best:
            break
    return list(best[max(best)])


class _Numbered(dict):
    """Words by number; one asked for the first time gets the next and is
    listed in fresh."""

    fresh: list[bytes]

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at


class Tokens:
    """Ids of texts by a tokenizer file. Words between ASCII white space are
    tokenized once each, as this tokenizer never joins over white space. New
    words go through it many at a time, in one text: the token that ends a word
    part tells where the next word begins."""

    #: How the tokenizer splits a word into parts.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = "</w>"
    JOINED = 512

    def __init__(self, path: str, words: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.END)]] = True
        self.parts = regex.compile(self.PARTS)
        self.most = words
        self.reset()

    def reset(self) -> None:
        # the empty word, which no split gives, stands for the end id
        self.known = _Numbered({b"": 0})
        self.known.fresh = []
        self.ids = np.empty(1 << 16, np.uint32)
        self.ids[0] = END_ID
        self.starts = np.zeros(1 << 16, np.int64)
        self.starts[1] = 1
        self.seen = np.zeros(1 << 16, np.int64)
        self.learned = 1

    def forget(self) -> None:
        """Keeps the more frequent half of the words."""
        seen = self.seen[: self.learned].copy()
        seen[0] = np.iinfo(np.int64).max
        kept = np.sort(np.argpartition(-seen, self.learned // 2)[: self.learned // 2 + 1])
        if kept[0] != 0:
            kept = np.concatenate([[0], kept])
        words = list(self.known)
        # the old table goes before the new one is made
        self.known = _Numbered()
        self.known.update((words[i], n) for n, i in enumerate(kept.tolist()))
        self.known.fresh = []
        self.learned = len(kept)
        self.ids, ends = self._ids_of(kept)
        self.starts = np.concatenate([[0], ends])
        # halved, so that words that were frequent once can go
        self.seen = self.seen[kept] // 2

    def _ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one after the other, and where each ends."""
        starts = self.starts[at]
        sizes = self.starts[at + 1] - starts
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(n) + np.repeat(starts - (ends - sizes), sizes)], ends

    def learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), self.JOINED):
            ids, sizes = self.encode([w.decode("utf-8", "surrogatepass") for w in words[at : at + self.JOINED]])
            first, n = self.learned, len(sizes)
            self.starts = _room(self.starts, first + n + 1)
            start = self.starts[first]
            self.starts[first + 1 : first + n + 1] = start + np.cumsum(sizes)
            self.ids = _room(self.ids, start + len(ids))
            self.ids[start : start + len(ids)] = ids
            self.learned += n

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        joined = " ".join(words)
        if joined.isascii() or unicodedata.is_normalized("NFC", joined):
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            parts = np.fromiter((1 if w.isascii() and w.isalpha() else len(self.parts.findall(w)) for w in joined.lower().split(" ")), np.int64, len(words))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if parts.min() > 0 and parts.sum() == len(ends) and (not len(ids) or ends[-1] == len(ids)) and "<|" not in joined:
                return ids, np.diff(ends[np.cumsum(parts) - 1], prepend=0)
        found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        return np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        for words in split:
            words.append(b"")
        if len(self.known) > self.most:
            self.forget()
        flat = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        if fresh := self.known.fresh:
            self.known.fresh = []
            self.learn(fresh)
        self.seen = _room(self.seen, self.learned)
        self.seen[: self.learned] += np.bincount(at, minlength=self.learned)
        ids, ends = self._ids_of(at)
        return np.split(ids, ends[np.cumsum([len(w) for w in split])[:-1] - 1]) if split else []


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy of twice its size if it is shorter than size."""
    if len(array) >= size:
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


#: One for each tokenizer file, kept from task to task in a Python worker.
_TOKENS: dict[str, Tokens] = {}


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with a checksum of their ids, written; part and
    nth number those of one length within the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        tokens, part = _TOKENS.get(tokenizer) or Tokens(tokenizer), TaskContext.get().partitionId()
        _TOKENS[tokenizer] = tokens
        seen: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for some in batches_by_bytes([batch], 1):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()]
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), tokens(texts), strict=True):
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        n = len(own)
                        nth = seen.get(n, 0)
                        seen[n] = nth + 1
                        rows.append((doc_id, piece, start, n, zlib.crc32(own.astype("<u4").tobytes()), part, nth))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = clear_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(releasing(run), PIECES), "pack-pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece of every document.

    A null or empty text is the end id alone; a text longer than the capacity
    is cut into full pieces and a rest. Repeated rows are packed each; ids may
    be null; extra columns are not read; an empty table gives no rows. Only
    counts by length, at most `capacity` of them, reach the driver."""
    pieces = cut_pieces(docs, tokenizer, capacity)
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(by_part.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-offsets")
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(best_plan(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("ahead").to_numpy() + batch.column("nth").to_numpy()
            sequence, offset = places(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offsets.select("part", "length", "ahead"), ["part", "length"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "ahead").mapInArrow(run, PLACED)


class Places:
    """A plan as arrays, looked up by length and rank."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int]]) -> None:
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 6)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(length):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        wide = int(self.rows[:, 1].max()) + int(rank.max()) + 2
        keys = self.rows[:, 0] * wide + self.rows[:, 1]
        row = self.rows[np.searchsorted(keys, length * wide + rank, side="right") - 1]
        k = rank - row[:, 1]
        return row[:, 4] + k // row[:, 3], row[:, 5] + k % row[:, 3] * length
