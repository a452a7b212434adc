"""WARC archives with a two-level capture index.

Archives hold one gzip member per record. The index sorts reversed-host URL
keys into gzip blocks of lines; a sparse directory keeps each block's first
key and place. A lookup binary-searches the bounds of the index parts, then the
part's directory, reads one block by its range, and finally the record by its
range. Files live in the shared folder; names are unique for each attempt of a
task, and only files that the written manifests name are ever read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clear_of, fresh_path, small_or_not, utf8, written

#: Lines of one block of the index.
BLOCK_LINES = 2000
#: Bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
#: Gaps up to this size are read through rather than skipped.
READ_GAP = 64 << 10
#: Bytes of one ranged read over neighbouring records.
READ_BYTES = 4 << 20
LEVEL = 4
WHEN = "1970-01-01T00:00:00Z"

MANIFEST = "page_id long, key string, file string, offset long, length long"
DIRECTORY = "part int, file string, offset long, length long, lines long, first string, last string"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: `com,example,www)/a?b`.
    Scheme, user and fragment do not count; a null url has the key "-"."""
    if url is None:
        return "-"
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.strip()).split("#", 1)[0]
    cut = re.search(r"[/?]", rest)
    host, tail = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "/")
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "")
    return re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", f"{key}){tail if tail[0] == '/' else '/' + tail}")


def capture_key(url: str | None, page_id: int | None) -> str:
    """The url key and the page_id, padded so that text order is its order;
    captures of one url are told apart, however many there are."""
    return f"{url_key(url)} {'-' if page_id is None else format(page_id + (1 << 63), '020d')}"


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI."""
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: an HTTP response, or a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\r\n]", "", url) if url is not None else None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {WHEN}",
        *([f"WARC-Target-URI: {target}"] if target is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, the same for the same data."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size, found = len(payload), b32(hashlib.sha1(payload).digest())
        if found != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    of = fields.get("WARC-Refers-To")
    return {"type": fields["WARC-Type"], "bytes": size, "digest": digest, "refers_to": int(of[10:-1]) if of else None}


def with_roles(pages: DataFrame) -> DataFrame:
    """Adds digest (SHA-1), first (the smallest page_id of equal payloads) and
    revisit. Of rows that share the smallest page_id all are responses, and so
    are all rows of a payload whose page_ids are all null."""
    rows = clear_of(pages, ["page_id", "url", "html"]).select(F.col("page_id").cast("long"), "url", "html")
    keyed = rows.withColumn("digest", F.unhex(F.sha1(utf8("html"))))
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = written(firsts, "warc-firsts")
    joined = keyed.join(small_or_not(firsts), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.withColumn("revisit", revisit)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes with_roles rows as archives; returns the manifest, written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            places = []
            for page_id, url, html, digest, first, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "revisit")), strict=True):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(page_id, url, (html or "").encode(), b32(digest), first, revisit))
                out.write(data)
                places.append((page_id, capture_key(url, page_id), name, at, len(data)))
                at += len(data)
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*places, strict=True)] if places else [], names=["page_id", "key", "file", "offset", "length"]).cast(
                    pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return written(pages.mapInArrow(write, MANIFEST), "warc-manifest")


def _sorted_by_key(rows: DataFrame) -> DataFrame:
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = ["key", "file", "offset"] if "file" in rows.columns else ["key"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def write_index(manifest: DataFrame, folder: str) -> DataFrame:
    """Sorts the captures by key into compressed blocks; returns the sparse
    directory, one row for each block, written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        lines: list[tuple[str, str]] = []
        out, name, at, rows = None, f"{uuid.uuid4().hex}.cdx.gz", 0, []

        def close_block() -> None:
            nonlocal out, at, lines
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = member("".join(f"{line}\n" for _, line in lines).encode())
            out.write(data)
            rows.append((name, at, len(data), len(lines), lines[0][0], lines[-1][0]))
            at, lines = at + len(data), []

        for batch in batches:
            for page_id, key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "key", "file", "offset", "length")), strict=True):
                lines.append((key, f"{key}\t{'' if page_id is None else page_id}\t{file}\t{offset}\t{length}"))
                if len(lines) == BLOCK_LINES:
                    close_block()
        if lines:
            close_block()
        if out is not None:
            out.close()
            file, offset, length, n, first, last = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"part": pa.array([0] * len(rows), pa.int32()), "file": file, "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64()), "lines": pa.array(n, pa.int64()), "first": first, "last": last})

    return written(_sorted_by_key(manifest).mapInArrow(write, DIRECTORY), "warc-directory")


class Directory:
    """Blocks of some index parts, in the order of their keys."""

    def __init__(self, blocks: list[tuple]) -> None:
        self.blocks = sorted(blocks, key=lambda b: (b[4], b[5], b[0], b[1]))
        self.lasts: list[str] = []
        for b in self.blocks:
            self.lasts.append(max(b[5], self.lasts[-1]) if self.lasts else b[5])

    def at(self, key: str) -> Iterator[tuple]:
        """The blocks that may hold a key, by binary search."""
        i = bisect.bisect_left(self.lasts, key)
        while i < len(self.blocks) and self.blocks[i][4] <= key:
            yield self.blocks[i]
            i += 1


def lookup(wanted: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Places of the captures with the keys of the wanted rows.

    The wanted keys are sorted as the index is, so a task reads each block it
    needs once, and of the directory only the parts that its keys fall in."""
    bounds = _directory_files(directory)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        held: dict[int, Directory] = {}
        cached: tuple[tuple, dict] | None = None
        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                for i in bounds.at(key):
                    if i not in held:
                        if len(held) > 8:
                            held.clear()
                        held[i] = Directory(bounds.read(i))
                    for block in held[i].at(key):
                        if cached is None or cached[0] != block:
                            with fs.open_input_file(f"{root}/{block[0]}") as f:
                                data = gzip.decompress(f.read_at(block[2], block[1])).decode()
                            captures: dict = {}
                            for line in data.split("\n")[:-1]:
                                k, *place = line.split("\t")
                                captures.setdefault(k, []).append(place)
                            cached = block, captures
                        for page_id, file, offset, length in cached[1].get(key, ()):
                            found.append((int(page_id) if page_id else None, file, int(offset), int(length)))
            if found:
                page_ids, files, offsets, lengths = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(page_ids, pa.int64()), "file": files, "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})

    return _sorted_by_key(wanted.distinct()).mapInArrow(find, "page_id long, file string, offset long, length long")


class _Bounds:
    """First and last key of each part of the directory; parts are as many as
    the index's range partitions, whatever the number of captures."""

    def __init__(self, parts: list[tuple[str, str, str]], folder: str) -> None:
        self.parts, self.folder = sorted(parts), folder
        self.lasts: list[str] = []
        for _, last, _ in self.parts:
            self.lasts.append(max(last, self.lasts[-1]) if self.lasts else last)

    def at(self, key: str) -> Iterator[int]:
        i = bisect.bisect_left(self.lasts, key)
        while i < len(self.parts) and self.parts[i][0] <= key:
            yield i
            i += 1

    def read(self, i: int) -> list[tuple]:
        fs, root = store(self.folder)
        with fs.open_input_file(f"{root}/{self.parts[i][2]}") as f:
            lines = gzip.decompress(f.read()).decode().split("\n")[:-1]
        return [(a, int(b), int(c), int(d), e, g) for a, b, c, d, e, g in (x.split("\t") for x in lines)]


def _directory_files(directory: DataFrame) -> _Bounds:
    """Writes each part's directory as a small file; only the parts' bounds
    reach the driver."""
    folder = fresh_path(directory.sparkSession, "warc-dirs")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "lines", "first", "last")), strict=True):
                parts.setdefault(row[0], []).append(row)
        rows = []
        for blocks in parts.values():
            name = f"{uuid.uuid4().hex}.dir.gz"
            blocks.sort(key=lambda b: b[1])
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(member("".join("\t".join(map(str, b)) + "\n" for b in blocks).encode()))
            rows.append((min(b[4] for b in blocks), max(b[5] for b in blocks), name))
        if rows:
            first, last, name = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"first": first, "last": last, "name": name})

    parts = written(directory.mapInArrow(write, "first string, last string, name string"), "warc-bounds")
    return _Bounds([tuple(r) for r in parts.select("first", "last", "name").collect()], folder)


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Reads records by range; places are sorted by file and offset, and close
    ones share a read."""
    parts = max(1, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ordered = places.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def runs(rows: list[tuple]) -> Iterator[list[tuple]]:
        run: list[tuple] = []
        for row in rows:
            if run and (row[1] != run[-1][1] or row[2] - (run[-1][2] + run[-1][3]) > READ_GAP or row[2] + row[3] - run[0][2] > READ_BYTES):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        file, name = None, ""
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "file", "offset", "length")), strict=True))
            out = []
            for run in runs(rows):
                if run[0][1] != name:
                    if file is not None:
                        file.close()
                    name = run[0][1]
                    file = fs.open_input_file(f"{root}/{name}")
                start = run[0][2]
                data = file.read_at(max(r[2] + r[3] for r in run) - start, start)
                for page_id, _, offset, length in run:
                    x = parse(data[offset - start : offset - start + length])
                    out.append((page_id, x["bytes"], x["digest"], x["type"], x["refers_to"]))
            if out:
                ids, sizes, digests, kinds, refs = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64()), "payload_bytes": pa.array(sizes, pa.int64()), "payload_digest": digests, "record_type": kinds, "refers_to": pa.array(refs, pa.int64())})
        if file is not None:
            file.close()

    return ordered.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archives pages, indexes the captures, looks every page up and reads its
    record back.

    A null html is an empty payload, a null url has the key "-", a null page_id
    is looked up as such and never is another's original unless all are null.
    Repeated rows give a record each; extra columns are not read; an empty
    table gives no rows."""
    spark = pages.sparkSession
    archives, index = fresh_path(spark, "warc-archives"), fresh_path(spark, "warc-index")
    manifest = write_archives(with_roles(pages), archives)
    directory = write_index(manifest, index)
    places = written(lookup(manifest.select("key"), directory, index), "warc-places")
    return read_records(places, archives)


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {shift}) & 31 AS INTEGER) + 1, 1)"
_QUAD = " || ".join(_DIGIT.format(shift=s) for s in (15, 10, 5, 0))
#: DuckDB SQL of archive_and_read over pages.
ORACLE = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(
    list_transform(range(8), lambda i: ('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5))::BIGINT), lambda v: {_QUAD}), '') AS payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM r
"""
