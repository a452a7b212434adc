"""Media columns: audio stored losslessly and its features.

Bytes are kept as unsigned 8-bit samples of a WAV file. Features come from the
bytes read back: polyphase resampling, overlapped log-mel filterbanks and
segmentation of frame energy with hysteresis. A segment is a fixed-shape tensor
of TENSOR_FRAMES x MELS values with its time span; longer segments continue in
further tensors, and the last one is padded. Tensors are stored as Arrow's
fixed-shape tensor type in IPC files of the shared folder, each task writing one
of its own; a document's row tells where its tensors are.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_by_bytes, clear_of, fresh_path, utf8, written

RATE = 16_000
#: Output rate is RATE * UP / DOWN.
UP, DOWN = 3, 4
#: Taps of the resampling filter for each of its phases.
TAPS = 8
FRAME, HOP, FFT = 384, 192, 512
MELS = 40
TENSOR_FRAMES = 32
#: Tensors of one record batch of a file.
FILE_TENSORS = 256
#: Energies (in ln units over the floor) at which a segment opens and closes.
OPEN, CLOSE = 1.0, 0.5
#: Payloads are padded with PAD to a positive multiple of UNIT bytes.
UNIT, PAD = 192, 32
#: Samples that are resampled and framed at once.
CHUNK = 1 << 18
HEADER = 44

TENSOR = pa.fixed_shape_tensor(pa.float16(), (TENSOR_FRAMES, MELS))
FILE = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("values", TENSOR)])
#: A tensor: start and end in seconds, frames that are not padding, values.
Tensor = tuple[float, float, int, np.ndarray]


def padded(payload: bytes) -> bytes:
    size = max(UNIT, -(-len(payload) // UNIT) * UNIT)
    return payload.ljust(size, bytes([PAD]))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    pad = len(samples) & 1
    return b"".join((
        b"RIFF", struct.pack("<I", 36 + len(samples) + pad), b"WAVEfmt ",
        struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8), b"data", struct.pack("<I", len(samples)), samples, b"\0" * pad,
    ))


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def polyphase(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass filter, one row for each of the `up` phases."""
    wide = max(up, down)
    n = taps * wide * 2 // max(1, up) * up
    t = np.arange(n) - (n - 1) / 2
    filt = np.sinc(t / wide) * np.hamming(n) / wide * up
    return np.ascontiguousarray(filt.reshape(-1, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up/down of its rate: only the phases and places that the output
    keeps are computed."""
    bank = polyphase(up, down)
    width = bank.shape[1]
    size = -(-len(x) * up // down)
    edge = np.concatenate([np.zeros(width // 2, np.float32), x, np.zeros(width, np.float32)])
    rows = np.lib.stride_tricks.sliding_window_view(edge, width)
    out = np.empty(size, np.float32)
    for first in range(up):
        # outputs first, first + up, ... share one phase and step `down`
        n = len(range(first, size, up))
        phase, start = first * down % up, first * down // up
        taken = rows[start : start + (n - 1) * down + 1 : down]
        out[first::up] = taken @ bank[phase]
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles of equal width on the mel scale, bins by mels."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    rise = (bins[:, None] - edges[:-2]) / np.diff(edges)[:-1]
    fall = (edges[2:] - bins[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and log energies of overlapped Hann frames; the last
    frame is padded with zeros, so that each sample is in a frame."""
    short = FRAME - len(x) if len(x) < FRAME else (FRAME - len(x)) % HOP
    x = np.concatenate([x, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    bank = mel_bank(rate)
    mels, energy = [], []
    # blocks of a fixed number of frames, so that equal signals give equal bits
    for at in range(0, len(frames), 512):
        block = frames[at : at + 512] * window
        power = np.abs(np.fft.rfft(block, FFT)).astype(np.float32) ** 2
        mels.append(np.log(power @ bank + np.float32(1e-6)))
        energy.append(np.log(np.einsum("ij,ij->i", block, block) + np.float32(1e-6)))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, open_at: float = OPEN, close_at: float = CLOSE) -> list[tuple[int, int]]:
    """Runs of frames that open where the energy is open_at over the floor and
    last until it is less than close_at over it. The floor is the tenth
    percentile; a flat signal with no opening is one segment."""
    floor = np.partition(energy, len(energy) // 10)[len(energy) // 10]
    above = energy - floor
    state = np.where(above >= open_at, 1, np.where(above < close_at, 0, -1))
    known = np.flatnonzero(state >= 0)
    if not len(known) or not (state == 1).any():
        return [(0, len(energy))]
    last = np.searchsorted(known, np.arange(len(energy)), side="right") - 1
    on = np.where(last >= 0, state[known[np.maximum(last, 0)]], 0) == 1
    edge = np.diff(on.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """Log-mel frames, segments and rate after resampling."""
    raw = np.frombuffer(samples, np.uint8)
    out_rate = rate * UP // DOWN
    step = CHUNK // DOWN * DOWN
    if len(raw) <= step:
        x = resample((raw.astype(np.float32) - 128) / 128)
    else:
        # chunks with the filter's reach on both sides, cut back after it
        reach = TAPS * 4 * DOWN
        parts = []
        for at in range(0, len(raw), step):
            low = max(0, at - reach)
            some = (raw[low : at + step + reach].astype(np.float32) - 128) / 128
            y = resample(some)
            skip = (at - low) * UP // DOWN
            parts.append(y[skip : skip + -(-min(step, len(raw) - at) * UP // DOWN)])
        x = np.concatenate(parts)
    mels, energy = log_mel(x, out_rate)
    return mels, segments(energy), out_rate


def tensors(mels: np.ndarray, spans: list[tuple[int, int]], rate: int) -> Iterator[Tensor]:
    """Fixed-shape tensors of the segments with time spans in seconds."""
    for start, end in spans:
        for at in range(start, end, TENSOR_FRAMES):
            own = mels[at : min(end, at + TENSOR_FRAMES)]
            block = np.zeros((TENSOR_FRAMES, mels.shape[1]), np.float16)
            block[: len(own)] = own
            yield at * HOP / rate, ((at + len(own) - 1) * HOP + FRAME) / rate, len(own), block


def tensor_array(blocks: list[np.ndarray]) -> pa.Array:
    """Blocks as an Arrow fixed-shape tensor array."""
    flat = np.stack(blocks).reshape(-1) if blocks else np.zeros(0, np.float16)
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float16()), TENSOR_FRAMES * MELS))


class TensorFile:
    """An IPC file of tensors in batches of FILE_TENSORS, made when the first
    tensor comes. Its name is new for each attempt of a task."""

    def __init__(self, folder: str) -> None:
        self.folder, self.name, self.count = folder, f"{uuid.uuid4().hex}.arrow", 0
        self.held: list[Tensor] = []
        self.out = self.writer = None

    def add(self, made: Iterable[Tensor]) -> tuple[int, int]:
        """Number of the first tensor added, and how many were."""
        first = self.count
        for tensor in made:
            self.held.append(tensor)
            self.count += 1
            if len(self.held) == FILE_TENSORS:
                self.flush()
        return first, self.count - first

    def flush(self) -> None:
        if self.writer is None:
            fs, root = file_system(self.folder)
            fs.create_dir(root, recursive=True)
            self.out = fs.open_output_stream(f"{root}/{self.name}", compression=None)
            self.writer = pa.ipc.new_file(self.out, FILE, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        start, end, frames, blocks = zip(*self.held, strict=True)
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.array(frames, pa.int32()), tensor_array(list(blocks))], schema=FILE))
        self.held = []

    def close(self) -> None:
        if self.held:
            self.flush()
        if self.writer is not None:
            self.writer.close()
            self.out.close()


class TensorReader:
    """Tensors by number from the files of a folder; the last file and batch
    stay open."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = file_system(folder)
        self.name = self.reader = None
        self.at, self.batch = -1, None

    def read(self, name: str, first: int, n: int) -> Iterator[Tensor]:
        if name != self.name:
            self.name, self.at = name, -1
            self.reader = pa.ipc.open_file(self.fs.open_input_file(f"{self.root}/{name}"))
        for i in range(first, first + n):
            if i // FILE_TENSORS != self.at:
                self.at = i // FILE_TENSORS
                batch = self.reader.get_batch(self.at)
                self.batch = [batch.column(c).to_pylist() for c in range(3)], batch.column(3).to_numpy_ndarray()
            (start, end, frames), values = self.batch
            j = i % FILE_TENSORS
            yield start[j], end[j], frames[j], values[j]


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a WAV file) of each document, written.

    A null text is empty, and an empty payload one unit of padding; repeated
    rows and null ids keep a row each; extra columns are not read; an empty
    table gives no rows. A very long text is one WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches_by_bytes(batches, 1):
            data = some.column("payload").to_pylist()
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(padded(x)) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = clear_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("payload"))
    return written(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments int, file string, first long, n int"


def store_tensors(media: DataFrame, folder: str) -> DataFrame:
    """The tensors of each media row, stored in a folder that all tasks see.
    Returns, written, digests of what was read, the number of segments, and
    where the tensors are: file, first and n. Every row has at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = TensorFile(folder)
        for some in batches_by_bytes(batches, 2):
            rows = []
            for data in some.column("media").to_pylist():
                samples, rate = from_wav(data)
                mels, spans, out_rate = features(samples, rate)
                first, n = out.add(tensors(mels, spans, out_rate))
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), len(spans), out.name, first, n))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[x.split()[0] for x in STORED.split(", ")])
        out.close()

    return written(media.select("doc_id", "n_bytes", "media").mapInArrow(run, STORED), "media-tensors")


def segment_tensors(stored: DataFrame, folder: str) -> DataFrame:
    """One row for each stored tensor: doc_id, nth, start_s, end_s, frames and
    values (TENSOR_FRAMES * MELS floats, row by row)."""
    schema = "doc_id long, nth int, start_s double, end_s double, frames int, values array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = TensorReader(folder)
        for batch in batches:
            for doc_id, name, first, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "file", "first", "n")), strict=True):
                for at in range(0, n, FILE_TENSORS):
                    start, end, frames, values = zip(*files.read(name, first + at, min(FILE_TENSORS, n - at)), strict=True)
                    flat = [v.astype(np.float32).reshape(-1) for v in values]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc_id] * len(start), pa.int64()), pa.array(range(at, at + len(start)), pa.int32()),
                        pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.array(frames, pa.int32()), pa.array(flat, pa.list_(pa.float32())),
                    ], names=["doc_id", "nth", "start_s", "end_s", "frames", "values"])

    return stored.select("doc_id", "file", "first", "n").mapInArrow(run, schema)


def digest(made: Iterable[Tensor], segments: int) -> str:
    """Frames, segments, seconds in tensors, and checksums of the time spans and
    of the values without padding."""
    frames, seconds, where, values = 0, 0.0, 0, 0
    for start, end, n, block in made:
        frames += n
        seconds += end - start
        where = zlib.crc32(struct.pack("<dd", start, end), where)
        values = zlib.crc32(np.ascontiguousarray(block[:n], "<f2").tobytes(), values)
    return f"frames={frames};mels={MELS};segments={segments};seconds={seconds:.3f};spans={where:08x};values={values:08x}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def audio_features(docs: DataFrame) -> DataFrame:
    """Digests of each document's stored media and of its stored tensors, both
    read back.

    A null text is empty; an empty payload is one unit of padding. Each text is
    processed on its own, so equal texts have equal values; a long one is
    resampled in chunks. Repeated rows and null ids keep a row each; extra
    columns are not read; an empty table gives no rows."""
    folder = fresh_path(docs.sparkSession, "tensors")
    stored = store_tensors(store_media(docs), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = TensorReader(folder)
        for batch in batches:
            found = [digest(files.read(name, first, n), segments) for name, first, n, segments in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n", "segments")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(found, pa.string())], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return stored.mapInArrow(run, DIGESTS)
