"""Media columns: lossless 8-bit audio and its features.

A payload of bytes becomes a WAV file of 8-bit mono samples. From the stored
file come, for each row: a polyphase resampled signal, overlapped log-mel
filterbank frames, and the time spans in which the energy is high by a hysteresis (a span
starts above the high threshold and ends below the low one). Frames are stored in
patches of fixed shape (PATCH x MELS half floats, the last one padded with zeros) with
their time spans: a row's patches are an Arrow stream of a fixed-shape tensor column. The
feature string is made from what is read back.

A null text is an empty one: its payload is padding alone. Equal texts have equal
values. Rows come back as they are, repeated ones too, a null id stays null, and an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import flat
from llm.store import stored

UNIT, PAD = 576, 255
RATE, UP, DOWN = 16_000, 1, 2
WINDOW, HOP, MELS, PATCH = 256, 128, 24, 32
#: Taps of the resampling filter for each input sample step; frames transformed at once.
TAPS, STEP = 16, 4096
#: Decibels above and below the median frame energy where a span starts and ends.
HIGH, LOW = 1.0, -0.5


def payload(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples; an odd number of them is padded by a byte that their size leaves out."""
    n = len(samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * (n % 2)


def samples_of(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of such a file."""
    head = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (head[0], head[2], head[5], head[6], head[10], head[11]) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) < 44 + head[12]:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44 : 44 + head[12]], head[7]


def _filter(up: int, down: int) -> np.ndarray:
    """A windowed sinc whose cut-off is the lower of both Nyquist rates."""
    wide = max(up, down)
    n = TAPS * wide + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / wide) * np.hamming(n)
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: each branch filters only the samples that reach an output."""
    h = _filter(up, down)
    n, half = -(-len(x) * up // down), len(h) // 2
    if up == 1:
        padded = np.pad(x, (half, half + down))
        out = np.zeros(n, np.float32)
        for p in range(down):
            branch = h[p::down]
            out += np.convolve(padded[p::down], branch[::-1], "valid")[:n]
        return out
    k = np.arange(n) * down + half  # places in the signal with up - 1 zeros after each sample
    out = np.zeros(n, np.float32)
    for p in range(up):
        at = np.flatnonzero(k % up == p)
        branch = h[p::up]
        full = np.convolve(np.pad(x, (0, len(branch))), branch)
        out[at] = full[k[at] // up]
    return out


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_banks: dict[float, np.ndarray] = {}


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS, energy of each frame in decibels); the last frame is padded with silence."""
    if rate not in _banks:
        _banks[rate] = _mel_bank(rate)
    n = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    x = np.pad(x, (0, (n - 1) * HOP + WINDOW - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    shape = np.hanning(WINDOW).astype(np.float32)
    for k in range(0, n, STEP):
        part = frames[k : k + STEP]
        power = np.abs(np.fft.rfft(part * shape, axis=1)).astype(np.float32) ** 2
        mels[k : k + STEP] = np.log(power @ _banks[rate] + 1e-6)
        energy[k : k + STEP] = 10 * np.log10((part.astype(np.float32) ** 2).mean(axis=1) + 1e-9)
    return mels, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """(first frame, frame after the last) of each span of high energy."""
    middle = np.median(energy)
    above, start = energy > middle + LOW, energy >= middle + HIGH
    edge = np.flatnonzero(np.diff(np.concatenate([[0], above.astype(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    if len(runs) == 0:
        return runs
    highs = np.append(0, np.cumsum(start))
    first = np.searchsorted(highs, highs[runs[:, 0]] + 1) - 1  # the first high frame at or after the run's start
    good = highs[runs[:, 1]] > highs[runs[:, 0]]
    return np.stack([first[good], runs[good, 1]], axis=1)


def analyse(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[float, float, int]], list[tuple[float, float]]]:
    """(samples, patches, (start, end, frames) of each patch, active spans in seconds)."""
    raw, rate = samples_of(media)
    x = resample((np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128)
    low_rate = rate * UP / DOWN
    mels, energy = log_mel(x, low_rate)
    n = len(mels)
    patches = np.zeros((-(-n // PATCH) * PATCH, MELS), np.float16)
    patches[:n] = mels
    hop, end = HOP / low_rate, len(x) / low_rate
    until = lambda k: float(min(end, ((k - 1) * HOP + WINDOW) / low_rate))
    spans = [(float(a * hop), until(b)) for a, b in segments(energy)]
    times = [(k * hop, until(min(k + PATCH, n)), min(PATCH, n - k)) for k in range(0, n, PATCH)]
    return raw, patches.reshape(-1, PATCH, MELS), times, spans


#: Columns of a row's stored patches.
PATCHES = pa.schema([("patch", pa.fixed_shape_tensor(pa.float16(), [PATCH, MELS])), ("start", pa.float64()), ("end", pa.float64()), ("frames", pa.int32())])


def to_stream(patches: np.ndarray, times: list[tuple[float, float, int]]) -> bytes:
    """An Arrow stream of the patches as a fixed-shape tensor column with their time spans."""
    flat_ = pa.FixedSizeListArray.from_arrays(pa.array(patches.reshape(-1), pa.float16()), PATCH * MELS)
    start, end, frames = zip(*times, strict=True)
    columns = [pa.ExtensionArray.from_storage(PATCHES.field("patch").type, flat_), pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.array(frames, pa.int32())]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, PATCHES) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=PATCHES))
    return out.getvalue().to_pybytes()


def from_stream(data: bytes) -> tuple[np.ndarray, list[tuple[float, float, int]]]:
    """(patches, (start, end, frames) of each) of such a stream."""
    table = pa.ipc.open_stream(data).read_all()
    if table.schema.field("patch").type != PATCHES.field("patch").type:
        raise ValueError("not patches of this shape")
    patch = table["patch"].combine_chunks()
    return patch.to_numpy_ndarray(), list(zip(*(table[c].to_pylist() for c in ("start", "end", "frames")), strict=True))


def summary(patches: np.ndarray, times: list[tuple[float, float, int]], spans: list[tuple[float, float]]) -> str:
    """The feature string of a row's stored tensors and spans."""
    n = sum(k for _, _, k in times)
    mels = patches.reshape(-1, MELS)[:n]
    digest = zlib.crc32(mels.astype("<f2").tobytes())
    return f"rate={RATE * UP / DOWN:g};frames={n};patches={len(times)};seconds={times[-1][1]:.3f};spans={len(spans)};active={sum(b - a for a, b in spans):.3f};mean={float(mels.astype(np.float64).mean()):.3f};mel={digest:08x}"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media), stored in the shared folder and read back."""

    def run(batches):
        for batch in batches:
            for start, stop, data, offsets in flat.blocks(flat.column(batch, "text")):
                raw = data.tobytes()
                media = [wav(payload(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(plain.mapInArrow(run, "id long, n_bytes long, media binary"), "media")


_KINDS = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
_NAMES = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
_SPANS = "spans array<struct<start: double, end: double>>"


def media_features(media: DataFrame) -> DataFrame:
    """(id, n_bytes, sizes and hashes, tensors, spans) of stored media, stored in the shared folder and read back.

    ``tensors`` is an Arrow stream of fixed-shape patches with their time spans; ``from_stream`` reads it.
    """
    span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                files = part.column(2).to_pylist()
                made = [analyse(m) for m in files]
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array([len(raw) for raw, *_ in made], pa.int64()),
                    pa.array([hashlib.sha256(raw).hexdigest() for raw, *_ in made], pa.string()),
                    pa.array([zlib.crc32(raw[-32:]) for raw, *_ in made], pa.int64()),
                    pa.array([len(m) for m in files], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in files], pa.string()),
                    pa.array([to_stream(patches, times) for _, patches, times, _ in made], pa.binary()),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for *_, spans in made], span),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "tensors", "spans"])

    found = media.select("id", "n_bytes", "media").mapInArrow(run, f"{_KINDS}, tensors binary, {_SPANS}")
    return stored(found, "tensors")


def digests(features: DataFrame) -> DataFrame:
    """The rows of ``media_features`` with the feature string in place of tensors and spans."""

    def run(batches):
        for batch in batches:
            texts = []
            for data, spans in zip(batch.column(7), batch.column(8).to_pylist(), strict=True):
                texts.append(summary(*from_stream(data.as_buffer()), [(s["start"], s["end"]) for s in spans]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(texts, pa.string())], names=[*_NAMES, "feature"])

    return features.select(*_NAMES, "tensors", "spans").mapInArrow(run, f"{_KINDS}, feature string")


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored audio and feature digests of the whole ``documents`` table."""
    media = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digests(media_features(media)).withColumnRenamed("id", "doc_id")
