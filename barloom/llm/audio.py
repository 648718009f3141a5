"""Bytes as 8-bit audio: a lossless WAV column, and features computed from the stored samples.

Per row: polyphase resampling to two fifths of the rate, overlapped log-mel filterbanks, and hysteresis energy
segmentation. Features are patches of one fixed shape ``(PATCH, MELS)``, stored as Arrow fixed-shape tensors with
their time spans. Media and tensors are tables in the shared folder; each step reads what the one before has written.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stash

# fixed values of this operator
RATE = 16_000  # stored samples a second
UP, DOWN, TAPS = 2, 5, 33
FRAME, HOP, FFT, MELS = 160, 64, 256, 16  # at the resampled rate of 6.4 kHz: 25 ms every 10 ms
PATCH = 32  # frames in a tensor
ON_DB, OFF_DB, MIN_FRAMES = -9.0, -15.0, 3  # hysteresis against the loudest frame; shorter segments go
UNIT, PAD = 576, b"\xff"
CHUNK = 4096  # frames at a time: the bound on memory for very long rows


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with bytes 255 up to a positive multiple of 576, and the length before padding."""
    data = (text or "").encode("utf-8")
    return data + PAD * (UNIT * max(1, -(-len(data) // UNIT)) - len(data)), len(data)


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples; the payload's even length needs no padding byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(media: bytes) -> bytes:
    """The sample bytes that a stored file holds."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack("<4sI", media[at : at + 8])
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a WAV file without samples")


def _lowpass(taps: int, cut: float) -> np.ndarray:
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(cut * t) * cut * np.hamming(taps)
    return h / h.sum()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Rate times up/down: each output phase is one strided dot product with its branch of the filter."""
    h = _lowpass(taps * up, 1.0 / max(up, down)) * up
    half = (len(h) - 1) // 2
    n_out = -(-len(x) * up // down)
    out = np.empty(n_out)
    for phase in range(up):  # output k takes the branch of (k * down) mod up
        ks = np.arange(phase, n_out, up)
        if not len(ks):
            continue
        at = ks * down + half  # position in the upsampled, filter-aligned grid
        branch = h[at[0] % up :: up]
        last = at // up  # newest input sample in reach; the taps run back from it
        pad = len(branch)
        padded = np.concatenate((np.zeros(pad), x, np.zeros(pad + half)))
        views = np.lib.stride_tricks.sliding_window_view(padded, len(branch))
        step = (last[1] - last[0]) if len(last) > 1 else 1
        first = last[0] + pad - len(branch) + 1
        out[ks] = views[first : first + step * (len(ks) - 1) + 1 : step] @ branch[::-1]
    return out


def mel_bank(rate: int = RATE * UP // DOWN, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), mels + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(fft, 1 / rate)[:, None]
    up, down = (freq - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - freq) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


BANK = mel_bank().astype(np.float32)
WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log energies and the frames' energies in dB; a signal shorter than a frame is padded."""
    if len(y) < FRAME:
        y = np.concatenate((y, np.zeros(FRAME - len(y))))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mels, energy = [], []
    for k in range(0, len(frames), CHUNK):
        part = frames[k : k + CHUNK].astype(np.float32)
        power = np.abs(np.fft.rfft(part * WINDOW, FFT)).astype(np.float32) ** 2
        mels.append(np.log(power @ BANK + 1e-6))
        energy.append(10 * np.log10((part * part).mean(axis=1) + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, on: float = ON_DB, off: float = OFF_DB, least: int = MIN_FRAMES) -> np.ndarray:
    """(n, 2) first and end frames: a segment starts where energy rises above ``on`` and lasts until it falls below ``off``."""
    rel = energy - energy.max()
    state = np.where(rel >= on, 1, np.where(rel < off, 0, -1))
    state[0] = max(state[0], 0)
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), 0))
    active = np.concatenate(([0], state[at], [0]))
    edge = np.flatnonzero(np.diff(active))
    spans = edge.reshape(-1, 2)
    return spans[spans[:, 1] - spans[:, 0] >= least]


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensors ``(n, PATCH, MELS)`` (the last one repeats its last frame), their spans and the segments, in milliseconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    mels, energy = log_mel(resample(x))
    ms = 1000 * HOP * DOWN // (RATE * UP)
    n = -(-len(mels) // PATCH)
    padded = np.concatenate((mels, np.repeat(mels[-1:], n * PATCH - len(mels), axis=0)))
    start = np.arange(n) * PATCH * ms
    spans = np.stack((start, np.minimum(start + PATCH * ms, len(mels) * ms)), axis=1)
    return np.round(padded.reshape(n, PATCH, MELS), 3).astype(np.float32), spans, segments(energy) * ms


def tensor_column(patches: np.ndarray) -> pa.ExtensionArray:
    """Patches as an Arrow fixed-shape tensor array."""
    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))
    flat = pa.array(np.ascontiguousarray(patches, np.float32).ravel())
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, PATCH * MELS))


def tensor_ipc(patches: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow stream of (tensor, start_ms, end_ms), one row a patch."""
    batch = pa.RecordBatch.from_arrays(
        [tensor_column(patches), pa.array(spans[:, 0], pa.int64()), pa.array(spans[:, 1], pa.int64())], names=["log_mel", "start_ms", "end_ms"]
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Patches and spans of an Arrow stream that :func:`tensor_ipc` has made."""
    table = pa.ipc.open_stream(stream).read_all().combine_chunks()
    column = table["log_mel"].chunk(0) if table["log_mel"].num_chunks else tensor_column(np.empty((0, PATCH, MELS)))
    return column.to_numpy_ndarray(), np.stack((table["start_ms"].to_numpy(), table["end_ms"].to_numpy()), axis=1)


MEDIA = "n_bytes long, media binary"
STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
SEGMENTS = "array<struct<start_ms:long,end_ms:long>>"
DIGEST = f"{STORED}, feature string, n_frames long, n_tensors long, n_segments long"


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _names(schema: str) -> list[str]:
    return ["doc_id", *(x.split()[0] for x in schema.split(", "))]


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text (null: empty) as a WAV file. Ids keep their type; repeated rows stay repeated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, media = [], []
            for text in batch.column(1):
                payload, n = payload_of(text.as_py())
                n_bytes.append(n)
                media.append(wav(payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary())], names=_names(MEDIA))

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {_kind(docs)}, {MEDIA}")


def extract(media: DataFrame) -> DataFrame:
    """What stored files ``doc_id, n_bytes, media`` hold: lengths, checksums, ``tensors`` (an Arrow stream of fixed-shape tensors and spans) and ``segments``."""

    def run(batches):
        kind = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), kind]
        for batch in batches:
            rows = []
            for value in batch.column(2):
                data = value.as_py()
                payload = samples_of(data)
                patches, spans, segs = features(payload)
                found = [{"start_ms": int(a), "end_ms": int(b)} for a, b in segs]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), tensor_ipc(patches, spans), found))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[*_names(STORED), "tensors", "segments"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {_kind(media)}, {STORED}, tensors binary, segments {SEGMENTS}")


def digest(stored: DataFrame) -> DataFrame:
    """The rows of :func:`extract` with a summary of their stored tensors and segments.

    ``feature`` is ``frames:tensors:segments:active ms:mean log-mel of each band:hash of the tensors``,
    the same for equal texts.
    """

    def run(batches):
        names = _names(DIGEST)
        for batch in batches:
            rows = []
            for stream, found in zip(batch.column("tensors"), batch.column("segments").to_pylist(), strict=True):
                patches, spans = read_tensors(stream.as_py())
                segs = np.array([(x["start_ms"], x["end_ms"]) for x in found], np.int64).reshape(-1, 2)
                frames = int(spans[-1, 1]) * RATE * UP // (1000 * HOP * DOWN)
                mean = patches.reshape(-1, MELS)[:frames].mean(axis=0, dtype=np.float64)
                mark = hashlib.sha256(patches.tobytes() + spans.tobytes() + segs.tobytes()).hexdigest()
                active = int((segs[:, 1] - segs[:, 0]).sum())
                feature = f"{frames}:{len(patches)}:{len(segs)}:{active}:{','.join(f'{m:.2f}' for m in mean)}:{mark[:32]}"
                rows.append((feature, frames, len(patches), len(segs)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            kept = [batch.column(c) for c in names[: -len(kinds)]]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=names)

    return stored.mapInArrow(run, f"doc_id {_kind(stored)}, {DIGEST}")


def media_digest(docs: DataFrame) -> DataFrame:
    """Write the media, read them back, write their tensors, read those back and summarise: ``doc_id`` and the columns of ``DIGEST``."""
    media = stash(store(docs), "media", "zstd")
    stored = stash(extract(media), "tensors", "zstd")
    return digest(stored)
