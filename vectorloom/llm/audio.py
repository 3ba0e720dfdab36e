"""Media columns: audio stored as WAV, polyphase resampling, log-mel filterbanks, energy segmentation.

Samples are resampled by a windowed-sinc filter in polyphase form: only the taps that meet a sample are multiplied. Frames
overlap by half, are windowed, and give log energies of triangular filters on the mel scale. A frame is active from when
its energy rises over the upper threshold until it falls under the lower one (hysteresis); runs of active frames are
segments with times. The log-mel frames are stored as tensors of one fixed shape, the last one padded with the floor
value, each with its time span: a document's tensors are an Arrow table in IPC form, with a fixed-shape tensor column
(`tensor_bytes`, `tensor_table`), as Spark has no such column type. `tensor_summary` reads them back.

Defined results: a null text counts as empty; a text's payload is its UTF-8 bytes, then zero bytes up to a positive
multiple of 64; the payload is one 8-bit sample a byte. Equal payloads give equal values: each is computed by itself.
A WAV that is null or damaged gives nulls. Repeated rows give repeated rows; an empty table gives no rows. Other
columns of the input are not read. Every text is stored whole.
"""

from __future__ import annotations

import io
import wave
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.bpe import slices
from vectorloom.llm.shared import small_batches

UNIT = 64
RATE = 16_000
TARGET_RATE = 12_000  # 3 / 4 of the rate: three phases
FRAME, HOP = 256, 128
BANDS = 20
TENSOR_FRAMES = 32
TAPS_PER_PHASE = 16
FLOOR = -23.0
#: Of the range between the quietest and the loudest frame.
RISE, FALL = 0.6, 0.4


def payload(text: str | None) -> tuple[bytes, int]:
    """(padded bytes, unpadded length)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return held.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(8-bit samples, rate) of a mono 8-bit WAV; ValueError if it is none."""
    try:
        with wave.open(io.BytesIO(media), "rb") as w:
            if w.getnchannels() != 1 or w.getsampwidth() != 1:
                raise ValueError("not a mono 8-bit WAV")
            return w.readframes(w.getnframes()), w.getframerate()
    except (wave.Error, EOFError) as e:
        raise ValueError(str(e)) from e


@lru_cache(maxsize=8)
def polyphase_filter(up: int, down: int) -> np.ndarray:
    """up phases of TAPS_PER_PHASE taps of a Hann-windowed sinc, centred on a sample; each phase sums to 1."""
    half = TAPS_PER_PHASE // 2 * up
    t = np.arange(-half, half)
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.cos(np.pi * t / (2 * half)) ** 2
    phases = h.reshape(TAPS_PER_PHASE, up).T[:, ::-1]
    return np.ascontiguousarray(phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """x at target samples a second: ceil(len * target / rate) of them."""
    k = gcd(rate, target)
    up, down = target // k, rate // k
    if up == down:
        return x.astype(np.float32)
    n = -(-len(x) * up // down)
    phases = polyphase_filter(up, down)
    padded = np.concatenate([np.zeros(TAPS_PER_PHASE // 2 - 1, np.float32), x.astype(np.float32), np.zeros(TAPS_PER_PHASE + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS_PER_PHASE)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        base, phase = divmod(first * down, up)
        own = windows[base::down][: len(out[first::up])]
        out[first::up] = own @ phases[phase]
    return out


@lru_cache(maxsize=8)
def mel_filters(rate: int, bands: int = BANDS, frame: int = FRAME) -> np.ndarray:
    """Triangular filters, equally spaced in mel, over the bins of a real FFT."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    rise = (bins - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    fall = (points[2:, None] - bins) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, BANDS) log energies; a signal shorter than a frame is one padded frame."""
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((n, BANDS), np.float32)
    for at in range(0, n, 1024):  # bounded memory for very long signals
        spectrum = np.fft.rfft(frames[at : at + 1024] * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[at : at + 1024] = np.log(power @ mel_filters(rate) + np.float32(np.exp(FLOOR)))
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) frames of active runs, with hysteresis between the two thresholds."""
    energy = mel.mean(axis=1)
    low, high = float(energy.min()), float(energy.max())
    rise, fall = low + RISE * (high - low), low + FALL * (high - low)
    # What counts at a frame is the last crossing: over the upper threshold, or under the lower one.
    mark = np.where(energy >= rise, 1, np.where(energy < fall, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = np.where(last >= 0, mark[np.maximum(last, 0)], 0) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> np.ndarray:
    """(k, TENSOR_FRAMES, BANDS): the frames in tensors of one shape."""
    k = -(-len(mel) // TENSOR_FRAMES)
    out = np.full((k * TENSOR_FRAMES, BANDS), FLOOR, np.float32)
    out[: len(mel)] = mel
    return out.reshape(k, TENSOR_FRAMES, BANDS)


def tensor_bytes(values: np.ndarray, start_s: list[float], end_s: list[float]) -> bytes:
    """Tensors (k, TENSOR_FRAMES, BANDS) and their time spans as an Arrow table in IPC form."""
    kind = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, BANDS])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), pa.float32()), TENSOR_FRAMES * BANDS)
    batch = pa.record_batch([pa.array(start_s, pa.float64()), pa.array(end_s, pa.float64()), pa.ExtensionArray.from_storage(kind, flat)], names=["start_s", "end_s", "values"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def tensor_table(data: bytes) -> pa.Table:
    """start_s, end_s and values (fixed-shape tensors) of what tensor_bytes wrote."""
    with pa.ipc.open_stream(data) as reader:
        return reader.read_all()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (WAV) of every text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                rows = [payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([to_wav(p) for p, _ in rows], pa.binary())], names=["id", "n_bytes", "media"])

    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


FEATURES = pa.schema(
    [
        ("samples", pa.binary()),
        ("frames", pa.int64()),
        ("mel_mean", pa.list_(pa.float32())),
        ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
        ("tensors", pa.binary()),
    ]
)
FEATURES_DDL = "samples binary, frames long, mel_mean array<float>, segments array<struct<start_s:double,end_s:double>>, tensors binary"


def analyse(media: bytes, target: int = TARGET_RATE) -> dict:
    """The stored samples as read back, and their features."""
    samples, rate = from_wav(media)
    signal = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(signal, rate, target), target)
    at = lambda frame: frame * HOP / target
    length = len(samples) / rate
    spans = [{"start_s": at(a), "end_s": min(length, at(b - 1) + FRAME / target)} for a, b in segments(mel)]
    blocks = tensors(mel)
    starts = [at(k * TENSOR_FRAMES) for k in range(len(blocks))]
    held = tensor_bytes(blocks, starts, [min(length, at((k + 1) * TENSOR_FRAMES - 1) + FRAME / target) for k in range(len(blocks))])
    return {"samples": samples, "frames": len(mel), "mel_mean": mel.mean(axis=0, dtype=np.float64).astype(np.float32), "segments": spans, "tensors": held}


def features(media: DataFrame, media_col: str = "media", target: int = TARGET_RATE) -> DataFrame:
    """The columns of media with those of FEATURES. Narrow: no shuffle."""

    def run(batches):
        nothing = dict.fromkeys(FEATURES.names)
        for batch in batches:
            for part in slices(batch, 16):
                rows = []
                for m in part.column(part.schema.get_field_index(media_col)).to_pylist():
                    try:
                        rows.append(analyse(m, target) if m is not None else nothing)
                    except ValueError:
                        rows.append(nothing)
                columns = [pa.array([r[f.name] for r in rows], f.type) for f in FEATURES]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *FEATURES.names])

    clash = set(media.columns) & set(FEATURES.names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{kinds}, {FEATURES_DDL}")


SUMMARY = pa.schema([("n_tensors", pa.int64()), ("tensor_shape", pa.string()), ("tensor_mean", pa.float64()), ("covered_s", pa.float64())])
SUMMARY_DDL = "n_tensors long, tensor_shape string, tensor_mean double, covered_s double"


def tensor_summary(found: DataFrame, tensors_col: str = "tensors") -> DataFrame:
    """The columns of found, but the tensors replaced by what they hold when they are read back: their number, their shape,
    the mean of their values and the end of the last span. A null gives nulls. Narrow: no shuffle."""
    keep = [c for c in found.columns if c != tensors_col]

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                if data is None:
                    rows.append((None,) * 4)
                    continue
                table = tensor_table(data)
                values = table["values"].combine_chunks().to_numpy_ndarray()
                rows.append((len(values), "x".join(map(str, values.shape[1:])), float(values.mean(dtype=np.float64)), table["end_s"][-1].as_py()))
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SUMMARY)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*keep, *SUMMARY.names])

    if clash := set(keep) & set(SUMMARY.names):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep)
    return found.select(tensors_col, *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, f"{kinds}, {SUMMARY_DDL}")
