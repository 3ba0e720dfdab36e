import wave
import io

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import clashing, documents
from vectorloom.llm import audio as A


@pytest.mark.parametrize("text", ["", None, "a", "x" * 64, "ä" * 33, "long " * 50_000])
def test_exact_round_trip(text):
    raw, n = A.payload(text)
    assert len(raw) % 64 == 0 and len(raw) >= 64 and n == len((text or "").encode())
    assert raw == (text or "").encode() + bytes(len(raw) - n)
    media = A.to_wav(raw)
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, A.RATE)
    assert A.from_wav(media) == (raw, A.RATE)
    assert A.analyse(media)["samples"] == raw


@pytest.mark.parametrize("rate,target", [(16000, 8000), (16000, 24000), (16000, 11025), (8000, 8000)])
def test_resampling_keeps_a_tone(rate, target):
    x = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    y = A.resample(x, rate, target)
    assert len(y) == target
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(target) / target))[100:-100].max() < 0.01


def test_resampling_stops_what_would_alias():
    x = np.sin(2 * np.pi * 7000 * np.arange(16000) / 16000)
    assert np.abs(A.resample(x, 16000, 8000))[100:-100].max() < 0.05


def test_mel_band_of_a_tone():
    mel = A.log_mel(np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000).astype(np.float32), 8000)
    assert mel.shape == (1 + -(-(8000 - A.FRAME) // A.HOP), A.BANDS)
    filters = A.mel_filters(8000)
    assert (mel.argmax(axis=1) == filters[32].argmax()).all()  # bin 32 of 256 is 1000 Hz
    assert A.log_mel(np.zeros(10, np.float32), 8000).shape == (1, A.BANDS)


def test_hysteresis():
    energy = [0, 10, 5, 5, 3, 5, 10, 10, 5, 0]
    mel = np.repeat(np.array(energy, np.float32)[:, None], A.BANDS, axis=1)
    assert A.segments(mel) == [(1, 4), (6, 9)]  # 5 holds a segment, and starts none


def test_table(spark):
    rows = [(1, "Hello " * 500), (2, None), (3, ""), (4, "Hello " * 500), (4, "Hello " * 500), (None, "x" * 200_000)]
    stored = A.store(clashing(documents(spark, rows)))
    out = A.features(stored).collect()
    assert len(out) == len(rows)
    a, b = [r for r in out if r["doc_id"] in (1, 4)][:2]
    assert a["tensors"] == b["tensors"] and a["segments"] == b["segments"]
    for r in out:
        assert bytes(r["samples"]) == A.from_wav(bytes(r["media"]))[0]
        held = A.tensor_table(bytes(r["tensors"]))
        values = held["values"].combine_chunks().to_numpy_ndarray()
        assert values.shape == (-(-r["frames"] // A.TENSOR_FRAMES), A.TENSOR_FRAMES, A.BANDS)
        assert all(a < b for a, b in zip(held["start_s"].to_pylist(), held["end_s"].to_pylist(), strict=True))
        assert values.reshape(-1, A.BANDS)[: r["frames"]].mean(axis=0) == pytest.approx(np.array(r["mel_mean"]), abs=1e-3)
    read = {r["doc_id"]: r for r in A.tensor_summary(A.features(stored).drop("samples")).collect()}
    assert "tensors" not in read[1].asDict() and read[1]["tensor_shape"] == f"{A.TENSOR_FRAMES}x{A.BANDS}" and read[2]["n_tensors"] == 1
    assert read[1]["covered_s"] == pytest.approx(3008 / A.RATE)
    assert A.features(A.store(documents(spark, []))).count() == 0
    damaged = spark.createDataFrame([(1, bytearray(b"RIFF")), (2, None)], "doc_id long, media binary")
    assert [r["samples"] for r in A.features(damaged).collect()] == [None, None]
    assert [r["n_tensors"] for r in A.tensor_summary(A.features(damaged)).collect()] == [None, None]


def test_arrow_tensors():
    mel = np.arange(40 * A.BANDS, dtype=np.float32).reshape(40, A.BANDS)
    held = A.tensors(mel)
    table = A.tensor_table(A.tensor_bytes(held, [0.0, 1.0], [1.0, 2.0]))
    assert table.schema.field("values").type == pa.fixed_shape_tensor(pa.float32(), [A.TENSOR_FRAMES, A.BANDS])
    assert (table["values"].combine_chunks().to_numpy_ndarray() == held).all() and table["end_s"].to_pylist() == [1.0, 2.0]


def test_the_registered_resampling_has_phases():
    k = np.gcd(A.RATE, A.TARGET_RATE)
    assert A.polyphase_filter(A.TARGET_RATE // k, A.RATE // k).shape == (3, A.TAPS_PER_PHASE)
    # Against the filter applied at the full upsampled rate.
    rng, up, down = np.random.default_rng(3), 3, 4
    x = rng.normal(size=200).astype(np.float32)
    full = np.zeros(len(x) * up)
    full[::up] = x
    phases = A.polyphase_filter(up, down)
    taps = phases[:, ::-1].T.ravel()  # back in one row
    half = A.TAPS_PER_PHASE // 2 * up
    plain = [sum(taps[half + j] * full[n - j] for j in range(-half, half) if 0 <= n - j < len(full)) for n in range(0, len(full), down)]
    assert A.resample(x, A.RATE, A.TARGET_RATE) == pytest.approx(np.array(plain), abs=1e-4)


def test_feature_against_a_plain_version(spark):
    """The digest that the query returns, computed frame by frame."""
    text = "Some words of a text, long enough for frames. " * 40
    r = A.tensor_summary(A.features(A.store(documents(spark, [(1, text)])))).first()
    samples = (np.frombuffer(A.payload(text)[0], np.uint8).astype(np.float64) - 128) / 128
    x = A.resample(samples, A.RATE, A.TARGET_RATE).astype(np.float64)
    frames = []
    for at in range(0, max(1, len(x) - A.FRAME + A.HOP), A.HOP):
        own = np.zeros(A.FRAME)
        own[: len(x[at : at + A.FRAME])] = x[at : at + A.FRAME]
        power = np.abs(np.fft.rfft(own * np.hanning(A.FRAME))) ** 2
        frames.append(np.log(power @ A.mel_filters(A.TARGET_RATE) + np.exp(A.FLOOR)))
    assert r["frames"] == len(frames)
    assert np.array(r["mel_mean"]) == pytest.approx(np.mean(frames, axis=0), abs=2e-3)
    energy, active, spans = np.mean(frames, axis=1), False, []
    low, high = energy.min(), energy.max()
    for k, e in enumerate(energy):
        if not active and e >= low + A.RISE * (high - low):
            active = True
            spans.append([k, k])
        elif active and e < low + A.FALL * (high - low):
            active = False
        if active:
            spans[-1][1] = k
    got = [(s["start_s"], s["end_s"]) for s in r["segments"]]
    length = len(samples) / A.RATE
    assert got == [(pytest.approx(a * A.HOP / A.TARGET_RATE), pytest.approx(min(length, (b * A.HOP + A.FRAME) / A.TARGET_RATE))) for a, b in spans]
