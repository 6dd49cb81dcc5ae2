"""Audio features against their plain formulas, sample by sample."""

import math

import numpy as np
import pytest

from pactlake.llm import audio


def signal(n, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return rng.normal(0, 0.02, n) + np.where((t // 900) % 2, 0.6, 0.02) * np.sin(t * 0.4)


def plain_resample(x):
    """Zeros between samples, one long low-pass filter, every DOWN-th value."""
    n = audio.UP * audio.TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(audio.UP, audio.DOWN)) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    h *= audio.UP / h.sum()
    wide = np.zeros(len(x) * audio.UP)
    wide[:: audio.UP] = x
    return np.convolve(wide, h)[:: audio.DOWN]


@pytest.mark.parametrize("n", [1, 7, 576, 2000, 70001])
def test_resampling(n):
    x = signal(n)
    got, want = audio.resample(x), plain_resample(x)
    k = min(len(got), len(want))
    assert k >= n * audio.UP // audio.DOWN
    assert np.allclose(got[:k], want[:k], atol=1e-6)
    assert np.allclose(got[k:], 0, atol=1e-6) and np.allclose(want[k:], 0, atol=1e-6)


def test_log_mel():
    y = signal(1500)
    mel, db = audio.log_mel(y)
    top = audio.RATE * audio.UP / audio.DOWN / 2
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hertz(2595 * math.log10(1 + top / 700) * i / (audio.MELS + 1)) for i in range(audio.MELS + 2)]
    padded = np.concatenate([y, np.zeros(audio.FRAME)])
    for f in (0, 3, len(mel) - 1):
        frame = padded[f * audio.HOP : f * audio.HOP + audio.FRAME] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1)))
        k = np.arange(audio.FRAME // 2 + 1)
        power = np.abs(np.exp(-2j * np.pi * np.outer(k, np.arange(audio.FRAME)) / audio.FRAME) @ frame) ** 2
        at = k * top / (audio.FRAME / 2)
        for m in range(audio.MELS):
            a, b, c = edges[m : m + 3]
            weight = np.maximum(0, np.minimum((at - a) / (b - a), (c - at) / (c - b)))
            assert math.isclose(mel[f, m], math.log(weight @ power + 1e-6), rel_tol=1e-4, abs_tol=1e-4)
        assert math.isclose(db[f], 10 * math.log10(power.sum() + 1e-9), abs_tol=1e-3)


def test_hysteresis_segments():
    rng = np.random.default_rng(6)
    for _ in range(40):
        db = rng.normal(0, 4, int(rng.integers(1, 60)))
        floor, on, spans, start = np.quantile(db, 0.1), False, [], 0
        for i, v in enumerate(db):
            if not on and v >= floor + audio.ON_DB:
                on, start = True, i
            elif on and v < floor + audio.OFF_DB:
                on = False
                spans.append([start, i])
        if on:
            spans.append([start, len(db)])
        assert audio.segments(db).tolist() == spans


def test_tensors_hold_every_frame_and_its_time():
    mel, db = audio.log_mel(audio.resample(signal(30000)))
    back = audio.from_ipc(audio.to_ipc(audio.tensor_batch(mel, db)))
    blocks = back.column("tensor").to_numpy_ndarray()
    assert blocks.shape[1:] == (audio.BLOCK, audio.MELS)
    assert np.array_equal(blocks.reshape(-1, audio.MELS)[: len(mel)], mel)
    ms = 1000 * audio.DOWN / (audio.RATE * audio.UP)
    starts, ends = back.column("start_ms").to_pylist(), back.column("end_ms").to_pylist()
    assert starts == [i * audio.BLOCK * audio.HOP * ms for i in range(len(blocks))]
    assert math.isclose(ends[-1], ((len(mel) - 1) * audio.HOP + audio.FRAME) * ms)
