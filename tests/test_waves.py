"""Filters against plain convolution and direct sums; planted beats and responses; blocks against whole series."""

import math

import numpy as np
import pytest

from pulseframe.operators import waves


def plain_resample(x, up, down):
    """Zeros put in, convolved, every down-th kept."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    half = 10 * max(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, up * waves.low_pass(0.5 / max(up, down), half))[half : half + len(wide)][::down]


@pytest.mark.parametrize("up,down", [(3, 2), (2, 3), (1, 4), (5, 1), (4, 6), (37, 64), (1, 1)])
def test_polyphase_equals_convolution(up, down):
    rng = np.random.default_rng(up)
    for n in (1, 7, 64, 301):
        x = rng.normal(size=n)
        got = waves.resample_poly(x, up, down)
        want = plain_resample(x, up, down) if up != down else x
        assert len(got) == -(-n * up // down) and np.allclose(got, want)


@pytest.mark.parametrize("n,m", [(10, 10), (10, 25), (11, 24), (24, 11), (25, 10), (30, 12), (12, 13), (13, 12)])
def test_spectrum_keeps_slow_waves(n, m):
    for k in range((min(n, m) - 1) // 2):
        wave = lambda size: 2.0 + np.cos(2 * np.pi * k * np.arange(size) / size + 0.3)  # noqa: B023, E731
        assert np.allclose(waves.resample_fourier(wave(n), m), wave(m))


def test_resampling_does_not_alias():
    t = np.arange(4000) / 64.0
    fast, slow = np.sin(2 * np.pi * 13 * t), np.sin(2 * np.pi * 1 * t)
    out = waves.resample_poly(fast + slow, 1, 8)  # to 8 Hz: 13 Hz would come out as 3 Hz
    assert np.abs(out - slow[::8])[20:-20].max() < 0.02


def test_moving_max_and_mean():
    rng = np.random.default_rng(0)
    for half in (1, 2, 3, 5, 8, 13):
        x = rng.normal(size=40)
        assert (waves.moving_max(x, half) == [x[max(0, i - half) : i + half + 1].max() for i in range(40)]).all()
    long = rng.normal(size=1 << 15)
    h = waves.low_pass(0.1, 300)
    assert np.allclose(waves.filtered(long, h), np.convolve(np.pad(long, 300, mode="edge"), h, mode="valid"))


def pulse(seconds, rate, seed):
    """A pulse wave of uneven beats, drift and noise; the times of its beats."""
    rng = np.random.default_rng(seed)
    beats = np.cumsum(rng.uniform(0.6, 1.1, 2 * int(seconds)))
    beats = beats[(beats > 1) & (beats < seconds - 1)]
    t = np.arange(int(seconds * rate)) / rate
    wave = sum(np.exp(-((t - b) ** 2) / (2 * 0.08**2)) + 0.3 * np.exp(-((t - b - 0.28) ** 2) / (2 * 0.07**2)) for b in beats)
    return t, wave + 3 * np.sin(2 * np.pi * 0.02 * t) + 0.05 * rng.normal(size=len(t)), beats


def test_planted_beats_are_found_once_in_every_block(spark):
    rate = 64.0
    frames, planted = [], {}
    for s in range(3):
        t, x, beats = pulse(120, rate, s)
        planted[s] = beats
        frames += [(s, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x))]
    df = spark.createDataFrame(frames, "subject int, pos long, t double, value double").repartition(7)
    found = {}
    for block in (1 << 14, 1000):  # whole series, and eight blocks
        rows = waves.pulse_wave(df, ["subject"], rate, block).collect()
        assert len(rows) == len(frames)
        found[block] = sorted((r.subject, r.pos) for r in rows if r.is_beat)
        clean = {(r.subject, r.pos): r.clean for r in rows}
        found[f"{block} wave"] = [clean[k] for k in sorted(clean)]
    assert found[1 << 14] == found[1000] and np.allclose(found["16384 wave"], found["1000 wave"])
    for s, beats in planted.items():
        at = np.array([p / rate for k, p in found[1000] if k == s])
        near = [np.abs(at - b).min() < 0.12 for b in beats]
        assert np.mean(near) >= 0.95 and len(at) <= len(beats) * 1.05 and np.diff(at).min() > 0.3


def test_planted_responses_have_their_amplitudes(spark):
    rate, rng = 4.0, np.random.default_rng(3)
    t = np.arange(0, 900, 1 / rate)
    times, sizes = np.arange(30, 870, 30) + rng.uniform(-4, 4, 28), rng.uniform(0.3, 1.0, 28)
    x = 5 + 0.002 * np.sin(2 * np.pi * t / 600)
    for at, size in zip(times, sizes):
        rise = np.clip((t - at) / 4, 0, 1)
        shape = np.where(t < at + 4, 0.5 - 0.5 * np.cos(np.pi * rise), np.exp(-np.maximum(t - at - 5, 0) / 3))
        x = x + size * shape
    x = x + 0.02 * np.exp(-((t - 15) ** 2) / 2)  # too small a response
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x))], "subject string, pos long, t double, value double")
    wave = waves.skin_wave(df, ["subject"], rate, 1000)
    got = sorted(waves.skin_responses(wave, ["subject"]).collect(), key=lambda r: r.pos)
    assert len(got) == 28
    for r, at, size in zip(got, times, sizes):
        assert abs(r.amplitude - size) <= 0.01 * size and at + 3 < r.t < at + 7 and r.onset / rate < r.t and r.recovery / rate > r.t
    whole = {r.pos: r.amplitude for r in waves.skin_wave(df, ["subject"], rate).collect()}
    assert all(math.isclose(r.amplitude, whole[r.pos], rel_tol=1e-9) for r in got)
    parts = wave.filter("abs(clean - tonic - phasic) > 1e-9").count()
    assert parts == 0


def test_graph_points_of_windows(spark):
    rng = np.random.default_rng(1)
    rows = [("a", w, float(i), float(x), 2.0) for w in range(2) for i, x in enumerate(rng.normal(size=50 + w))] + [("flat", 0, float(i), 1.0, 2.0) for i in range(9)] + [("one", 0, 0.0, 7.0, None)]
    df = spark.createDataFrame(rows, "k string, w int, t double, value double, rate double")
    got = {}
    for r in waves.graph_points(df, ["k", "w"], 20, 0.8, "rate").collect():
        got.setdefault((r.k, r.w), []).append((r.pos, r.value))
    assert set(got) == {("a", 0), ("a", 1), ("flat", 0), ("one", 0)} and all([p for p, _ in sorted(v)] == list(range(20)) for v in got.values())
    x = np.array([r[3] for r in rows if r[:2] == ("a", 1)])
    z = waves.resample_fourier(plain_resample(x, 2, 5), 20)
    assert np.allclose([v for _, v in sorted(got["a", 1])], (z - z.mean()) / z.std())
    assert np.allclose([v for _, v in got["one", 0]], 0)
