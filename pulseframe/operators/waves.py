"""Filters and events of sampled waves: anti-aliased resampling, cleaned pulse waves with beats, skin-conductance responses.

A series of any length is cut into blocks by position; a block's task gets its samples and a halo on both sides that is as wide as all filters
and searches reach, so blocks give what the whole series would and no task holds a series. Filters are symmetric (no shift in time) windowed sincs; beyond the
ends of a series its first and last value go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = list[str]

#: Samples of a block.
BLOCK = 1 << 14
#: Pulse: pass band in Hz, half length of the filter in s; widths of the two moving averages and of the mean level in s; its share; refractory time in s.
PULSE_BAND, PULSE_REACH, PEAK_S, BEAT_S, LEVEL_S, LEVEL_SHARE, REFRACTORY_S = (0.5, 8.0), 3.0, 0.111, 0.667, 10.0, 0.02, 0.3
#: Skin conductance: cut-off of the cleaned wave and of the tonic part in Hz, half lengths in s, longest rise and half-recovery in s, share of the largest amplitude.
CLEAN_HZ, CLEAN_REACH, TONIC_HZ, TONIC_REACH, RISE_S, RECOVERY_S, FLOOR = 1.5, 2.0, 0.05, 20.0, 10.0, 20.0, 0.1


def low_pass(cutoff: float, half: int) -> np.ndarray:
    """Symmetric Hann-windowed sinc of 2 half + 1 coefficients with sum 1; cutoff in cycles per sample."""
    k = np.arange(-half, half + 1)
    h = 2 * cutoff * np.sinc(2 * cutoff * k) * (0.5 + 0.5 * np.cos(np.pi * k / (half + 1)))
    return h / h.sum()


def band_pass(low: float, high: float, half: int) -> np.ndarray:
    """Difference of two low-passes: nothing of a constant gets through."""
    upper = low_pass(high, half) if high < 0.5 else (np.arange(-half, half + 1) == 0).astype(float)
    return upper - low_pass(low, half)


def filtered(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """x convolved with a symmetric filter, its ends continued."""
    half = len(h) // 2
    padded = np.pad(x, half, mode="edge")
    if len(padded) * len(h) < 1 << 22:
        return np.convolve(padded, h, mode="valid")
    size = 1 << int(np.ceil(np.log2(len(padded) + len(h))))
    return np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(h, size), size)[2 * half : 2 * half + len(x)]


def moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Centred mean of `width` values (made odd)."""
    return filtered(x, np.full(2 * (width // 2) + 1, 1.0 / (2 * (width // 2) + 1)))


def moving_max(x: np.ndarray, half: int) -> np.ndarray:
    """Greatest value within `half` places on both sides."""
    out, reach = np.pad(x, half, constant_values=-np.inf), 1
    width = 2 * half + 1
    while 2 * reach <= width:
        out = np.maximum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.maximum(out[: len(x)], out[rest : rest + len(x)]) if rest else out[: len(x)]


def resample_poly(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up / down times its rate: as if zeros were put in, a windowed sinc below both Nyquist rates applied, and every
    down-th value kept; only the products that count are formed. Beyond the ends there is nothing."""
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    if up == down == 1:
        return x.astype(float)
    half = 10 * max(up, down)
    h = up * low_pass(0.5 / max(up, down), half)
    at = np.arange(-(-len(x) * up // down)) * down  # places in the widened series
    first = -(-(at - half) // up)
    taps = (2 * half) // up + 1
    m = first[:, None] + np.arange(taps)[None]
    place = at[:, None] - m * up + half
    good = (m >= 0) & (m < len(x)) & (place >= 0) & (place <= 2 * half)
    return (np.where(good, x[np.clip(m, 0, len(x) - 1)], 0.0) * np.where(good, h[np.clip(place, 0, 2 * half)], 0.0)).sum(axis=1)


def resample_fourier(x: np.ndarray, n: int) -> np.ndarray:
    """x as `n` values of the same period by its spectrum, cut off or filled up with zeros."""
    if n == len(x):
        return x.astype(float)
    spectrum, keep = np.fft.rfft(x), min(n, len(x))
    out = np.zeros(n // 2 + 1, dtype=complex)
    out[: keep // 2 + 1] = spectrum[: keep // 2 + 1]
    if keep % 2 == 0:  # the middle frequency stands for two
        out[keep // 2] *= 0.5 if n > len(x) else 1.0
        if n < len(x):
            out[keep // 2] = 2 * out[keep // 2].real if keep // 2 < (len(x) + 1) // 2 else out[keep // 2]
    return np.fft.irfft(out, n) * (n / len(x))


def ratio(target: float, source: float, most: int = 1000) -> tuple[int, int]:
    """The fraction next to target / source with a denominator of at most `most`."""
    from fractions import Fraction

    f = Fraction(target / source).limit_denominator(most)
    return max(f.numerator, 1), f.denominator


def over_blocks(df: DataFrame, keys: Keys, fields: str, halo: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], block: int = BLOCK, value: str = "value", t: str = "t", pos: str = "pos") -> DataFrame:
    """keys and `fields` (as DDL) of what `work` makes of (positions, times, values) of a block with its halo; the first field is a position, and rows of other blocks' positions are left out.

    Positions count from 0 without gaps; values are there (`series.fill_gaps`).
    """
    block = max(block, halo)
    p = F.col(pos).cast("long")
    b = F.floor(p / block)
    blocks = F.array_compact(F.array(b, F.when((p - b * block < halo) & (b > 0), b - 1), F.when((b + 1) * block - p <= halo, b + 1)))
    spread = df.select(*keys, F.explode(blocks).alias("_b"), F.struct(p.alias("p"), F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("s"))
    rows = spread.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list("s")).alias("s")).select(*keys, "_b", "s.p", "s.t", "s.v")
    schema = ", ".join([f"`{k}` {dict(df.dtypes)[k]}" for k in keys] + [fields])
    names = [*keys, *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, number in enumerate(batch.column("_b").to_pylist()):
                places, times, values = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in "ptv")
                if not (places // block == number).any():
                    continue  # a halo beyond the series' end
                made = work(places, times, values)
                own = made[0] // block == number
                made = [m[own] for m in made]
                if len(made[0]):
                    again = pa.array(np.full(len(made[0]), r))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(again) for k in keys), *map(pa.array, made)], names=names)

    return rows.mapInArrow(run, schema)


def _tops(x: np.ndarray) -> np.ndarray:
    """Places of local maxima: above the value before and not below the one after."""
    return 1 + np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]))


def pulse_work(rate: float) -> tuple[int, Callable]:
    """How far a beat's decision reaches in samples, and the function that gives cleaned wave and beat marks."""
    half, refractory = int(PULSE_REACH * rate), max(1, int(round(REFRACTORY_S * rate)))
    h = band_pass(PULSE_BAND[0] / rate, min(0.5, PULSE_BAND[1] / rate), half)
    widths = [max(1, int(round(s * rate))) for s in (PEAK_S, BEAT_S, LEVEL_S)]

    def clean(x: np.ndarray) -> np.ndarray:
        return filtered(x, h)

    def beats(wave: np.ndarray) -> np.ndarray:
        square = np.maximum(wave, 0) ** 2
        peak, beat, level = (moving_mean(square, w) for w in widths)
        tops = _tops(wave)
        found = (wave[tops] > 0) & (peak[tops] > beat[tops] + LEVEL_SHARE * level[tops]) & (wave[tops] >= moving_max(wave, refractory)[tops])
        tops = tops[found]
        return tops[np.concatenate([[True], np.diff(tops) > refractory])] if len(tops) else tops  # of equal ones the first

    return half + widths[2] + 2 * refractory + 2, lambda p, t, x: (clean(x), beats)


def pulse_wave(df: DataFrame, keys: Keys, rate: float, block: int = BLOCK) -> DataFrame:
    """keys, pos, t, value, clean, is_beat: the band-passed pulse wave, and whether a sample is a heart beat: a top of the wave where the short moving average of its
    positive part's square is above the long one (plus a share of the level), greatest within the refractory time."""
    halo, work = pulse_work(rate)

    def run(p, t, x):
        wave, beats = work(p, t, x)
        mark = np.zeros(len(x), dtype=bool)
        mark[beats(wave)] = True
        return [p, t, x, wave, mark]

    return over_blocks(df, keys, "pos long, t double, value double, clean double, is_beat boolean", halo, run, block)


def skin_wave(df: DataFrame, keys: Keys, rate: float, block: int = BLOCK) -> DataFrame:
    """keys, pos, t, clean, tonic, phasic, amplitude, onset, recovery: the low-passed conductance, its slow part and the rest; where a sample is the peak of a
    response, its amplitude above the onset (the lowest point of the rise into it), and the positions of onset and half-recovery (null if none)."""
    clean_half, tonic_half = int(CLEAN_REACH * rate), int(TONIC_REACH * rate)
    clean_h = low_pass(min(0.45, CLEAN_HZ / rate), clean_half)
    tonic_h = low_pass(TONIC_HZ / rate, tonic_half)
    rise, recovery = int(RISE_S * rate), int(RECOVERY_S * rate)

    def run(p, t, x):
        clean = filtered(x, clean_h)
        tonic = filtered(clean, tonic_h)
        phasic = clean - tonic
        amplitude, onset, half = np.full(len(x), np.nan), np.full(len(x), -1), np.full(len(x), -1)
        for top in _tops(clean):
            if phasic[top] <= 0:
                continue
            low = top  # rising: back to where the wave stops falling
            while low > 0 and top - low < rise and clean[low - 1] < clean[low]:
                low -= 1
            size = clean[top] - clean[low]
            if size <= 0:
                continue
            amplitude[top], onset[top] = size, p[low]
            for k in range(top + 1, min(top + recovery, len(x))):  # recovering: until half is lost or the next rise is well above
                if clean[k] <= clean[top] - size / 2:
                    half[top] = p[k]
                    break
                if clean[k] > clean[top] + size / 10:
                    break
        return [p, t, clean, tonic, phasic, amplitude, onset, half]

    halo = clean_half + tonic_half + max(rise, recovery) + 2
    out = over_blocks(df, keys, "pos long, t double, clean double, tonic double, phasic double, amplitude double, onset long, recovery long", halo, run, block)
    return out.withColumns({"amplitude": F.nanvl("amplitude", F.lit(None).cast("double")), "onset": F.when(F.col("onset") >= 0, F.col("onset")), "recovery": F.when(F.col("recovery") >= 0, F.col("recovery"))})


def skin_responses(wave: DataFrame, keys: Keys, floor: float = FLOOR) -> DataFrame:
    """Responses of `skin_wave` with at least `floor` of their series' largest amplitude."""
    most = wave.filter("amplitude is not null").withColumn("_most", F.max("amplitude").over(Window.partitionBy(*keys)))
    return most.filter(F.col("amplitude") >= F.lit(floor) * F.col("_most")).drop("_most")


def graph_points(df: DataFrame, keys: Keys, points: int, rate: float, source_rate: str, value: str = "value", t: str = "t") -> DataFrame:
    """keys, pos, value: `points` values for every group (a window of a signal): resampled by a bounded ratio to `rate`, brought to the exact number by
    its spectrum, centred and, unless constant, divided by the population deviation. `source_rate` is a column that is constant in a group.
    A group is the samples of one window, one row of a task."""
    schema = ", ".join([f"`{k}` {dict(df.dtypes)[k]}" for k in keys] + ["pos long, value double"])
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v")))).alias("s"), F.max(source_rate).alias("_rate")).select(*keys, "s.v", "_rate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, own in enumerate(batch.column("_rate").to_pylist()):
                x = batch.column("v")[r].values.to_numpy(zero_copy_only=False)
                z = even_points(x, own, rate, points)
                again = pa.array(np.full(points, r))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(again) for k in keys), pa.array(np.arange(points)), pa.array(z)], names=[*keys, "pos", "value"])

    return rows.mapInArrow(run, schema)


def even_points(x: np.ndarray, source: float | None, target: float, points: int) -> np.ndarray:
    """`points` standardised values of one window."""
    z = resample_fourier(resample_poly(x, *ratio(target, source)) if source and source > 0 else x.astype(float), points)
    spread = z.std()
    return (z - z.mean()) / spread if spread > 1e-12 else z - z.mean()
