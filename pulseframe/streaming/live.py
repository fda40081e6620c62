"""Window statistics over a live stream of samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_statistics(stream: DataFrame, window: str, step: str, delay: str, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Count, mean, population std, min and max per sliding window and keys; rows later than `delay` are
    dropped. Windows are aligned to the epoch. In append mode a window comes out once the greatest time
    seen less `delay` has passed its end. State is one small buffer per open window and key."""
    w = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, window, step), *keys)
    out = w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "mean", "std", "min", "max")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what is there, appends to Parquet at `path`, and reads that."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


#: Values that a window keeps exactly at each level of its sketch.
SKETCH = 512


class Sketch:
    """Quantiles of a stream in bounded memory. Values are kept as they are up to `size`; a full level is sorted and every second value
    goes one level up, where it stands for twice as many. Two sketches merge by their levels."""

    def __init__(self, levels: list[list[float]] | None = None, size: int = SKETCH):
        self.levels, self.size = levels or [[]], size

    def add(self, values) -> None:
        self.levels[0].extend(float(x) for x in values)
        self._settle()

    def merge(self, other: Sketch) -> None:
        for k, level in enumerate(other.levels):
            while len(self.levels) <= k:
                self.levels.append([])
            self.levels[k].extend(level)
        self._settle()

    def _settle(self) -> None:
        k = 0
        while k < len(self.levels):
            level = self.levels[k]
            if len(level) > self.size:
                level.sort()
                odd = [level.pop()] if len(level) % 2 else []  # without a partner
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].extend(level[len(self.levels[k + 1]) % 2 :: 2])
                self.levels[k] = odd
            k += 1

    def quantile(self, q: float) -> float | None:
        """Between the two values next to place q * (n - 1), as an exact quantile where nothing was thinned."""
        pairs = sorted((x, 1 << k) for k, level in enumerate(self.levels) for x in level)
        total = sum(w for _, w in pairs)
        if not total:
            return None
        place = q * (total - 1)
        low, high = math.floor(place), math.ceil(place)
        found, seen = [], 0
        for x, w in pairs:
            for want in (low, high)[len(found) :]:
                if seen <= want < seen + w:
                    found.append(x)
            seen += w
        return found[0] + (found[1] - found[0]) * (place - low)


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean, second and third central sums, least and greatest of two sets of values out of those of each."""
    if not a[0]:
        return b
    if not b[0]:
        return a
    (n, mean, two, three, lo, hi), (m, other, two_b, three_b, lo_b, hi_b) = a, b
    t, d = n + m, other - mean
    second = two + two_b + d * d * n * m / t
    third = three + three_b + d**3 * n * m * (n - m) / t**2 + 3 * d * (n * two_b - m * two) / t
    return t, mean + d * m / t, second, third, min(lo, lo_b), max(hi, hi_b)


def _moments(values) -> tuple:
    n = len(values)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    mean = float(values.mean())
    off = values - mean
    return float(n), mean, float((off**2).sum()), float((off**3).sum()), float(values.min()), float(values.max())


def window_statistics_stream(stream: DataFrame, window_s: int, step_s: int, delay: str, keys: list[str], ts: str = "ts", value: str = "value", least: int = 4, sketch: int = SKETCH) -> DataFrame:
    """keys, window_start, window_end, n, mean, std, min, max, range, median, skewness of every sliding window of a live stream that has `least` samples or more.

    State of a key: for each open window six sums and a quantile sketch of bounded size, so it does not grow with the rate. A window comes out once, when the watermark (greatest
    time less `delay`) has passed its end, by a timer if nothing arrives; samples of windows that are out are dropped. Median is exact up to `sketch` samples. Windows
    are aligned to the epoch; null values do not count.
    """
    import pandas as pd

    kinds = dict(stream.dtypes)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "window_start timestamp, window_end timestamp, n long, mean double, std double, min double, max double, range double, median double, skewness double"])
    state_schema = "starts array<long>, sums array<array<double>>, levels array<array<array<double>>>"
    names = [*keys, "window_start", "window_end", "n", "mean", "std", "min", "max", "range", "median", "skewness"]

    def update(key, frames, state):
        open_: dict[int, tuple[tuple, Sketch]] = {}
        if state.exists:
            starts, sums, levels = state.get
            open_ = {int(s): (tuple(m), Sketch([list(x) for x in v], sketch)) for s, m, v in zip(starts, sums, levels)}
        mark = state.getCurrentWatermarkMs() / 1000
        if not state.hasTimedOut:
            for frame in frames:
                frame = frame.dropna(subset=[value])
                at = frame[ts].astype("int64").to_numpy() / (1e9 if str(frame[ts].dtype).startswith("datetime64[ns") else 1e6)
                last = (at // step_s * step_s).astype("int64")
                for back in range(-(-window_s // step_s)):
                    start = last - back * step_s
                    inside = (at < start + window_s) & (start + window_s > mark)
                    for s in set(start[inside].tolist()):
                        values = frame[value].to_numpy(dtype=float)[inside & (start == s)]
                        sums, kept = open_.get(s, (_moments(values[:0]), Sketch(size=sketch)))
                        kept.add(values)
                        open_[s] = _merged(sums, _moments(values)), kept
        done = sorted(s for s in open_ if s + window_s <= mark)
        rows = []
        for s in done:
            (n, mean, two, three, lo, hi), kept = open_.pop(s)
            if n >= least:
                flat = hi - lo <= 1e-12
                skew = 0.0 if flat or n < 3 else three / n / (two / n) ** 1.5
                rows.append((*key, pd.Timestamp(s, unit="s"), pd.Timestamp(s + window_s, unit="s"), int(n), mean, math.sqrt(two / n), lo, hi, hi - lo, kept.quantile(0.5), skew))
        if open_:
            order = sorted(open_)
            state.update((order, [list(open_[s][0]) for s in order], [open_[s][1].levels for s in order]))
            state.setTimeoutTimestamp(max(int((order[0] + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=names)

    timed = stream.select(*keys, F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value)).withWatermark(ts, delay)
    return timed.groupBy(*keys).applyInPandasWithState(update, out, state_schema, "append", "EventTimeTimeout")
