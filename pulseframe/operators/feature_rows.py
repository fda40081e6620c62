"""One row per window of a trial: 29 hand-crafted columns of three signals and 96 columns of their visibility graphs.

Each signal is cleaned over its whole recording first (blocks with halos, see `waves`), then samples are dealt to their windows once and every
column comes from groups of (trial, window, signal): statistics, events inside the window, and the graphs of its evenly resampled points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series, visibility, waves, windows
from .nested import settled

Keys = list[str]

#: The statistics of each signal's columns. Names are hc_<sensor>_<statistic> and <family>_<signal>_<metric>.
STATISTICS = {
    "temp": ("skt", ["std", "max", "median", "range", "entropy", "kurtosis", "skewness"]),
    "eda": ("eda", ["max", "median", "range", "entropy", "kurtosis", "skewness"]),
    "bvp": ("ppg", ["mean", "std", "min", "max", "range", "kurtosis", "skewness"]),
}
SIGNALS = ["bvp", "eda", "temp"]
HANDCRAFTED = [f"hc_{short}_{c}" for short, columns in STATISTICS.values() for c in columns] + [
    "hc_eda_scr_count", "hc_eda_scr_amplitude", "hc_skt_deriv_mean", "hc_skt_deriv_std", "hc_skt_baseline_norm", "hc_ppg_meanNN", "hc_ppg_sdnn", "hc_ppg_rmssd", "hc_ppg_pnn50",
]
GRAPHS = [f"{family}_{signal}_{m}" for family in ("nvg", "hvg") for signal in SIGNALS for m in visibility.METRICS]


def cleaned(samples: DataFrame, trial: Keys, rates: dict[str, float]) -> DataFrame:
    """trial, signal, pos, t, raw, value (cleaned), is_beat, amplitude of all three signals: band-passed pulse with beats, low-passed
    conductance with the amplitudes of its responses, temperature without its trend. Positions count from 0, gaps are filled."""
    keys = [*trial, "signal"]
    empty = F.lit(None).cast("double")
    columns = [*keys, "pos", "t", "raw", "value", "is_beat", "amplitude"]
    part = lambda name: samples.filter(F.col("signal") == name)
    pulse = waves.pulse_wave(part("bvp"), keys, rates["bvp"]).select(*keys, "pos", "t", F.col("value").alias("raw"), F.col("clean").alias("value"), "is_beat", empty.alias("amplitude"))
    skin = waves.skin_wave(part("eda"), keys, rates["eda"])
    good = waves.skin_responses(skin, keys).select(*keys, "pos", F.col("amplitude").alias("_a"))
    skin = skin.drop("amplitude").join(good, [*keys, "pos"], "left").select(*keys, "pos", "t", F.col("clean").alias("raw"), F.col("clean").alias("value"), F.lit(False).alias("is_beat"), F.col("_a").alias("amplitude"))
    temp = series.detrend(part("temp"), keys).select(*keys, F.col("pos").cast("long").alias("pos"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("raw"), F.col("detrended").alias("value"), F.lit(False).alias("is_beat"), empty.alias("amplitude"))
    return reduce(DataFrame.unionByName, [p.select(columns) for p in (pulse, skin, temp)])


def feature_rows(samples: DataFrame, trial: Keys, subject: Keys, window: float, overlap: float, rates: dict[str, float], graph_rate: float, points: int, baseline: DataFrame | None = None, least: int = 4) -> DataFrame:
    """trial, window_id, n_<signal>, HANDCRAFTED and GRAPHS of every window in which each signal has `least` samples or more.

    samples: trial, signal (bvp, eda, temp), pos, t, value, filled. Windows lie in the interval that the three signals share. `rates` are samples a second;
    graphs have `points` points, resampled at `graph_rate` first. `baseline` (subject, value) has the temperatures before the trials; without them, or if they are flat, the
    normalised temperature is null. Pulse variability is null with fewer than four beats in a window.
    """
    keys = [*trial, "window_id"]
    by = [*keys, "signal"]
    intervals = windows.intersection(series.signal_index(samples, [*trial, "signal"]), trial, len(SIGNALS))
    dealt = windows.assign(cleaned(samples, trial, rates), intervals.select(*trial, "common_start", "common_s"), trial, window, overlap)
    good = windows.quality(dealt, keys, SIGNALS, least=least)
    dealt = settled(dealt.join(good.select(*keys), keys))  # eight groupings read it; signals are cleaned once
    good = windows.quality(dealt, keys, SIGNALS, least=least)
    stats = windows.statistics(dealt, by).join(windows.histogram_entropy(dealt, by), by)
    named = stats.groupBy(*keys).agg(*[F.max(F.when(F.col("signal") == s, F.col(c))).alias(f"hc_{short}_{c}") for s, (short, columns) in STATISTICS.items() for c in columns])
    temp = dealt.filter("signal = 'temp'")
    slopes = windows.derivative_statistics(temp, keys).select(*keys, F.col("deriv_mean").alias("hc_skt_deriv_mean"), F.col("deriv_std").alias("hc_skt_deriv_std"))
    responses = dealt.filter("signal = 'eda'").groupBy(*keys).agg(F.count("amplitude").cast("double").alias("hc_eda_scr_count"), F.coalesce(F.avg("amplitude"), F.lit(0.0)).alias("hc_eda_scr_amplitude"))
    beats = series.pulse_variability(dealt.filter("is_beat"), keys).select(*keys, F.col("mean_nn").alias("hc_ppg_meanNN"), F.col("sdnn").alias("hc_ppg_sdnn"), F.col("rmssd").alias("hc_ppg_rmssd"), F.col("pnn50").alias("hc_ppg_pnn50"))
    level = temp.groupBy(*keys).agg(F.avg("raw").alias("mean"))
    if baseline is not None:
        level = windows.baseline_normalised(level, baseline, subject).select(*keys, F.col("baseline_norm").alias("hc_skt_baseline_norm"))
    else:
        level = level.select(*keys, F.lit(None).cast("double").alias("hc_skt_baseline_norm"))
    rate = reduce(lambda c, s: c.when(F.col("signal") == s, F.lit(float(rates[s]))), SIGNALS, F)
    grid = waves.graph_points(dealt.withColumn("_source", rate), by, points, graph_rate, "_source")
    graphs = visibility.graph_features(grid, by).withColumn("name", F.concat_ws("_", "family", "signal"))
    graphs = visibility.widen(graphs, keys, visibility.METRICS, [f"{f}_{s}" for f in ("nvg", "hvg") for s in SIGNALS])
    out = reduce(lambda a, b: a.join(b, keys, "left"), [named, slopes, responses, beats, level, graphs], good)
    return out.select(*keys, *[f"n_{s}" for s in SIGNALS], *HANDCRAFTED, *GRAPHS)
