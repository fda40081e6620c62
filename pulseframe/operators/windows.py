"""Sliding windows by index arithmetic, and the statistics of a window.

A sample's windows are the integers k with k * step <= t < k * step + window, so membership is an
explode of a short sequence, never a range join; one shuffle by (series, window) follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = list[str]
TOLERANCE, EPSILON = 1e-6, 1e-12


def intersection(index: DataFrame, trial: Keys, signals: int | None = None, start: str = "start_s", end: str = "recording_end_s") -> DataFrame:
    """The common interval of a trial's signals: latest start to earliest end; trials whose interval is empty,
    or that lack one of `signals` signals, are left out."""
    out = index.groupBy(*trial).agg(F.max(start).alias("common_start"), F.min(end).alias("common_end"), F.count(F.lit(1)).alias("_n"))
    out = out.filter("common_end > common_start")
    return (out.filter(F.col("_n") == signals) if signals else out).drop("_n").withColumn("common_s", F.col("common_end") - F.col("common_start"))


def window_table(trials: DataFrame, window: float, overlap: float, duration: str = "common_s") -> DataFrame:
    """One row per window that lies within the duration (by TOLERANCE): window_id, window_start_s, window_end_s."""
    step = window - overlap
    last = F.floor((F.col(duration) + TOLERANCE - window) / step)
    ids = F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>")))
    return trials.select("*", ids.alias("window_id")).withColumns({"window_start_s": F.col("window_id") * step, "window_end_s": F.col("window_id") * step + window})


def assign(samples: DataFrame, intervals: DataFrame, trial: Keys, window: float, overlap: float, t: str = "t") -> DataFrame:
    """Adds window_id and rel_t to every sample, once per window [start, end) that holds it. `intervals` has
    one row per trial and is joined by key."""
    step = window - overlap
    joined = samples.join(intervals, trial).withColumn("rel_t", F.col(t) - F.col("common_start")).filter("rel_t >= 0")
    last = F.floor((F.col("common_s") + TOLERANCE - window) / step)
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("rel_t") - window) / step))
    high = F.least(last, F.floor(F.col("rel_t") / step) + 1)
    spread = joined.withColumn("_ks", F.when(high >= low, F.sequence(low, high))).select("*", F.explode("_ks").alias("window_id")).drop("_ks")
    return spread.filter((F.col("rel_t") >= F.col("window_id") * step) & (F.col("rel_t") < F.col("window_id") * step + window))


def quality(assigned: DataFrame, keys: Keys, signals: list[str], signal: str = "signal", least: int = 4) -> DataFrame:
    """Counts per window and signal as columns n_<signal>; windows where one has fewer than `least` are left out."""
    counts = assigned.groupBy(*keys).pivot(signal, signals).agg(F.count(F.lit(1)))
    counts = counts.select(*keys, *[F.coalesce(s, F.lit(0)).alias(f"n_{s}") for s in signals])
    return counts.filter(F.least(*[F.col(f"n_{s}") for s in signals]) >= least) if len(signals) > 1 else counts.filter(F.col(f"n_{signals[0]}") >= least)


def statistics(df: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Population std, min, max, mean, range, median, biased skewness and excess kurtosis per group. Flat and too
    short groups have 0 for the last two (under 3 and under 4 values)."""
    span = F.max(value) - F.min(value)
    flat = span <= EPSILON
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        span.alias("range"), F.median(value).alias("median"),
        F.when((F.count(value) < 3) | flat, 0.0).otherwise(F.skewness(value)).alias("skewness"),
        F.when((F.count(value) < 4) | flat, 0.0).otherwise(F.kurtosis(value)).alias("kurtosis"),
    )


def histogram_entropy(df: DataFrame, keys: Keys, value: str = "value", bins: int = 10) -> DataFrame:
    """Entropy in bits of the histogram of `bins` equal bins over [min, max], the last one closed; 0 for flat
    groups and single values."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))
    rows = df.filter(F.col(value).isNotNull()).join(bounds, keys).withColumn("_bin", F.when(F.col("_hi") - F.col("_lo") > EPSILON, place).otherwise(0))
    parts = rows.groupBy(*keys, "_bin", "_n").agg((F.count(F.lit(1)) / F.col("_n")).alias("_p"))
    return parts.groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("_h")).select(*keys, F.abs("_h").alias("entropy"))


def derivative_statistics(df: DataFrame, keys: Keys, value: str = "value", t: str = "t") -> DataFrame:
    from .series import gradient

    return gradient(df, keys, value, t, t).groupBy(*keys).agg(F.avg("gradient").alias("deriv_mean"), F.stddev_pop("gradient").alias("deriv_std"))


def baseline_normalised(windows: DataFrame, baseline: DataFrame, subject: Keys, mean: str = "mean") -> DataFrame:
    """(window mean - baseline mean) / baseline sample std of the subject; null without a baseline or if it is flat.
    `baseline` has samples with `value`."""
    base = baseline.groupBy(*subject).agg(F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_std"))
    out = windows.join(base, subject, "left")
    return out.withColumn("baseline_norm", F.when(F.col("base_std") > EPSILON, (F.col(mean) - F.col("base_mean")) / F.col("base_std")))


def events_in_windows(windows: DataFrame, found: DataFrame, keys: Keys, amplitude: str = "amplitude") -> DataFrame:
    """scr_count and scr_amplitude (mean of the known amplitudes, 0 if none) of every window; `found` are peaks
    already assigned to windows."""
    per = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(amplitude).alias("_a"))
    return windows.join(per, keys, "left").withColumns({"scr_count": F.coalesce("_n", F.lit(0)), "scr_amplitude": F.coalesce("_a", F.lit(0.0))}).drop("_n", "_a")


def ranked(df: DataFrame, keys: Keys, *order, name: str = "rank", kind: str = "min") -> DataFrame:
    """Rank within group: `min` (gaps), `ordinal` (unique), `average` (ties share the mean of their places). A group is ordered in one
    task; `value_ranks` is for groups of any size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if kind == "ordinal":
        return df.withColumn(name, F.row_number().over(w))
    if kind == "min":
        return df.withColumn(name, F.rank().over(w))
    ties = Window.partitionBy(*keys, *order)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def value_ranks(df: DataFrame, keys: Keys, value: str, parts: int = 64) -> DataFrame:
    """keys, value, rank_min, rank_avg, n of every distinct value of each group, so hot values cost one row. The values of a group are cut at
    approximate quantiles into `parts` ranges; counts are summed within a range and over the ranges before, so no
    task orders a whole group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    at = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)])
    cuts = counts.groupBy(*keys).agg(F.array_distinct(F.approx_percentile(F.col(value).cast("double"), at, F.lit(1000))).alias("_cuts"))
    counts = counts.join(F.broadcast(cuts), keys) if keys else counts.crossJoin(F.broadcast(cuts))
    counts = counts.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value).cast("double")))).drop("_cuts")
    sizes = counts.groupBy(*keys, "_part").agg(F.sum("n").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sizes, [*keys, "_part"])
    first = F.col("_before") + F.col("_in")
    return out.select(*keys, value, "n", (first + 1).alias("rank_min"), (first + (F.col("n") + 1) / 2).alias("rank_avg"))


def holm(df: DataFrame, keys: Keys, p: str = "p") -> DataFrame:
    """Adds p_holm: step-down corrected p within each family, running maximum of min(1, p * (m - rank)); null
    p stay out of the count and null."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*keys, known).orderBy(p, *[c for c in df.columns if c not in (*keys, p)])
    df = df.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * (F.count(F.lit(1)).over(Window.partitionBy(*keys, known)) - F.row_number().over(w) + 1)))
    return df.withColumn("p_holm", F.when(known, F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")
