"""Ordered operators within one series (a subject's signal): shuffles once by series key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = list[str]


def _by(keys: Keys, *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def relative_time(df: DataFrame, keys: Keys, t: str = "t", pos: str = "pos") -> DataFrame:
    """Adds rel_t, the time since the series' first sample."""
    return df.withColumn("rel_t", F.col(t) - F.first(t).over(_by(keys, pos)))


def fill_gaps(df: DataFrame, keys: Keys, value: str = "value", pos: str = "pos") -> DataFrame:
    """Adds filled: missing, NaN and infinite values interpolated linearly by position, ends take the nearest
    good value; and was_bad. A series without any good value stays null (`unfillable` lists those)."""
    v = F.col(value)
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    df = df.withColumn("_v", F.when(good, v)).withColumn("_p", F.when(good, F.col(pos)))
    back, ahead = _by(keys, pos).rowsBetween(Window.unboundedPreceding, 0), _by(keys, pos).rowsBetween(0, Window.unboundedFollowing)
    last = lambda c: F.last(c, ignorenulls=True).over(back)
    after = lambda c: F.first(c, ignorenulls=True).over(ahead)
    df = df.withColumns({"_v0": last("_v"), "_p0": last("_p"), "_v1": after("_v"), "_p1": after("_p")})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(pos) - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    filled = F.coalesce("_v", line, "_v0", "_v1")
    return df.withColumns({"filled": filled, "was_bad": ~F.coalesce(good, F.lit(False))}).drop("_v", "_p", "_v0", "_p0", "_v1", "_p1")


def unfillable(df: DataFrame, keys: Keys, filled: str = "filled") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(filled).alias("n")).filter("n = 0").drop("n")


def detrend(df: DataFrame, keys: Keys, value: str = "value", pos: str = "pos") -> DataFrame:
    """Adds detrended: the residual of the least-squares line through (pos, value) of the whole series."""
    w = Window.partitionBy(*keys)
    slope = F.covar_pop(pos, value).over(w) / F.nullif(F.var_pop(pos).over(w), F.lit(0.0))
    centre = F.col(pos) - F.avg(pos).over(w)
    return df.withColumn("detrended", F.col(value) - F.avg(value).over(w) - F.coalesce(slope, F.lit(0.0)) * centre)


def gradient(df: DataFrame, keys: Keys, value: str = "value", t: str = "t", pos: str = "pos") -> DataFrame:
    """Adds gradient: second-order derivative over uneven times, one-sided at both ends."""
    w = _by(keys, pos)
    f, fp, fn = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    inner = (hs * hs * fn + (hd * hd - hs * hs) * f - hd * hd * fp) / (hs * hd * (hs + hd))
    return df.withColumn("gradient", F.when(fp.isNull(), (fn - f) / hd).when(fn.isNull(), (f - fp) / hs).otherwise(inner))


def signal_index(df: DataFrame, keys: Keys, t: str = "t", pos: str = "pos", rate: Column | None = None) -> DataFrame:
    """One row per series: samples, start, end, duration, estimated rate (1 / median positive step), the rate
    to use (nominal if positive, else estimated) and the recording's end (last t + median step)."""
    step = F.col(t) - F.lag(t).over(_by(keys, pos))
    out = df.withColumn("_d", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.min(t).alias("start_s"), F.max(t).alias("end_s"),
        F.median(F.when(F.col("_d") > 0, F.col("_d"))).alias("median_step"),
    )
    estimated = F.when(F.col("median_step") > 0, 1 / F.col("median_step"))
    nominal = F.when(rate > 0, rate) if rate is not None else F.lit(None).cast("double")
    return out.withColumns({"duration_s": F.col("end_s") - F.col("start_s"), "estimated_rate": estimated}).withColumns(
        {"rate": F.coalesce(nominal, F.col("estimated_rate")), "recording_end_s": F.col("end_s") + F.coalesce(F.col("median_step"), 1 / F.coalesce(nominal, F.col("estimated_rate")))}
    )


def time_checks(df: DataFrame, keys: Keys, t: str = "t", value: str = "value", pos: str = "pos") -> DataFrame:
    """Per series: steps backwards, repeated times, values that are missing or not finite."""
    d = F.col(t) - F.lag(t).over(_by(keys, pos))
    v = F.col(value)
    return df.withColumn("_d", d).groupBy(*keys).agg(
        F.count_if(F.col("_d") < 0).alias("decreasing"), F.count_if(F.col("_d") == 0).alias("repeated"),
        F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("not_finite"),
    )


def first_rows(df: DataFrame, keys: Keys, *order: Column | str) -> DataFrame:
    """The first row of each group in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def peaks(df: DataFrame, keys: Keys, value: str = "value", pos: str = "pos", half: int = 2) -> DataFrame:
    """Rows at local maxima of the value above its centred moving average (2 * half + 1 samples) that are the
    greatest within `half` positions: our own definition of a pulse peak. Adds smooth."""
    w = _by(keys, pos)
    around = w.rowsBetween(-half, half)
    df = df.withColumns({"smooth": F.avg(value).over(around), "_top": F.max(value).over(around), "_before": F.max(value).over(w.rowsBetween(-half, -1))})
    is_peak = (F.col(value) == F.col("_top")) & (F.col(value) > F.col("smooth")) & (F.coalesce(F.col("_before") < F.col(value), F.lit(True)))
    return df.filter(is_peak).drop("_top", "_before")


def response_peaks(df: DataFrame, keys: Keys, value: str = "value", pos: str = "pos", half: int = 2, trough: int = 3) -> DataFrame:
    """Peaks of the phasic part (value less its moving average), with amplitude = value less the smallest
    of the `trough` values before (null at the first sample)."""
    w = _by(keys, pos)
    df = df.withColumn("phasic", F.col(value) - F.avg(value).over(w.rowsBetween(-half, half))).withColumn("_low", F.min(value).over(w.rowsBetween(-trough, -1)))
    df = df.withColumns({"_p0": F.lag("phasic").over(w), "_p1": F.lead("phasic").over(w)})
    top = (F.col("phasic") > 0) & (F.col("phasic") > F.coalesce("_p0", F.lit(float("-inf")))) & (F.col("phasic") >= F.coalesce("_p1", F.lit(float("-inf"))))
    return df.filter(top).withColumn("amplitude", F.col(value) - F.col("_low")).drop("_low", "_p0", "_p1")


def pulse_variability(peaks_: DataFrame, keys: Keys, t: str = "t", least: int = 4) -> DataFrame:
    """Per group of peaks: mean, sample std, RMSSD and pNN50 (share of successive differences over 50) of the
    intervals in ms; null with fewer than `least` peaks. pNN50 divides by the number of differences."""
    w = _by(keys, t)
    nn = peaks_.withColumn("_nn", (F.col(t) - F.lag(t).over(w)) * 1000.0)
    nn = nn.withColumn("_d", F.col("_nn") - F.lag("_nn").over(w))
    out = nn.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_peaks"), F.avg("_nn").alias("mean_nn"), F.stddev_samp("_nn").alias("sdnn"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"), (100.0 * F.avg((F.abs("_d") > 50).cast("int"))).alias("pnn50"),
    )
    return out.select(*keys, "n_peaks", *[F.when(F.col("n_peaks") >= least, F.col(c)).alias(c) for c in ("mean_nn", "sdnn", "rmssd", "pnn50")])


def resample(df: DataFrame, keys: Keys, points: int, value: str = "value", t: str = "t") -> DataFrame:
    """`points` values per series: means of equal time buckets over [first, last], empty buckets interpolated
    by position; then centred and, unless constant, divided by the population std. Adds k and z."""
    if points < 2:
        raise ValueError("a resampled series needs two points or more")
    w = Window.partitionBy(*keys)
    lo, hi = F.min(t).over(w), F.max(t).over(w)
    k = F.least(F.lit(points - 1), F.floor((F.col(t) - lo) / F.nullif(hi - lo, F.lit(0.0)) * points)).cast("int")
    means = df.withColumn("k", F.coalesce(k, F.lit(0))).groupBy(*keys, "k").agg(F.avg(value).alias("m"))
    grid = means.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    full = fill_gaps(grid.join(means, [*keys, "k"], "left"), keys, "m", "k")
    return zscore(full.drop("m", "was_bad"), keys, "filled")


def zscore(df: DataFrame, keys: Keys, value: str = "value", eps: float = 1e-12) -> DataFrame:
    w = Window.partitionBy(*keys)
    sd, mid = F.stddev_pop(value).over(w), F.avg(value).over(w)
    return df.withColumn("z", F.when(sd > eps, (F.col(value) - mid) / sd).otherwise(F.col(value) - mid))
