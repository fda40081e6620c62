"""Feature rows of windows against NumPy on the cleaned signals."""

import numpy as np
from pyspark.sql import functions as F

from pulseframe.operators import feature_rows as fr
from pulseframe.operators import visibility, waves


def test_columns_of_a_window(spark):
    rng = np.random.default_rng(4)
    rates = {"bvp": 32.0, "eda": 4.0, "temp": 4.0}
    rows = []
    for trial in ("x", "y"):
        for signal, rate in rates.items():
            t = np.arange(int(50 * rate)) / rate
            wave = {"bvp": np.exp(-(((t % 0.8) - 0.4) ** 2) / 0.01), "eda": 3 + np.maximum(0, np.sin(t / 2)) ** 3, "temp": 30 + 0.01 * t + 0.05 * rng.normal(size=len(t))}[signal]
            rows += [("p1", trial, signal, i, float(1000.0 + a), float(b)) for i, (a, b) in enumerate(zip(t, wave + 0.001 * rng.normal(size=len(t))))]
    df = spark.createDataFrame(rows, "subject string, trial string, signal string, pos long, t double, value double").repartition(5)
    base = spark.createDataFrame([("p1", float(v)) for v in (29.0, 30.0, 31.0)], "subject string, value double")
    keys = ["subject", "trial"]
    out = fr.feature_rows(df, keys, ["subject"], 20.0, 10.0, rates, 4.0, 80, base)
    assert len(fr.HANDCRAFTED) == 29 and len(fr.GRAPHS) == 96 and out.columns == [*keys, "window_id", "n_bvp", "n_eda", "n_temp", *fr.HANDCRAFTED, *fr.GRAPHS]
    got = {(r.trial, r.window_id): r for r in out.collect()}
    assert set(got) == {(t, w) for t in "xy" for w in range(4)}
    clean = fr.cleaned(df, keys, rates).filter("trial = 'x'").toPandas()
    r = got["x", 1]
    part = {s: c[(c.t >= 1010) & (c.t < 1030)].sort_values("t") for s, c in clean.groupby("signal")}
    temp, eda, bvp = part["temp"], part["eda"], part["bvp"]
    assert (r.n_bvp, r.n_eda, r.n_temp) == (640, 80, 80)
    assert np.isclose(r.hc_skt_std, temp.value.std(ddof=0)) and np.isclose(r.hc_eda_median, eda.value.median()) and np.isclose(r.hc_ppg_mean, bvp.value.mean(), atol=1e-9)
    assert np.isclose(r.hc_skt_deriv_std, np.gradient(temp.value, temp.t).std()) and np.isclose(r.hc_skt_baseline_norm, temp.raw.mean() - 30)
    assert r.hc_eda_scr_count == eda.amplitude.notna().sum() > 0 and np.isclose(r.hc_eda_scr_amplitude, eda.amplitude.mean())
    nn = np.diff(bvp.t[bvp.is_beat]) * 1000
    assert len(nn) >= 20 and np.isclose(r.hc_ppg_meanNN, nn.mean()) and abs(r.hc_ppg_meanNN - 800) < 10 and np.isclose(r.hc_ppg_rmssd, np.sqrt((np.diff(nn) ** 2).mean()))
    for signal, rate in rates.items():
        z = waves.even_points(part[signal].value.to_numpy(), rate, 4.0, 80)
        for family, kind in (("nvg", "natural"), ("hvg", "horizontal")):
            want = visibility.graph_numbers(visibility.edge_matrix(z, np.arange(80.0), kind))
            assert np.allclose([r[f"{family}_{signal}_{m}"] for m in visibility.METRICS], want)


def test_no_baseline_and_no_windows(spark):
    rows = [("a", s, i, float(i), float(i % 3)) for s in fr.SIGNALS for i in range(12)]
    df = spark.createDataFrame(rows, "trial string, signal string, pos long, t double, value double")
    rates = dict.fromkeys(fr.SIGNALS, 1.0)
    (r,) = fr.feature_rows(df, ["trial"], ["trial"], 12.0, 0.0, rates, 1.0, 12).collect()
    assert r.hc_skt_baseline_norm is None and r.hc_ppg_meanNN is None and r.nvg_bvp_edges > 0
    assert fr.feature_rows(df, ["trial"], ["trial"], 60.0, 0.0, rates, 1.0, 12).count() == 0
    assert fr.feature_rows(df.filter(F.col("signal") != "eda"), ["trial"], ["trial"], 12.0, 0.0, rates, 1.0, 12).count() == 0
