"""The stateful stream against the same windows in batch, and its sketch."""

import random

import numpy as np
from pyspark.sql import functions as F

from pulseframe.operators import windows
from pulseframe.streaming import live


def test_sketch_is_exact_while_small_and_close_when_large():
    rng = random.Random(1)
    for n in (1, 2, 5, 64, 65, 300, 5000):
        values = [rng.gauss(0, 1) for _ in range(n)]
        whole, a, b = live.Sketch(size=64), live.Sketch(size=64), live.Sketch(size=64)
        whole.add(values)
        a.add(values[: n // 3])
        b.add(values[n // 3 :])
        a.merge(b)
        for s in (whole, a):
            assert sum(len(level) for level in s.levels) <= 65 * len(s.levels)
            got = s.quantile(0.5)
            if n <= 64:
                assert np.isclose(got, np.median(values))
            else:
                assert abs(sum(x <= got for x in values) / n - 0.5) < 0.08
    assert live.Sketch().quantile(0.5) is None


def test_moments_merge():
    rng = np.random.default_rng(0)
    parts = [rng.normal(size=k) for k in (0, 1, 7, 30)]
    total = live._moments(parts[0])
    for p in parts[1:]:
        total = live._merged(total, live._moments(p))
    assert np.allclose(total, live._moments(np.concatenate(parts)))


def test_stream_equals_batch(spark, tmp_path):
    """Files come one by one; median and skewness of each window as windows.statistics has them, windows under four samples left out."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value")
    for k, part in enumerate(np.array_split(events.orderBy("ts").toPandas(), 4)):  # in order of time, so nothing is late
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(f"{tmp_path}/events/{k}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    day = 86400
    out = live.window_statistics_stream(stream, 14 * day, 7 * day, "1 day", ["user_id"])
    got = {(r.user_id, r.window_start.timestamp()): r for r in live.run_available(out, f"{tmp_path}/out", f"{tmp_path}/cp").collect()}
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    starts = events.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("window_start", (F.floor(t / (7 * day)) - F.col("s")) * 7 * day)
    last = events.select(F.max(t)).first()[0] - day
    want = windows.statistics(starts, ["user_id", "window_start"]).filter((F.col("n") >= 4) & (F.col("window_start") + 14 * day < last)).collect()
    assert len(want) > 5
    assert {(r.user_id, float(r.window_start)) for r in want} == set(got)
    for r in want:
        g = got[r.user_id, float(r.window_start)]
        assert g.n == r.n and np.allclose([g.mean, g.std, g.min, g.max, g.range, g.median, g.skewness], [r["mean"], r["std"], r["min"], r["max"], r["range"], r["median"], r["skewness"]])
        assert (g.window_end - g.window_start).days == 14
