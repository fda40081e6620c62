"""Rank correlations of all draws at once against ranks of rows that are really repeated, by all ways and in small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import resampling


@pytest.mark.parametrize("ranks, block", [(8 << 20, 4 << 20), (8 << 20, 40), (200, 40), (0, 40)])
def test_ranks_by_columns_of_draws(spark, monkeypatch, ranks, block):
    monkeypatch.setattr(resampling, "RANKS_MOST", ranks)
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i % 2, f"s{i % 5}", float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 6, (90, 2)))] + [(1, f"s{i % 3}", float(i), 2.0) for i in range(25)] + [(0, "s1", None, 1.0)]
    df = spark.createDataFrame(rows, "k int, subject string, y_true double, y_pred double").repartition(5)
    draws = resampling.subject_draws(df, "subject", 40)
    repeated = df.dropna().join(draws, "subject").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).toPandas()
    want = {key: g["y_true"].rank().corr(g["y_pred"].rank()) for key, g in repeated.groupby(["k", "rep"])}
    got = {(r.k, r.rep): r.spearman_rho for r in resampling._rank_correlations(df, ["k"], "subject", draws, 40).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[key], want[key]) for key in want)

