"""Operators on small hand-made frames: NumPy expectations, properties, error paths, files and the stream."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import scalars as fn
from pulseframe.operators import align, evaluate, models, prepare, reports, resampling, series, trials, validate, visibility, windows
from pulseframe.sources import recordings
from pulseframe.streaming import live


def one_series(spark, values, times=None):
    times = times or [float(i) for i in range(len(values))]
    return spark.createDataFrame([("a", i, t, v) for i, (t, v) in enumerate(zip(times, values))], "s string, pos long, t double, value double")


def test_fill_gaps(spark):
    nan, inf = float("nan"), float("inf")
    got = [r.filled for r in series.fill_gaps(one_series(spark, [nan, 1.0, None, 4.0, inf, nan]), ["s"]).orderBy("pos").collect()]
    assert got == [1.0, 1.0, 2.5, 4.0, 4.0, 4.0]
    assert series.unfillable(series.fill_gaps(one_series(spark, [nan, None]), ["s"]), ["s"]).count() == 1


def test_gradient_equals_numpy(spark):
    rng = np.random.default_rng(0)
    t, v = np.cumsum(rng.random(30) + 0.1), rng.random(30)
    got = [r.gradient for r in series.gradient(one_series(spark, v.tolist(), t.tolist()), ["s"]).orderBy("pos").collect()]
    assert np.allclose(got, np.gradient(v, t))


def test_detrend_and_zscore(spark):
    v = (3 * np.arange(20) + np.sin(np.arange(20))).tolist()
    got = np.array([r.detrended for r in series.detrend(one_series(spark, v), ["s"]).orderBy("pos").collect()])
    fit = np.polyfit(np.arange(20), v, 1)
    assert np.allclose(got, np.array(v) - np.polyval(fit, np.arange(20)))
    flat = [r.z for r in series.zscore(one_series(spark, [2.0] * 4), ["s"]).collect()]
    assert flat == [0.0] * 4


@pytest.mark.parametrize("kind", ["natural", "horizontal"])
def test_visibility_equals_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    y = np.round(rng.random(25), 1)
    want = set()
    for i, j in itertools.combinations(range(25), 2):
        between = range(i + 1, j)
        if kind == "natural":
            ok = all(y[k] < y[i] + (y[j] - y[i]) * (k - i) / (j - i) - 1e-12 for k in between)
        else:
            ok = all(y[k] < min(y[i], y[j]) for k in between)
        if ok:
            want.add((i, j))
    got = {(r.i, r.j) for r in visibility.visibility_edges(one_series(spark, y.tolist()), ["s"], kind).collect()}
    assert {(i, i + 1) for i in range(24)} <= got
    assert len(got ^ want) <= (2 if kind == "natural" else 0)  # ties of slopes differ by rounding


def test_horizontal_is_part_of_natural(spark):
    s = one_series(spark, np.random.default_rng(2).random(40).tolist())
    n, h = ({(r.i, r.j) for r in visibility.visibility_edges(s, ["s"], k).collect()} for k in ("natural", "horizontal"))
    assert h <= n


def plain_paths(a):
    """Distances and betweenness of a 0/1 matrix by one breadth-first search per node."""
    from collections import deque

    n = len(a)
    distance, between = np.full((n, n), -1), np.zeros(n)
    for s in range(n):
        ways, order, parents = np.zeros(n), [], [[] for _ in range(n)]
        distance[s, s], ways[s] = 0, 1
        todo = deque([s])
        while todo:
            x = todo.popleft()
            order.append(x)
            for w in np.flatnonzero(a[x]):
                if distance[s, w] < 0:
                    distance[s, w] = distance[s, x] + 1
                    todo.append(w)
                if distance[s, w] == distance[s, x] + 1:
                    ways[w] += ways[x]
                    parents[w].append(x)
        share = np.zeros(n)
        for w in reversed(order):
            for x in parents[w]:
                share[x] += ways[x] / ways[w] * (1 + share[w])
            if w != s:
                between[w] += share[w]
    return distance, between / 2


@pytest.mark.parametrize("kind", ["natural", "horizontal"])
def test_graph_numbers_equal_plain_ones(spark, kind):
    rng = np.random.default_rng(12)
    for n in (1, 2, 3, 40):
        y = np.round(rng.random(n), 1 if n == 40 else 3)
        a = visibility.edge_matrix(y, np.arange(n, dtype=float), kind)
        d, b = plain_paths(a)
        got = visibility.path_numbers(a)
        if n > 1:
            b = b / ((n - 1) * (n - 2) / 2) if n > 2 else b
            close = (n - 1) / d.sum(axis=1)
            assert np.allclose(got, [d.sum() / (n * (n - 1)), d.max(), close.mean(), close.std(), b.mean(), b.std()])


def test_graph_features_equal_the_edge_tables(spark):
    points = spark.createDataFrame([(s, k, float(x)) for s in range(3) for k, x in enumerate(np.random.default_rng(s).random(30))], "s long, pos long, value double")
    long = {(r.s, r.family): r for r in visibility.graph_features(points, ["s"]).collect()}
    for kind, family in (("natural", "nvg"), ("horizontal", "hvg")):
        e = visibility.visibility_edges(points, ["s"], kind)
        for table in (visibility.degree_metrics(e, ["s"]), visibility.clustering_metrics(e, ["s"]), visibility.path_metrics(e, ["s"])):
            for r in table.collect():
                assert all(math.isclose(r[c], long[r.s, family][c], rel_tol=1e-9, abs_tol=1e-9) for c in table.columns if c != "s")


def test_clustering_of_a_triangle_with_a_tail(spark):
    e = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 1, 2), ("a", 2, 3)], "s string, i long, j long")
    m = visibility.clustering_metrics(e, ["s"]).first()
    assert math.isclose(m.clustering_mean, (1 + 1 + 1 / 3 + 0) / 4) and math.isclose(m.transitivity, 3 / 5)
    p = visibility.path_metrics(e, ["s"]).first()
    assert p.diameter == 2 and math.isclose(p.avg_path_length, 8 / 6)


def test_windows_follow_the_count_formula(spark):
    for duration, window, overlap in ((100.0, 30.0, 15.0), (29.0, 30.0, 0.0), (60.0, 30.0, 0.0), (90.0, 30.0, 7.5)):
        t = spark.createDataFrame([("a", duration)], "s string, common_s double")
        n = windows.window_table(t, window, overlap).count()
        want = sum(1 for k in range(1000) if k * (window - overlap) + window <= duration + 1e-6)
        assert n == want
    iv = spark.createDataFrame([("a", 0.0, 100.0, 100.0)], "s string, common_start double, common_end double, common_s double")
    got = windows.assign(one_series(spark, [0.0] * 101), iv, ["s"], 30.0, 15.0).groupBy("window_id").count().orderBy("window_id").collect()
    assert [tuple(r) for r in got] == [(k, 30) for k in range(5)]


def test_flat_and_short_windows(spark):
    r = windows.statistics(one_series(spark, [1.0, 1.0, 1.0, 1.0]), ["s"]).first()
    assert (r.skewness, r["kurtosis"], r.std) == (0.0, 0.0, 0.0)
    assert windows.histogram_entropy(one_series(spark, [5.0]), ["s"]).first().entropy == 0.0
    assert math.isclose(windows.histogram_entropy(one_series(spark, [0.0, 1.0]), ["s"]).first().entropy, 1.0)


def test_holm_is_never_below_p(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.5])], "f string, i int, p double")
    rows = {r.i: r.p_holm for r in windows.holm(df, ["f"]).collect()}
    assert rows[3] is None and [round(rows[i], 9) for i in (0, 2, 1, 4)] == [0.04, 0.09, 0.09, 0.5]


def test_times_and_tokens(spark):
    df = spark.createDataFrame([("2020-01-01T10:00:00:015625",), ("2020-01-01T10:00:00.5",), ("2020-01-01T10:00:00",), ("bad",), (None,)], "x string")
    got = [r[0] for r in df.select(fn.epoch_seconds(fn.parse_time(F.col("x")))).collect()]
    base = 1577872800.0
    assert got == [base + 0.015625, base + 0.5, base, None, None]
    tok = spark.createDataFrame([("a b//c",), ("..",), ("_x_",)], "x string").select(fn.safe_token(F.col("x"))).collect()
    assert [r[0] for r in tok] == ["a_b_c", "run", "x"]
    assert fn.setting_slug(30, 7.5) == "w30_o7p5"
    with pytest.raises(ValueError):
        fn.setting_slug(30, 30)


def test_refusals(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    for call in (lambda: validate.required_columns(df, ["c"]), lambda: validate.required_columns(df.limit(0), ["a"]), lambda: validate.family_columns(df, {"hc": "hc_"}), lambda: validate.select_named(df, "b", "x", "X"), lambda: prepare.node_slots(["hc_foo_mean"])):
        with pytest.raises(ValueError):
            call()


def test_auc_is_invariant_and_bounds_hold(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 200), rng.random(200))]
    df = spark.createDataFrame(rows, "y_true int, score double")
    a = evaluate.roc_auc(df, []).first()[0]
    b = evaluate.roc_auc(df.withColumn("score", F.exp(F.col("score") * 5)), []).first()[0]
    pairs = [(x[1] > y[1]) + 0.5 * (x[1] == y[1]) for x in rows if x[0] for y in rows if not y[0]]
    assert math.isclose(a, b) and math.isclose(a, np.mean(pairs))


def test_confusion_has_all_labels_and_mcc(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y_true int, y_pred int")
    m = evaluate.confusion(df, [], [0, 1, 2])
    assert m.count() == 9
    s = evaluate.summary_metrics(evaluate.class_metrics(evaluate.confusion(df, [], [0, 1]), []), []).first()
    assert math.isclose(s.accuracy, 0.75) and math.isclose(s.mcc, 1 / math.sqrt(3), rel_tol=1e-9)
    t = evaluate.summary_metrics(evaluate.class_metrics(m, []), []).first()
    assert t.balanced_accuracy is None


def test_bootstrap_bounds(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"s{i % 9}", int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 2, (300, 2)))], "subject string, y_true int, y_pred int")
    r = resampling.bootstrap_accuracy(df, [], "subject", 100).first()
    acc = df.filter("y_true = y_pred").count() / 300
    assert r.accuracy_low <= acc <= r.accuracy_high and r.valid == 100


def test_folds_keep_subjects_whole_and_classes_complete(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(f"s{int(i)}", int(rng.integers(0, 3))) for i in rng.integers(0, 12, 400)], "subject string, y int")
    f = prepare.greedy_folds(spark, df, "subject", 4, "y")
    assert f.count() == f.select("subject").distinct().count() == 12
    per = df.join(f, "subject").groupBy("fold").agg(F.count_distinct("y").alias("n")).collect()
    assert len(per) == 4 and all(r.n == 3 for r in per)
    h = prepare.hashed_folds(df, "subject", 5).groupBy("fold").count().collect()
    assert max(r["count"] for r in h) - min(r["count"] for r in h) <= 1


def test_blocked_neighbours_equal_broadcast_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.random(5).tolist(), float(i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double")
    a, b = (sorted(map(tuple, models.nearest(df.filter("id >= 20"), df.filter("id < 20"), 4, train_most=m).select("test_id", "rank", "train_id").collect())) for m in (1000, 13))
    assert a == b


@pytest.mark.parametrize("name, classes", [("rf", 2), ("svm", 3), ("boost", 0), ("mlp", 2), ("knn", 2)])
def test_models_fit_and_score(spark, name, classes):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(z), float((x > 0.5) if classes == 2 else int(x * 3) if classes else x)) for i, (x, z) in enumerate(rng.random((120, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    out = models.fit_predict(df.filter("id >= 30"), df.filter("id < 30"), ["a", "b"], name, classes, trees=5, rounds=5, max_depth=4, hidden=(4,))
    got = out.select("y", "y_pred").toPandas()
    assert len(got) == 30
    assert (got["y"] == got["y_pred"]).mean() > 0.5 if classes else (got["y"] - got["y_pred"]).abs().mean() < 0.2


def test_shapley_values_add_up(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(6)], "id long, a double, b double")
    df = df.withColumn("fold", F.lit("f"))
    back = spark.createDataFrame([("f", 0, 0.0, 0.0)], "fold string, _b int, _b_a double, _b_b double")
    v = reports.shapley_values(df, "id", ["a", "b"], back, lambda x: x.withColumn("y_pred", 2 * F.col("a") + 3 * F.col("b")), 4, fold="fold")
    got = {(r.id, r.feature): r.value for r in v.collect()}
    assert all(math.isclose(got[i, "a"], 2 * i, abs_tol=1e-9) and math.isclose(got[i, "b"], 3 * i * i, abs_tol=1e-9) for i in range(6))


def test_paired_tests_of_equal_candidates(spark):
    rows = [(c, f"s{i % 6}", i, i % 2, (i + (c == 1 and i % 5 == 0)) % 2) for c in (0, 1) for i in range(60)]
    p = spark.createDataFrame(rows, "candidate_order int, subject string, trial long, y_true int, y_pred int")
    c = spark.createDataFrame([(0, "a", "w", "r", "rf"), (1, "a", "w", "r", "svm")], "candidate_order int, input_id string, mode string, representation string, model string")
    out = resampling.paired_tests(p, c, "subject", ["trial"], 2, 100).collect()
    assert {r.metric for r in out} == {"primary", "accuracy"} and all(0 < r.p <= 1 and r.p_holm >= r.p and r.status == "ok" for r in out)
    short = p.filter("not (candidate_order = 1 and trial = 3)")
    bad = resampling.paired_tests(short, c, "subject", ["trial"], 2, 20).collect()
    assert {(r.status, r.p) for r in bad} == {("incompatible_sample_sets", None)}


def test_grid_and_candidates(spark):
    g = align.parameter_grid(spark, {"b": [1, 2], "a": ["x"]}).orderBy("parameter_index").collect()
    assert [tuple(r) for r in g] == [(0, "x", "1"), (1, "x", "2")]
    assert len(models.grid("boost")) == 8
    fam = resampling.comparison_families(spark.createDataFrame([(i, "a", "w", "r", m) for i, m in enumerate("xyz")], "candidate_order int, input_id string, mode string, representation string, model string"))
    assert resampling.test_count(fam, 2).first().tests == 6


def test_recordings_questionnaires_and_stores(spark, tmp_path):
    folder = tmp_path / "in" / "22"
    folder.mkdir(parents=True)
    (folder / "22_BASELINE_STIMULUS_EMPATICA.json").write_text(json.dumps({"BVP": [["2020-01-01T10:00:00:000000", 1.5], ["2020-01-01T10:00:00:500000", "NaN"]], "ACC": [["2020-01-01T10:00:00", 1, 2, 63]], "IBI": []}))
    s = recordings.read_recordings(spark, f"file://{tmp_path}/in")
    rows = {(r.signal, r.pos): (r.t, r["values"]) for r in s.collect()}
    assert rows == {("BVP", 0): (1577872800.0, [1.5]), ("BVP", 1): (1577872800.5, [None]), ("ACC", 0): (1577872800.0, [1.0, 2.0, 63.0])}
    (folder / "22_FEAR_STIMULUS_EMPATICA.json").write_text("[1, 2]")
    with pytest.raises(Exception, match="no object of signals"):
        recordings.read_recordings(spark, f"file://{tmp_path}/in").collect()
    assert recordings.read_recordings(spark, f"file://{tmp_path}/in", strict=False).count() == 3
    (folder / "22_FEAR_STIMULUS_EMPATICA.json").unlink()
    q = {"metadata": {"id": 22, "movie_order": ["BASELINE", "FEAR"]}, "questionnaires": [{"movie": "FEAR", "sam": {"VALENCE": 5, "AROUSAL": 0, "MOTIVATION": 5}}, {"movie": "BASELINE", "sam": {"VALENCE": 5}}]}
    out = recordings.questionnaire_rows(spark.createDataFrame([(json.dumps(q),)], "text string"), "text", [])
    assert {(r.condition, r.movie_order_index, r.problem) for r in out.collect()} == {("FEAR", 2, "out_of_range"), ("BASELINE", 1, "missing_sam")}
    flat = s.select(F.col("subject"), "signal", "pos", "t", F.col("values")[0].alias("value"))
    rel, index = series.relative_time(flat, ["subject", "signal"]), series.signal_index(flat, ["subject", "signal"])
    t = spark.createDataFrame([(22, 5)], "subject int, rating int")
    assert validate.store_violations(rel, index, t, ["subject", "signal"], ["subject"]).count() == 0
    recordings.write_store(flat, t, index, f"file://{tmp_path}/store")
    assert spark.read.parquet(f"file://{tmp_path}/store/samples").count() == 3
    files = recordings.file_digests(spark, f"file://{tmp_path}/in")
    assert files.count() == 1 and trials.tree_digest(files).first().files == 1


def test_feature_files_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("s", 1.5, None), ("t", 2.0, 3.0)], "subject string, hc_a double, hc_b double")
    recordings.write_features_csv(df.coalesce(1), f"file://{tmp_path}/f", ["subject"])
    back = recordings.read_features(spark, [f"file://{tmp_path}/f"] * 2, ["subject"])
    assert sorted(map(tuple, back.collect())) == [("s", 1.5, None), ("t", 2.0, 3.0)]
    (tmp_path / "m.json").write_text(json.dumps({"output": {"row_count": 2, "column_count": 4}}))
    with pytest.raises(validate.InvalidTable):
        recordings.check_manifest(spark, back, f"file://{tmp_path}/m.json")
    for run in ("one", "two", "one"):
        recordings.write_results({"oof": df.withColumn("target", F.lit("v"))}, f"file://{tmp_path}/r", run)
        recordings.write_eligibility(df, df.limit(1), f"file://{tmp_path}/r", run)
    assert spark.read.parquet(f"file://{tmp_path}/r/oof").count() == 4 and spark.read.parquet(f"file://{tmp_path}/r/input_eligibility").count() == 2
    files = recordings.file_digests(spark, f"file://{tmp_path}/m.json")
    for status in ("running", "complete"):
        recordings.write_manifest(df, f"file://{tmp_path}/run", "subject", ["subject"], status, {"b": 1, "a": [2]}, files, contract="v1")
    said = spark.read.json(f"file://{tmp_path}/run").collect()
    assert len(said) == 1 and said[0].rows == 2 and said[0].status == "complete" and said[0].configuration == '{"a":[2],"b":1}' and len(said[0].inputs[0].sha) == 64
    bad = tmp_path / "bad.csv"
    bad.write_text("subject,hc_a\ns,abc\n")
    with pytest.raises(validate.InvalidTable):
        recordings.read_features(spark, [f"file://{bad}"], ["subject"])


def test_stream_gives_the_batch_windows(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    out = live.live_statistics(stream, "14 days", "7 days", "1 day", ["user_id", "event_type"])
    got = live.run_available(out, f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = live.live_statistics(events, "14 days", "7 days", "1 day", ["user_id", "event_type"])
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    want = batch.filter(F.col("window_end") <= F.lit(last) - F.expr("interval 1 day"))
    key = lambda df: sorted((str(r.window_start), r.user_id, r.event_type, r.n, round(r.mean, 6), round(r.std, 6)) for r in df.collect())
    assert got.count() > 0 and key(got) == key(want)


def test_plans_prune_and_push_down(spark):
    from pulseframe.plans import views

    plan = views.samples(spark, "/root/testdata/sf0.001").filter("signal = 'view'")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan


def test_entry_without_text_operators():
    """The driver may delete the text folders; nothing else may need them."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, '.'); import pulseframe.catalog as c; print(len(c.QUERIES)); print(any('llm' in m for m in sys.modules))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
    assert out.stdout.split()[1] == "False", out.stderr


def test_rbf_machine_separates_a_ring(spark):
    """A linear machine cannot tell the inside of a ring from the outside."""
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(z), float(x * x + z * z > 1.1)) for i, (x, z) in enumerate(rng.normal(0, 1, (500, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    out = models.fit_predict(df.filter("id >= 150"), df.filter("id < 150"), ["a", "b"], "svm", 2, cost=10.0, gamma="scale").select("y", "y_pred").toPandas()
    assert (out["y"] == out["y_pred"]).mean() > 0.9
    assert models.gamma_of("auto", 4) == 0.25 and models.gamma_of("scale", 4, 2.0) == 0.125 and models.gamma_of(0.3, 4) == 0.3


def test_oversampling_evens_classes(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("double").alias("y"))
    n = {r.y: r["count"] for r in models.oversample(df, "y", "id").groupBy("y").count().collect()}
    assert n[0.0] == 900 and n[1.0] == 900
    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).cast("double").alias("y"))
    n = {r.y: r["count"] for r in models.oversample(df, "y", "id").groupBy("y").count().collect()}
    assert n[0.0] == 857 and abs(n[1.0] - 857) < 40


def test_nested_rbf_equals_plain_loops(spark):
    """Every fold and parameter set fitted on its own rows, with two windows for some trials."""
    from pulseframe.operators import kernels

    rng = np.random.default_rng(5)
    rows = []
    for t in range(90):
        x = rng.normal(0, 1, 2)
        y = int(x[0] * x[1] > 0)
        for w in range(1 + t % 2):
            rows.append((f"s{t % 6}", t, w, float(x[0] + rng.normal(0, 0.1)), float(x[1]), y))
    df = spark.createDataFrame(rows, "subject string, trial long, window_id long, a double, b double, y int")
    plan = prepare.split_plan(df, "subject", 2)
    params = [{"cost": 1.0, "gamma": 0.5}, {"cost": 50.0, "gamma": 0.5}, {"cost": 1.0, "gamma": 2.0}]
    found, scores = kernels.nested_rbf(kernels.trial_vectors(df, ["subject", "trial"], ["a", "b"], "y"), plan, params, 2, size=16, seed=4)
    fourier = kernels.Map(2, 16, 4)

    def fit(train, test, p):
        x = np.array([r[3:5] for r in train])
        mean, std = x.mean(0), x.std(0)
        y = np.array([r[5] for r in train])
        w = np.array([len(y) / (2 * (y == c).sum()) for c in (0, 1)])[y][:, None]
        z = fourier((x - mean) / std, p["gamma"])
        beta = np.linalg.solve((z * w).T @ z + np.diag([1 / p["cost"]] * 16 + [1e-9]), (z * w).T @ (2.0 * y - 1))
        out = {}
        for r in test:
            out.setdefault((r[0], r[1], r[5]), []).append(float(fourier((np.array([r[3:5]]) - mean) / std, p["gamma"])[0] @ beta))
        return {k: int(np.mean(v) >= 0) for k, v in out.items()}

    inner = {(r.outer_fold, r.subject): r.inner_fold for r in plan.collect()}
    outers = {r.outer_fold: r.test_subject for r in plan.select("outer_fold", "test_subject").distinct().collect()}
    want, utilities = {}, {}
    for o, held in outers.items():
        train = [r for r in rows if r[0] != held]
        for i, p in enumerate(params):
            pooled = {}
            for f in range(2):
                pooled |= fit([r for r in train if inner[o, r[0]] != f], [r for r in train if inner[o, r[0]] == f], p)
            recall: dict = {}
            for (s, _, y), got in pooled.items():
                recall.setdefault((y, s), []).append(got == y)
            utilities[o, i] = np.mean([np.mean([np.mean(v) for (y, _), v in recall.items() if y == c]) for c in (0, 1)])
        best = max(range(3), key=lambda i: (round(utilities[o, i], 9), -i))
        want |= {(o, t): (best, got) for (_, t, _), got in fit(train, [r for r in rows if r[0] == held], params[best]).items()}
    assert {(r.outer_fold, r.parameter_index): round(r.utility, 6) for r in scores.collect()} == {k: round(x, 6) for k, x in utilities.items()}
    assert {(r.outer_fold, r.trial): (r.parameter_index, int(r.y_pred)) for r in found.collect()} == want
    again = kernels.nested_rbf(kernels.trial_vectors(df, ["subject", "trial"], ["a", "b"], "a"), plan, params, 0, size=16)[0]
    assert again.count() == 90 and again.select(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).first()[0] < 0.4


def test_nested_selection_of_estimators(spark):
    rng = np.random.default_rng(8)
    rows = [(t, f"s{t % 4}", t, float(x), float(x > 0.5)) for t, x in enumerate(rng.random(48))]
    df = spark.createDataFrame(rows, "id long, subject string, trial long, a double, y double")
    roll = lambda p: p.select("subject", "trial", F.col("y").alias("y_true"), "y_pred")
    score = lambda p: p.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("utility"))
    candidates = {0: (df, ["a"], "knn", [{"k": 1}, {"k": 3}]), 1: (df, ["a"], "rf", [{"trees": 3, "max_depth": 3}])}
    found, inner = models.nested_selection(candidates, 2, prepare.split_plan(df, "subject", 2), roll, score)
    got = found.collect()
    assert len(got) == 96 and {r.candidate_order for r in got} == {0, 1} and np.mean([r.y_true == r.y_pred for r in got]) > 0.8
    assert inner.count() == 8 and inner.filter("chosen").count() == 4


def test_bootstrap_rho_equals_repeated_rows(spark):
    """Ranks by weight against ranks of rows that are really repeated."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(f"s{i % 5}", float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 6, (60, 2)))], "subject string, y_true double, y_pred double")
    draws = resampling.subject_draws(df, "subject", 30)
    rows = df.join(draws, "subject").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).toPandas()
    rho = [g["y_true"].rank().corr(g["y_pred"].rank()) for _, g in rows.groupby("rep")]
    r2 = [1 - ((g.y_true - g.y_pred) ** 2).sum() / ((g.y_true - g.y_true.mean()) ** 2).sum() for _, g in rows.groupby("rep")]
    r = resampling.bootstrap_numbers(df, [], "subject", 30).first()
    assert np.allclose([r.spearman_rho_low, r.spearman_rho_high], np.percentile(rho, [2.5, 97.5])) and np.allclose([r.r2_low, r.r2_high], np.percentile(r2, [2.5, 97.5]))


def test_no_comparison_gives_one_row(spark):
    p = spark.createDataFrame([(0, "s", 1, 0, 0)], "candidate_order int, subject string, trial long, y_true int, y_pred int")
    c = spark.createDataFrame([(0, "a", "w", "r", "rf")], "candidate_order int, input_id string, mode string, representation string, model string")
    (row,) = resampling.paired_tests(p, c, "subject", ["trial"], 2, 10).collect()
    assert row.status == "not_applicable" and row.p is None


def test_numbers_have_twelve_digits(spark):
    values = [0.0, 1.0, -2.5, 1 / 3, 1e-5, 123456789.123456789, 1e12, 123456789012345.0, 2.5e-300, 0.0001, -1e300, 100.0, 99999999999.96, 1e11]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(recordings.twelve_digits(F.col("x"))).collect()]
    assert got == ["%.12g" % x for x in values]


def test_resume_refuses_other_hashes(spark):
    work = spark.createDataFrame([(i, "c", "s") for i in range(4)], "unit int, config string, split string")
    assert align.resume(work, work.filter("unit < 2"), ["unit"], ["config", "split"]).count() == 2
    with pytest.raises(validate.InvalidTable, match="split"):
        align.resume(work, work.filter("unit < 2").withColumn("split", F.lit("t")), ["unit"], ["config", "split"])


def test_shapley_values_meet_once_per_row(spark):
    """No window over the rounds of a row: predictions are added up before the one shuffle of the rows."""
    df = spark.createDataFrame([(i, float(i), float(i * i), f"f{i % 2}") for i in range(8)], "id long, a double, b double, fold string")
    back = spark.createDataFrame([(f, b, float(b), 1.0) for f in ("f0", "f1") for b in range(3)], "fold string, _b int, _b_a double, _b_b double")
    v = reports.shapley_values(df, "id", ["a", "b"], back, lambda x: x.withColumn("y_pred", F.col("a") * F.col("b")), 3, fold="fold")
    assert "Window" not in v._jdf.queryExecution().optimizedPlan().toString()
    rows = v.collect()
    assert sorted((r.id, r.feature) for r in rows) == [(i, f) for i in range(8) for f in "ab"]
    with_idle = reports.shapley_values(df.withColumn("c", F.lit(1.0)), "id", ["a", "b", "c"], back.withColumn("_b_c", F.lit(2.0)), lambda x: x.withColumn("y_pred", F.col("a") + 10 * F.col("b")), 3, fold="fold")
    assert with_idle.filter("feature = 'c' and abs(value) > 1e-9").count() == 0 and with_idle.filter("feature = 'a' and value > id + 1e-9").count() == 0


def test_permuted_rows_are_matched_once(spark):
    """All turns of a row come from one join by its place in the fold, with the values that the rows in hashed order lend."""
    import hashlib

    rows = [(f"r{i:02d}", f"k{i % 2}", float(i), None if i == 3 else -float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, k string, a double, b double")
    out = reports.permuted(df, "id", ["a", "b"], 2, ["k"])
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and "feature" not in joins[0] and "repeat" not in joins[0]
    got = {(r.id, r.feature, r.repeat): (r.a, r.b) for r in out.collect()}
    hashed = lambda f, k, i: int(hashlib.sha256(f"permute|{f}|{k}|{i}".encode()).hexdigest()[:8], 16)
    for fold in ("k0", "k1"):
        own = sorted(r for r in rows if r[1] == fold)
        for n, f in ((2, "a"), (3, "b")):
            for k in range(2):
                lend = sorted(own, key=lambda r: (hashed(f, k, r[0]), r[0]))
                for r, other in zip(own, lend):
                    assert got[r[0], f, k] == ((other[n], r[3]) if f == "a" else (r[2], other[n]))
    assert len(got) == 48
