"""Queries over samples, windows and graphs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as fn
from ..operators import feature_rows, series, trials, validate, visibility, waves, windows
from ..sources import recordings
from . import views as v
from .register import SQL, query



def _gappy(s, d):
    """Samples with missing values and NaN by formula."""
    nan = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return v.samples(s, d).withColumn("value", F.when(F.col("event_id") % 7 != 0, nan))


SQL_GAPPY = v.SQL_SAMPLES + ", gappy AS (SELECT *, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS g FROM samples)"


@query("scan_json_signals", """SELECT event_id, 'k' AS signal, i AS pos, CASE WHEN i = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE value END AS value FROM events, (SELECT unnest([0, 1]) AS i) WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def scan_json_signals(s, d):
    """Objects signal -> list of [time, value] rows, made of each event's properties: two rows, the property and the event's value."""
    e = v.read(s, d, "events").select("event_id", "value", F.from_json("props", "map<string,double>").alias("m"))
    stamp = F.lit("2020-01-01T10:00:00:000000")
    text = F.to_json(F.transform_values("m", lambda k, x: F.array(F.array(stamp, x.cast("string")), F.array(stamp, F.col("value").cast("string")))))
    rows = recordings.explode_signals(e.filter("m.k is not null").select("event_id", text.alias("text")), "text", ["event_id"])
    return rows.filter("signal = 'k'").select("event_id", "signal", "pos", fn.no_nan(F.element_at("row", 2).try_cast("double")).alias("value"))


@query("scan_questionnaires", """SELECT o_orderkey AS id, 'M' || (o_orderkey % 3) AS condition, CAST(o_orderkey % 3 + 1 AS BIGINT) AS movie_order_index, CAST(o_custkey % 11 AS INTEGER) AS sam_valence,
CASE WHEN o_custkey % 11 BETWEEN 1 AND 9 THEN NULL ELSE 'out_of_range' END AS problem FROM orders""")
def scan_questionnaires(s, d):
    o = v.read(s, d, "orders")
    text = F.to_json(F.struct(F.struct(F.col("o_orderkey").cast("int").alias("id"), F.array(F.lit("M0"), F.lit("M1"), F.lit("M2")).alias("movie_order")).alias("metadata"), F.array(F.struct(F.concat(F.lit("M"), F.col("o_orderkey") % 3).alias("movie"), F.struct((F.col("o_custkey") % 11).alias("VALENCE"), F.lit(5).alias("AROUSAL"), F.lit(5).alias("MOTIVATION")).alias("sam"))).alias("questionnaires")))
    rows = recordings.questionnaire_rows(o.select(F.col("o_orderkey").alias("id"), text.alias("text")), "text", ["id"])
    return rows.select("id", "condition", F.col("movie_order_index").cast("long").alias("movie_order_index"), "sam_valence", "problem")


@query("discover_files", """WITH f AS (SELECT event_id, user_id || '/' || user_id || '_' || upper(event_type) || '_STIMULUS_EMPATICA.json' AS path, user_id, event_type FROM events)
SELECT path, CAST(user_id AS INTEGER) AS subject, upper(event_type) AS condition, 'STIMULUS' AS phase, CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN 'duplicate' END AS problem FROM f""")
def discover_files(s, d):
    e = v.read(s, d, "events")
    name = F.concat(F.col("user_id"), F.lit("_"), F.upper("event_type"), F.lit("_STIMULUS_EMPATICA.json"))
    return recordings.discover(e.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), name).alias("path")))


@query("parse_times", """SELECT event_id, epoch_us(ts) AS micros, epoch_us(date_trunc('second', ts)) AS micros_plain FROM events""")
def parse_times(s, d):
    e = v.read(s, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss:SSSSSS").alias("colon"))
    plain = F.substring("colon", 1, 19)
    return e.select("event_id", fn.epoch_micros(fn.parse_time(F.col("colon"))).alias("micros"), fn.epoch_micros(fn.parse_time(plain)).alias("micros_plain"))


@query("signal_index", f"""WITH {v.SQL_INDEX} SELECT subject, signal, n_samples, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(end_s - start_s, 6) AS duration_s, round(1 / median_step, 9) AS estimated_rate,
round(end_s + median_step, 5) AS recording_end_s FROM idx""")
def signal_index(s, d):
    i = series.signal_index(v.samples(s, d), ["subject", "signal"])
    return i.select("subject", "signal", "n_samples", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), F.round("duration_s", 6).alias("duration_s"), F.round("estimated_rate", 9).alias("estimated_rate"), F.round("recording_end_s", 5).alias("recording_end_s"))


@query("relative_time", f"""WITH {v.SQL_SAMPLES} SELECT subject, signal, pos, round(t - first_value(t) OVER (PARTITION BY subject, signal ORDER BY pos), 6) AS rel_t FROM samples""")
def relative_time(s, d):
    return series.relative_time(v.samples(s, d), ["subject", "signal"]).select("subject", "signal", "pos", F.round("rel_t", 6).alias("rel_t"))


@query("fill_gaps", f"""WITH {SQL_GAPPY}, marks AS (SELECT *, last_value(g IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN g IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
first_value(g IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN g IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1 FROM gappy
WINDOW b AS (PARTITION BY subject, signal ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY subject, signal ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT subject, signal, pos, round(coalesce(g, CASE WHEN p1 > p0 THEN v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, v0, v1), 6) AS filled, g IS NULL AS was_bad FROM marks""")
def fill_gaps(s, d):
    return series.fill_gaps(_gappy(s, d), ["subject", "signal"]).select("subject", "signal", "pos", F.round("filled", 6).alias("filled"), "was_bad")


@query("detrend", f"""WITH {v.SQL_SAMPLES}, fit AS (SELECT subject, signal, regr_slope(value, pos) AS b, avg(value) AS m, avg(pos) AS p FROM samples GROUP BY ALL)
SELECT subject, signal, pos, round(value - m - coalesce(CASE WHEN isnan(b) THEN NULL ELSE b END, 0) * (pos - p), 6) AS detrended FROM samples JOIN fit USING (subject, signal)""")
def detrend(s, d):
    return series.detrend(v.samples(s, d), ["subject", "signal"]).select("subject", "signal", "pos", F.round("detrended", 6).alias("detrended"))


@query("gradient", f"""WITH {v.SQL_SAMPLES}, n AS (SELECT *, lag(value) OVER w AS fp, lead(value) OVER w AS fn, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd FROM samples WINDOW w AS (PARTITION BY subject, signal ORDER BY pos))
SELECT subject, signal, pos, round(CASE WHEN fp IS NULL THEN (fn - value) / hd WHEN fn IS NULL THEN (value - fp) / hs ELSE (hs * hs * fn + (hd * hd - hs * hs) * value - hd * hd * fp) / (hs * hd * (hs + hd)) END, 9) AS gradient FROM n""")
def gradient(s, d):
    return series.gradient(v.samples(s, d), ["subject", "signal"]).select("subject", "signal", "pos", F.round("gradient", 9).alias("gradient"))


@query("time_checks", f"""WITH {SQL_GAPPY}, n AS (SELECT *, t - lag(t) OVER (PARTITION BY subject, signal ORDER BY pos) AS d FROM gappy)
SELECT subject, signal, count(*) FILTER (WHERE d < 0) AS decreasing, count(*) FILTER (WHERE d = 0) AS repeated, count(*) FILTER (WHERE g IS NULL) AS not_finite FROM n GROUP BY ALL""")
def time_checks(s, d):
    return series.time_checks(_gappy(s, d), ["subject", "signal"])


@query("row_shapes", """SELECT event_type AS signal, CAST(1 + 1 AS INTEGER) AS min_width, CAST(3 AS INTEGER) AS max_width, CAST(2 AS BIGINT) AS formats, false AS valid FROM events GROUP BY event_type""")
def row_shapes(s, d):
    e = v.read(s, d, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    row = F.when(F.col("event_id") % 2 == 0, F.array(F.concat(stamp, F.lit(":000001")), F.col("value").cast("string"))).otherwise(F.array(stamp, F.col("value").cast("string"), F.lit("1")))
    return validate.row_shapes(e.select(F.col("event_type").alias("signal"), row.alias("row")), ["signal"], "row")


@query("interval_intersection", f"""WITH {v.SQL_ALIGNED} SELECT subject, round(common_start, 5) AS common_start, round(common_end, 5) AS common_end FROM itv""")
def interval_intersection(s, d):
    i = windows.intersection(series.signal_index(v.samples(s, d).filter(F.col("signal").isin(v.SIGNALS)), ["subject", "signal"]), ["subject"], 3)
    return i.select("subject", F.round("common_start", 5).alias("common_start"), F.round("common_end", 5).alias("common_end"))


@query("sliding_windows", f"""WITH {v.SQL_ALIGNED} SELECT subject, window_id, window_id * {v.OVERLAP_S} AS window_start_s, window_id * {v.OVERLAP_S} + {v.WINDOW_S} AS window_end_s FROM win""")
def sliding_windows(s, d):
    _, i = v.aligned(s, d)
    return windows.window_table(i, v.WINDOW_S, v.OVERLAP_S).select("subject", "window_id", "window_start_s", "window_end_s")


@query("assign_windows", f"""WITH {v.SQL_ALIGNED} SELECT subject, signal, event_id, window_id FROM aligned""")
def assign_windows(s, d):
    return v.aligned(s, d)[0].select("subject", "signal", "event_id", "window_id")


@query("window_quality", f"""WITH {v.SQL_ALIGNED}, c AS (SELECT subject, window_id, count(*) FILTER (WHERE signal = 'view') AS n_view, count(*) FILTER (WHERE signal = 'click') AS n_click, count(*) FILTER (WHERE signal = 'purchase') AS n_purchase FROM aligned GROUP BY ALL)
SELECT * FROM c WHERE least(n_view, n_click, n_purchase) >= 4""")
def window_quality(s, d):
    return windows.quality(v.aligned(s, d)[0], ["subject", "window_id"], v.SIGNALS)


@query("window_statistics", f"""WITH {v.SQL_ALIGNED}, m AS (SELECT subject, window_id, signal, count(value) AS n, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, avg(value) AS mu, median(value) AS med FROM aligned GROUP BY ALL),
c AS (SELECT subject, window_id, signal, avg((value - mu) ^ 3) AS m3, avg((value - mu) ^ 4) AS m4 FROM aligned JOIN m USING (subject, window_id, signal) GROUP BY ALL)
SELECT subject, window_id, signal, n, round(sd, 6) AS std, lo AS min, hi AS max, round(mu, 6) AS mean, round(hi - lo, 6) AS range, round(med, 6) AS median,
round(CASE WHEN n < 3 OR hi - lo <= 1e-12 THEN 0 ELSE m3 / sd ^ 3 END, 6) AS skewness, round(CASE WHEN n < 4 OR hi - lo <= 1e-12 THEN 0 ELSE m4 / sd ^ 4 - 3 END, 6) AS kurtosis FROM m JOIN c USING (subject, window_id, signal)""")
def window_statistics(s, d):
    w = windows.statistics(v.aligned(s, d)[0], ["subject", "window_id", "signal"])
    return w.select("subject", "window_id", "signal", "n", F.round("std", 6).alias("std"), "min", "max", F.round("mean", 6).alias("mean"), F.round("range", 6).alias("range"), F.round("median", 6).alias("median"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@query("histogram_entropy", f"""WITH {v.SQL_ALIGNED}, m AS (SELECT subject, window_id, signal, min(value) AS lo, max(value) AS hi, count(value) AS n FROM aligned GROUP BY ALL),
b AS (SELECT subject, window_id, signal, n, CASE WHEN hi - lo > 1e-12 THEN least(9, floor((value - lo) / (hi - lo) * 10)) ELSE 0 END AS bin FROM aligned JOIN m USING (subject, window_id, signal)),
p AS (SELECT subject, window_id, signal, count(*) / n AS p FROM b GROUP BY subject, window_id, signal, bin, n)
SELECT subject, window_id, signal, round(abs(sum(p * log2(p))), 6) AS entropy FROM p GROUP BY ALL""")
def histogram_entropy(s, d):
    return windows.histogram_entropy(v.aligned(s, d)[0], ["subject", "window_id", "signal"]).select("subject", "window_id", "signal", F.round("entropy", 6).alias("entropy"))


@query("derivative_statistics", f"""WITH {v.SQL_ALIGNED}, n AS (SELECT *, lag(value) OVER w AS fp, lead(value) OVER w AS fn, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd FROM aligned WINDOW w AS (PARTITION BY subject, window_id, signal ORDER BY t)),
g AS (SELECT subject, window_id, signal, CASE WHEN fp IS NULL THEN (fn - value) / hd WHEN fn IS NULL THEN (value - fp) / hs ELSE (hs * hs * fn + (hd * hd - hs * hs) * value - hd * hd * fp) / (hs * hd * (hs + hd)) END AS g FROM n)
SELECT subject, window_id, signal, round(avg(g), 7) AS deriv_mean, round(stddev_pop(g), 7) AS deriv_std FROM g GROUP BY ALL""")
def derivative_statistics(s, d):
    g = windows.derivative_statistics(v.aligned(s, d)[0], ["subject", "window_id", "signal"])
    return g.select("subject", "window_id", "signal", F.round("deriv_mean", 7).alias("deriv_mean"), F.round("deriv_std", 7).alias("deriv_std"))


@query("window_zscore", f"""WITH {v.SQL_ALIGNED}, m AS (SELECT *, stddev_pop(value) OVER w AS sd, avg(value) OVER w AS mu FROM aligned WINDOW w AS (PARTITION BY subject, window_id, signal))
SELECT subject, window_id, signal, event_id, round(CASE WHEN sd > 1e-12 THEN (value - mu) / sd ELSE value - mu END, 6) AS z FROM m""")
def window_zscore(s, d):
    return series.zscore(v.aligned(s, d)[0], ["subject", "window_id", "signal"]).select("subject", "window_id", "signal", "event_id", F.round("z", 6).alias("z"))


@query("baseline_normalised", f"""WITH {v.SQL_ALIGNED}, m AS (SELECT subject, window_id, avg(value) AS mean FROM aligned WHERE signal = 'view' GROUP BY ALL),
b AS (SELECT subject, avg(value) AS bm, stddev_samp(value) AS bs FROM samples WHERE signal = 'signup' GROUP BY ALL)
SELECT subject, window_id, round(CASE WHEN bs > 1e-12 THEN (mean - bm) / bs END, 6) AS baseline_norm FROM m LEFT JOIN b USING (subject)""")
def baseline_normalised(s, d):
    w = v.aligned(s, d)[0].filter("signal = 'view'").groupBy("subject", "window_id").agg(F.avg("value").alias("mean"))
    out = windows.baseline_normalised(w, v.samples(s, d).filter("signal = 'signup'"), ["subject"])
    return out.select("subject", "window_id", F.round("baseline_norm", 6).alias("baseline_norm"))


SQL_PEAKS = v.SQL_SAMPLES + """, sm AS (SELECT *, avg(value) OVER a AS smooth, max(value) OVER a AS top, max(value) OVER (PARTITION BY subject, signal ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS bef FROM samples
WINDOW a AS (PARTITION BY subject, signal ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), peaks AS (SELECT * FROM sm WHERE value = top AND value > smooth AND coalesce(bef < value, true))"""


@query("pulse_peaks", f"""WITH {SQL_PEAKS} SELECT subject, signal, pos, value FROM peaks""")
def pulse_peaks(s, d):
    return series.peaks(v.samples(s, d), ["subject", "signal"]).select("subject", "signal", "pos", "value")


@query("pulse_variability", f"""WITH {SQL_PEAKS}, nn AS (SELECT *, (t - lag(t) OVER (PARTITION BY subject, signal ORDER BY t)) * 1000.0 AS nn FROM peaks), dd AS (SELECT *, nn - lag(nn) OVER (PARTITION BY subject, signal ORDER BY t) AS d FROM nn)
SELECT subject, signal, count(*) AS n_peaks, round(CASE WHEN count(*) >= 4 THEN avg(nn) END, 2) AS mean_nn, round(CASE WHEN count(*) >= 4 THEN stddev_samp(nn) END, 2) AS sdnn, round(CASE WHEN count(*) >= 4 THEN sqrt(avg(d * d)) END, 2) AS rmssd,
round(CASE WHEN count(*) >= 4 THEN 100.0 * avg(CASE WHEN abs(d) > 50 THEN 1 WHEN d IS NOT NULL THEN 0 END) END, 4) AS pnn50 FROM dd GROUP BY subject, signal""")
def pulse_variability(s, d):
    p = series.pulse_variability(series.peaks(v.samples(s, d), ["subject", "signal"]), ["subject", "signal"])
    return p.select("subject", "signal", "n_peaks", *[F.round(c, 2).alias(c) for c in ("mean_nn", "sdnn", "rmssd")], F.round("pnn50", 4).alias("pnn50"))


SQL_SCR = v.SQL_SAMPLES + """, ph AS (SELECT *, value - avg(value) OVER (PARTITION BY subject, signal ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS phasic, min(value) OVER (PARTITION BY subject, signal ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS low FROM samples),
nb AS (SELECT *, lag(phasic) OVER w AS p0, lead(phasic) OVER w AS p1 FROM ph WINDOW w AS (PARTITION BY subject, signal ORDER BY pos)), scr AS (SELECT *, value - low AS amplitude FROM nb WHERE phasic > 0 AND (p0 IS NULL OR phasic > p0) AND (p1 IS NULL OR phasic >= p1))"""


@query("response_peaks", f"""WITH {SQL_SCR} SELECT subject, signal, pos, round(amplitude, 6) AS amplitude FROM scr""")
def response_peaks(s, d):
    return series.response_peaks(v.samples(s, d), ["subject", "signal"]).select("subject", "signal", "pos", F.round("amplitude", 6).alias("amplitude"))


@query("responses_in_windows", f"""WITH {v.SQL_ALIGNED}, {SQL_SCR[len(v.SQL_SAMPLES) + 2:]}, hit AS (SELECT a.subject, a.window_id, s.amplitude FROM aligned a JOIN scr s ON a.event_id = s.event_id WHERE a.signal = 'click'),
per AS (SELECT subject, window_id, count(*) AS n, avg(amplitude) AS a FROM hit GROUP BY ALL)
SELECT w.subject, w.window_id, coalesce(n, 0) AS scr_count, round(coalesce(a, 0), 6) AS scr_amplitude FROM win w LEFT JOIN per USING (subject, window_id)""")
def responses_in_windows(s, d):
    clicks = series.response_peaks(v.samples(s, d).filter("signal = 'click'"), ["subject", "signal"])
    i = v.aligned(s, d)[1]
    hits = windows.assign(clicks, i, ["subject"], v.WINDOW_S, v.OVERLAP_S)
    out = windows.events_in_windows(windows.window_table(i, v.WINDOW_S, v.OVERLAP_S), hits, ["subject", "window_id"])
    return out.select("subject", "window_id", F.col("scr_count").cast("long").alias("scr_count"), F.round("scr_amplitude", 6).alias("scr_amplitude"))


SQL_RESAMPLED = v.SQL_SAMPLES + """, bounds AS (SELECT subject, signal, min(t) AS lo, max(t) AS hi FROM samples GROUP BY ALL),
m AS (SELECT subject, signal, coalesce(least(11, CAST(floor((t - lo) / nullif(hi - lo, 0) * 12) AS BIGINT)), 0) AS k, avg(value) AS m FROM samples JOIN bounds USING (subject, signal) GROUP BY ALL),
grid AS (SELECT subject, signal, unnest(range(0, 12)) AS k FROM bounds), g AS (SELECT subject, signal, k, m FROM grid LEFT JOIN m USING (subject, signal, k)),
mk AS (SELECT *, last_value(m IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN m IS NOT NULL THEN k END IGNORE NULLS) OVER b AS p0, first_value(m IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN m IS NOT NULL THEN k END IGNORE NULLS) OVER f AS p1 FROM g
WINDOW b AS (PARTITION BY subject, signal ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY subject, signal ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT subject, signal, k, coalesce(m, CASE WHEN p1 > p0 THEN v0 + (v1 - v0) * (k - p0) / (p1 - p0) END, v0, v1) AS f FROM mk)"""


@query("resample", f"""WITH {SQL_RESAMPLED}, z AS (SELECT *, stddev_pop(f) OVER w AS sd, avg(f) OVER w AS mu FROM fl WINDOW w AS (PARTITION BY subject, signal))
SELECT subject, signal, CAST(k AS INTEGER) AS k, round(CASE WHEN sd > 1e-12 THEN (f - mu) / sd ELSE f - mu END, 6) AS z FROM z""")
def resample(s, d):
    return series.resample(v.samples(s, d), ["subject", "signal"], 12).select("subject", "signal", "k", F.round("z", 6).alias("z"))


SQL_PAIRS = v.SQL_SERIES + """, pairs AS (SELECT a.subject, a.pos AS i, b.pos AS j, a.value AS yi, b.value AS yj, (b.value - a.value) / (b.pos - a.pos) AS s FROM series a JOIN series b ON a.subject = b.subject AND a.pos < b.pos),
seen AS (SELECT *, max(s) OVER w AS ms, max(yj) OVER w AS my FROM pairs WINDOW w AS (PARTITION BY subject, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nvg AS (SELECT subject, i, j FROM seen WHERE ms IS NULL OR s > ms), hvg AS (SELECT subject, i, j FROM seen WHERE my IS NULL OR least(yi, yj) > my)"""


@query("natural_visibility", f"""WITH {SQL_PAIRS} SELECT subject, i, j FROM nvg""")
def natural_visibility(s, d):
    return visibility.visibility_edges(v.whole_series(s, d), ["subject"], "natural")


@query("horizontal_visibility", f"""WITH {SQL_PAIRS} SELECT subject, i, j FROM hvg""")
def horizontal_visibility(s, d):
    return visibility.visibility_edges(v.whole_series(s, d), ["subject"], "horizontal")


SQL_DEGREE = SQL_PAIRS + ", deg AS (SELECT subject, node, count(*) AS degree FROM (SELECT subject, i AS node FROM nvg UNION ALL SELECT subject, j FROM nvg) GROUP BY ALL)"


@query("degree_metrics", f"""WITH {SQL_DEGREE}, main AS (SELECT subject, count(*) AS n, sum(degree) / 2 AS m, avg(degree) AS am, stddev_pop(degree) AS sd, min(degree) AS lo, max(degree) AS hi, median(degree) AS med FROM deg GROUP BY ALL),
p AS (SELECT subject, count(*) / n AS p FROM deg JOIN main USING (subject) GROUP BY subject, degree, n), e AS (SELECT subject, abs(sum(p * log2(p))) AS h FROM p GROUP BY ALL)
SELECT subject, CAST(m AS DOUBLE) AS edges, round(2 * m / (n * (n - 1)), 6) AS density, round(am, 6) AS degree_mean, round(sd, 6) AS degree_std, lo AS degree_min, hi AS degree_max, med AS degree_median, round(h, 6) AS degree_entropy FROM main JOIN e USING (subject)""")
def degree_metrics(s, d):
    m = visibility.degree_metrics(visibility.visibility_edges(v.whole_series(s, d), ["subject"], "natural"), ["subject"])
    return m.select("subject", "edges", F.round("density", 6).alias("density"), F.round("degree_mean", 6).alias("degree_mean"), F.round("degree_std", 6).alias("degree_std"), "degree_min", "degree_max", "degree_median", F.round("degree_entropy", 6).alias("degree_entropy"))


@query("clustering_metrics", f"""WITH {SQL_DEGREE}, tri AS (SELECT a.subject, unnest([a.i, a.j, b.j]) AS node FROM nvg a JOIN nvg b ON a.subject = b.subject AND a.j = b.i JOIN nvg c ON c.subject = a.subject AND c.i = a.i AND c.j = b.j),
t AS (SELECT subject, node, count(*) AS t FROM tri GROUP BY ALL), b AS (SELECT deg.subject, degree * (degree - 1) / 2 AS w, coalesce(t, 0) AS t FROM deg LEFT JOIN t ON deg.subject = t.subject AND deg.node = t.node)
SELECT subject, round(avg(CASE WHEN w > 0 THEN t / w ELSE 0 END), 6) AS clustering_mean, round(coalesce(sum(t) / nullif(sum(w), 0), 0), 6) AS transitivity FROM b GROUP BY ALL""")
def clustering_metrics(s, d):
    m = visibility.clustering_metrics(visibility.visibility_edges(v.whole_series(s, d), ["subject"], "natural"), ["subject"])
    return m.select("subject", F.round("clustering_mean", 6).alias("clustering_mean"), F.round("transitivity", 6).alias("transitivity"))


@query("path_metrics")
def path_metrics(s, d):
    """Mean shortest path, diameter, closeness and betweenness of the natural graph of every subject."""
    return visibility.path_metrics(visibility.visibility_edges(v.whole_series(s, d), ["subject"], "natural"), ["subject"])


@query("graph_features_wide")
def graph_features_wide(s, d):
    """Both graphs of the three signals of every subject, resampled to 120 points, as family_signal_metric columns; the tests hold the
    numbers against the edge tables."""
    points = series.resample(v.samples(s, d).filter(F.col("signal").isin(v.SIGNALS)), ["subject", "signal"], 120).select("subject", "signal", F.col("k").cast("long").alias("pos"), F.col("z").alias("value"))
    long = visibility.graph_features(points, ["subject", "signal"]).withColumn("name", F.concat_ws("_", "family", "signal"))
    names = [f"{f}_{x}" for f in ("nvg", "hvg") for x in v.SIGNALS]
    return visibility.widen(long, ["subject"], [c for c in long.columns if c not in ("subject", "signal", "family", "name")], names)


SQL_WINDOW_PAIRS = v.SQL_ALIGNED + """, pts AS (SELECT subject, window_id, signal, value, row_number() OVER (PARTITION BY subject, window_id, signal ORDER BY pos) - 1 AS p FROM aligned),
wp AS (SELECT a.subject, a.window_id, a.signal, a.p AS i, b.p AS j, (b.value - a.value) / (b.p - a.p) AS slope FROM pts a JOIN pts b ON a.subject = b.subject AND a.window_id = b.window_id AND a.signal = b.signal AND a.p < b.p),
ed AS (SELECT subject, window_id, signal, i, j FROM (SELECT *, max(slope) OVER (PARTITION BY subject, window_id, signal, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM wp) WHERE before IS NULL OR slope > before),
dg AS (SELECT subject, window_id, signal, node, count(*) AS d FROM (SELECT subject, window_id, signal, i AS node FROM ed UNION ALL SELECT subject, window_id, signal, j FROM ed) GROUP BY ALL)"""
SQL_WINDOW_GRAPHS = f"""WITH {SQL_WINDOW_PAIRS}, tri AS (SELECT a.subject, a.window_id, a.signal, unnest([a.i, a.j, b.j]) AS node FROM ed a JOIN ed b ON a.subject = b.subject AND a.window_id = b.window_id AND a.signal = b.signal AND a.j = b.i
JOIN ed c ON c.subject = a.subject AND c.window_id = a.window_id AND c.signal = a.signal AND c.i = a.i AND c.j = b.j), t AS (SELECT subject, window_id, signal, node, count(*) AS t FROM tri GROUP BY ALL),
b AS (SELECT dg.*, d * (d - 1) / 2 AS w, coalesce(t, 0) AS t FROM dg LEFT JOIN t USING (subject, window_id, signal, node))
SELECT subject, window_id, signal, sum(d) / 2.0::DOUBLE AS edges, round(avg(d), 6) AS degree_mean, round(stddev_pop(d), 6) AS degree_std, round(avg(CASE WHEN w > 0 THEN t / w ELSE 0 END), 6) AS clustering_mean, round(coalesce(sum(t) / nullif(sum(w), 0), 0), 6) AS transitivity FROM b GROUP BY ALL"""


@query("window_graphs", SQL_WINDOW_GRAPHS)
def window_graphs(s, d):
    """Degree and clustering columns of the natural graph of every signal in every window, over the samples themselves."""
    a, _ = v.aligned(s, d)
    keys = ["subject", "window_id", "signal"]
    points = a.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)
    g = visibility.graph_features(points, keys, ("natural",), "place").filter("edges > 0")
    return g.select(*keys, "edges", *[F.round(c, 6).alias(c) for c in ("degree_mean", "degree_std", "clustering_mean", "transitivity")])


SQL_CLEAN = v.SQL_SAMPLES + """, ks AS (SELECT unnest(range(-12, 13)) AS k), hw AS (SELECT k, CASE WHEN k = 0 THEN 0.25 ELSE sin(pi() * 0.25 * k) / (pi() * k) END * (0.5 + 0.5 * cos(pi() * k / 13)) AS w FROM ks),
h AS (SELECT k, (CASE WHEN k = 0 THEN 1 ELSE 0 END) - w / (SELECT sum(w) FROM hw) AS h FROM hw), nn AS (SELECT subject, signal, max(pos) AS last FROM samples GROUP BY ALL), tp AS (SELECT s.subject, s.signal, s.pos, h, greatest(0, least(last, s.pos + k)) AS at FROM samples s JOIN nn USING (subject, signal), h)"""


@query("pulse_wave", f"""WITH {SQL_CLEAN} SELECT tp.subject, tp.signal, tp.pos, round(sum(h * x.value), 6) AS clean FROM tp JOIN samples x ON tp.subject = x.subject AND tp.signal = x.signal AND tp.at = x.pos GROUP BY ALL""")
def pulse_wave(s, d):
    """Every signal as a band-passed pulse wave at four samples a second."""
    return waves.pulse_wave(v.samples(s, d), ["subject", "signal"], 4.0).select("subject", "signal", "pos", F.round("clean", 6).alias("clean"))


@query("pulse_beats")
def pulse_beats(s, d):
    """Beats of every signal's band-passed wave."""
    return waves.pulse_wave(v.samples(s, d), ["subject", "signal"], 4.0).filter("is_beat").select("subject", "signal", "pos", "t", F.round("clean", 6).alias("clean"))


@query("skin_conductance_responses")
def skin_conductance_responses(s, d):
    """Responses of every signal with onset, half-recovery and amplitude."""
    keys = ["subject", "signal"]
    r = waves.skin_responses(waves.skin_wave(v.samples(s, d), keys, 4.0), keys)
    return r.select(*keys, "pos", "onset", "recovery", F.round("amplitude", 6).alias("amplitude"))


@query("feature_rows")
def feature_rows_(s, d):
    """All 125 columns of every window of the three signals; graphs of 24 points."""
    roles = F.create_map(*[F.lit(x) for pair in zip(v.SIGNALS, feature_rows.SIGNALS) for x in pair])
    x = v.samples(s, d)
    named = x.withColumn("signal", roles[F.col("signal")]).filter("signal is not null")
    base = x.filter("signal = 'signup'").select("subject", "value")
    return feature_rows.feature_rows(named, ["subject"], ["subject"], v.WINDOW_S, v.OVERLAP_S, dict.fromkeys(feature_rows.SIGNALS, 4.0), 6.0, 24, base)


@query("store_violations", f"""WITH {v.SQL_INDEX} SELECT 'unknown_trial' AS check, subject || '|' || signal AS key FROM idx WHERE subject % 5 = 0
UNION ALL SELECT 'other_count', subject || '|' || signal FROM idx WHERE subject % 7 = 1 UNION ALL SELECT 'bad_rating', CAST(subject AS VARCHAR) FROM (SELECT DISTINCT subject FROM idx) WHERE subject % 5 <> 0 AND subject % 11 = 0""")
def store_violations(s, d):
    rel = series.relative_time(v.samples(s, d), ["subject", "signal"])
    index = series.signal_index(v.samples(s, d), ["subject", "signal"]).withColumn("n_samples", F.col("n_samples") + F.when(F.col("subject") % 7 == 1, 1).otherwise(0))
    t = rel.select("subject").distinct().filter("subject % 5 != 0").withColumn("rating", (F.col("subject") % 11).cast("int"))
    t = t.withColumn("rating", F.when(F.col("rating") > 9, 9).otherwise(F.col("rating")))
    return validate.store_violations(rel, index, t, ["subject", "signal"], ["subject"])


@query("store_totals", f"""WITH {v.SQL_INDEX} SELECT count(DISTINCT subject) AS subjects, count(DISTINCT subject) AS trials, count(*) AS series, CAST(sum(n_samples) AS BIGINT) AS samples FROM idx""")
def store_totals(s, d):
    return trials.totals(series.signal_index(v.samples(s, d), ["subject", "signal"]), "subject", ["subject"])


@query("live_window_statistics", """WITH w AS (SELECT user_id, event_type, value, epoch_us(ts) AS us, unnest([0, 1]) AS back FROM events), b AS (SELECT *, (us // 604800000000 - back) * 604800000000 AS ws FROM w)
SELECT make_timestamp(ws) AS window_start, user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM b
WHERE ws + 1209600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000 GROUP BY ws, user_id, event_type""")
def live_window_statistics(s, d):
    """The stream operator over all events at once; windows that end within a day of the last event are not
    out yet in append mode, so they are left out."""
    from ..streaming.live import live_statistics

    e = v.read(s, d, "events")
    out = live_statistics(e, "14 days", "7 days", "1 day", ["user_id", "event_type"])
    last = e.agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 1 day")).alias("last"))
    out = out.crossJoin(F.broadcast(last)).filter("window_end <= last")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "event_type", "n", F.round("mean", 6).alias("mean"), "min", "max")


_STATS = ["n", "std", "min", "max", "mean", "range", "median", "skewness", "kurtosis", "entropy", "deriv_mean", "deriv_std"]
SQL_WIDE = ", ".join(f"max(CASE WHEN signal = '{x}' THEN {m} END) AS {x}_{m}" for x in v.SIGNALS for m in _STATS)


@query("window_features", f"""WITH g AS ({SQL["window_quality"]}), s AS ({SQL["window_statistics"]}), e AS ({SQL["histogram_entropy"]}), d AS ({SQL["derivative_statistics"]}), l AS (SELECT * FROM s JOIN e USING (subject, window_id, signal) JOIN d USING (subject, window_id, signal)),
p AS (SELECT subject, window_id, {SQL_WIDE} FROM l GROUP BY subject, window_id) SELECT * FROM g JOIN p USING (subject, window_id)""")
def window_features(s, d):
    """Statistics, entropy and derivatives of the three signals of every window that passes the quality check."""
    a, _ = v.aligned(s, d)
    keys = ["subject", "window_id"]
    good = windows.quality(a, keys, v.SIGNALS)
    a = a.join(good.select(*keys), keys)
    by = [*keys, "signal"]
    long = windows.statistics(a, by).join(windows.histogram_entropy(a, by), by).join(windows.derivative_statistics(a, by), by)
    long = long.select(*by, "n", "min", "max", *[F.round(c, 7 if c.startswith("deriv") else 6).alias(c) for c in _STATS if c not in ("n", "min", "max")])
    metrics = [c for c in long.columns if c not in by]
    return good.join(visibility.widen(long.withColumnRenamed("signal", "name"), keys, metrics, v.SIGNALS), keys)


@query("rate_choice", f"""WITH {v.SQL_INDEX}, r AS (SELECT *, CASE WHEN median_step > 0 THEN 1 / median_step END AS est, CASE signal WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.0 END AS nominal FROM idx)
SELECT subject, signal, round(coalesce(CASE WHEN nominal > 0 THEN nominal END, est), 9) AS rate FROM r""")
def rate_choice(s, d):
    """The nominal rate where it is positive, else the estimated one."""
    nominal = F.when(F.col("signal") == "view", 0.5).when(F.col("signal") == "click", 0.0)
    out = series.signal_index(v.samples(s, d), ["subject", "signal"], rate=nominal)
    return out.select("subject", "signal", F.round("rate", 9).alias("rate"))


@query("variability_in_windows", f"""WITH {v.SQL_ALIGNED}, {SQL_PEAKS[len(v.SQL_SAMPLES) + 2:]}, hit AS (SELECT a.subject, a.window_id, a.t FROM aligned a JOIN peaks p ON a.event_id = p.event_id WHERE a.signal = 'click'),
nn AS (SELECT *, (t - lag(t) OVER (PARTITION BY subject, window_id ORDER BY t)) * 1000.0 AS nn FROM hit), dd AS (SELECT *, nn - lag(nn) OVER (PARTITION BY subject, window_id ORDER BY t) AS d FROM nn)
SELECT subject, window_id, count(*) AS n_peaks, round(CASE WHEN count(*) >= 4 THEN avg(nn) END, 2) AS mean_nn, round(CASE WHEN count(*) >= 4 THEN stddev_samp(nn) END, 2) AS sdnn, round(CASE WHEN count(*) >= 4 THEN sqrt(avg(d * d)) END, 2) AS rmssd,
round(CASE WHEN count(*) >= 4 THEN 100.0 * avg(CASE WHEN abs(d) > 50 THEN 1 WHEN d IS NOT NULL THEN 0 END) END, 4) AS pnn50 FROM dd GROUP BY subject, window_id""")
def variability_in_windows(s, d):
    """Pulse variability from the peaks inside each window; peaks are found once per recording."""
    peaks = series.peaks(v.samples(s, d).filter("signal = 'click'"), ["subject", "signal"])
    hits = windows.assign(peaks, v.aligned(s, d)[1], ["subject"], v.WINDOW_S, v.OVERLAP_S)
    p = series.pulse_variability(hits, ["subject", "window_id"])
    return p.select("subject", "window_id", "n_peaks", *[F.round(c, 2).alias(c) for c in ("mean_nn", "sdnn", "rmssd")], F.round("pnn50", 4).alias("pnn50"))


@query("flatten_json", """WITH j AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_acctbal AS bal FROM customer) SELECT id, 'a.bal' AS path, 'number' AS kind, CAST(CAST(round(bal * 100) AS BIGINT) AS VARCHAR) AS value FROM j
UNION ALL SELECT id, 'a.list', 'list', '[1,"x"]' FROM j UNION ALL SELECT id, 'flag', 'bool', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END FROM j UNION ALL SELECT id, 'none', 'null', '' FROM j UNION ALL SELECT id, 'seg', 'text', seg FROM j""")
def flatten_json(s, d):
    """Leaves of objects whose fields no schema names."""
    c = v.read(s, d, "customer")
    text = F.concat(F.lit('{"seg":"'), "c_mktsegment", F.lit('","a":{"bal":'), F.round(F.col("c_acctbal") * 100).cast("long").cast("string"), F.lit(',"list":[1,"x"]},"flag":'), F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false"), F.lit(',"none":null}'))
    return c.select(F.col("c_custkey").alias("id"), F.explode(fn.flatten_json(text)).alias("x")).select("id", "x.*")


@query("parse_settings", """WITH t AS (SELECT o_orderkey AS id, o_custkey % 90 AS w, o_orderkey % 70 AS o FROM orders) SELECT id, CASE WHEN w > 0 AND o < w THEN CAST(w AS DOUBLE) END AS window_s, CASE WHEN w > 0 AND o < w THEN CAST(o AS DOUBLE) + 0.5 * (CASE WHEN o + 0.5 < w THEN 1 ELSE 0 END) END AS overlap_s FROM t""")
def parse_settings(s, d):
    o = v.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 90).alias("w"), (F.col("o_orderkey") % 70).alias("o"))
    text = F.concat(F.col("w").cast("string"), F.lit(":"), F.col("o").cast("string"), F.when(F.col("o") + 0.5 < F.col("w"), ".5").otherwise(""))
    p = o.select("id", fn.parse_setting(text).alias("p"))
    return p.select("id", "p.window_s", "p.overlap_s")
