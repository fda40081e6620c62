"""Queries over feature tables, predictions and vectors, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import align, evaluate, folded_trees, hinge, kernels, models, nested, prepare, reports, resampling, series, stored_models, trials, validate, windows
from ..operators import perceptron as networks
from ..sources import versions
from . import views as v
from .register import query

TRIAL = ["subject", "trial"]
f6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


# --- validation and selection


@query("numeric_issues", """SELECT 'l_returnflag' AS "column", count(*) FILTER (WHERE l_returnflag IS NOT NULL AND try_cast(l_returnflag AS DOUBLE) IS NULL) AS not_numeric, count(*) FILTER (WHERE isinf(try_cast(l_returnflag AS DOUBLE))) AS infinite FROM lineitem
UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE q IS NOT NULL AND try_cast(q AS DOUBLE) IS NULL), count(*) FILTER (WHERE isinf(try_cast(q AS DOUBLE))) FROM (SELECT CASE WHEN l_partkey % 9 = 0 THEN 'Infinity' WHEN l_partkey % 9 = 1 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS q FROM lineitem)""")
def numeric_issues(s, d):
    text = F.when(F.col("l_partkey") % 9 == 0, "Infinity").when(F.col("l_partkey") % 9 == 1, "n/a").otherwise(F.col("l_quantity").cast("string"))
    return validate.numeric_issues(v.read(s, d, "lineitem").withColumn("l_quantity", text), ["l_returnflag", "l_quantity"])


@query("out_of_range", f"""WITH {v.SQL_FEATURES} SELECT trial, window_id, rating FROM features WHERE rating NOT BETWEEN 2 AND 8""")
def out_of_range(s, d):
    return validate.out_of_range(v.features(s, d), "rating", 2, 8).select("trial", "window_id", "rating")


@query("normalise_condition", """SELECT o_orderkey, upper(trim(o_orderpriority)) AS condition FROM orders WHERE upper(trim(o_orderpriority)) NOT IN ('1-URGENT', '5-LOW')""")
def normalise_condition(s, d):
    o = v.read(s, d, "orders").select("o_orderkey", F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("condition"))
    return validate.normalise_condition(o, "condition", ["1-urgent", "5-low "])


@query("select_named", """SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')""")
def select_named(s, d):
    return validate.select_named(v.read(s, d, "events"), "event_type", "view, CLICK,error", "purchase").filter("event_type != 'error'").select("event_id", "event_type")


@query("unknown_names", "SELECT name FROM (SELECT unnest(['VIEW', 'SLEEP']) AS name) WHERE name NOT IN (SELECT DISTINCT upper(event_type) FROM events)")
def unknown_names(s, d):
    return validate.unknown_names(v.read(s, d, "events"), "event_type", "view,sleep")


@query("phase_reasons", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'other_phase' WHEN o_custkey % 3 = 0 THEN 'not_available' WHEN o_custkey % 5 = 0 THEN 'missing_signal' END AS skip_reason FROM orders""")
def phase_reasons(s, d):
    o = v.read(s, d, "orders")
    return validate.phase_reasons(o, F.col("o_orderstatus"), F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 5 != 0, "F").select("o_orderkey", "skip_reason")


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(s, d):
    return validate.duplicate_keys(v.read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("label_conflicts", """SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_labels FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def label_conflicts(s, d):
    return validate.label_conflicts(v.read(s, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("zero_variance", f"""WITH {v.SQL_FEATURES} SELECT * FROM (SELECT 'hc_qty' AS "column", stddev_pop(hc_qty) AS std FROM features UNION ALL SELECT 'hc_price', stddev_pop(hc_price) FROM features UNION ALL SELECT 'flat', stddev_pop(3.0::DOUBLE) FROM features) WHERE std = 0""")
def zero_variance(s, d):
    return validate.zero_variance(v.features(s, d).withColumn("flat", F.lit(3.0)), [*v.FEATURES, "flat"])


@query("representation", f"""WITH {v.SQL_FEATURES} SELECT trial, window_id, hc_price, hc_qty, nvg_disc, nvg_tax FROM features""")
def representation(s, d):
    f = v.features(s, d)
    fam = validate.family_columns(f, {"hc": "hc_", "nvg": "nvg_"}, {"hc": 2})
    return validate.representation(f, fam, ["hc", "nvg"], ["trial", "window_id"])


# --- scalars


@query("keys_and_hashes", f"""WITH {v.SQL_FEATURES}, k AS (SELECT subject, trial, window_id, condition, subject || '|' || CAST(trial AS VARCHAR) || '|' || condition AS trial_id FROM features)
SELECT trial_id, trial_id || '|w' || CAST(window_id AS VARCHAR) AS sample_id, coalesce(nullif(regexp_replace(regexp_replace(trial_id, '[^A-Za-z0-9._+-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), ''), 'run') AS token,
CAST('0x' || substr(sha256(trial_id), 1, 8) AS BIGINT) AS seed, substr(sha256(condition), 1, 12) AS print FROM k""")
def keys_and_hashes(s, d):
    f = v.features(s, d).withColumn("trial_id", fn.trial_id(F.col("subject"), F.col("trial"), F.col("condition")))
    return f.select("trial_id", fn.sample_id(F.col("trial_id"), F.col("window_id")).alias("sample_id"), fn.safe_token(F.col("trial_id")).alias("token"), fn.stable_seed(F.col("subject"), F.col("trial"), F.col("condition")).alias("seed"), fn.fingerprint(F.col("condition")).alias("print"))


@query("encode_targets", f"""WITH {v.SQL_FEATURES} SELECT trial, window_id, CASE WHEN rating BETWEEN 1 AND 4 THEN 0 WHEN rating BETWEEN 6 AND 9 THEN 1 END AS "binary", CASE WHEN rating <= 3 THEN 0 WHEN rating <= 6 THEN 1 ELSE 2 END AS ternary,
rating - 1 AS multiclass, CAST(rating AS DOUBLE) AS regression FROM features""")
def encode_targets(s, d):
    f = v.features(s, d)
    return f.select("trial", "window_id", *[fn.encode_target(F.col("rating"), k).alias(k) for k in ("binary", "ternary", "multiclass", "regression")])


@query("setting_slugs", """SELECT DISTINCT 'w' || CAST(l_quantity AS INTEGER) || '_o' || CASE WHEN l_quantity % 2 = 0 THEN CAST(CAST(l_quantity / 2 AS INTEGER) AS VARCHAR) ELSE CAST(CAST(floor(l_quantity / 2) AS INTEGER) AS VARCHAR) || 'p5' END AS slug FROM lineitem""")
def setting_slugs(s, d):
    return v.read(s, d, "lineitem").select(fn.slug(F.col("l_quantity"), F.col("l_quantity") / 2).alias("slug")).distinct()


@query("score_vectors", f"""WITH {v.SQL_PREDICTIONS}, m AS (SELECT *, greatest(s0, s1, s2) AS g FROM pred) SELECT candidate_order, trial, window_id, y_pred AS best, round(exp(s0 - g) / (exp(s0 - g) + exp(s1 - g) + exp(s2 - g)), 6) AS first_share FROM m""")
def score_vectors(s, d):
    p = v.predictions(s, d)
    return p.select("candidate_order", "trial", "window_id", fn.argmax(F.col("scores")).alias("best"), F.round(fn.softmax(F.col("scores"))[0], 6).alias("first_share"))


# --- joins and sets


@query("paired_predictions", f"""WITH {v.SQL_FEATURES}, t AS MATERIALIZED (SELECT trial, window_id, CASE WHEN rating <= 3 THEN 0 WHEN rating <= 6 THEN 1 ELSE 2 END AS y_true FROM features),
a AS (SELECT trial, window_id, y_true FROM t WHERE trial % 10 <> 3), b AS (SELECT trial, window_id, CASE WHEN trial % 10 = 4 THEN y_true + 1 ELSE y_true END AS yt FROM t WHERE trial % 10 <> 5)
SELECT coalesce(a.trial, b.trial) AS trial, coalesce(a.window_id, b.window_id) AS window_id, CASE WHEN a.trial IS NULL OR b.trial IS NULL THEN 'incompatible_sample_sets' WHEN a.y_true <> b.yt THEN 'incompatible_true_labels' ELSE 'ok' END AS status
FROM a FULL JOIN b ON a.trial = b.trial AND a.window_id = b.window_id""")
def paired_predictions(s, d):
    p = v.predictions(s, d).select("candidate_order", "trial", "window_id", "y_true", "y_pred")
    a = p.filter("candidate_order = 0 and trial % 10 != 3").drop("candidate_order")
    b = p.filter("candidate_order = 1 and trial % 10 != 5").withColumn("y_true", F.col("y_true") + (F.col("trial") % 10 == 4).cast("int")).drop("candidate_order")
    return align.paired(a, b, ["trial", "window_id"]).select("trial", "window_id", "status")


@query("missing_expected", """WITH t AS (SELECT DISTINCT user_id AS subject, event_type AS condition FROM events), w AS (SELECT * FROM t, (SELECT unnest(['STIMULUS', 'WASHOUT']) AS phase) WHERE NOT (condition = 'signup' AND phase = 'WASHOUT'))
SELECT subject, condition, phase FROM w WHERE NOT (phase = 'WASHOUT' AND subject % 2 = 0)""")
def missing_expected(s, d):
    t = v.read(s, d, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("condition")).distinct()
    files = t.filter("subject % 2 = 0").withColumn("phase", F.lit("WASHOUT"))
    return align.missing_expected(t, files, ["subject", "condition"], "condition", ["STIMULUS", "WASHOUT"], baseline="signup")


@query("orphans", """SELECT DISTINCT o_custkey AS key, 'left' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL
SELECT c_custkey, 'right' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphans(s, d):
    return align.orphans(v.read(s, d, "orders").select(F.col("o_custkey").alias("key")), v.read(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key")), ["key"])


@query("common_trials", f"""WITH {v.SQL_INPUTS} SELECT DISTINCT trial FROM inputs WHERE input_id = 'a' INTERSECT SELECT DISTINCT trial FROM inputs WHERE input_id = 'b'""")
def common_trials(s, d):
    i = v.inputs(s, d)
    return align.common_trials([i.filter(F.col("input_id") == x) for x in "ab"], ["trial"])


@query("label_disagreements", f"""WITH {v.SQL_INPUTS}, a AS (SELECT trial, max(rating) AS a FROM inputs WHERE input_id = 'a' GROUP BY 1), b AS (SELECT trial, max(CASE WHEN trial % 9 = 0 THEN rating + 1 ELSE rating END) AS b FROM inputs WHERE input_id = 'b' GROUP BY 1)
SELECT trial, a, b FROM a JOIN b USING (trial) WHERE abs(a - b) > 1e-8 + 1e-5 * abs(b)""")
def label_disagreements(s, d):
    i = v.inputs(s, d)
    b = i.filter("input_id = 'b'").withColumn("rating", F.col("rating") + (F.col("trial") % 9 == 0).cast("int"))
    return align.label_disagreements(i.filter("input_id = 'a'"), b, ["trial"], "rating")


@query("expand_candidates", f"""WITH {v.SQL_INPUTS}, i AS (SELECT DISTINCT input_id FROM inputs), t AS (SELECT * FROM (VALUES (0, '*', 'rf'), (1, 'b', 'svm'), (2, '*', 'knn')) t(o, input_id, model))
SELECT row_number() OVER (ORDER BY t.o, i.input_id) AS candidate_order, i.input_id, t.model FROM t JOIN i ON t.input_id = '*' OR t.input_id = i.input_id""")
def expand_candidates(s, d):
    t = s.createDataFrame([(0, "*", "rf"), (1, "b", "svm"), (2, "*", "knn")], "template_order int, input_id string, model string")
    i = v.inputs(s, d).select("input_id").distinct().withColumn("input_order", F.col("input_id"))
    return align.expand_candidates(t, i).withColumn("candidate_order", F.col("candidate_order").cast("long"))


@query("latest_results", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_results(s, d):
    return align.latest(v.read(s, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("unfinished_work", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def unfinished_work(s, d):
    done = v.read(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return align.unfinished(v.read(s, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("append_results", """SELECT o_orderkey AS id, o_totalprice AS price, CAST(NULL AS DOUBLE) AS tax FROM orders UNION ALL SELECT l_orderkey, CAST(NULL AS DOUBLE), l_tax FROM lineitem""")
def append_results(s, d):
    return align.append(v.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), v.read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_tax").alias("tax")))


# --- trials and reports


@query("trial_table", f"""WITH {v.SQL_FEATURES} SELECT subject, trial, max(rating) AS rating, round(avg(hc_qty), 6) AS hc_qty__mean, round(stddev_pop(hc_qty), 6) AS hc_qty__std, round(avg(nvg_tax), 6) AS nvg_tax__mean, round(stddev_pop(nvg_tax), 6) AS nvg_tax__std, -1 AS window_id FROM features GROUP BY ALL""")
def trial_table(s, d):
    t = trials.trial_table(v.features(s, d), TRIAL, ["hc_qty", "nvg_tax"], ["rating"])
    return t.select("subject", "trial", "rating", *f6("hc_qty__mean", "hc_qty__std", "nvg_tax__mean", "nvg_tax__std"), "window_id")


SQL_COMPLETE = v.SQL_INPUTS + """, c AS (SELECT subject, count(DISTINCT trial) FILTER (WHERE input_id = 'a') AS a, count(DISTINCT trial) FILTER (WHERE input_id = 'b') AS b FROM inputs GROUP BY ALL)"""


@query("completeness", f"""WITH {SQL_COMPLETE}, lim AS (SELECT CAST(floor(avg(b)) AS BIGINT) AS n FROM c) SELECT subject, a AS trials__a, b AS trials__b, least(a, b) AS minimum_observed_trials, least(a, b) >= 100 AS eligible, CASE WHEN least(a, b) < 100 THEN 'too_few_trials' END AS exclusion_reason FROM c""")
def completeness(s, d):
    return trials.completeness(v.inputs(s, d), "subject", "trial", "input_id", ["a", "b"], 100)


@query("eligibility_report", f"""WITH {v.SQL_INPUTS}, k AS (SELECT * FROM inputs WHERE rating >= 5) SELECT input_id, b.*, a.* FROM (SELECT input_id AS i, count(*) AS rows_before, count(DISTINCT trial) AS trials_before, count(DISTINCT subject) AS subjects_before FROM inputs GROUP BY 1) b
JOIN (SELECT input_id, count(*) AS rows_after, count(DISTINCT trial) AS trials_after, count(DISTINCT subject) AS subjects_after FROM k GROUP BY 1) a ON a.input_id = b.i""".replace("SELECT input_id, b.*, a.*", "SELECT a.input_id, rows_before, trials_before, subjects_before, rows_after, trials_after, subjects_after"))
def eligibility_report(s, d):
    i = v.inputs(s, d)
    return trials.eligibility_report(i, i.filter("rating >= 5"), "subject", "trial", "input_id")


@query("single_values", """SELECT CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS l_linestatus, max(one) AS one FROM (SELECT *, 60.0::DOUBLE AS one FROM lineitem)""")
def single_values(s, d):
    return trials.single_value(v.read(s, d, "lineitem").withColumn("one", F.lit(60.0)), ["l_linestatus", "one"])


@query("class_distribution", f"""WITH {v.SQL_FEATURES}, f AS (SELECT *, CASE WHEN rating BETWEEN 1 AND 4 THEN 0 WHEN rating BETWEEN 6 AND 9 THEN 1 END AS code FROM features), t AS (SELECT trial, max(rating) AS rating, max(code) AS code FROM f GROUP BY 1)
SELECT 'sample' AS level, 'raw' AS stage, CAST(rating AS VARCHAR) AS label, count(*) AS count FROM f GROUP BY rating UNION ALL SELECT 'sample', 'encoded', CAST(code AS VARCHAR), count(*) FROM f WHERE code IS NOT NULL GROUP BY code
UNION ALL SELECT 'trial', 'raw', CAST(rating AS VARCHAR), count(*) FROM t GROUP BY rating UNION ALL SELECT 'trial', 'encoded', CAST(code AS VARCHAR), count(*) FROM t WHERE code IS NOT NULL GROUP BY code""")
def class_distribution(s, d):
    f = v.features(s, d).withColumn("code", fn.encode_target(F.col("rating"), "binary"))
    return trials.class_distribution(f, ["trial"], {"raw": "rating", "encoded": "code"})


@query("audit_counts", """SELECT event_type AS category, CAST(sum(user_id) AS BIGINT) AS total, count(*) AS entries FROM events GROUP BY 1""")
def audit_counts(s, d):
    return trials.audit(v.read(s, d, "events"), "event_type", "user_id").withColumnRenamed("event_type", "category")


@query("parameter_stability", """WITH p AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY user_id) AS folds, count(*) OVER (PARTITION BY user_id) AS sets FROM p)
SELECT user_id, event_type, n, round(n / folds, 6) AS share, sets FROM r WHERE k = 1""")
def parameter_stability(s, d):
    return trials.stability(v.read(s, d, "events"), ["user_id"], "event_type", "event_id").withColumn("share", F.round("share", 6))


@query("tree_digest", """WITH f AS (SELECT c_name AS path, sha256(c_name) AS sha FROM customer) SELECT count(*) AS files, sha256(string_agg(sha || '  ' || path || chr(10), '' ORDER BY path)) AS digest FROM f""")
def tree_digest(s, d):
    return trials.tree_digest(v.read(s, d, "customer").select(F.col("c_name").alias("path"), F.sha2("c_name", 256).alias("sha")))


@query("natural_order", """WITH s AS (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END AS subject FROM customer)
SELECT subject, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(subject, '\\d+') THEN 0 ELSE 1 END, try_cast(subject AS BIGINT), subject) AS place FROM s""")
def natural_order(s, d):
    from pyspark.sql.window import Window

    c = v.read(s, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string")).alias("subject")).distinct()
    return c.withColumn("place", F.row_number().over(Window.orderBy(*fn.natural_order(F.col("subject")))).cast("long"))


@query("best_parameters", """SELECT subject, parameter_index, utility FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY utility DESC, parameter_index) AS n FROM (SELECT o_custkey % 20 AS subject, o_orderkey AS parameter_index, CAST(o_custkey % 13 AS DOUBLE) AS utility FROM orders)) WHERE n = 1""")
def best_parameters(s, d):
    o = v.read(s, d, "orders").select((F.col("o_custkey") % 20).alias("subject"), F.col("o_orderkey").alias("parameter_index"), (F.col("o_custkey") % 13).cast("double").alias("utility"))
    return models.best_parameters(o, ["subject"])


@query("ranks", """SELECT l_orderkey, l_partkey, l_quantity, rank() OVER w AS rank_min, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rank_avg FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def ranks(s, d):
    line = v.read(s, d, "lineitem")
    r = windows.ranked(windows.ranked(line, ["l_returnflag"], "l_quantity", name="rank_min"), ["l_returnflag"], "l_quantity", name="rank_avg", kind="average")
    return r.select("l_orderkey", "l_partkey", "l_quantity", F.col("rank_min").cast("long").alias("rank_min"), "rank_avg")


@query("holm", """WITH p AS (SELECT o_orderkey AS id, o_custkey % 300 AS family, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 1e7 END AS p FROM orders),
r AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1)) AS raw FROM p WHERE p IS NOT NULL)
SELECT id, family, round(max(raw) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM r UNION ALL SELECT id, family, NULL FROM p WHERE p IS NULL""")
def holm(s, d):
    o = v.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 300).alias("family"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice") / 1e7).alias("p"))
    return windows.holm(o, ["family"]).select("id", "family", F.round("p_holm", 9).alias("p_holm"))


@query("first_rows", """SELECT l_orderkey, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def first_rows(s, d):
    return series.first_rows(v.read(s, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_partkey", "l_returnflag")



@query("spearman_matrix", f"""WITH {v.SQL_FEATURES}, r AS (SELECT rank() OVER (ORDER BY hc_qty) + (count(*) OVER (PARTITION BY hc_qty) - 1) / 2 AS a, rank() OVER (ORDER BY hc_price) + (count(*) OVER (PARTITION BY hc_price) - 1) / 2 AS b,
rank() OVER (ORDER BY nvg_disc) + (count(*) OVER (PARTITION BY nvg_disc) - 1) / 2 AS c FROM features) SELECT 'hc_qty' AS feature_a, 'hc_price' AS feature_b, round(corr(a, b), 6) AS spearman_rho, true AS same_family FROM r
UNION ALL SELECT 'hc_qty', 'nvg_disc', round(corr(a, c), 6), false FROM r UNION ALL SELECT 'hc_price', 'nvg_disc', round(corr(b, c), 6), false FROM r""")
def spearman_matrix(s, d):
    m = reports.spearman_matrix(v.features(s, d), ["hc_qty", "hc_price", "nvg_disc"])
    return m.select("feature_a", "feature_b", F.round("spearman_rho", 6).alias("spearman_rho"), "same_family")


@query("high_correlations", f"""WITH {v.SQL_FEATURES}, r AS (SELECT rank() OVER (ORDER BY hc_price) + (count(*) OVER (PARTITION BY hc_price) - 1) / 2 AS b, rank() OVER (ORDER BY -3 * hc_price) + (count(*) OVER (PARTITION BY hc_price) - 1) / 2 AS c FROM features)
SELECT 'hc_price' AS feature_a, 'nvg_minus' AS feature_b, round(corr(b, c), 6) AS spearman_rho FROM r""")
def high_correlations(s, d):
    f = v.features(s, d).withColumn("nvg_minus", -3 * F.col("hc_price"))
    h = reports.high_correlations(reports.spearman_matrix(f, ["hc_qty", "hc_price", "nvg_minus"]))
    return h.select("feature_a", "feature_b", F.round("spearman_rho", 6).alias("spearman_rho"))


# --- model inputs


@query("impute_median", f"""WITH {v.SQL_FEATURES}, g AS (SELECT *, CASE WHEN trial % 5 <> 0 THEN hc_qty END AS q FROM features), m AS (SELECT median(q) AS m FROM g WHERE subject <> '7')
SELECT trial, window_id, coalesce(q, m) AS hc_qty, 0.0::DOUBLE AS nothing FROM g, m""")
def impute_median(s, d):
    f = v.features(s, d).select("subject", "trial", "window_id", F.when(F.col("trial") % 5 != 0, F.col("hc_qty")).alias("hc_qty"), F.lit(None).cast("double").alias("nothing"))
    return prepare.impute_median(f, f.filter("subject != '7'"), ["hc_qty", "nothing"]).drop("subject")


@query("standardise", f"""WITH {v.SQL_FEATURES}, m AS (SELECT avg(hc_price) AS mu, stddev_pop(hc_price) AS sd FROM features WHERE subject <> '7') SELECT trial, window_id, round((hc_price - mu) / sd, 6) AS hc_price, 0.0::DOUBLE AS flat FROM features, m""")
def standardise(s, d):
    f = v.features(s, d).select("subject", "trial", "window_id", "hc_price", F.lit(2.0).alias("flat"))
    return prepare.standardise(f, f.filter("subject != '7'"), ["hc_price", "flat"]).select("trial", "window_id", F.round("hc_price", 6).alias("hc_price"), "flat")


@query("class_weights", f"""WITH {v.SQL_FEATURES}, c AS (SELECT rating, count(*) AS n FROM features GROUP BY 1), t AS (SELECT sum(n) AS a, count(*) AS k FROM c) SELECT rating, round(a / (k * n), 6) AS weight, n FROM c, t""")
def class_weights(s, d):
    w = prepare.class_weights(v.features(s, d), "rating")
    return w.groupBy("rating").agg(F.round(F.max("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


@query("loso_folds", f"""WITH {v.SQL_FEATURES} SELECT CAST(row_number() OVER (ORDER BY CAST(subject AS BIGINT)) - 1 AS INTEGER) AS fold, subject AS test_subject FROM (SELECT DISTINCT subject FROM features)""")
def loso_folds(s, d):
    return prepare.loso_folds(v.features(s, d), "subject").select("fold", "test_subject")


@query("fold_rows", f"""WITH {v.SQL_FEATURES}, t AS (SELECT DISTINCT subject, trial FROM features), f AS (SELECT row_number() OVER (ORDER BY CAST(subject AS BIGINT)) - 1 AS fold, subject AS test_subject FROM (SELECT DISTINCT subject FROM features)), c AS (SELECT subject, count(*) AS n FROM t GROUP BY 1)
SELECT fold, c.subject = test_subject AS is_test, CAST(sum(n) AS BIGINT) AS n FROM c, f GROUP BY ALL""")
def fold_rows(s, d):
    t = v.features(s, d).select(*TRIAL).distinct()
    rows = prepare.fold_rows(t, prepare.loso_folds(t, "subject"), "subject")
    return rows.groupBy(F.col("fold").cast("long").alias("fold"), "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("hashed_folds", f"""WITH {v.SQL_FEATURES} SELECT subject, CAST((row_number() OVER (ORDER BY CAST('0x' || substr(sha256('folds|' || subject), 1, 8) AS BIGINT), subject) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT subject FROM features)""")
def hashed_folds(s, d):
    return prepare.hashed_folds(v.features(s, d), "subject", 5)


@query("split_plan", f"""WITH {v.SQL_FEATURES}, s AS (SELECT row_number() OVER (ORDER BY CAST(subject AS BIGINT)) - 1 AS o, subject FROM (SELECT DISTINCT subject FROM features)),
p AS (SELECT a.o AS outer_fold, a.subject AS test_subject, b.subject, (row_number() OVER (PARTITION BY a.o ORDER BY CAST('0x' || substr(sha256('inner|' || a.subject || '|' || b.subject), 1, 8) AS BIGINT), b.subject) - 1) % 3 AS inner_fold FROM s a JOIN s b ON a.subject <> b.subject)
SELECT outer_fold, test_subject, substr(sha256(test_subject || '|' || string_agg(subject || ':' || inner_fold, ',' ORDER BY subject)), 1, 12) AS fingerprint FROM p GROUP BY outer_fold, test_subject""")
def split_plan(s, d):
    plan = prepare.plan_fingerprints(prepare.split_plan(v.features(s, d), "subject"))
    return plan.select(F.col("outer_fold").cast("long").alias("outer_fold"), "test_subject", "fingerprint")


@query("greedy_folds")
def greedy_folds(s, d):
    """Stratified subject folds; the tests check that they keep subjects whole and classes complete."""
    f = v.features(s, d).withColumn("code", fn.encode_target(F.col("rating"), "ternary"))
    return prepare.greedy_folds(s, f, "subject", 5, "code")


@query("stopping_holdout", f"""WITH {v.SQL_FEATURES}, s AS (SELECT subject, row_number() OVER (ORDER BY CAST('0x' || substr(sha256('stop|' || subject), 1, 8) AS BIGINT), subject) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM features))
SELECT subject, n >= 3 AND k <= greatest(1, round(n * 0.2)) AS is_holdout FROM s""")
def stopping_holdout(s, d):
    return prepare.stopping_holdout(v.features(s, d), "subject").select("subject", "is_holdout").distinct()


@query("sensor_nodes", f"""WITH {v.SQL_FEATURES} SELECT trial, window_id, hc_qty AS bvp_mean, nvg_tax AS eda_edges, 1.0::DOUBLE AS bvp_there, 0.0::DOUBLE AS temp_there FROM features""")
def sensor_nodes(s, d):
    f = v.features(s, d).select("trial", "window_id", F.col("hc_qty").alias("hc_ppg_mean"), F.col("hc_price").alias("hc_skt_mean"), F.col("nvg_tax").alias("nvg_eda_edges"))
    n = prepare.sensor_nodes(f, ["hc_ppg_mean", "hc_skt_mean", "nvg_eda_edges"])
    return n.select("trial", "window_id", F.col("nodes")[0][0].alias("bvp_mean"), F.col("nodes")[1][1].alias("eda_edges"), F.col("nodes")[0][2].alias("bvp_there"), F.col("nodes")[2][3].alias("temp_there"))


SQL_KNN = """e AS (SELECT vec_id, embedding AS x, CAST(label AS DOUBLE) AS y, vec_id % 10 AS subject FROM embeddings), pr AS (SELECT t.vec_id AS test_id, r.vec_id AS train_id, r.y, t.subject = r.subject AS own,
sqrt(list_sum(list_transform(list_zip(t.x, r.x), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))) AS distance FROM e t, e r WHERE t.vec_id % 50 = 0)"""


def _vectors(s, d):
    e = v.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 10).alias("subject"))
    return e, e.filter("id % 50 = 0")


@query("nearest_neighbours", f"""WITH {SQL_KNN} SELECT test_id, train_id, round(distance, 5) AS distance, row_number() OVER (PARTITION BY test_id ORDER BY distance, train_id) AS rank FROM pr QUALIFY rank <= 5""")
def nearest_neighbours(s, d):
    """The query set, every vector whose id 50 divides, against all vectors."""
    n = models.nearest(*_vectors(s, d), 5)
    return n.select("test_id", "train_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("neighbours_by_cells", f"""WITH {SQL_KNN} SELECT test_id, train_id, round(distance, 5) AS distance, row_number() OVER (PARTITION BY test_id ORDER BY distance, train_id) AS rank FROM pr QUALIFY rank <= 5""")
def neighbours_by_cells(s, d):
    """The same rows by pivots and bounds."""
    n = models.nearest_by_cells(*_vectors(s, d), 5)
    return n.select("test_id", "train_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("neighbour_votes", f"""WITH {SQL_KNN}, nb AS (SELECT * FROM pr WHERE NOT own QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY distance, train_id) <= 5), vt AS (SELECT test_id, y, round(sum(1 / distance), 9) AS votes FROM nb GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY votes DESC, y) AS n FROM vt), m AS (SELECT test_id, avg(y) AS m FROM nb GROUP BY 1) SELECT test_id, y AS y_pred, round(m, 6) AS y_mean FROM b JOIN m USING (test_id) WHERE n = 1""")
def neighbour_votes(s, d):
    """The query set against all vectors of other subjects, as in leave-one-subject-out folds."""
    n = models.nearest(*_vectors(s, d), 5, apart="subject")
    mean = models.neighbour_vote(n, "uniform", True).withColumnRenamed("y_pred", "y_mean")
    return models.neighbour_vote(n, "distance").join(mean, "test_id").select("test_id", "y_pred", F.round("y_mean", 6).alias("y_mean"))


@query("fourier_features", f"""WITH {v.SQL_FEATURES}, u AS (SELECT i, j, greatest(CAST('0x' || substr(sha256('rff|' || i || '|' || j || '|r'), 1, 8) AS BIGINT) / 4294967296.0, 1e-9) AS r, greatest(CAST('0x' || substr(sha256('rff|' || i || '|' || j || '|a'), 1, 8) AS BIGINT) / 4294967296.0, 1e-9) AS a
FROM (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)), n AS (SELECT i, j, sqrt(-2 * ln(r)) * cos(2 * pi() * a) AS w FROM u), b AS (SELECT i, greatest(CAST('0x' || substr(sha256('rff|' || i || '|b'), 1, 8) AS BIGINT) / 4294967296.0, 1e-9) AS b FROM (SELECT unnest([0, 1]) AS i)),
p AS (SELECT i, sum(CASE WHEN j = 0 THEN w END) AS w0, sum(CASE WHEN j = 1 THEN w END) AS w1, max(b) AS b FROM n JOIN b USING (i) GROUP BY i),
x AS (SELECT trial, window_id, i, cos(nvg_disc * w0 * sqrt(2 * 0.5) + nvg_tax * w1 * sqrt(2 * 0.5) + 2 * pi() * b) AS c FROM features, p)
SELECT trial, window_id, round(max(CASE WHEN i = 0 THEN c END), 6) AS z0, round(max(CASE WHEN i = 1 THEN c END), 6) AS z1 FROM x GROUP BY ALL""")
def fourier_features(s, d):
    f = models.fourier_features(v.features(s, d), ["nvg_disc", "nvg_tax"], 2, 0.5)
    return f.select("trial", "window_id", F.round(F.col("fourier")[0], 6).alias("z0"), F.round(F.col("fourier")[1], 6).alias("z1"))


def _trial_rows(s, d):
    t = trials.trial_table(v.features(s, d), TRIAL, v.FEATURES, ["rating"])
    return t.withColumns({"y": fn.encode_target(F.col("rating"), "binary").cast("double"), "id": F.col("trial")}).filter("y is not null"), [f"{f}__{k}" for f in v.FEATURES for k in ("mean", "std")]


def _out_of_fold(s, d, name, folds=2, **p):
    """Predictions of all trials, each by a model that was fitted without its subject, over hashed subject folds."""
    t, cols = _trial_rows(s, d)
    t = t.join(F.broadcast(prepare.hashed_folds(t, "subject", folds)), "subject").persist()
    parts = [models.fit_predict(t.filter(F.col("fold") != f), t.filter(F.col("fold") == f), cols, name, 2, **p) for f in range(folds)]
    return align.append(*parts).select("subject", "trial", "fold", "y", "y_pred", F.col("scores")[1].alias("score"))


@query("forest_fold")
def forest_fold(s, d):
    """The forest's out-of-fold predictions of all trials; 60 trees of depth 10 stand for the grid's 300 of depth 12 or 30."""
    return _out_of_fold(s, d, "rf", trees=60, max_depth=10)


@query("boosted_trees")
def boosted_trees(s, d):
    """Boosted trees, likewise; 20 rounds at depth 3 stand for the grid's 250 and 450."""
    return _out_of_fold(s, d, "boost", rounds=20, depth=3, rate=0.08)


@query("perceptron")
def perceptron(s, d):
    """The multilayer perceptron with repeated rows of the smaller class, likewise."""
    return _out_of_fold(s, d, "mlp", rounds=40, hidden=(16,))


@query("rbf_machine")
def rbf_machine(s, d):
    """The hinge-loss machine on Fourier features, likewise."""
    return _out_of_fold(s, d, "svm", rounds=10, cost=1.0, gamma="scale", directions=32)


def _trial_vectors(s, d, features=v.FEATURES):
    rows = v.features(s, d).withColumn("y", fn.encode_target(F.col("rating"), "binary")).filter("y is not null")
    return nested.trial_vectors(rows, TRIAL, features, "y"), prepare.split_plan(rows, "subject")


#: Smaller searches than `folded_trees.FOREST_GRID` and BOOST_GRID.
FORESTS = [{"trees": 4, "max_depth": d, "min_leaf": 3} for d in (3, 5)]
BOOSTS = [{"rounds": r, "depth": 2, "rate": 0.3} for r in (2, 4)]


def _nested(s, d):
    """Predictions and inner scores of all candidates."""
    found, scores = [], []
    fits = [
        (["hc_qty", "hc_price"], lambda t, p: kernels.nested_rbf(t, p, models.grid("svm"), 2)),
        (v.FEATURES, lambda t, p: kernels.nested_rbf(t, p, models.grid("svm"), 2)),
        (v.FEATURES, lambda t, p: folded_trees.nested_trees(t, p, FORESTS, 2, "rf")),
        (v.FEATURES, lambda t, p: folded_trees.nested_trees(t, p, BOOSTS, 2, "boost")),
    ]
    for order, (features, fit) in enumerate(fits):
        one, inner = fit(*_trial_vectors(s, d, features))
        found.append(one.withColumn("candidate_order", F.lit(order)))
        scores.append(inner.withColumn("candidate_order", F.lit(order)))
    return align.append(*found), align.append(*scores)


@query("nested_selection")
def nested_selection(s, d):
    """All leave-one-subject-out folds of four candidates (least-squares machines on two representations, forests, boosted trees) over all windows, each with the parameters that its
    inner folds choose, rolled up to trials; the tests hold each fit against plain loops. Trees are fewer than in the whole search."""
    return _nested(s, d)[0].select("candidate_order", "outer_fold", "parameter_index", "subject", "trial", "y_true", "y_pred", "source_sample_count", F.round(F.element_at("scores", -1), 6).alias("score"))


@query("inner_scores")
def inner_scores(s, d):
    """Utility of every parameter set of the least-squares candidate in every outer fold, and which was chosen."""
    return kernels.nested_rbf(*_trial_vectors(s, d), models.grid("svm"), 2)[1].select("outer_fold", "parameter_index", "utility", "chosen")


@query("nested_support_vectors")
def nested_support_vectors(s, d):
    """Support vector machines with hinge loss in all leave-one-subject-out folds, two costs; a machine stops at a proven gap of 5 % or after 16 passes."""
    found = hinge.nested_hinge(*_trial_vectors(s, d), [{"cost": c, "gamma": "scale"} for c in (0.1, 1.0)], 2, landmarks=24, gap=0.05, passes=16)[0]
    return found.select("outer_fold", "parameter_index", "subject", "trial", "y_true", "y_pred", "source_sample_count", F.round(F.col("scores")[0], 6).alias("score"))


@query("nested_perceptrons")
def nested_perceptrons(s, d):
    """Perceptrons that stop early on held-out training subjects in all leave-one-subject-out folds; at most 10 epochs of small networks stand for the whole search."""
    found = networks.nested_perceptrons(*_trial_vectors(s, d), [{"hidden": (8,), "alpha": 0.001, "rate": r} for r in (0.1, 0.03)], 2, epochs=10, patience=3)[0]
    return found.select("outer_fold", "parameter_index", "subject", "trial", "y_true", "y_pred", "source_sample_count", F.round(F.col("scores")[1], 6).alias("score"))


@query("stored_model_scores")
def stored_model_scores(s, d):
    """Every window by the stored forest of the fold that holds its subject out: fitted, written as a version, read back and applied."""
    kept = []
    folded_trees.nested_trees(*_trial_vectors(s, d), FORESTS[:1], 2, "rf", keep=kept)
    path = versions.scratch(s, "models")
    versions.write_version(stored_models.model_table(s, stored_models.exported(kept, 0, v.FEATURES)), path)
    found = stored_models.score_models(v.features(s, d), versions.read_version(s, path), ["subject", "trial", "window_id"], "subject")
    return found.select("subject", "trial", "window_id", "outer_fold", "y_pred", F.round(F.col("scores")[1], 6).alias("score"))


# --- evaluation


SQL_TRIALS = v.SQL_PREDICTIONS + """, tr AS (SELECT candidate_order, subject, trial, max(y_true) AS y_true, avg(s0) AS a0, avg(s1) AS a1, avg(s2) AS a2, count(*) AS n FROM pred GROUP BY ALL),
tp AS (SELECT candidate_order, subject, trial, y_true, n, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS y_pred FROM tr)"""


def _rolled(s, d):
    return evaluate.roll_up(v.predictions(s, d), ["candidate_order", *TRIAL], 3)


@query("roll_up", f"""WITH {SQL_TRIALS} SELECT candidate_order, subject, trial, y_true, y_pred, n AS source_sample_count FROM tp""")
def roll_up(s, d):
    return _rolled(s, d).select("candidate_order", *TRIAL, "y_true", "y_pred", "source_sample_count")


@query("majority_roll_up", f"""WITH {v.SQL_PREDICTIONS}, c AS (SELECT candidate_order, trial, y_pred, count(*) AS n FROM pred GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY candidate_order, trial ORDER BY n DESC, y_pred) AS k FROM c) SELECT candidate_order, trial, y_pred FROM r WHERE k = 1""")
def majority_roll_up(s, d):
    return evaluate.roll_up(v.predictions(s, d), ["candidate_order", "trial"], 3, score=None).select("candidate_order", "trial", "y_pred")


@query("decision_roll_up", f"""WITH {v.SQL_FEATURES} SELECT trial, round(avg(hc_price - 40000), 4) AS y_score, CASE WHEN avg(hc_price - 40000) >= 0 THEN 1 ELSE 0 END AS y_pred FROM features GROUP BY 1""")
def decision_roll_up(s, d):
    f = v.features(s, d).select("trial", (F.col("rating") > 5).cast("int").alias("y_true"), (F.col("hc_price") - 40000).alias("decision"))
    return evaluate.decision_roll_up(f, ["trial"]).select("trial", F.round("y_score", 4).alias("y_score"), "y_pred")


SQL_MATRIX = SQL_TRIALS + """, grid AS (SELECT * FROM (SELECT DISTINCT candidate_order FROM tp), (SELECT unnest([0, 1, 2]) AS y_true), (SELECT unnest([0, 1, 2]) AS y_pred)),
mx AS (SELECT candidate_order, y_true, y_pred, coalesce(n, 0) AS n FROM grid LEFT JOIN (SELECT candidate_order, y_true, y_pred, count(*) AS n FROM tp GROUP BY ALL) USING (candidate_order, y_true, y_pred)),
pc AS (SELECT a.candidate_order, a.label, support, hits, predicted, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM (SELECT candidate_order, y_true AS label, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS hits FROM mx GROUP BY ALL) a
JOIN (SELECT candidate_order, y_pred AS label, sum(n) AS predicted FROM mx GROUP BY ALL) b USING (candidate_order, label)), pf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pc)"""


@query("confusion", f"""WITH {SQL_MATRIX} SELECT * FROM mx""")
def confusion(s, d):
    return evaluate.confusion(_rolled(s, d), ["candidate_order"], [0, 1, 2])


@query("class_metrics", f"""WITH {SQL_MATRIX} SELECT candidate_order, label, CAST(support AS BIGINT) AS support, CAST(hits AS BIGINT) AS hits, CAST(predicted AS BIGINT) AS predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM pf""")
def class_metrics(s, d):
    m = evaluate.class_metrics(evaluate.confusion(_rolled(s, d), ["candidate_order"], [0, 1, 2]), ["candidate_order"])
    return m.select("candidate_order", "label", "support", "hits", "predicted", *f6("precision", "recall", "f1"))


@query("summary_metrics", f"""WITH {SQL_MATRIX} SELECT candidate_order, round(sum(hits) / sum(support), 6) AS accuracy, round(CASE WHEN min(support) > 0 THEN avg(r) END, 6) AS balanced_accuracy, round(avg(p), 6) AS precision_macro, round(avg(f), 6) AS f1_macro,
round((sum(hits) * sum(support) - sum(support * predicted))::DOUBLE / (sqrt((sum(support) ^ 2 - sum(predicted * predicted))::DOUBLE) * sqrt((sum(support) ^ 2 - sum(support * support))::DOUBLE)), 6) AS mcc FROM pf GROUP BY 1""")
def summary_metrics(s, d):
    m = evaluate.summary_metrics(evaluate.class_metrics(evaluate.confusion(_rolled(s, d), ["candidate_order"], [0, 1, 2]), ["candidate_order"]), ["candidate_order"])
    return m.select("candidate_order", *f6("accuracy", "balanced_accuracy", "precision_macro", "f1_macro", "mcc"))


@query("roc_auc", f"""WITH {v.SQL_BINARY}, r AS (SELECT subject, y_true, rank() OVER (PARTITION BY subject ORDER BY score) + (count(*) OVER (PARTITION BY subject, score) - 1) / 2 AS k FROM labelled),
a AS (SELECT subject, sum(CASE WHEN y_true = 1 THEN k END) AS s, sum(y_true) AS p, sum(1 - y_true) AS q FROM r GROUP BY 1) SELECT subject, round(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) END, 6) AS roc_auc FROM a""")
def roc_auc(s, d):
    return evaluate.roc_auc(v.binary_scores(s, d), ["subject"]).select("subject", F.round("roc_auc", 6).alias("roc_auc"))


@query("average_precision", f"""WITH {v.SQL_BINARY}, g AS (SELECT score, sum(y_true) AS pos, count(*) AS n FROM labelled GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM c""")
def average_precision(s, d):
    return evaluate.average_precision(v.binary_scores(s, d), []).select(F.round("average_precision", 6).alias("average_precision"))


SQL_REG = v.SQL_FEATURES + ", rg AS (SELECT subject, trial, CAST(max(rating) AS DOUBLE) AS y_true, 1 + avg(hc_price) / 10000 AS y_pred FROM features GROUP BY ALL)"


def _numbers(s, d):
    return v.features(s, d).groupBy(*TRIAL).agg(F.max("rating").cast("double").alias("y_true"), (1 + F.avg("hc_price") / 10000).alias("y_pred"))


@query("regression_metrics", f"""WITH {SQL_REG}, r AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY y_true) + (count(*) OVER (PARTITION BY subject, y_true) - 1) / 2 AS a, rank() OVER (PARTITION BY subject ORDER BY y_pred) + (count(*) OVER (PARTITION BY subject, y_pred) - 1) / 2 AS b FROM rg)
SELECT subject, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg((y_true - y_pred) ^ 2)), 6) AS rmse, round(1 - sum((y_true - y_pred) ^ 2) / nullif(var_pop(y_true) * count(*), 0), 6) AS r2, round(corr(a, b), 6) AS spearman_rho FROM r GROUP BY 1""")
def regression_metrics(s, d):
    return evaluate.regression_metrics(_numbers(s, d), ["subject"]).select("subject", *f6("mae", "rmse", "r2", "spearman_rho"))


@query("primary_score", f"""WITH {SQL_TRIALS}, p AS (SELECT candidate_order, subject, y_true, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END) AS r FROM tp GROUP BY ALL), c AS (SELECT candidate_order, y_true, avg(r) AS r FROM p GROUP BY ALL) SELECT candidate_order, round(avg(r), 6) AS "primary" FROM c GROUP BY 1""")
def primary_score(s, d):
    return evaluate.primary_score(_rolled(s, d), ["candidate_order"], "subject", 3).select("candidate_order", F.round("primary", 6).alias("primary"))


SQL_DRAWS = """subj AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM tp)), reps AS (SELECT unnest(range(0, 200)) AS rep), ks AS (SELECT DISTINCT i AS k, n FROM subj),
dr AS (SELECT rep, CAST('0x' || substr(sha256('bootstrap|' || rep || '|' || k), 1, 8) AS BIGINT) % n AS i FROM reps, ks), cp AS (SELECT rep, subject, count(*) AS copies FROM dr JOIN subj USING (i) GROUP BY ALL)"""


@query("bootstrap_intervals", f"""WITH {SQL_TRIALS}, {SQL_DRAWS}, ps AS (SELECT candidate_order, subject, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS h, sum(abs(y_true - y_pred)) AS e, count(*) AS n FROM tp GROUP BY ALL),
rp AS (SELECT candidate_order, rep, sum(h * copies) / sum(n * copies) AS acc, sum(e * copies) / sum(n * copies) AS mae FROM ps JOIN cp USING (subject) GROUP BY ALL)
SELECT candidate_order, round(quantile_cont(acc, 0.025), 6) AS accuracy_low, round(quantile_cont(acc, 0.975), 6) AS accuracy_high, round(quantile_cont(mae, 0.025), 6) AS mae_low, round(quantile_cont(mae, 0.975), 6) AS mae_high, count(acc) AS valid FROM rp GROUP BY 1""")
def bootstrap_intervals(s, d):
    b = resampling.bootstrap_accuracy(_rolled(s, d), ["candidate_order"], "subject", 200)
    return b.select("candidate_order", *f6("accuracy_low", "accuracy_high", "mae_low", "mae_high"), "valid")


def _candidates(s, d):
    """Four candidates: two models by two modes, from the distinct candidates of the predictions."""
    c = v.predictions(s, d).select("candidate_order").distinct()
    o = F.col("candidate_order")
    return c.select("candidate_order", F.lit("a").alias("input_id"), F.when(o % 2 == 0, "windowed").otherwise("aggregated").alias("mode"), F.lit("all").alias("representation"), F.when(o < 2, "rf").otherwise("svm").alias("model"))


@query("comparison_families", f"""WITH {v.SQL_PREDICTIONS}, c AS (SELECT DISTINCT candidate_order AS o FROM pred) SELECT 'models' AS comparison, 'a|' || CASE WHEN o % 2 = 0 THEN 'windowed' ELSE 'aggregated' END || '|all' AS family, o AS candidate_order FROM c
UNION ALL SELECT 'modes', 'a|all|' || CASE WHEN o < 2 THEN 'rf' ELSE 'svm' END, o FROM c""")
def comparison_families(s, d):
    return resampling.comparison_families(_candidates(s, d))


@query("test_count", f"""WITH {v.SQL_PREDICTIONS}, c AS (SELECT DISTINCT candidate_order AS o FROM pred), f AS (SELECT 'models' || o % 2 AS f, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'modes' || o // 2, count(*) FROM c GROUP BY 1) SELECT CAST(sum(n * (n - 1) / 2 * 2) AS BIGINT) AS tests FROM f""")
def test_count(s, d):
    return resampling.test_count(resampling.comparison_families(_candidates(s, d)), 2)


SQL_CONTRIB = SQL_TRIALS + """, pa AS (SELECT a.subject, a.trial, a.y_true, (CASE WHEN a.y_true = a.y_pred THEN 1.0::DOUBLE ELSE 0 END) - (CASE WHEN b.y_true = b.y_pred THEN 1 ELSE 0 END) AS hit FROM tp a JOIN tp b ON a.trial = b.trial AND a.candidate_order = 0 AND b.candidate_order = 3),
sl AS (SELECT subject, y_true, avg(hit) AS m FROM pa GROUP BY ALL), w AS (SELECT *, count(*) OVER (PARTITION BY y_true) AS s, (SELECT count(DISTINCT y_true) FROM sl) AS l FROM sl), cb AS (SELECT subject, sum(m / (l * s)) AS d FROM w GROUP BY 1)"""


def _contributions(s, d):
    p = _rolled(s, d)
    a, b = (p.filter(F.col("candidate_order") == i).select("subject", "trial", "y_true", "y_pred") for i in (0, 3))
    return resampling.contributions(align.paired(a, b, ["subject", "trial"]).withColumn("pair", F.lit(0)), ["pair"], "subject", "primary")


@query("contributions", f"""WITH {SQL_CONTRIB} SELECT subject, round(d, 9) AS d FROM cb""")
def contributions(s, d):
    return _contributions(s, d).select("subject", F.round("d", 9).alias("d"))


@query("sign_flip_test", f"""WITH {SQL_CONTRIB}, o AS (SELECT sum(d) AS obs FROM cb), r AS (SELECT unnest(range(0, 300)) AS rep), f AS (SELECT rep, sum(d * (1 - 2 * (CAST('0x' || substr(sha256('flip|' || rep || '|' || subject), 1, 8) AS BIGINT) % 2))) AS s FROM cb, r GROUP BY rep)
SELECT round(obs, 6) AS observed, round((count(*) FILTER (WHERE abs(s) + 2.220446049250313e-16 * greatest(1.0, abs(obs)) * 8 >= abs(obs)) + 1) / 301, 6) AS p FROM f, o GROUP BY obs""")
def sign_flip_test(s, d):
    return resampling.sign_flip_test(_contributions(s, d), ["pair"], "subject", 300).select(*f6("observed", "p"))


# --- importance


def _linear(df):
    return df.withColumn("y_pred", (F.col("hc_price") / 20000 + F.col("nvg_disc") * 10 + 0.0 * F.col("hc_qty")))


def _minus_error(df, keys):
    return df.groupBy(*keys).agg((-F.avg(F.abs(F.col("rating") - F.col("y_pred")))).alias("score"))


SQL_PERMUTED = v.SQL_FEATURES + """, rows AS (SELECT CAST(trial AS VARCHAR) || '|' || CAST(window_id AS VARCHAR) AS id, * FROM features), fe AS (SELECT unnest(['hc_price', 'nvg_disc']) AS feature), re AS (SELECT unnest([0, 1]) AS "repeat"),
wd AS (SELECT *, CASE WHEN feature = 'hc_price' THEN hc_price ELSE nvg_disc END AS val, row_number() OVER (PARTITION BY subject, feature, "repeat" ORDER BY id) AS own, row_number() OVER (PARTITION BY subject, feature, "repeat" ORDER BY CAST('0x' || substr(sha256('permute|' || feature || '|' || "repeat" || '|' || id), 1, 8) AS BIGINT), id) AS lend FROM rows, fe, re),
pm AS (SELECT a.subject, a.feature, a."repeat", a.rating, CASE WHEN a.feature = 'hc_price' THEN b.val ELSE a.hc_price END / 20000 + CASE WHEN a.feature = 'nvg_disc' THEN b.val ELSE a.nvg_disc END * 10 AS y_pred FROM wd a JOIN wd b ON a.subject = b.subject AND a.feature = b.feature AND a."repeat" = b."repeat" AND a.own = b.lend),
sc AS (SELECT subject, feature, "repeat", -avg(abs(rating - y_pred)) AS score FROM pm GROUP BY ALL), ba AS (SELECT subject, -avg(abs(rating - (hc_price / 20000 + nvg_disc * 10))) AS base FROM rows GROUP BY 1)"""


@query("permutation_importance", f"""WITH {SQL_PERMUTED} SELECT subject, feature, round(avg(base - score), 9) AS importance_mean, round(stddev_pop(base - score), 8) AS importance_std FROM sc JOIN ba USING (subject) GROUP BY ALL""")
def permutation_importance(s, d):
    """On the held-out fold of every subject, with a fixed linear scorer."""
    f = v.features(s, d).withColumn("id", F.concat_ws("|", "trial", "window_id"))
    p = reports.permutation_importance(f, "id", ["hc_price", "nvg_disc"], 2, _linear, _minus_error, ["subject"])
    return p.select("subject", "feature", F.round("importance_mean", 9).alias("importance_mean"), F.round("importance_std", 8).alias("importance_std"))


@query("importance_summary", """WITH x AS (SELECT event_type AS feature, user_id % 9 AS outer_fold, value FROM events), a AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s, count(DISTINCT outer_fold) AS folds FROM x GROUP BY 1) SELECT feature, round(m, 6) AS mean, round(s, 6) AS std, folds, rank() OVER (ORDER BY m DESC) AS rank FROM a""")
def importance_summary(s, d):
    e = v.read(s, d, "events").select(F.col("event_type").alias("feature"), (F.col("user_id") % 9).alias("outer_fold"), F.col("value").alias("importance_mean"))
    return reports.importance_summary(e, []).select("feature", *f6("mean", "std"), "folds", F.col("rank").cast("long").alias("rank"))


@query("attribution_ranks", """WITH x AS (SELECT event_type AS feature, length(event_type) AS feature_index, user_id % 9 AS fold, value - 100 AS value FROM events), a AS (SELECT fold, feature, feature_index, avg(abs(value)) AS m, avg(value) AS u FROM x GROUP BY ALL)
SELECT fold, feature, round(m, 6) AS mean_abs, round(u, 6) AS mean, row_number() OVER (PARTITION BY fold ORDER BY m DESC, feature_index) AS rank FROM a""")
def attribution_ranks(s, d):
    e = v.read(s, d, "events").select(F.col("event_type").alias("feature"), F.length("event_type").alias("feature_index"), (F.col("user_id") % 9).alias("fold"), (F.col("value") - 100).alias("value"))
    return reports.attribution_ranks(e, ["fold"]).select("fold", "feature", *f6("mean_abs", "mean"), F.col("rank").cast("long").alias("rank"))


SQL_SHAPLEY = v.SQL_FEATURES + """, rows AS (SELECT CAST(trial AS VARCHAR) || '|' || CAST(window_id AS VARCHAR) AS id, * FROM features), dr AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(sha256('background|' || id), 1, 8) AS BIGINT), id) AS k FROM rows QUALIFY k <= 2000),
bk AS (SELECT f.subject AS fold, b.hc_price, b.nvg_disc, row_number() OVER (PARTITION BY f.subject ORDER BY b.k) - 1 AS b FROM (SELECT DISTINCT subject FROM rows) f JOIN dr b ON b.subject <> f.subject QUALIFY row_number() OVER (PARTITION BY f.subject ORDER BY b.k) <= 100),
sh AS (SELECT r.subject, r.id, r.hc_price AS p, r.nvg_disc AS q, k.hc_price AS bp, k.nvg_disc AS bq FROM rows r, (SELECT unnest([0, 1, 2]) AS round) n, bk k WHERE k.fold = r.subject AND k.b = CAST('0x' || substr(sha256('shapley|' || r.id || '|' || round), 1, 8) AS BIGINT) % 100),
sv AS (SELECT subject, id, avg((p - bp) / 20000) AS hc_price, avg((q - bq) * 10) AS nvg_disc, 0.0::DOUBLE AS hc_qty FROM sh GROUP BY ALL)"""


def _shapley(s, d):
    f = v.features(s, d).withColumn("id", F.concat_ws("|", "trial", "window_id"))
    back = reports.background_rows(f, "id", "subject", ["hc_price", "nvg_disc", "hc_qty"])
    return reports.shapley_values(f, "id", ["hc_price", "nvg_disc", "hc_qty"], back, _linear, 3, fold="subject")


@query("shapley_values", f"""WITH {SQL_SHAPLEY} SELECT id, feature, round(value, 9) AS value FROM (UNPIVOT (SELECT id, hc_price, nvg_disc, hc_qty FROM sv) ON hc_price, nvg_disc, hc_qty INTO NAME feature VALUE value)""")
def shapley_values(s, d):
    """Sampled attributions of the linear scorer for all rows; each subject's background is 100 rows of other subjects."""
    return _shapley(s, d).select("id", "feature", F.round("value", 9).alias("value"))


@query("attribution_summary", f"""WITH {SQL_SHAPLEY}, u AS (SELECT subject, feature, avg(abs(value)) AS a, avg(value) AS m FROM (UNPIVOT sv ON hc_price, nvg_disc, hc_qty INTO NAME feature VALUE value) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY a DESC, feature) AS k FROM u),
t AS (SELECT feature, avg(a) AS mean_abs, avg(m) AS mean, avg(k) AS mean_rank, count(DISTINCT subject) AS folds FROM r GROUP BY 1) SELECT feature, round(mean_abs, 5) AS mean_abs, round(mean, 5) AS mean, round(mean_rank, 5) AS mean_rank, folds, row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank FROM t""")
def attribution_summary(s, d):
    per = _shapley(s, d)
    out = reports.attribution_summary(per, "subject")
    return out.select("feature", F.round("mean_abs", 5).alias("mean_abs"), F.round("mean", 5).alias("mean"), F.round("mean_rank", 5).alias("mean_rank"), "folds", F.col("rank").cast("long").alias("rank"))


@query("family_share", """WITH p AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'hc' ELSE 'nvg' END AS family, sum(value) AS total FROM events GROUP BY ALL), s AS (SELECT *, total / sum(total) OVER (PARTITION BY user_id) AS share FROM p)
SELECT family, round(avg(share), 6) AS share_mean, round(stddev_samp(share), 6) AS share_std, round(median(share), 6) AS share_median FROM s GROUP BY 1""")
def family_share(s, d):
    e = v.read(s, d, "events").select("user_id", F.concat(F.when(F.col("event_type").isin("view", "click"), "hc_").otherwise("nvg_"), "event_type").alias("feature"), F.col("value").alias("mean_abs"))
    return reports.family_share(e, "user_id").select("family", *f6("share_mean", "share_std", "share_median"))
