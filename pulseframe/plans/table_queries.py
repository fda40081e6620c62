"""Further queries over trials, candidates and predictions, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import align, evaluate, reports, resampling, trials
from . import views as v
from .model_queries import SQL_DRAWS, SQL_MATRIX, SQL_REG, SQL_TRIALS, _candidates, _numbers, _rolled, f6
from .register import query

# --- joins and sets


@query("keep_keys", f"""WITH {v.SQL_INPUTS} SELECT trial, window_id FROM inputs WHERE input_id = 'a' AND trial IN (SELECT trial FROM inputs WHERE input_id = 'b') AND subject IN (SELECT subject FROM inputs WHERE rating = 9)""")
def keep_keys(s, d):
    """Rows of common trials and eligible subjects."""
    i = v.inputs(s, d)
    a = align.keep_keys(i.filter("input_id = 'a'"), i.filter("input_id = 'b'"), ["trial"])
    return align.keep_keys(a, i.filter("rating = 9"), ["subject"]).select("trial", "window_id")


@query("eligible_trials", f"""WITH {v.SQL_INPUTS}, k AS (SELECT * FROM inputs WHERE rating <> 5 AND rating > 1) SELECT DISTINCT trial FROM k WHERE input_id = 'a' INTERSECT SELECT DISTINCT trial FROM k WHERE input_id = 'b'""")
def eligible_trials(s, d):
    """Trials with a class for two targets in both inputs."""
    i = v.inputs(s, d).withColumns({"x": fn.encode_target(F.col("rating"), "binary"), "y": F.when(F.col("rating") > 1, F.col("rating"))})
    return align.eligible_trials([i.filter(F.col("input_id") == n) for n in "ab"], ["trial"], ["x", "y"])


@query("subject_union", f"""WITH {v.SQL_INPUTS} SELECT DISTINCT subject FROM inputs WHERE input_id = 'a' AND rating = 1 UNION SELECT DISTINCT subject FROM inputs WHERE input_id = 'b' AND rating = 9""")
def subject_union(s, d):
    i = v.inputs(s, d)
    return align.subject_union([i.filter("input_id = 'a' and rating = 1"), i.filter("input_id = 'b' and rating = 9")], "subject")


@query("first_kept", """SELECT user_id % 30 AS window_s, length(event_type) AS overlap_s, min(event_id) AS event_id FROM events GROUP BY ALL""")
def first_kept(s, d):
    """Settings without repeats, in the order of their first mention."""
    e = v.read(s, d, "events").select((F.col("user_id") % 30).alias("window_s"), F.length("event_type").alias("overlap_s"), "event_id")
    return align.first_kept(e, ["window_s", "overlap_s"], "event_id")


@query("parameter_grid", """WITH g AS (SELECT *, row_number() OVER (ORDER BY o1, o2) - 1 AS parameter_index FROM (VALUES (0, '0.1'), (1, '1.0'), (2, '10.0')) a(o1, cost), (VALUES (0, 'scale'), (1, 'auto')) b(o2, gamma))
SELECT o_orderkey, cost, gamma FROM orders JOIN g ON o_custkey % 6 = parameter_index""")
def parameter_grid(s, d):
    """The grid joined to units of work by parameter number."""
    g = align.parameter_grid(s, {"gamma": ["scale", "auto"], "cost": [0.1, 1.0, 10.0]})
    o = v.read(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 6).cast("int").alias("parameter_index"))
    return o.join(F.broadcast(g), "parameter_index").select("o_orderkey", "cost", "gamma")


@query("resume_check", """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 AND o_custkey % 7 = 0 THEN 'config,split' WHEN o_custkey % 5 = 0 THEN 'config' ELSE 'split' END AS changed FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 7 = 0""")
def resume_check(s, d):
    """Stored units whose configuration or split hash is another one today."""
    o = v.read(s, d, "orders")
    now = o.select("o_orderkey", F.sha2("o_orderstatus", 256).alias("config"), F.sha2("o_orderpriority", 256).alias("split"))
    stored = o.select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, "other").otherwise(F.sha2("o_orderstatus", 256)).alias("config"), F.when(F.col("o_custkey") % 7 == 0, "other").otherwise(F.sha2("o_orderpriority", 256)).alias("split"))
    return align.check_resume(stored, now, ["o_orderkey"], ["config", "split"])


@query("source_features", """SELECT DISTINCT regexp_replace(regexp_replace(l_shipmode || CASE l_linenumber % 3 WHEN 0 THEN '__mean' WHEN 1 THEN '__std' ELSE '__std__mean' END, '__mean$', ''), '__std$', '') AS feature, l_linenumber % 3 AS kind FROM (SELECT l_linestatus AS l_shipmode, l_linenumber FROM lineitem)""")
def source_features(s, d):
    line = v.read(s, d, "lineitem").select((F.col("l_linenumber") % 3).alias("kind"), "l_linestatus").distinct()
    name = F.concat("l_linestatus", F.when(F.col("kind") == 0, "__mean").when(F.col("kind") == 1, "__std").otherwise("__std__mean"))
    return line.select(fn.source_feature(name).alias("feature"), "kind")


@query("score_json", f"""WITH {v.SQL_FEATURES} SELECT trial, window_id, hc_qty AS first, CASE WHEN trial % 3 <> 0 THEN hc_price END AS second, CAST(2 AS BIGINT) AS n FROM features""")
def score_json(s, d):
    """Score vectors to JSON text and back; a NaN comes back as null."""
    f = v.features(s, d)
    scores = F.array("hc_qty", F.when(F.col("trial") % 3 != 0, F.col("hc_price")).otherwise(F.lit(float("nan"))))
    back = f.select("trial", "window_id", fn.decode_scores(fn.encode_scores(scores)).alias("x"))
    return back.select("trial", "window_id", F.col("x")[0].alias("first"), F.col("x")[1].alias("second"), F.size("x").cast("long").alias("n"))


@query("configuration_prints", """SELECT c_custkey, substr(sha256('{"balance":' || c_custkey || ',"name":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}'), 1, 10) AS print FROM customer""")
def configuration_prints(s, d):
    """Prefixes of the SHA-256 of canonical JSON."""
    c = v.read(s, d, "customer")
    text = fn.canonical_json({"name": F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")), "balance": F.col("c_custkey")})
    return c.select("c_custkey", fn.fingerprint(text, 10).alias("print"))


@query("fit_totals", """SELECT event_type AS candidate, count(*) AS fits, round(sum(value), 4) AS total_s, round(avg(value), 6) AS mean_s, max(value) AS longest_s FROM events GROUP BY 1""")
def fit_totals(s, d):
    e = v.read(s, d, "events").select(F.col("event_type").alias("candidate"), F.col("value").alias("seconds"))
    return trials.fit_totals(e, ["candidate"]).select("candidate", "fits", F.round("total_s", 4).alias("total_s"), F.round("mean_s", 6).alias("mean_s"), "longest_s")


# --- evaluation


@query("binary_counts", f"""WITH {SQL_TRIALS} SELECT candidate_order, count(*) FILTER (WHERE y_true < 2 AND y_pred < 2) AS tn, count(*) FILTER (WHERE y_true < 2 AND y_pred = 2) AS fp, count(*) FILTER (WHERE y_true = 2 AND y_pred < 2) AS fn, count(*) FILTER (WHERE y_true = 2 AND y_pred = 2) AS tp FROM tp GROUP BY 1""")
def binary_counts(s, d):
    """True and false positives of the highest class against the rest."""
    p = _rolled(s, d).withColumns({"y_true": (F.col("y_true") == 2).cast("int"), "y_pred": (F.col("y_pred") == 2).cast("int")})
    return evaluate.binary_counts(evaluate.confusion(p, ["candidate_order"], [0, 1]), ["candidate_order"])


@query("roc_auc_ovr", f"""WITH {SQL_TRIALS}, l AS (SELECT candidate_order, y_true, c, CASE c WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END AS s FROM tr, (SELECT unnest([0, 1, 2]) AS c)),
r AS (SELECT candidate_order, c, CASE WHEN y_true = c THEN 1 ELSE 0 END AS hit, rank() OVER (PARTITION BY candidate_order, c ORDER BY s) + (count(*) OVER (PARTITION BY candidate_order, c, s) - 1) / 2 AS k FROM l),
a AS (SELECT candidate_order, c, sum(CASE WHEN hit = 1 THEN k END) AS s, sum(hit) AS p, sum(1 - hit) AS q FROM r GROUP BY ALL) SELECT candidate_order, round(avg((s - p * (p + 1) / 2) / (p * q)), 5) AS roc_auc FROM a GROUP BY 1""")
def roc_auc_ovr(s, d):
    return evaluate.roc_auc_ovr(_rolled(s, d), ["candidate_order"], 3).select("candidate_order", F.round("roc_auc", 5).alias("roc_auc"))


SQL_SUBJECTS = SQL_TRIALS + """, sg AS (SELECT candidate_order, subject, l, count(*) FILTER (WHERE y_true = l) AS su, count(*) FILTER (WHERE y_pred = l) AS pr, count(*) FILTER (WHERE y_true = l AND y_pred = l) AS h FROM tp, (SELECT unnest([0, 1, 2]) AS l) GROUP BY ALL),
sf AS (SELECT *, coalesce(2 * (h / nullif(pr, 0)) * (h / nullif(su, 0)) / nullif(h / nullif(pr, 0) + h / nullif(su, 0), 0), 0) AS f, h / nullif(su, 0) AS r FROM sg),
sr AS (SELECT candidate_order, subject, sum(su) AS n, sum(h) / sum(su) AS accuracy, avg(f) AS f1, avg(r) AS own, count(r) AS classes FROM sf GROUP BY ALL)"""


@query("subject_rows", f"""WITH {SQL_SUBJECTS} SELECT candidate_order, subject, CAST(n AS BIGINT) AS "rows", round(accuracy, 6) AS accuracy, round(f1, 6) AS f1_macro, round(own, 6) AS recall_of_own, classes FROM sr""")
def subject_rows(s, d):
    r = evaluate.subject_rows(_rolled(s, d), ["candidate_order"], "subject", [0, 1, 2])
    return r.select("candidate_order", "subject", "rows", *f6("accuracy", "f1_macro", "recall_of_own"), "classes")


@query("subject_summary", f"""WITH {SQL_SUBJECTS} SELECT candidate_order, count(*) AS subjects, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std, round(avg(own), 6) AS recall_of_own_mean, round(stddev_samp(own), 6) AS recall_of_own_std FROM sr GROUP BY 1""")
def subject_summary(s, d):
    r = evaluate.subject_summary(evaluate.subject_rows(_rolled(s, d), ["candidate_order"], "subject", [0, 1, 2]), ["candidate_order"], ["accuracy", "recall_of_own"])
    return r.select("candidate_order", "subjects", *f6("accuracy_mean", "accuracy_std", "recall_of_own_mean", "recall_of_own_std"))


@query("primary_error", f"""WITH {SQL_REG} SELECT round(avg(m), 6) AS "primary" FROM (SELECT subject, avg(abs(y_true - y_pred)) AS m FROM rg GROUP BY 1)""")
def primary_error(s, d):
    """The primary score of regression."""
    return evaluate.primary_score(_numbers(s, d), [], "subject", 0).select(F.round("primary", 6).alias("primary"))


_CUT = lambda m: f"round(quantile_cont({m}, 0.025), 6) AS {m}_low, round(quantile_cont({m}, 0.975), 6) AS {m}_high, count({m}) AS {m}_valid"
_BOUNDS = lambda ms: [x for m in ms for x in (*f6(f"{m}_low", f"{m}_high"), f"{m}_valid")]
CLASS_METRICS, NUMBER_METRICS = ["accuracy", "balanced_accuracy", "f1_macro", "mcc", "primary_score"], ["mae", "rmse", "r2", "primary_score"]
SQL_REPS = SQL_TRIALS + ", " + SQL_DRAWS + """, bm AS (SELECT candidate_order, rep, y_true, y_pred, sum(copies) AS n FROM tp JOIN cp USING (subject) GROUP BY ALL), bl AS (SELECT DISTINCT candidate_order, rep, unnest([0, 1, 2]) AS l FROM bm),
bc AS (SELECT l.candidate_order, l.rep, l.l, coalesce(sum(CASE WHEN y_true = l THEN n END), 0) AS su, coalesce(sum(CASE WHEN y_pred = l THEN n END), 0) AS pr, coalesce(sum(CASE WHEN y_true = l AND y_pred = l THEN n END), 0) AS h FROM bl l JOIN bm USING (candidate_order, rep) GROUP BY ALL),
bf AS (SELECT *, coalesce(h / nullif(su, 0), 0) AS r, coalesce(h / nullif(pr, 0), 0) AS p FROM bc),
bs AS (SELECT candidate_order, rep, sum(h) / sum(su) AS accuracy, CASE WHEN min(su) > 0 THEN avg(r) END AS balanced_accuracy, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) AS f1_macro,
  (sum(h) * sum(su) - sum(su * pr))::DOUBLE / nullif(sqrt((sum(su) ^ 2 - sum(pr * pr))::DOUBLE) * sqrt((sum(su) ^ 2 - sum(su * su))::DOUBLE), 0) AS mcc FROM bf GROUP BY ALL),
sc AS (SELECT candidate_order, subject, y_true, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END) AS r FROM tp GROUP BY ALL), bp AS (SELECT candidate_order, rep, y_true, sum(r * copies) / sum(copies) AS r FROM sc JOIN cp USING (subject) GROUP BY ALL),
bq AS (SELECT candidate_order, rep, avg(r) AS primary_score FROM bp GROUP BY ALL)"""


@query("bootstrap_classes", f"""WITH {SQL_REPS} SELECT candidate_order, {", ".join(map(_CUT, CLASS_METRICS))} FROM bs JOIN bq USING (candidate_order, rep) GROUP BY 1""")
def bootstrap_classes(s, d):
    """Intervals of all classification metrics."""
    b = resampling.bootstrap_classes(_rolled(s, d), ["candidate_order"], "subject", [0, 1, 2], 200)
    b = b.withColumnsRenamed({f"primary_{k}": f"primary_score_{k}" for k in ("low", "high", "valid")})
    return b.select("candidate_order", *_BOUNDS(CLASS_METRICS))


@query("bootstrap_numbers", f"""WITH {SQL_REG}, {SQL_DRAWS.replace("FROM tp", "FROM rg")}, dn AS (SELECT rep, subject, copies, y_true, y_pred FROM rg JOIN cp USING (subject)), bs AS (SELECT rep, sum(abs(y_true - y_pred) * copies) / sum(copies) AS mae, sqrt(sum((y_true - y_pred) ^ 2 * copies) / sum(copies)) AS rmse,
1 - sum((y_true - y_pred) ^ 2 * copies) / (sum(y_true * y_true * copies) - sum(y_true * copies) ^ 2 / sum(copies)) AS r2 FROM dn GROUP BY 1), sm AS (SELECT subject, avg(abs(y_true - y_pred)) AS m FROM rg GROUP BY 1),
bq AS (SELECT rep, sum(m * copies) / sum(copies) AS primary_score FROM sm JOIN cp USING (subject) GROUP BY 1) SELECT {", ".join(map(_CUT, NUMBER_METRICS))} FROM bs JOIN bq USING (rep)""")
def bootstrap_numbers(s, d):
    """Intervals of the regression metrics that are sums per subject; the tests cover Spearman's rho."""
    b = resampling.bootstrap_numbers(_numbers(s, d), [], "subject", 200)
    b = b.withColumnsRenamed({f"primary_{k}": f"primary_score_{k}" for k in ("low", "high", "valid")})
    return b.select(*_BOUNDS(NUMBER_METRICS))


SQL_TWO = SQL_TRIALS + """, pa AS (SELECT a.subject, a.y_true, a.y_pred AS x, b.y_pred AS y FROM tp a JOIN tp b ON a.trial = b.trial AND a.candidate_order = 0 AND b.candidate_order = 3)"""


@query("other_contributions", f"""WITH {SQL_TWO}, m AS (SELECT subject, avg(abs(y_true - x) - abs(y_true - y)) AS e, sum((CASE WHEN y_true = x THEN 1 ELSE 0 END) - (CASE WHEN y_true = y THEN 1 ELSE 0 END)) AS h FROM pa GROUP BY 1)
SELECT subject, round(e / (SELECT count(*) FROM m), 9) AS mae, round(h / (SELECT count(*) FROM pa), 9) AS accuracy FROM m""")
def other_contributions(s, d):
    """Contributions to the differences of mean absolute error and accuracy."""
    p = _rolled(s, d)
    a, b = (p.filter(F.col("candidate_order") == i).select("subject", "trial", "y_true", "y_pred") for i in (0, 3))
    pairs = align.paired(a, b, ["subject", "trial"]).withColumn("pair", F.lit(0))
    mae, acc = (resampling.contributions(pairs, ["pair"], "subject", m).select("subject", F.round("d", 9).alias(m)) for m in ("mae", "accuracy"))
    return mae.join(acc, "subject")


SQL_TESTS = SQL_TRIALS + """, prs AS (SELECT * FROM (VALUES ('models', 'a|windowed|all', 0, 2), ('models', 'a|aggregated|all', 1, 3), ('modes', 'a|all|rf', 0, 1), ('modes', 'a|all|svm', 2, 3)) t(comparison, family, order_a, order_b)),
pa AS (SELECT p.*, a.subject, a.y_true, (CASE WHEN a.y_true = a.y_pred THEN 1.0::DOUBLE ELSE 0 END) - (CASE WHEN b.y_true = b.y_pred THEN 1 ELSE 0 END) AS hit FROM prs p JOIN tp a ON a.candidate_order = order_a JOIN tp b ON b.candidate_order = order_b AND a.trial = b.trial),
sl AS (SELECT comparison, family, order_a, order_b, subject, y_true, avg(hit) AS m FROM pa GROUP BY ALL), w AS (SELECT *, count(*) OVER (PARTITION BY order_a, order_b, y_true) AS s FROM sl), lb AS (SELECT order_a, order_b, count(DISTINCT y_true) AS l FROM sl GROUP BY ALL),
cb AS (SELECT comparison, family, order_a, order_b, 'primary' AS metric, subject, sum(m / (l * s)) AS d FROM w JOIN lb USING (order_a, order_b) GROUP BY ALL UNION ALL
  SELECT comparison, family, order_a, order_b, 'accuracy', subject, sum(hit) / max(n) FROM pa JOIN (SELECT order_a, order_b, count(*) AS n FROM pa GROUP BY ALL) USING (order_a, order_b) GROUP BY ALL),
ob AS (SELECT comparison, family, order_a, order_b, metric, sum(d) AS obs FROM cb GROUP BY ALL), rp AS (SELECT unnest(range(0, 200)) AS rep),
fl AS (SELECT order_a, order_b, metric, rep, sum(d * (1 - 2 * (CAST('0x' || substr(sha256('flip|' || rep || '|' || subject), 1, 8) AS BIGINT) % 2))) AS s FROM cb, rp GROUP BY ALL),
ps AS (SELECT comparison, family, order_a, order_b, metric, obs, (count(*) FILTER (WHERE abs(s) + 2.220446049250313e-16 * greatest(1.0, abs(obs)) * 8 >= abs(obs)) + 1) / 201 AS p FROM fl JOIN ob USING (order_a, order_b, metric) GROUP BY ALL)"""


@query("paired_tests", f"""WITH {SQL_TESTS} SELECT comparison, family, order_a, order_b, metric, 'ok' AS status, round(obs, 6) AS observed, round(p, 6) AS p, round(p, 6) AS p_holm, p < 0.05 AS significant FROM ps""")
def paired_tests(s, d):
    """All paired comparisons of the four candidates with corrected p; each family has one pair, so Holm's correction leaves p."""
    t = resampling.paired_tests(_rolled(s, d).select("candidate_order", "subject", "trial", "y_true", "y_pred"), _candidates(s, d), "subject", ["trial"], 3, 200)
    return t.select("comparison", "family", "order_a", "order_b", "metric", "status", *f6("observed", "p", "p_holm"), "significant")


SQL_SUMMARY = SQL_MATRIX + ", " + SQL_DRAWS + """, su AS (SELECT candidate_order, sum(hits) / sum(support) AS accuracy, avg(f) AS f1_macro FROM pf GROUP BY 1), ps AS (SELECT candidate_order, subject, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS h, count(*) AS n FROM tp GROUP BY ALL),
bo AS (SELECT candidate_order, rep, sum(h * copies) / sum(n * copies) AS acc FROM ps JOIN cp USING (subject) GROUP BY ALL), iv AS (SELECT candidate_order, quantile_cont(acc, 0.025) AS low, quantile_cont(acc, 0.975) AS high FROM bo GROUP BY 1),
sv AS (SELECT candidate_order, CAST(y_pred AS VARCHAR) AS parameters, count(*) AS n, min(trial) AS first FROM tp GROUP BY ALL), sb AS (SELECT *, sum(n) OVER (PARTITION BY candidate_order) AS folds FROM sv QUALIFY row_number() OVER (PARTITION BY candidate_order ORDER BY n DESC, first) = 1)"""


@query("candidate_summary", f"""WITH {SQL_SUMMARY} SELECT candidate_order, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(low, 6) AS accuracy_low, round(high, 6) AS accuracy_high, parameters, round(n / folds, 6) AS share, rank() OVER (ORDER BY accuracy DESC) AS rank FROM su JOIN iv USING (candidate_order) JOIN sb USING (candidate_order)""")
def candidate_summary(s, d):
    """Metrics, intervals and parameter stability of each candidate, ranked by accuracy."""
    p, key = _rolled(s, d), ["candidate_order"]
    m = evaluate.summary_metrics(evaluate.class_metrics(evaluate.confusion(p, key, [0, 1, 2]), key), key)
    st = trials.stability(p.select("candidate_order", F.col("y_pred").cast("string").alias("parameters"), "trial"), key, "parameters", "trial")
    out = reports.candidate_summary(m, resampling.bootstrap_accuracy(p, key, "subject", 200), st, key, "accuracy")
    return out.select("candidate_order", *f6("accuracy", "f1_macro", "accuracy_low", "accuracy_high"), "parameters", F.round("share", 6).alias("share"), F.col("rank").cast("long").alias("rank"))


@query("value_ranks", """SELECT l_returnflag, l_extendedprice, count(*) AS n, CAST(min(k) AS BIGINT) AS rank_min, min(k) + (count(*) - 1) / 2 AS rank_avg FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k FROM lineitem) GROUP BY ALL""")
def value_ranks(s, d):
    """Ranks of the distinct values of groups of any size."""
    from ..operators.windows import value_ranks as ranks

    return ranks(v.read(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 16)


@query("feature_order", f"""WITH {v.SQL_FEATURES} SELECT subject, trial, window_id, row_number() OVER (PARTITION BY subject ORDER BY trial, window_id) AS place FROM features""")
def feature_order(s, d):
    """Rows of each subject in the stable order of feature files."""
    from ..operators.windows import ranked

    f = v.features(s, d).select("subject", "trial", "window_id")
    return ranked(f, ["subject"], "trial", "window_id", name="place", kind="ordinal").select("subject", "trial", "window_id", F.col("place").cast("long").alias("place"))
