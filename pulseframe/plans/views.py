"""Base views of the tables as samples, features and predictions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import epoch_seconds
from ..operators.series import signal_index
from ..operators.windows import assign, intersection

SIGNALS = ["view", "click", "purchase"]
WINDOW_S, OVERLAP_S = 14 * 86400.0, 7 * 86400.0
FEATURES = ["hc_qty", "hc_price", "nvg_disc", "nvg_tax"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One series per (subject, signal) in time order."""
    w = Window.partitionBy("subject", "signal").orderBy("ts", "event_id")
    e = read(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("signal"), "event_id", "ts", "value")
    return e.select("subject", "signal", "event_id", epoch_seconds(F.col("ts")).alias("t"), "value", (F.row_number().over(w) - 1).cast("long").alias("pos"))


def whole_series(spark: SparkSession, d: str) -> DataFrame:
    """All events of a subject as one series."""
    w = Window.partitionBy("subject").orderBy("ts", "event_id")
    e = read(spark, d, "events").select(F.col("user_id").alias("subject"), "event_id", "ts", "value")
    return e.select("subject", "value", (F.row_number().over(w) - 1).cast("long").alias("pos"))


def aligned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples of the three aligned signals in their windows, and the intervals of the subjects."""
    s = samples(spark, d).filter(F.col("signal").isin(SIGNALS))
    intervals = intersection(signal_index(s, ["subject", "signal"]), ["subject"], len(SIGNALS))
    return assign(s, intervals, ["subject"], WINDOW_S, OVERLAP_S), intervals


def features(spark: SparkSession, d: str) -> DataFrame:
    """One row per line of an order: subject, trial, window_id, condition, four features, rating 1 to 9."""
    line, order = read(spark, d, "lineitem"), read(spark, d, "orders")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        (F.col("o_custkey") % 50).cast("string").alias("subject"), F.col("o_orderkey").alias("trial"), (F.row_number().over(w) - 1).cast("long").alias("window_id"),
        F.col("o_orderpriority").alias("condition"), F.col("l_quantity").alias("hc_qty"), F.col("l_extendedprice").alias("hc_price"), F.col("l_discount").alias("nvg_disc"),
        F.col("l_tax").alias("nvg_tax"), (F.floor(F.col("o_totalprice") / 55556) + 1).cast("int").alias("rating"), "l_returnflag",
    )


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """Two inputs: `a` all rows, `b` without returned lines."""
    f = features(spark, d)
    return f.withColumn("input_id", F.explode(F.when(F.col("l_returnflag") == "R", F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three classes per window for four formula candidates: candidate_order, subject, trial, y_true, y_pred, scores."""
    f = features(spark, d)
    rows = f.select("subject", "trial", "window_id", F.when(F.col("rating") <= 3, 0).when(F.col("rating") <= 6, 1).otherwise(2).alias("y_true"), "hc_qty", "hc_price", "nvg_disc", "nvg_tax")
    rows = rows.withColumn("candidate_order", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    base = F.col("hc_price") / 100000 + F.col("candidate_order") * F.col("nvg_disc") + F.col("hc_qty") / 1000
    scores = F.array(1.0 - base, 0.55 - F.abs(base - 0.5), base - F.col("nvg_tax") * F.col("candidate_order"))
    rows = rows.withColumn("scores", scores)
    return rows.select("candidate_order", "subject", "trial", "window_id", "y_true", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("y_pred"), "scores")


def binary_scores(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: subject (source), y_true (quality), score (length)."""
    both = read(spark, d, "documents").select("doc_id", "source", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return both.select("doc_id", F.col("source").alias("subject"), F.col("quality").alias("y_true"), (F.col("n_chars") / 50000.0).alias("score"))


SQL_SAMPLES = "samples AS (SELECT user_id AS subject, event_type AS signal, event_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS pos FROM events)"
SQL_SERIES = "series AS (SELECT user_id AS subject, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
SQL_INDEX = SQL_SAMPLES + """, steps AS (SELECT *, t - lag(t) OVER (PARTITION BY subject, signal ORDER BY pos) AS d FROM samples),
idx AS (SELECT subject, signal, count(*) AS n_samples, min(t) AS start_s, max(t) AS end_s, median(d) FILTER (WHERE d > 0) AS median_step FROM steps GROUP BY subject, signal)"""
SQL_ALIGNED = SQL_INDEX + f""", itv AS (SELECT subject, max(start_s) AS common_start, min(end_s + median_step) AS common_end FROM idx WHERE signal IN ('view', 'click', 'purchase') GROUP BY subject
  HAVING count(*) = 3 AND min(end_s + median_step) > max(start_s)),
win AS (SELECT subject, common_start, common_end - common_start AS common_s, unnest(range(0, greatest(0, CAST(floor((common_end - common_start + 1e-6 - {WINDOW_S}) / {OVERLAP_S}) AS BIGINT) + 1))) AS window_id FROM itv),
aligned AS (SELECT s.*, w.window_id, s.t - w.common_start AS rel_t FROM samples s JOIN win w ON s.subject = w.subject
  WHERE s.signal IN ('view', 'click', 'purchase') AND s.t - w.common_start >= w.window_id * {OVERLAP_S} AND s.t - w.common_start < w.window_id * {OVERLAP_S} + {WINDOW_S})"""
SQL_FEATURES = """features AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS subject, o_orderkey AS trial,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS window_id, o_orderpriority AS condition,
  l_quantity AS hc_qty, l_extendedprice AS hc_price, l_discount AS nvg_disc, l_tax AS nvg_tax, CAST(floor(o_totalprice / 55556) + 1 AS INTEGER) AS rating, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_INPUTS = SQL_FEATURES.replace("AS (", "AS MATERIALIZED (", 1) + ", inputs AS MATERIALIZED (SELECT *, 'a' AS input_id FROM features UNION ALL SELECT *, 'b' FROM features WHERE l_returnflag <> 'R')"
SQL_PREDICTIONS = SQL_FEATURES + """, based AS (SELECT *, hc_price / 100000 + k * nvg_disc + hc_qty / 1000 AS base FROM features, (SELECT unnest([0, 1, 2, 3]) AS k)),
scored AS (SELECT k AS candidate_order, subject, trial, window_id, CASE WHEN rating <= 3 THEN 0 WHEN rating <= 6 THEN 1 ELSE 2 END AS y_true, 1.0 - base AS s0, 0.55 - abs(base - 0.5) AS s1, base - nvg_tax * k AS s2 FROM based),
pred AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS y_pred FROM scored)"""
SQL_BINARY = "labelled AS (SELECT doc_id, source AS subject, quality AS y_true, n_chars / 50000.0 AS score FROM documents JOIN labels USING (doc_id))"

