"""Trial predictions and metrics, for any number of candidates at once by grouping keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = list[str]


def roll_up(df: DataFrame, keys: Keys, classes: int, score: str | None = "scores") -> DataFrame:
    """Window predictions to trials: regression mean; score vectors averaged, then the first greatest; without
    scores the majority, the smaller label of equals. y_true is constant in a trial."""
    base = [F.max("y_true").alias("y_true"), F.count(F.lit(1)).alias("source_sample_count")]
    if not classes:
        return df.groupBy(*keys).agg(*base, F.avg("y_pred").alias("y_pred"))
    if score:
        out = df.groupBy(*keys).agg(*base, F.array(*[F.avg(F.col(score)[i]) for i in range(classes)]).alias("scores"))
        return out.withColumn("y_pred", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    votes = df.groupBy(*keys, "y_pred").agg(F.count(F.lit(1)).alias("n"), F.max("y_true").alias("y_true"))
    out = votes.groupBy(*keys).agg(F.max("y_true").alias("y_true"), F.sum("n").alias("source_sample_count"), F.max(F.struct("n", (-F.col("y_pred")).alias("minus"))).alias("b"))
    return out.select(*keys, "y_true", "source_sample_count", (-F.col("b.minus")).alias("y_pred"))


def decision_roll_up(df: DataFrame, keys: Keys, decision: str = "decision") -> DataFrame:
    """Binary decision values: their mean, and class 1 if it is 0 or more."""
    out = df.groupBy(*keys).agg(F.max("y_true").alias("y_true"), F.avg(decision).alias("y_score"), F.count(F.lit(1)).alias("source_sample_count"))
    return out.withColumn("y_pred", (F.col("y_score") >= 0).cast("int"))


def confusion(df: DataFrame, keys: Keys, labels: list[int]) -> DataFrame:
    """keys, y_true, y_pred, n for all pairs of configured labels, 0 where there is none."""
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    values = F.array(*[F.lit(x) for x in labels])
    grid = grid.withColumn("y_true", F.explode(values)).withColumn("y_pred", F.explode(values))
    counts = df.groupBy(*keys, F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [*keys, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(matrix: DataFrame, keys: Keys) -> DataFrame:
    """Per class: support, predicted, hits, precision, recall, f1 (0 for 0/0)."""
    rows = matrix.groupBy(*keys, F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hits"))
    cols = matrix.groupBy(*keys, F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    out = rows.join(cols, [*keys, "label"])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    out = out.withColumns({"precision": ratio("hits", "predicted"), "recall": ratio("hits", "support")})
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def summary_metrics(per_class: DataFrame, keys: Keys) -> DataFrame:
    """Accuracy, balanced accuracy (null unless every class occurs), macro precision, recall, F1, and the
    multiclass Matthews correlation (0 if undefined)."""
    s, t, p, c = F.sum("support"), F.col("support"), F.col("predicted"), F.sum("hits")
    over = c * s - F.sum(t * p)
    under = F.sqrt((s * s - F.sum(p * p)).cast("double")) * F.sqrt((s * s - F.sum(t * t)).cast("double"))
    return per_class.groupBy(*keys).agg(
        (c / s).alias("accuracy"), F.when(F.min("support") > 0, F.avg("recall")).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"),
        F.when(under > 0, over / under).otherwise(0.0).alias("mcc"), s.alias("rows"),
    )


def roc_auc(df: DataFrame, keys: Keys, score: str = "score", label: str = "y_true") -> DataFrame:
    """Area under the ROC curve by average ranks; null unless both classes occur. Ranks come from counts per
    distinct score, so ties and hot scores cost one row."""
    per = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    out = per.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return out.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("roc_auc"))


def binary_counts(matrix: DataFrame, keys: Keys) -> DataFrame:
    """tn, fp, fn, tp of a two-class confusion matrix."""
    cell = lambda t, p: F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n")).otherwise(0)).cast("long")
    return matrix.groupBy(*keys).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def roc_auc_ovr(df: DataFrame, keys: Keys, classes: int, scores: str = "scores", label: str = "y_true") -> DataFrame:
    """Mean over classes of the area of each class against the rest; null unless every class occurs and all scores are finite."""
    odd = F.exists(scores, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.col(scores).isNull()
    bad = df.groupBy(*keys).agg(F.max(odd.cast("int")).alias("_bad"))
    rows = df.select(*keys, label, F.posexplode(scores).alias("_class", "_score")).filter(F.col("_class") < classes)
    per = roc_auc(rows.withColumn("_hit", (F.col(label) == F.col("_class")).cast("int")), [*keys, "_class"], "_score", "_hit")
    out = per.groupBy(*keys).agg(F.avg("roc_auc").alias("_auc"), F.count("roc_auc").alias("_n"))
    out = out.join(bad, keys) if keys else out.crossJoin(bad)
    return out.select(*keys, F.when((F.col("_n") == classes) & (F.col("_bad") == 0), F.col("_auc")).alias("roc_auc"))


def subject_rows(df: DataFrame, keys: Keys, subject: str, labels: list[int]) -> DataFrame:
    """Metrics of every subject of every candidate: accuracy, the recall over the classes it has, macro F1 and rows."""
    per = class_metrics(confusion(df, [*keys, subject], labels), [*keys, subject])
    main = summary_metrics(per, [*keys, subject]).select(*keys, subject, "rows", "accuracy", "f1_macro")
    own = per.filter("support > 0").groupBy(*keys, subject).agg(F.avg("recall").alias("recall_of_own"), F.count(F.lit(1)).alias("classes"))
    return main.join(own, [*keys, subject])


def subject_summary(per_subject: DataFrame, keys: Keys, metrics: list[str]) -> DataFrame:
    """Mean and sample std over subjects of each metric, and the subjects, per candidate."""
    aggs = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return per_subject.groupBy(*keys).agg(F.count(F.lit(1)).alias("subjects"), *aggs)


def average_precision(df: DataFrame, keys: Keys, score: str = "score", label: str = "y_true") -> DataFrame:
    """Sum of (R_k - R_k-1) * P_k over distinct thresholds, greatest first."""
    per = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"tp": F.sum("pos").over(w), "seen": F.sum("n").over(w)})
    out = per.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("s"), F.sum("pos").alias("p"))
    return out.select(*keys, F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("average_precision"))


def regression_metrics(df: DataFrame, keys: Keys) -> DataFrame:
    """MAE, RMSE, R2 and Spearman's rho (null for one row)."""
    e = F.col("y_true") - F.col("y_pred")
    main = df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop("y_true") * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
    )
    return main.join(spearman(df, keys, "y_true", "y_pred"), keys)


def spearman(df: DataFrame, keys: Keys, x: str, y: str) -> DataFrame:
    """rho: correlation of average ranks within each group (null for one row and flat columns). Ranks are those of distinct values and
    pairs are counted first, so ties cost one row and no task orders a whole group."""
    from .windows import value_ranks

    pairs = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    weighted = lambda c, name: value_ranks(df.select(*keys, F.col(c).alias(f"_{name}")), keys, f"_{name}").select(*keys, f"_{name}", F.col("rank_avg").alias(f"_r{name}"))
    r = pairs.join(weighted(x, "x"), [*keys, "_x"]).join(weighted(y, "y"), [*keys, "_y"])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    mid = (F.col("_n") + 1) / 2
    r = (r.join(F.broadcast(n), keys) if keys else r.crossJoin(F.broadcast(n))).select(*keys, "_n", w, (a - mid).alias("a"), (b - mid).alias("b"))
    sums = r.groupBy(*keys, "_n").agg(F.sum(F.col("_w") * F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("_w") * F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("_w") * F.col("b") * F.col("b")).alias("bb"))
    return sums.select(*keys, F.when((F.col("_n") > 1) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt("aa") / F.sqrt("bb")).alias("spearman_rho"))


def primary_score(df: DataFrame, keys: Keys, subject: str, classes: int) -> DataFrame:
    """Classification: recall per (subject, class it has), mean over subjects, then over classes. Regression:
    mean over subjects of their MAE."""
    if not classes:
        per = df.groupBy(*keys, subject).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("v"))
        return per.groupBy(*keys).agg(F.avg("v").alias("primary"))
    per = df.groupBy(*keys, subject, "y_true").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("v"))
    return per.groupBy(*keys, "y_true").agg(F.avg("v").alias("v")).groupBy(*keys).agg(F.avg("v").alias("primary"))
