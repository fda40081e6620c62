"""Model inputs: imputation, scaling, weights, folds, sensor-node layout. Fold statistics are aggregates by fold,
so all folds are prepared in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import deviation, hashed_unit, natural_order

Keys = list[str]


def loso_folds(spark_or_df: DataFrame, subject: str, most: int | None = None) -> DataFrame:
    """fold, test_subject: one fold per subject in natural order, the first `most` of them."""
    s = F.col(subject).cast("string")
    w = Window.orderBy(*natural_order(F.col("test_subject")))
    out = spark_or_df.select(s.alias("test_subject")).distinct().withColumn("fold", F.row_number().over(w) - 1)
    return out.filter(F.col("fold") < most) if most else out


def fold_rows(df: DataFrame, folds: DataFrame, subject: str) -> DataFrame:
    """Every row once per fold with is_test: rows x folds, so hand it trial tables. Folds are one row per
    subject and are broadcast."""
    return df.crossJoin(F.broadcast(folds)).withColumn("is_test", F.col(subject).cast("string") == F.col("test_subject"))


def impute_median(df: DataFrame, train: DataFrame, columns: list[str], by: Keys = ()) -> DataFrame:
    """Missing values become the training median of their column (of their fold with `by`), 0 if it has none."""
    medians = train.groupBy(*by).agg(*[F.median(c).alias(f"_{c}") for c in columns]) if by else train.agg(*[F.median(c).alias(f"_{c}") for c in columns])
    joined = df.join(F.broadcast(medians), list(by), "left") if by else df.crossJoin(F.broadcast(medians))
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def constant_columns(train: DataFrame, columns: list[str]) -> list[str]:
    """Columns without variance on the training rows; one small row reaches the driver."""
    row = train.agg(*[deviation(c).alias(c) for c in columns]).first()
    return [c for c in columns if not row[c]]


def standardise(df: DataFrame, train: DataFrame, columns: list[str], by: Keys = ()) -> DataFrame:
    """(x - mean) / population std of the training rows, std 0 as 1."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), deviation(c).alias(f"_s_{c}"))]
    stats = train.groupBy(*by).agg(*aggs) if by else train.agg(*aggs)
    joined = df.join(F.broadcast(stats), list(by), "left") if by else df.crossJoin(F.broadcast(stats))
    out = joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns})
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight = rows / (classes * rows of the class), from one aggregate per class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(per.crossJoin(total)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def hashed_folds(df: DataFrame, subject: str, k: int, seed: str = "folds") -> DataFrame:
    """subject, fold: subjects in hashed order dealt round, so fold sizes differ by one subject at most."""
    w = Window.orderBy(hashed_unit(F.lit(seed), F.col(subject)), subject)
    return df.select(F.col(subject).cast("string").alias(subject)).distinct().withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)))


def split_plan(df: DataFrame, subject: str, k: int = 3, seed: str = "inner") -> DataFrame:
    """outer_fold, test_subject, subject, inner_fold: one row per outer fold and training subject. Outer folds are the subjects in
    natural order; the training subjects of each go round k inner folds in an order hashed with the outer fold. It depends on the
    subjects alone, so all candidates share it. Rows grow with the square of the subjects, not with the data."""
    outer = loso_folds(df, subject).withColumnRenamed("fold", "outer_fold")
    pairs = outer.crossJoin(F.broadcast(outer.select(F.col("test_subject").alias("subject")))).filter("subject != test_subject")
    w = Window.partitionBy("outer_fold").orderBy(hashed_unit(F.lit(seed), F.col("test_subject"), F.col("subject")), "subject")
    return pairs.withColumn("inner_fold", F.pmod(F.row_number().over(w) - 1, F.lit(k))).select("outer_fold", "test_subject", "subject", "inner_fold")


def plan_fingerprints(plan: DataFrame) -> DataFrame:
    """outer_fold, fingerprint: the first 12 characters of the SHA-256 of each outer fold's subject and assignment in subject order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("subject", "inner_fold"))), lambda x: F.concat_ws(":", x["subject"], x["inner_fold"].cast("string")))
    return plan.groupBy("outer_fold", "test_subject").agg(F.substring(F.sha2(F.concat_ws("|", "test_subject", F.array_join(lines, ",")), 256), 1, 12).alias("fingerprint"))


def greedy_folds(spark: SparkSession, df: DataFrame, subject: str, k: int, label: str | None = None) -> DataFrame:
    """subject, fold: largest subjects first to the lightest fold, or with `label` to the fold that keeps class
    shares most even. Falls to fewer folds until every class is in each training and validation part.
    Only one row per subject (and class) is collected: subjects are people."""
    counts = df.groupBy(F.col(subject).cast("string").alias("s"), *([F.col(label).alias("y")] if label else [F.lit(0).alias("y")])).agg(F.count(F.lit(1)).alias("n")).toPandas()
    table = counts.pivot_table(index="s", columns="y", values="n", fill_value=0).sort_index()
    sizes = table.to_numpy(dtype=float)
    order = sorted(range(len(table)), key=lambda i: (-sizes[i].sum(), table.index[i]))
    for folds in range(min(k, len(table)), 1, -1):
        held = [sizes[0] * 0 for _ in range(folds)]
        place = {}
        for i in order:
            def cost(f):
                after = [h + (sizes[i] if g == f else 0) for g, h in enumerate(held)]
                if label:
                    shares = [[a[c] / max(1.0, sizes[:, c].sum()) for a in after] for c in range(sizes.shape[1])]
                    spread = sum(max(x) - min(x) for x in shares)
                    return round(spread, 12), held[f].sum(), f
                return held[f].sum(), f

            best = min(range(folds), key=cost)
            place[i] = best
            held[best] = held[best] + sizes[i]
        total = sizes.sum(axis=0)
        if not label or all((h > 0).all() and (total - h > 0).all() for h in held):
            return spark.createDataFrame([(str(table.index[i]), f) for i, f in sorted(place.items())], f"`{subject}` string, fold int")
    raise ValueError("no split leaves every class in training and validation")


def stopping_holdout(df: DataFrame, subject: str, share: float = 0.2, least: int = 3, seed: str = "stop") -> DataFrame:
    """Adds is_holdout: a fifth of the subjects (one or more) in hashed order, none with fewer than `least` subjects."""
    subjects = df.select(subject).distinct()
    w = Window.orderBy(hashed_unit(F.lit(seed), F.col(subject)), subject)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    chosen = subjects.withColumn("_k", F.row_number().over(w)).withColumn("_n", n)
    chosen = chosen.select(subject, ((F.col("_n") >= least) & (F.col("_k") <= F.greatest(F.lit(1), F.round(F.col("_n") * share)))).alias("is_holdout"))
    return df.join(F.broadcast(chosen), subject)


#: Other names of sensors (fixed values).
SENSORS = {"ppg": "bvp", "bvp": "bvp", "eda": "eda", "skt": "temp", "temp": "temp"}
NODES = ("bvp", "eda", "temp")


def node_slots(features: list[str]) -> tuple[list[str], dict[tuple[str, str], str]]:
    """Slots (`family::descriptor`, sorted) and which feature fills (node, slot). Every feature has one place."""
    place = {}
    for f in features:
        family, signal, descriptor = f.split("_", 2)
        if signal not in SENSORS:
            raise ValueError(f"no sensor node for {f}")
        key = SENSORS[signal], f"{family}::{descriptor}"
        if key in place:
            raise ValueError(f"{f} and {place[key]} share a slot")
        place[key] = f
    return sorted({s for _, s in place}), place


def sensor_nodes(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds nodes: per sensor the slot values (missing 0), their presence, and a one-hot node id."""
    slots, place = node_slots(features)
    rows = []
    for k, node in enumerate(NODES):
        values = [F.coalesce(F.col(place[node, s]).cast("double"), F.lit(0.0)) if (node, s) in place else F.lit(0.0) for s in slots]
        there = [F.lit(1.0 if (node, s) in place else 0.0) for s in slots]
        rows.append(F.array(*values, *there, *[F.lit(1.0 if i == k else 0.0) for i in range(len(NODES))]))
    return df.withColumn("nodes", F.array(*rows))
