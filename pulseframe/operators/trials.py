"""Trial tables, eligibility policies and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = list[str]


def trial_table(df: DataFrame, trial: Keys, features: list[str], labels: list[str] = ()) -> DataFrame:
    """One row per trial: mean and population std of each feature, the labels, window_id -1."""
    aggs = [x for f in features for x in (F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std"))]
    return df.groupBy(*trial).agg(*[F.first(c, ignorenulls=True).alias(c) for c in labels], *aggs).withColumn("window_id", F.lit(-1))


def completeness(inputs: DataFrame, subject: str, trial: str, input_: str, names: list[str], least: int) -> DataFrame:
    """Distinct trials per subject and input (trials__<input>, 0 if none), their minimum, and whether it is
    `least` or more (0 keeps all), with the reason otherwise."""
    counts = inputs.groupBy(subject).pivot(input_, names).agg(F.count_distinct(trial))
    counts = counts.select(subject, *[F.coalesce(n, F.lit(0)).alias(f"trials__{n}") for n in names])
    low = F.least(*[F.col(f"trials__{n}") for n in names]) if len(names) > 1 else F.col(f"trials__{names[0]}")
    out = counts.withColumn("minimum_observed_trials", low).withColumn("eligible", (F.lit(least) == 0) | (F.col("minimum_observed_trials") >= least))
    return out.withColumn("exclusion_reason", F.when(~F.col("eligible"), "too_few_trials"))


def eligibility_report(inputs: DataFrame, kept: DataFrame, subject: str, trial: str, input_: str) -> DataFrame:
    """Rows, trials and subjects of each input before and after the policies."""
    count = lambda df, when: df.groupBy(input_).agg(F.count(F.lit(1)).alias(f"rows_{when}"), F.count_distinct(trial).alias(f"trials_{when}"), F.count_distinct(subject).alias(f"subjects_{when}"))
    out = count(inputs, "before").join(count(kept, "after"), input_, "left")
    return out.fillna(0, [f"{c}_after" for c in ("rows", "trials", "subjects")])


def single_value(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's value if the table has just one, else null."""
    return df.agg(*[F.when(F.count_distinct(c) == 1, F.max(c)).alias(c) for c in columns])


def class_distribution(df: DataFrame, trial: Keys, stages: dict[str, str]) -> DataFrame:
    """level (`sample`, `trial`), stage, label, count; `stages` maps a stage name to its label column."""
    per_trial = df.groupBy(*trial).agg(*[F.first(c, ignorenulls=True).alias(c) for c in dict.fromkeys(stages.values())])
    out = None
    for level, rows in (("sample", df), ("trial", per_trial)):
        for stage, column in stages.items():
            one = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("count"))
            one = one.select(F.lit(level).alias("level"), F.lit(stage).alias("stage"), "label", "count")
            out = one if out is None else out.unionByName(one)
    return out


def audit(issues: DataFrame, category: str = "category", amount: str = "amount") -> DataFrame:
    return issues.groupBy(category).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("entries"))


def stability(choices: DataFrame, keys: Keys, parameters: str, fold: str) -> DataFrame:
    """The parameter set chosen most often (first seen wins ties), how often, its share, and how many sets."""
    per = choices.groupBy(*keys, parameters).agg(F.count(F.lit(1)).alias("n"), F.min(fold).alias("first"))
    out = per.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("early"), parameters)).alias("best"), F.sum("n").alias("folds"), F.count(F.lit(1)).alias("sets"))
    return out.select(*keys, F.col(f"best.{parameters}").alias(parameters), F.col("best.n").alias("n"), (F.col("best.n") / F.col("folds")).alias("share"), "sets")


def fit_totals(fits: DataFrame, keys: Keys, seconds: str = "seconds") -> DataFrame:
    """Fits, seconds in all, mean and longest of every candidate."""
    return fits.groupBy(*keys).agg(F.count(F.lit(1)).alias("fits"), F.sum(seconds).alias("total_s"), F.avg(seconds).alias("mean_s"), F.max(seconds).alias("longest_s"))


def tree_digest(files: DataFrame, path: str = "path", sha: str = "sha") -> DataFrame:
    """SHA-256 over `sha  path` lines in path order: one row. The digest is defined over the whole list, that of one store's source
    files (some hundred bytes each), so one task joins it."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(path, sha))), lambda x: F.concat(x[sha], F.lit("  "), x[path], F.lit("\n")))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(lines, ""), 256).alias("digest"))


def totals(index: DataFrame, subject: str, trial: Keys) -> DataFrame:
    return index.agg(F.count_distinct(subject).alias("subjects"), F.count_distinct(*trial).alias("trials"), F.count(F.lit(1)).alias("series"), F.sum("n_samples").alias("samples"))
