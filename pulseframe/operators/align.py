"""Joins and set operations between inputs, trials, candidates and predictions."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = list[str]


def paired(a: DataFrame, b: DataFrame, keys: Keys, truth: str = "y_true") -> DataFrame:
    """Full outer join of two predictions with status: `ok`, `incompatible_sample_sets` or
    `incompatible_true_labels`. Columns besides the keys get suffixes _a and _b."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in a.columns if c not in keys], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys], F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_a").isNull() | F.col("_in_b").isNull(), "incompatible_sample_sets").when(~F.col(f"{truth}_a").eqNullSafe(F.col(f"{truth}_b")), "incompatible_true_labels").otherwise("ok")
    return left.join(right, keys, "full_outer").withColumn("status", status).drop("_in_a", "_in_b")


def missing_expected(trials: DataFrame, files: DataFrame, trial: Keys, condition: str, phases: list[str], baseline: str = "BASELINE", not_in_baseline: str = "WASHOUT") -> DataFrame:
    """(trial, phase) that should have a file and has none; the baseline expects no washout."""
    wanted = trials.select(*trial, F.explode(F.array(*[F.lit(p) for p in phases])).alias("phase")).filter(~((F.col(condition) == baseline) & (F.col("phase") == not_in_baseline)))
    return wanted.join(files, [*trial, "phase"], "left_anti")


def orphans(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Keys of one side only, with `side`."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def common_trials(inputs: list[DataFrame], trial: Keys) -> DataFrame:
    """Trials that every input has."""
    return reduce(lambda a, b: a.intersect(b), [x.select(*trial) for x in inputs]).distinct()


def expand_candidates(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """A template of input `*` fans out to all inputs, another one to the input it names; candidate_order
    counts in template and input order. Templates that name no input get no row (`orphans` lists them)."""
    hit = (F.col("t.input_id") == "*") | (F.col("t.input_id") == F.col("i.input_id"))
    # templates and inputs are configuration: a few rows each
    made = templates.alias("t").join(F.broadcast(inputs.alias("i")), hit)
    w = Window.orderBy("t.template_order", "i.input_order")
    rest = [F.col(f"t.{c}") for c in templates.columns if c not in ("input_id", "template_order")]
    return made.select(F.row_number().over(w).alias("candidate_order"), F.col("i.input_id").alias("input_id"), *rest)


def parameter_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """All combinations of the lists, keys sorted, numbered in that order: parameter_index and one string
    column per key. The grid is configuration, its size the product of short lists."""
    names = sorted(grid)
    rows = [(i, *map(str, values)) for i, values in enumerate(product(*(grid[n] for n in names)))]
    return spark.createDataFrame(rows, "parameter_index int, " + ", ".join(f"`{n}` string" for n in names))


def label_disagreements(a: DataFrame, b: DataFrame, trial: Keys, label: str, exact: bool = False) -> DataFrame:
    """Shared trials whose labels differ; numbers by more than 1e-8 + 1e-5 * |b|."""
    both = a.groupBy(*trial).agg(F.first(label).alias("a")).join(b.groupBy(*trial).agg(F.first(label).alias("b")), trial)
    return both.filter(~F.col("a").eqNullSafe(F.col("b")) if exact else F.abs(F.col("a") - F.col("b")) > 1e-8 + 1e-5 * F.abs("b"))


def candidate_pairs(candidates: DataFrame, family: Keys, order: str = "candidate_order") -> DataFrame:
    """Unordered pairs within each family, earlier candidate first: order_a, order_b. Families are groups of a
    run's candidates, some tens."""
    a = candidates.select(*family, F.col(order).alias("order_a"))
    b = candidates.select(*family, F.col(order).alias("order_b"))
    return a.join(b, family).filter("order_a < order_b")


def latest(df: DataFrame, keys: Keys, *order) -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def unfinished(work: DataFrame, done: DataFrame, keys: Keys) -> DataFrame:
    """Units of work without a finished one."""
    return work.join(done.select(*keys), keys, "left_anti")


def append(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_keys(df: DataFrame, kept: DataFrame, keys: Keys) -> DataFrame:
    """Rows whose key is among `kept` (common trials, eligible subjects, a fold's subjects); repeated keys there change nothing."""
    return df.join(kept.select(*keys).distinct(), keys, "left_semi")


def eligible_trials(inputs: list[DataFrame], trial: Keys, codes: list[str]) -> DataFrame:
    """Trials that every input has with a class for every one of the encoded targets `codes`."""
    for code in codes:
        inputs = [x.filter(F.col(code).isNotNull()) for x in inputs]
    return common_trials(inputs, trial)


def subject_union(inputs: list[DataFrame], subject: str) -> DataFrame:
    """Subjects of any input."""
    return reduce(lambda a, b: a.union(b), [x.select(F.col(subject).cast("string").alias(subject)) for x in inputs]).distinct()


def first_kept(df: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Each key once, with the place of its first row, in that order's number: settings and paths without repeats."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def check_resume(stored: DataFrame, now: DataFrame, keys: Keys, hashes: list[str]) -> DataFrame:
    """Stored units whose hashes (configuration, input, split) differ from today's: a resumed run must refuse if there are any."""
    both = stored.select(*keys, *[F.col(h).alias(f"_{h}") for h in hashes]).join(now.select(*keys, *hashes), keys)
    changed = F.array_compact(F.array(*[F.when(~F.col(h).eqNullSafe(F.col(f"_{h}")), F.lit(h)) for h in hashes]))
    return both.withColumn("changed", changed).filter(F.size("changed") > 0).select(*keys, F.array_join("changed", ",").alias("changed"))


def resume(work: DataFrame, stored: DataFrame, keys: Keys, hashes: list[str]) -> DataFrame:
    """The units of `work` that are not stored yet; refuses to go on from stored units made under other hashes."""
    from .validate import InvalidTable

    bad = check_resume(stored, work, keys, hashes).limit(1).collect()
    if bad:
        raise InvalidTable(f"stored results were made with another {bad[0]['changed']}")
    return unfinished(work, stored, keys)
