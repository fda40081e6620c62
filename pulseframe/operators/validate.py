"""Checks of tables: each gives the violations as rows or counts, so an empty result is a valid table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import deviation

Keys = list[str]


class InvalidTable(ValueError):
    """A table that a strict reader refuses."""


def required_columns(df: DataFrame, names: list[str]) -> None:
    """Refuses missing columns, repeated column names and empty tables."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise InvalidTable(f"missing columns: {', '.join(missing)}")
    if len(set(df.columns)) != len(df.columns):
        raise InvalidTable("column names repeat")
    if df.limit(1).count() == 0:
        raise InvalidTable("the table has no rows")


def family_columns(df: DataFrame, prefixes: dict[str, str], expected: dict[str, int] | None = None) -> dict[str, list[str]]:
    """Family -> sorted columns with its prefix; empty families and unexpected counts are refused."""
    out = {}
    for family, prefix in prefixes.items():
        out[family] = sorted(c for c in df.columns if c.startswith(prefix))
        if not out[family]:
            raise InvalidTable(f"no columns of family {family}")
        if expected and family in expected and len(out[family]) != expected[family]:
            raise InvalidTable(f"family {family} has {len(out[family])} columns, not {expected[family]}")
    return out


def representation(df: DataFrame, families: dict[str, list[str]], parts: list[str], keep: Keys) -> DataFrame:
    """`keep` and the columns of the named families, in that order."""
    return df.select(*keep, *[c for p in parts for c in families[p]])


def numeric_issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, not_numeric (present but no number), infinite: one row per column."""
    aggs = []
    for c in columns:
        number = F.col(c).try_cast("double")
        aggs += [F.count_if(F.col(c).isNotNull() & number.isNull()).alias(f"{c}|n"), F.count_if(F.abs(number) == float("inf")).alias(f"{c}|i")]
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|n`").alias("not_numeric"), F.col(f"`{c}|i`").alias("infinite")) for c in columns]))
    return wide.select(stacked.alias("r")).select("r.*")


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value is missing, no number or outside [low, high]."""
    number = F.col(column).try_cast("double")
    return df.filter(number.isNull() | ~number.between(low, high))


def normalise_condition(df: DataFrame, column: str, exclude: list[str] = (), casefold: bool = True) -> DataFrame:
    """Trimmed (and upper-cased) conditions without the excluded ones."""
    c = F.trim(F.col(column))
    c = F.upper(c) if casefold else c
    gone = [x.strip().upper() if casefold else x.strip() for x in exclude]
    return df.withColumn(column, c).filter(~F.col(column).isin(gone) if gone else F.lit(True))


def select_named(df: DataFrame, column: str, include: str = "", exclude: str = "") -> DataFrame:
    """Comma-separated include and exclude lists, upper-cased; a name in both is refused."""
    names = lambda text: [x.strip().upper() for x in text.split(",") if x.strip()]
    yes, no = names(include), names(exclude)
    if set(yes) & set(no):
        raise InvalidTable(f"included and excluded: {', '.join(sorted(set(yes) & set(no)))}")
    c = F.upper(F.col(column).cast("string"))
    df = df.filter(c.isin(yes)) if yes else df
    return df.filter(~c.isin(no)) if no else df


def unknown_names(df: DataFrame, column: str, include: str) -> DataFrame:
    """Names of the include list that the table has not."""
    names = [(x.strip().upper(),) for x in include.split(",") if x.strip()]
    wanted = df.sparkSession.createDataFrame(names, "name string")
    return wanted.join(df.select(F.upper(F.col(column).cast("string")).alias("name")).distinct(), "name", "left_anti")


def phase_reasons(df: DataFrame, phase: Column, available: Column, has_signals: Column, wanted: str = "STIMULUS") -> DataFrame:
    """Adds skip_reason, null for the rows to use."""
    return df.withColumn("skip_reason", F.when(phase != wanted, "other_phase").when(~F.coalesce(available, F.lit(False)), "not_available").when(~F.coalesce(has_signals, F.lit(False)), "missing_signal"))


def duplicate_keys(df: DataFrame, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def label_conflicts(df: DataFrame, trial: Keys, label: str) -> DataFrame:
    """Trials with more than one label."""
    return df.groupBy(*trial).agg(F.count_distinct(label).alias("n_labels")).filter("n_labels > 1")


def row_shapes(df: DataFrame, keys: Keys, row: str, channels: Column | None = None) -> DataFrame:
    """Per series of array rows [time, v1..vn]: widths, time formats, and whether it is as it should be: one
    width of two or more, one format, and the expected channel count."""
    form = F.when(F.element_at(row, 1).rlike(r"T\d\d:\d\d:\d\d:\d+$"), "colon").when(F.element_at(row, 1).rlike(r"T\d\d:\d\d:\d\d\.\d+$"), "point").otherwise("plain")
    out = df.groupBy(*keys).agg(F.min(F.size(row)).alias("min_width"), F.max(F.size(row)).alias("max_width"), F.count_distinct(form).alias("formats"))
    fits = (F.col("min_width") >= 2) & (F.col("min_width") == F.col("max_width")) & (F.col("formats") == 1)
    return out.withColumn("valid", fits & (F.col("min_width") - 1 == channels) if channels is not None else fits)


def zero_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns whose known values have population std 0, in one pass."""
    wide = df.agg(*[deviation(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("std")) for c in columns]))
    return wide.select(rows.alias("r")).select("r.*").filter("std = 0")


def store_violations(samples: DataFrame, index: DataFrame, trials: DataFrame, keys: Keys, trial: Keys) -> DataFrame:
    """check, key: series in data or index only, other sample counts, series that do not begin at rel_t 0
    (1e-9), trials without a rating from 1 to 9, series of unknown trials. Empty if the store is sound."""
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    data = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"), F.min("rel_t").alias("first"))
    both = data.join(index.select(*keys, F.col("n_samples").alias("said")), keys, "full_outer")
    found = [
        both.filter("said is null").select(F.lit("not_indexed").alias("check"), name.alias("key")),
        both.filter("have is null").select(F.lit("no_data").alias("check"), name.alias("key")),
        both.filter("have != said").select(F.lit("other_count").alias("check"), name.alias("key")),
        both.filter("abs(first) > 1e-9").select(F.lit("start_not_zero").alias("check"), name.alias("key")),
        trials.filter("rating is null or rating not between 1 and 9").select(F.lit("bad_rating").alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in trial]).alias("key")),
        index.join(trials, trial, "left_anti").select(F.lit("unknown_trial").alias("check"), name.alias("key")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
