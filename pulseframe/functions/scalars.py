"""Scalar expressions over columns. Everything stays inside Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Target classes by task kind (fixed values): class name -> ratings, in code order.
TASKS = {
    "binary": {"low": (1, 2, 3, 4), "high": (6, 7, 8, 9)},
    "ternary": {"low": (1, 2, 3), "medium": (4, 5, 6), "high": (7, 8, 9)},
    "multiclass": {str(i): (i,) for i in range(1, 10)},
}


def parse_time(text: Column) -> Column:
    """A timestamp without zone from `2020-01-01T10:00:00:015625`, `...:00.015625` or `...:00`; null if it is
    none of these."""
    plain = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}):(\d{1,6})$", "$1.$2")
    fits = plain.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$")
    return F.when(fits, F.regexp_replace(plain, "T", " ").try_cast("timestamp_ntz"))


def epoch_micros(t: Column) -> Column:
    """Microseconds of a timestamp without zone since 1970-01-01."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def epoch_seconds(t: Column) -> Column:
    return epoch_micros(t) / F.lit(1e6)


def no_nan(c: Column) -> Column:
    """Null for NaN: the rule of every source."""
    return F.when(F.isnan(c), None).otherwise(c)


def trial_id(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def sample_id(trial: Column, window: Column) -> Column:
    return F.concat(trial, F.lit("|w"), window.cast("string"))


def safe_token(text: Column) -> Column:
    """Runs outside letters, digits and ._+- become _; _ and . go from both ends; nothing left is `run`."""
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._+-]+", "_"), r"^[_.]+|[_.]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("run"))


def stable_seed(*parts: Column) -> Column:
    """The first four bytes, big-endian, of the SHA-256 of the parts joined by a bar."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def fingerprint(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def setting_slug(window: float, overlap: float) -> str:
    """`w60_o30`, `w30_o7p5`; refuses windows and overlaps that make no step."""
    if not (math.isfinite(window) and math.isfinite(overlap) and window > 0 and 0 <= overlap < window):
        raise ValueError(f"not a window setting: {window}:{overlap}")
    return f"w{window:g}_o{overlap:g}".replace(".", "p")


def parse_setting(text: Column) -> Column:
    """Struct of window and overlap seconds of `W:O`; null unless both are finite, W > 0 and 0 <= O < W."""
    parts = F.split(F.trim(text), ":")
    w, o = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    fits = (F.size(parts) == 2) & (w > 0) & (o >= 0) & (o < w) & (w < float("inf")) & ~F.isnan(w) & ~F.isnan(o)
    return F.when(fits, F.struct(w.alias("window_s"), o.alias("overlap_s")))


def slug(window: Column, overlap: Column) -> Column:
    """`setting_slug` over columns."""
    text = lambda c: F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")
    return F.regexp_replace(F.concat(F.lit("w"), text(window), F.lit("_o"), text(overlap)), r"\.", "p")


def encode_target(rating: Column, kind: str) -> Column:
    """Class code of a rating, null where the task leaves it out; `regression` passes the number."""
    number = rating.try_cast("double")
    if kind == "regression":
        return number
    out = F.lit(None).cast("int")
    for code, members in reversed(list(enumerate(TASKS[kind].values()))):
        out = F.when(number.isin([float(m) for m in members]), F.lit(code)).otherwise(out)
    return out


def source_feature(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "__mean$", ""), "__std$", "")


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def argmax(scores: Column) -> Column:
    """Index from 0 of the greatest element; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def encode_scores(scores: Column) -> Column:
    """JSON text of a score vector; null stays null, NaN and infinite elements become null inside."""
    return F.to_json(F.transform(scores, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)))


def decode_scores(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text of named values with sorted keys, nulls kept: equal values have equal text."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def flatten_json(text: Column) -> Column:
    """Array of (path, kind, value) for every leaf of an object's JSON text, whatever its fields, two levels deep: `kind` is number, bool,
    text, list (its JSON text as it stands) or null (value empty). Objects below the second level stay as their text."""
    level = lambda t: F.map_entries(F.from_json(t, "map<string,string>"))
    is_object = lambda v: v.rlike(r"^\s*\{")

    def leaf(path: Column, v: Column) -> Column:
        kind = F.when(v.isNull(), "null").when(v.rlike(r"^\s*\["), "list").when(is_object(v), "object").when(v.isin("true", "false"), "bool").when(v.try_cast("double").isNotNull(), "number").otherwise("text")
        return F.struct(path.alias("path"), kind.alias("kind"), F.coalesce(v, F.lit("")).alias("value"))

    def one(e: Column) -> Column:
        inner = F.transform(level(e["value"]), lambda x: leaf(F.concat(e["key"], F.lit("."), x["key"]), x["value"]))
        return F.when(is_object(e["value"]), inner).otherwise(F.array(leaf(e["key"], e["value"])))

    return F.array_sort(F.flatten(F.transform(level(text), one)))


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone; stands in for a seeded generator."""
    return stable_seed(*parts) / F.lit(float(1 << 32))


def natural_order(subject: Column) -> list[Column]:
    """Sort keys: whole numbers first by value, then text."""
    return [F.when(subject.rlike(r"^\d+$"), 0).otherwise(1), F.when(subject.rlike(r"^\d+$"), subject.try_cast("bigint")), subject]


def deviation(column: str) -> Column:
    """Aggregate: population std, exactly 0 where all known values are one finite number (Spark's own puts parts together
    with rounding, so a column that never varies can get 1e-16)."""
    least, most = F.min(column).cast("double"), F.max(column).cast("double")
    return F.when((least == most) & (F.abs(most) < float("inf")), F.lit(0.0)).otherwise(F.stddev_pop(column))
