"""Columns that never vary, in parts of sizes whose means are rounded when they are put together."""

from pyspark.sql import functions as F

from pulseframe.operators import prepare, validate


def parts(spark):
    x = F.col("id") * 0.0
    return spark.range(0, 98, 1, 2).select("id", (x + 3).alias("three"), (x + 0.25).alias("quarter"), (x + 0.1).alias("tenth"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") < 3, "NaN").otherwise("0.25").cast("double").alias("nan"))


def test_constant_columns_are_found(spark):
    assert prepare.constant_columns(parts(spark), ["three", "quarter", "tenth", "none", "nan", "id"]) == ["three", "quarter", "tenth", "none"]
    flat = prepare.standardise(parts(spark), parts(spark), ["quarter", "tenth"]).agg(F.max(F.abs("quarter")), F.max(F.abs("tenth"))).first()
    assert max(flat) < 1e-9


def test_zero_variance_finds_them(spark):
    found = validate.zero_variance(parts(spark), ["three", "quarter", "tenth", "none", "nan", "id"]).collect()
    assert sorted((r.column, r.std) for r in found) == [("quarter", 0.0), ("tenth", 0.0), ("three", 0.0)]
