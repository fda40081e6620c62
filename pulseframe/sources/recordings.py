"""Recordings as one JSON file per subject, condition and phase; questionnaires; feature tables; results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, no_nan, parse_time
from ..operators.validate import InvalidTable, duplicate_keys

#: The file name of a recording (fixed value of the format).
NAME = r"^(\d+)_([A-Z0-9]+)_(BASELINE|STIMULUS|QUESTIONNAIRES|WASHOUT)_EMPATICA\.json$"
ROWS = "map<string,array<array<string>>>"


def parse_name(name: Column) -> Column:
    """Struct of subject, condition, phase from a file name; null if it is none."""
    part = lambda i: F.regexp_extract(name, NAME, i)
    return F.when(name.rlike(NAME), F.struct(part(1).cast("int").alias("subject"), part(2).alias("condition"), part(3).alias("phase")))


def discover(files: DataFrame, path: str = "path") -> DataFrame:
    """path, subject, condition, phase, problem of every file: `not_a_recording`, `wrong_folder` (the subject is
    not the folder's name) or `duplicate`."""
    parts = F.split(F.col(path), "/")
    found = files.select(path, parse_name(F.element_at(parts, -1)).alias("_n"), F.element_at(parts, -2).alias("_folder"))
    found = found.select(path, "_n.*", "_folder")
    twice = duplicate_keys(found.filter("subject is not null"), ["subject", "condition", "phase"]).select("subject", "condition", "phase", F.lit(True).alias("_twice"))
    found = found.join(twice, ["subject", "condition", "phase"], "left")
    problem = F.when(F.col("subject").isNull(), "not_a_recording").when(F.col("_folder").try_cast("int") != F.col("subject"), "wrong_folder").when(F.col("_twice"), "duplicate")
    return found.withColumn("problem", problem).select(path, "subject", "condition", "phase", "problem")


def explode_signals(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, signal, pos, row (array of text) of JSON objects signal -> list of rows."""
    return df.select(*keep, F.explode(F.from_json(text, ROWS)).alias("signal", "_rows")).select(*keep, "signal", F.posexplode("_rows").alias("pos", "row"))


def read_recordings(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """subject, condition, phase, signal, pos, t (epoch seconds, no zone), values (doubles, null for NaN) of every
    sample under `path`. A file is parsed once; strict: one whose root is no object fails the scan, otherwise it gives no rows."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_EMPATICA.json").text(path, wholetext=True)
    files = files.select("value", parse_name(F.col("_metadata.file_name")).alias("n"), F.col("_metadata.file_path").alias("file")).filter("n is not null")
    signals = F.from_json("value", ROWS)
    if strict:
        signals = F.when(F.trim("value").rlike(r"^\{[\s\S]*\}$"), signals)
        signals = F.coalesce(signals, F.raise_error(F.concat(F.lit("no object of signals: "), "file")).cast(ROWS))
    rows = files.select("n.*", signals.alias("_s")).select("subject", "condition", "phase", F.explode("_s").alias("signal", "_rows"))
    rows = rows.select("subject", "condition", "phase", "signal", F.posexplode("_rows").alias("pos", "row"))
    values = F.transform(F.slice("row", 2, F.greatest(F.lit(0), F.size("row") - 1)), lambda x: no_nan(x.try_cast("double")))
    return rows.select("subject", "condition", "phase", "signal", "pos", epoch_seconds(parse_time(F.element_at("row", 1))).alias("t"), values.alias("values"))


QUESTIONNAIRE = "struct<metadata:struct<id:int,movie_order:array<string>>,questionnaires:array<struct<movie:string,sam:struct<VALENCE:int,AROUSAL:int,MOTIVATION:int>,emotions:map<string,int>>>>"


def questionnaire_rows(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per movie with its place in the order and ratings, and problem: `duplicate_movie`, `missing_sam`,
    `out_of_range` (not 1 to 9)."""
    rows = df.select(*keep, F.from_json(text, QUESTIONNAIRE).alias("q")).select(*keep, F.col("q.metadata.id").alias("subject"), F.col("q.metadata.movie_order").alias("_order"), F.explode("q.questionnaires").alias("r"))
    rows = rows.select(*keep, "subject", F.col("r.movie").alias("condition"), F.nullif(F.array_position("_order", F.col("r.movie")), F.lit(0)).alias("movie_order_index"), *[F.col(f"r.sam.{s}").alias(f"sam_{s.lower()}") for s in ("VALENCE", "AROUSAL", "MOTIVATION")])
    twice = duplicate_keys(rows, ["subject", "condition"]).select("subject", "condition", F.lit(True).alias("_twice"))
    sams = [F.col(f"sam_{s}") for s in ("valence", "arousal", "motivation")]
    missing = sams[0].isNull() | sams[1].isNull() | sams[2].isNull()
    outside = ~(sams[0].between(1, 9) & sams[1].between(1, 9) & sams[2].between(1, 9))
    out = rows.join(twice, ["subject", "condition"], "left")
    return out.withColumn("problem", F.when(F.col("_twice"), "duplicate_movie").when(missing, "missing_sam").when(outside, "out_of_range")).drop("_twice")


def read_features(spark: SparkSession, paths: list[str], metadata: list[str]) -> DataFrame:
    """A feature CSV: metadata columns as text, all others as doubles, NaN as null. A value that is no number is
    refused; repeated paths are read once."""
    from ..operators.validate import numeric_issues, required_columns

    raw = spark.read.option("header", "true").option("nullValue", "NaN").csv(list(dict.fromkeys(paths)))
    required_columns(raw, metadata)
    numbers = [c for c in raw.columns if c not in metadata]
    bad = numeric_issues(raw, numbers).filter("not_numeric > 0 or infinite > 0").limit(1).collect()
    if bad:
        raise InvalidTable(f"column {bad[0]['column']} has values that are no finite numbers")
    return raw.select(*metadata, *[F.col(c).cast("double").alias(c) for c in numbers])


def check_manifest(spark: SparkSession, table: DataFrame, path: str) -> None:
    """The table must have the rows and columns that its manifest tells."""
    text = spark.read.text(path, wholetext=True).first()[0]
    said = json.loads(text)["output"]
    have = {"row_count": table.count(), "column_count": len(table.columns)}
    wrong = [f"{k} is {have[k]}, not {said[k]}" for k in have if said.get(k) is not None and said[k] != have[k]]
    if wrong:
        raise InvalidTable("; ".join(wrong))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha of every file below (each under 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.length("content").alias("size"), F.sha2("content", 256).alias("sha"))


def write_store(samples: DataFrame, trials: DataFrame, index: DataFrame, path: str) -> None:
    """The signal store: samples by series, sorted within; trials and the series index beside. A file holds a range of series, so files follow
    the data's size and not the number of subjects, and a reader of one subject is led by the files' bounds."""
    samples.repartitionByRange("subject", "signal").sortWithinPartitions("subject", "signal", "pos").write.parquet(f"{path}/samples")
    trials.write.parquet(f"{path}/trials")
    index.write.parquet(f"{path}/signals")


def twelve_digits(c: Column) -> Column:
    """A number as text with at most twelve significant digits, as C's %.12g: plain from 1e-5 to 1e12, else with an exponent of two digits
    or more, without trailing zeros; null is NaN. Halves are those of the shortest decimal form, and
    subnormal numbers have Java's fewer digits."""
    x = c.cast("double")
    text = F.format_string("%.11e", x)
    power = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_extract(text, r"^(-?\d\.?\d*)e", 1), r"\.?0+$", "")
    plain = lambda k: F.format_string(f"%.{k}f", x)
    fixed = F.lit(None).cast("string")
    for k in range(17):
        fixed = F.when(F.lit(11) - power == k, plain(k)).otherwise(fixed)
    fixed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    return F.when(x.isNull() | F.isnan(x), "NaN").when(x == 0, "0").when((power < -4) | (power >= 12), F.concat(digits, F.regexp_extract(text, r"(e[+-]\d+)$", 1))).otherwise(fixed)


def write_features_csv(df: DataFrame, path: str, order: list) -> None:
    """Feature files in the order of `order` (a range sort: file after file), doubles with twelve digits, NaN for nulls; an older table
    there is replaced."""
    out = df.orderBy(*order).select(*[twelve_digits(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema])
    out.write.mode("overwrite").option("header", "true").option("nullValue", "NaN").csv(path)


def write_results(results: dict[str, DataFrame], path: str, run: str) -> None:
    """One table per result, partitioned by run and by target where it has one; vectors stay arrays. A run that is written again replaces
    its own partitions, so nothing doubles."""
    for name, df in results.items():
        parts = ["run", *(["target"] if "target" in df.columns else [])]
        df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/{name}")


def write_eligibility(subjects: DataFrame, inputs: DataFrame, path: str, run: str) -> None:
    """The participants' and the inputs' eligibility tables (trials.completeness, trials.eligibility_report) of a run."""
    write_results({"participant_eligibility": subjects, "input_eligibility": inputs}, path, run)


def write_manifest(df: DataFrame, path: str, subject: str, trial: list[str], status: str, configuration: dict, inputs: DataFrame, **contract) -> None:
    """One JSON row: status, the configuration and its fingerprint, per input file (path, size, sha; see file_digests) its hash, rows, subjects, trials and what
    the caller states. An older manifest there is replaced."""
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(subject).alias("subjects"), F.count_distinct(*trial).alias("trials"))
    files = inputs.agg(F.sort_array(F.collect_list(F.struct("path", "size", "sha"))).alias("inputs"))
    text = json.dumps(configuration, sort_keys=True, separators=(",", ":"))
    said = {"status": F.lit(status), "configuration": F.lit(text), "configuration_sha256": F.sha2(F.lit(text), 256)}
    said |= {k: F.lit(v if isinstance(v, (int, float, bool, str)) else json.dumps(v)) for k, v in contract.items()}
    facts.crossJoin(F.broadcast(files)).select("*", *[c.alias(k) for k, c in said.items()]).coalesce(1).write.mode("overwrite").json(path)
