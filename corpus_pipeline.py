"""Corpus cleaning in stages. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm.chunks import drop_repeats
from pulseframe.llm.decontam import drop_contaminated
from pulseframe.llm.neardup import keep_one_of_each
from pulseframe.llm.pieces import encode_stage
from pulseframe.llm.store import materialise, table
from pulseframe.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("segmentation", encode_stage),
]

#: Hashing, sampling and a fitted model are outside SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
