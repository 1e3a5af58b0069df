"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet in the shared folder and read again as the next one's documents.  All
but the last return the columns of ``documents``; n_chars follows the text.

* quality: rejected documents go, the others lose their failing lines;
* lines: repeated and nearly repeated lines go, and documents left without a word;
* near_duplicates: the smallest id of each component stays;
* decontamination: documents that hold a benchmark item go;
* packing: every piece of every document with its sequence and offset.

A document without an id passes the stages that work by id untouched; an empty
table passes every stage.  No SQL expresses the third stage, so there is
none; tests hold the rows against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, line_dedup, near_dup, packing, quality_rules
from tokenloom.llm.shared import cut


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else df


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.stage(spark, docs, sf_dir))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_dup.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
