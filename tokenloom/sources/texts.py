"""Text inputs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANGRAM = "the quick brown fox jumps over the lazy dog "


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): the lines of text files; a carriage return before the line feed is dropped."""
    return spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("text"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text, up to its first byte that isn't UTF-8."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", valid_prefix(F.col("content")).alias("text"))


def valid_prefix(content):
    """The longest start of a binary column that is UTF-8."""

    @F.pandas_udf("string")
    def run(s):
        def cut(b):
            try:
                return bytes(b).decode()
            except UnicodeDecodeError as e:
                return bytes(b)[: e.start].decode()

        return s.map(cut, na_action="ignore")

    return run(content)


def synthetic(spark: SparkSession, size: int, rows: int = 1) -> DataFrame:
    """(id, text): a repeated pangram of ``size`` bytes."""
    n = len(PANGRAM)
    return spark.range(rows).select("id", F.substring(F.repeat(F.lit(PANGRAM), size // n + 1), 1, size).alias("text"))


def checked(df: DataFrame, raw: str = "raw", out: str = "text") -> DataFrame:
    """A binary column as text; null or bad UTF-8 raises, naming the column."""
    ok = F.is_valid_utf8(F.col(raw).cast("string"))
    return df.withColumn(out, F.when(F.col(raw).isNotNull() & ok, F.col(raw).cast("string")).otherwise(F.raise_error(F.lit(f"null or invalid UTF-8 in {raw}"))))
