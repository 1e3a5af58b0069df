"""Outputs: ids as text lines, CSR tables, vocabulary bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import Vocabulary
from ..operators.encode import joined


def id_lines(df: DataFrame, path: str, ids: str = "ids") -> None:
    """One line of ids, separated by blanks, for each row."""
    df.select(joined(ids).alias("value")).write.text(path)


def bundle(v: Vocabulary, spark: SparkSession, path: str) -> None:
    """The vocabulary's tables as folders of Parquet, with a table of its scalars."""
    for name, t in v.tables(spark).items():
        t.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(v.algo, v.prefix)], "algo string, prefix string").write.parquet(f"{path}/scalars")


def load_bundle(spark: SparkSession, path: str) -> Vocabulary:
    """A vocabulary from the tables that ``bundle`` wrote; they are as small as the file they came from."""
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    algo, prefix = read("scalars").first()
    vocab = {r["token"]: r["token_id"] for r in read("vocab").collect()}
    merges = tuple((r["left"], r["right"]) for r in read("merges").orderBy("rank").collect())
    scores = tuple((r["token"], r["score"]) for r in read("scores").orderBy("ord").collect())
    return Vocabulary(algo, vocab, merges, scores, prefix).validate()


def numpy_ids(df: DataFrame, ids: str = "ids"):
    """All ids as one uint32 array on the driver: for a result known to be small."""
    import numpy as np

    return np.concatenate([np.asarray(x, np.uint32) for x in df.select(F.col(ids)).toArrow()[ids].to_pylist() if x] or [np.zeros(0, np.uint32)])
