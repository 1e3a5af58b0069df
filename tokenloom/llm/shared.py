"""The shared folder in which lineage is cut, and small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and the session local, as in tests."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tl_folder", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = spark._tl_folder = tempfile.mkdtemp(prefix="tokenloom-")
    return d.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no more than a rereading."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tokenloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if folder.getName().startswith("tokenloom-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
