"""Two-pass external shuffle into shards of equal row counts (law ``rows``).

Pass one scatters the rows by a seeded hash into buckets of about
``bucket_bytes``, uniformly; pass two puts each bucket in a fixed order and
applies a seeded Fisher-Yates shuffle to it.  A row's place in the whole
order is its bucket's start plus its place in the bucket; place p goes to
shard p mod n and slot p div n, so counts differ by one at most and slots have
no gaps.  The bucket starts come from one count by bucket and meet their buckets as
a table, so nothing that grows with the input is collected or broadcast; a bucket that
doesn't have the rows it was counted with fails the job.  Partitions follow the
buckets: a task holds one bucket at a time, and ``write`` writes in pass two, without a third shuffle.

The hash takes the id and the row's number in its input partition:
equal ids, equal texts and repeated rows scatter as others do.  The input must be a
deterministic scan (files, or a table cut in the shared folder), so that a
lost task is repeated alike.

Defined results: a null text has no bytes; null ids are kept; a very long text is a
bucket's rest larger; an empty table gives no rows; an empty shard is written as no file; other
columns travel with the row, whatever their names, but for input columns ``_shard`` and ``_slot``, which are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents

SHARDS = 8
BUCKET_BYTES = 64 << 20
MOST_TASKS = 20_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places; numpy's generator swaps from the end, as Fisher and Yates do."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def shuffle(df: DataFrame, doc: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with _shard int and _slot long; its rows come in bucket order."""
    names = [c for c in df.columns if c not in ("_shard", "_slot")]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    row = F.xxhash64(F.lit(seed), F.col(doc), F.monotonically_increasing_id())
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets, MOST_TASKS))
    d = df.select(*own, row.alias("hash")).withColumn("bucket", F.pmod(F.col("hash"), F.lit(buckets)).cast("int"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one small row a bucket
    starts = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))

    def run(key, t, start):
        import pyarrow as pa

        bucket, n, at = key[0].as_py(), start.column("n")[0].as_py(), start.column("at")[0].as_py()
        if t.num_rows != n:
            raise RuntimeError(f"bucket {bucket} has {t.num_rows} rows, not {n}: the input isn't deterministic")
        t = t.sort_by([("hash", "ascending")])
        p = at + fisher_yates(n, seed, bucket)
        t = t.drop_columns(["hash", "bucket"])
        return t.append_column("_shard", pa.array((p % shards).astype(np.int32))).append_column("_slot", pa.array(p // shards))

    schema = "".join(f"c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(names)) + "_shard int, _slot long"
    both = d.repartition(parts, "bucket").groupBy("bucket").cogroup(starts.repartition(parts, "bucket").groupBy("bucket"))
    return both.applyInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "_shard", "_slot")


def write(shuffled: DataFrame, path: str) -> None:
    """The shards as folders of Parquet, one file for each task that holds buckets; rows are in slot order in each file."""
    shuffled.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shuffle(documents(spark, sf_dir))
    raw = F.coalesce(F.col("text"), F.lit(""))
    return s.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(F.encode(raw, "utf-8")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
