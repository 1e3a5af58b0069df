"""Aggregates over texts and their tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kernels
from ..functions import text as T
from ..functions import udfs
from ..ir import Vocabulary

COUNTERS = ("total_bytes", "total_words", "fast_words", "fast_bytes", "fallback_words", "fallback_bytes")


def bulk_stats(df: DataFrame, v: Vocabulary, text: str = "text") -> DataFrame:
    """One row of the six counters and their percentages, 0 for no input."""
    s = df.select(udfs.bulk_stats(df.sparkSession, v)(F.col(text)).alias("s"))
    t = s.agg(*[F.coalesce(F.sum(f"s.{c}"), F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) * 100.0 / F.col(b))
    return t.withColumns({"fast_words_percent": share("fast_words", "total_words"), "fast_bytes_percent": share("fast_bytes", "total_bytes")})


def pretoken_stats(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Count, longest and mean bytes of pretokens, without a row for each."""
    sizes = F.transform(T.pretokens(F.col(text)), lambda p: F.octet_length(p).cast("long"))
    zero = F.lit(0).cast("long")
    per = df.select(*keys, F.size(sizes).cast("long").alias("n"), F.coalesce(F.array_max(sizes), zero).alias("m"), F.aggregate(sizes, zero, lambda a, x: a + x).alias("b"))
    g = per.groupBy(*keys).agg(F.coalesce(F.sum("n"), zero).alias("n_pretokens"), F.coalesce(F.max("m"), zero).alias("max_bytes"), F.sum("b").alias("total"))
    return g.select(*keys, "n_pretokens", "max_bytes", F.when(F.col("n_pretokens") == 0, 0.0).otherwise(F.col("total") / F.col("n_pretokens")).alias("avg_bytes"))


def token_frequencies(df: DataFrame, v: Vocabulary, text: str = "text", mode: str = "word", strategy: str = "stepwise") -> DataFrame:
    """(token_id, n): how often each id occurs in all texts.

    Workers count, a slice of the texts at a time, so neither ids nor a row for each leave them.
    """
    kernels.Encoder(v, mode, strategy)
    known = df.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = kernels.Encoder(known.value, mode, strategy)
        for s in udfs._slices(b.column(0) for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in e.count_all(s.to_pylist())], names=["token_id", "n"])

    return df.select(text).mapInArrow(run, "token_id bigint, n bigint").groupBy("token_id").agg(F.sum("n").alias("n"))


def only_in_one(df: DataFrame, a: str, b: str, *keys: str, sides: tuple[str, str]) -> DataFrame:
    """(keys, ids, side): EXCEPT ALL of the rows (keys, a) and (keys, b), either way.

    Where a row's two arrays are equal it counts on both sides and cancels out, so only
    the others are grouped: nothing is shuffled where the sides agree.  They come from
    the generator; a filter would be pushed down and encode what it keeps again.
    """
    sign = lambda x, n: F.struct(F.array_join(F.col(x).cast("array<string>"), " ").alias("ids"), F.lit(n).cast("long").alias("n"))
    rows = df.select(*keys, F.explode(F.when(~F.col(a).eqNullSafe(F.col(b)), F.array(sign(a, 1), sign(b, -1)))).alias("s"))
    left = rows.groupBy(*keys, F.col("s.ids").alias("ids")).agg(F.sum("s.n").alias("n")).filter("n <> 0")
    side = F.when(F.col("n") > 0, sides[0]).otherwise(sides[1])
    return left.select(*keys, "ids", side.alias("side"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))).alias("i")).drop("i")


def upper_median(values: list[float]) -> float:
    """The middle of the sorted values, the upper one of two."""
    return sorted(values)[len(values) // 2]
