"""Encoding operators on DataFrames: no shuffle, partitions are the units of work."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels
from ..functions import text as T
from ..functions import udfs
from ..ir import BPE_UNKNOWN, Vocabulary


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a single small file would keep all but one idle.

    A large input already has more file splits than cores and is not moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    fs = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    size = sum(fs(f).getFileSystem(conf).getFileStatus(fs(f)).getLen() for f in files)
    return df.repartition(cores) if size < cores * (16 << 20) else df


def encode(df: DataFrame, v: Vocabulary, text: str = "text", out: str = "ids", mode: str = "word", strategy: str = "stepwise", on_error: str = "raise") -> DataFrame:
    """``df`` with the column ``out``: token ids as array<bigint>."""
    return df.withColumn(out, udfs.encoder(df.sparkSession, v, mode, strategy, on_error)(F.col(text)))


def long_form(df: DataFrame, *keys: str, ids: str = "ids") -> DataFrame:
    """(keys, pos, token_id), a row for each token."""
    return df.select(*keys, F.posexplode(ids).alias("pos", "token_id")).withColumn("pos", F.col("pos").cast("long"))


def csr(df: DataFrame, key: str, ids: str = "ids", length: str | None = None) -> DataFrame:
    """(key, length, offset): where each row's ids begin when all are laid out in key order.

    ``length`` names a column that holds the number of ids, where they aren't
    needed themselves.  The pairs (key, length) are kept, so texts are encoded once, not
    again for the ranges of keys.  Offsets come from sums by key range, so no single
    task sees all rows: only one row for each range goes through the unpartitioned window.
    """
    spark = df.sparkSession
    n = df.select(F.col(key).alias("k"), (F.col(length) if length else F.size(ids)).cast("long").alias("length")).persist(StorageLevel.DISK_ONLY)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, so that ranges are the same wherever they are read
    ranged = n.repartitionByRange(parts, F.col("k")).sortWithinPartitions("k").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("part").agg(F.sum("length").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    r = ranged.withColumn("inner", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return r.join(F.broadcast(bases), "part").select(F.col("k").alias(key), "length", (F.col("base") + F.col("inner")).alias("offset"))


def counted(df: DataFrame, v: Vocabulary, text: str = "text", out: str = "n_tokens", mode: str = "word", strategy: str = "stepwise") -> DataFrame:
    """``df`` with the number of token ids of each text; the ids don't leave the workers."""
    return df.withColumn(out, udfs.token_counter(df.sparkSession, v, mode, strategy)(F.col(text)))


def joined(ids: str = "ids"):
    """Ids as one string, separated by blanks."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def _symbols(v: Vocabulary) -> tuple[dict[str, str], list[tuple[str, str]], str, dict[str, int]]:
    """(characters with an id, replacements in rank order, the unknown symbol, id of each symbol) of a BPE vocabulary.

    A token's symbol is one character: its own, or one that no token and no white space is.
    """
    own = {t: t for t in v.vocab if len(t) == 1 and kernels.WORD.fullmatch(t)}
    free = (c for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))) if c not in own and c not in "$\\" and kernels.WORD.fullmatch(c))
    symbols, steps = dict(own), []
    for a, b in sorted(v.ranks, key=v.ranks.get):
        if a in symbols and b in symbols and a + b in v.vocab:
            if a + b not in symbols:
                symbols[a + b] = next(free)
            steps.append((symbols[a] + symbols[b], symbols[a + b]))
    unk = v.unknown(BPE_UNKNOWN) or 0
    ids = {c: v.vocab[t] for t, c in symbols.items()}
    unknown = next((c for c, i in ids.items() if i == unk), None) or next(free)  # a real token's id: it merges like that token
    return own, steps, unknown, ids | {unknown: unk}


def encode_native(df: DataFrame, v: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """BPE by built-in functions alone: every merge, in rank order, replaces its pair of symbols in the whole text.

    White space becomes one blank between words and any character without an id the
    unknown symbol before pairs are looked for, so a text can hold any characters and no pair reaches
    over two words.  The time is the text's length for each merge, however long its words.
    For well-formed merge lists of some tens of rules (parts are characters or
    results of earlier rules).
    """
    own, steps, unknown, ids = _symbols(v)
    x = F.regexp_replace(F.col(text), T.WHITE, " ")
    x = F.regexp_replace(x, "[^ " + "".join(f"\\x{{{ord(c):x}}}" for c in own) + "]", unknown if unknown not in "$\\" else "\\" + unknown)
    for pair, merged in steps:
        x = F.replace(x, F.lit(pair), F.lit(merged))
    letters = F.array_remove(F.split(F.replace(x, F.lit(" "), F.lit("")), ""), "")
    long = lambda i: F.lit(i).cast("long")
    top = max(map(ord, ids))
    if top < 2048:
        table = F.array(*[long(ids.get(chr(i), 0)) for i in range(top + 1)])
        found = F.transform(letters, lambda c: F.get(table, F.ascii(c)))
    else:
        table = F.create_map(*[y for c, i in ids.items() for y in (F.lit(c), long(i))])
        found = F.transform(letters, lambda c: F.try_element_at(table, c))
    return df.withColumn(out, found)
