"""Vocabulary tables: lookups, merge rules and trie states as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import BPE_UNKNOWN, Vocabulary


def merge_ranks(merges: DataFrame) -> DataFrame:
    """(left, right, rank): a pair that comes twice keeps its last rank."""
    return merges.groupBy("left", "right").agg(F.max("rank").alias("rank"))


def id_merges(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """(left_id, right_id, merged_id, rank) of the rules of which both parts and the result have ids."""

    def ids(column: str, name: str) -> DataFrame:
        return vocab.select(F.col("token").alias(column), F.col("token_id").alias(name))

    m = merge_ranks(merges).withColumn("merged", F.concat("left", "right"))
    j = m.join(ids("left", "left_id"), "left").join(ids("right", "right_id"), "right").join(ids("merged", "merged_id"), "merged")
    return j.select("left_id", "right_id", "merged_id", "rank")


def byte_vocab(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """(byte, token_id) for all 256 bytes."""
    unk = v.unknown(BPE_UNKNOWN) or 0
    b = spark.range(256).select(F.col("id").alias("byte"), F.when(F.col("id") < 128, F.char("id")).alias("token"))
    t = v.tables(spark)["vocab"]
    return b.join(t, "token", "left").select("byte", F.coalesce("token_id", F.lit(unk)).alias("token_id"))


def short_words(vocab: DataFrame) -> DataFrame:
    """(word, token_id) of tokens of 1 to 8 bytes, U+0120 also read as a blank; raw tokens first, then the lowest id."""
    raw = vocab.select(F.col("token").alias("word"), "token_id", F.lit(0).alias("turn"))
    blank = vocab.filter(F.col("token").contains("Ġ")).select(F.translate("token", "Ġ", " ").alias("word"), "token_id", F.lit(1).alias("turn"))
    both = raw.union(blank).filter(F.octet_length("word").between(1, 8))
    return both.groupBy("word").agg(F.min_by("token_id", F.struct("turn", "token_id")).alias("token_id"))


def whole_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``words`` (key = word with the blank before it, if any) with the id of the first of four lookups that hits, else null."""
    short = short_words(vocab)
    plain = F.when(F.col("key").startswith(" "), F.substring("key", 2, 2**30)).otherwise(F.col("key"))
    out = words.withColumn("word", plain)
    for i, (table, column, key) in enumerate(((short, "word", "key"), (short, "word", "word"), (vocab, "token", "key"), (vocab, "token", "word"))):
        out = out.join(table.select(F.col(column).alias(key), F.col("token_id").alias(f"hit{i}")), key, "left")
    return out.select(*words.columns, "word", F.coalesce(*[f"hit{i}" for i in range(4)]).alias("token_id"))


def _longest(vocab: DataFrame) -> int:
    return vocab.agg(F.max(F.length("token"))).first()[0] or 0


def common_prefixes(texts: DataFrame, vocab: DataFrame, text: str = "word") -> DataFrame:
    """``texts`` with (length in bytes, token_id) of every token that is a prefix: an equi-join on the prefixes up to the longest token."""
    n = F.least(F.length(text), F.lit(_longest(vocab)))
    p = texts.filter(n > 0).withColumn("token", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substr(F.col(text), F.lit(1), k))))
    return p.join(vocab, "token").select(*texts.columns, F.octet_length("token").cast("long").alias("length"), "token_id")


def trie_states(vocab: DataFrame) -> DataFrame:
    """(state, token_id): every non-empty byte prefix of a token in hex, and the token's id where it ends."""
    t = vocab.filter("token <> ''").select(F.hex(F.encode("token", "utf-8")).alias("h"), "token_id")
    states = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.expr("length(h) div 2").cast("int")), lambda k: F.substr(F.col("h"), F.lit(1), k * 2))).alias("state")).distinct()
    return states.join(t.withColumnRenamed("h", "state"), "state", "left")


def trie_edges(vocab: DataFrame) -> DataFrame:
    """(parent, byte, state): the root is the empty string."""
    s = F.col("state")
    return trie_states(vocab).select(F.substr(s, F.lit(1), F.length(s) - 2).alias("parent"), F.conv(F.substr(s, F.length(s) - 1), 16, 10).cast("long").alias("byte"), "state")


def fail_links(vocab: DataFrame) -> DataFrame:
    """(state, fail, fail_pop): the longest proper suffix that is a state, and that is a token; '' is none."""
    states = trie_states(vocab)
    n = F.expr("length(state) div 2")
    suffix = states.filter(n > 1).select("state", F.explode(F.transform(F.sequence(F.lit(1), (n - 1).cast("int")), lambda k: F.substr(F.col("state"), k * 2 + 1))).alias("suffix"))
    known = states.select(F.col("state").alias("suffix"), F.col("token_id").isNotNull().alias("is_token"))
    best = suffix.join(known, "suffix").groupBy("state").agg(
        F.max_by("suffix", F.length("suffix")).alias("fail"), F.max_by(F.when(F.col("is_token"), F.col("suffix")), F.when(F.col("is_token"), F.length("suffix"))).alias("fail_pop")
    )
    return states.select("state").join(best, "state", "left").select("state", F.coalesce("fail", F.lit("")).alias("fail"), F.coalesce("fail_pop", F.lit("")).alias("fail_pop"))


def path_exists(texts: DataFrame, vocab: DataFrame, text: str = "word") -> DataFrame:
    """``texts`` that are the beginning, in bytes, of some token: a semi join with the trie's states."""
    states = trie_states(vocab).select(F.col("state").alias("_tl_state"))
    return texts.join(states, F.hex(F.encode(F.col(text), "utf-8")) == states["_tl_state"], "left_semi")


def transitions(steps: DataFrame, vocab: DataFrame, release: bool = False) -> DataFrame:
    """``steps`` (state, byte) with ``next``: the state one byte on, or none; with ``release`` the failure state of a state without that byte, the root's being the root."""
    edges = trie_edges(vocab).select(F.col("parent").alias("state"), "byte", F.col("state").alias("next"))
    j = steps.join(edges, ["state", "byte"], "left")
    if not release:
        return j
    fail = fail_links(vocab).select("state", "fail")
    return j.join(fail, "state", "left").withColumn("next", F.coalesce("next", "fail", F.lit(""))).drop("fail")


def trie_annotations(v: Vocabulary, spark: SparkSession) -> DataFrame:
    """(token, token_id, annotation): the rank of the last rule that makes a token (BPE), or its score (Unigram)."""
    t = v.tables(spark)
    made = t["merges"].groupBy(F.concat("left", "right").alias("token")).agg(F.max("rank").cast("double").alias("annotation"))
    scored = t["scores"].groupBy("token").agg(F.max_by("score", "ord").cast("double").alias("annotation"))
    return t["vocab"].join(made if v.algo == "Bpe" else scored, "token", "left")
