"""Arrow-batched functions of text columns, for what built-in functions can't express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import kernels
from ..ir import Vocabulary

SPANS = "array<struct<start_byte:bigint,end_byte:bigint>>"
SLICE_BYTES = 1 << 20


def _slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The rows of all batches in order, so many at a time as have ``SLICE_BYTES`` of text, one at least.

    What Python makes of a text is many times its size, and a batch has up to 10,000
    texts: taken at once, it would set the worker's memory.  Spark counts rows, not batches.
    """
    for s in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(s), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(s):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield s.slice(at, to - at)
            at = to


def encoder(spark: SparkSession, v: Vocabulary, mode: str = "word", strategy: str = "stepwise", on_error: str = "raise") -> Callable[[Column], Column]:
    """text -> array<bigint> of token ids; null text gives null.

    ``on_error``: "raise", or "null" for texts that can't be encoded.  The
    vocabulary is broadcast once; each worker keeps its own bounded memo.
    """
    if on_error not in ("raise", "null"):
        raise ValueError('on_error: "raise" or "null"')
    kernels.Encoder(v, mode, strategy)
    known = spark.sparkContext.broadcast(v)  # a vocabulary file, not data

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = kernels.Encoder(known.value, mode, strategy)
        for s in _slices(batches):
            ids, begins, good = e.encode_all(s.to_pylist(), on_error == "null")
            yield pa.ListArray.from_arrays(pa.array(begins.astype("int32")), pa.array(ids), mask=None if good.all() else pa.array(~good))

    return F.arrow_udf(run, "array<bigint>")


def token_counter(spark: SparkSession, v: Vocabulary, mode: str = "word", strategy: str = "stepwise") -> Callable[[Column], Column]:
    """text -> how many ids it has, without the ids themselves; null text gives null."""
    known = spark.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = kernels.Encoder(known.value, mode, strategy)
        for s in _slices(batches):
            _, begins, good = e.encode_all(s.to_pylist())
            yield pa.array(begins[1:] - begins[:-1], pa.int64(), mask=~good)

    return F.arrow_udf(run, "long")


def bulk_stats(spark: SparkSession, v: Vocabulary) -> Callable[[Column], Column]:
    """text -> the six counters of the bulk path."""
    names = ("total_bytes", "total_words", "fast_words", "fast_bytes", "fallback_words", "fallback_bytes")
    known = spark.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = kernels.Encoder(known.value, "bulk")
        for s in _slices(batches):
            counts = np.array([e.stats(t or "") for t in s.to_pylist()], np.int64)
            yield pa.StructArray.from_arrays([pa.array(c.copy()) for c in counts.T], names=list(names))

    return F.arrow_udf(run, "struct<" + ",".join(f"{n}:bigint" for n in names) + ">")


def _spans(f: Callable[[bytes], list[tuple[int, int]]]) -> Callable[[Column], Column]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in _slices(batches):
            found = [None if t is None else f(t.encode()) for t in s.to_pylist()]
            flat = np.array([x for spans in found for x in spans or ()], np.int64).reshape(-1, 2)
            ends = np.cumsum([0, *(len(x or ()) for x in found)]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["start_byte", "end_byte"])
            yield pa.ListArray.from_arrays(pa.array(ends), rows, mask=pa.array([x is None for x in found]))

    return F.arrow_udf(run, SPANS)


def pretoken_spans() -> Callable[[Column], Column]:
    """text -> byte spans of its pretokens."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in _slices(batches):
            starts, ends, begins = kernels.pretoken_spans([t.encode() if t is not None else b"" for t in s.to_pylist()])
            rows = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], names=["start_byte", "end_byte"])
            yield pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), rows, mask=pc.is_null(s))

    return F.arrow_udf(run, SPANS)


def utf8_chunks(n: int) -> Callable[[Column], Column]:
    return _spans(lambda raw: kernels.utf8_chunks(raw, n))


def blank_chunks(chunk_kb: int) -> Callable[[Column], Column]:
    return _spans(lambda raw: kernels.blank_chunks(raw, kernels.chunk_target(len(raw), chunk_kb)))


def byte_sum() -> Callable[[Column], Column]:
    """text -> the sum of its bytes modulo 2**32."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in _slices(batches):
            yield pa.array([None if t is None else int(np.frombuffer(t.encode(), np.uint8).sum(dtype=np.uint64)) & 0xFFFFFFFF for t in s.to_pylist()], pa.int64())

    return F.arrow_udf(run, "long")


def register(spark: SparkSession, v: Vocabulary) -> None:
    """SQL functions for a vocabulary: tokenize_words, pretokens (built-in functions inside), and encode in each mode as ``encode_<mode>``."""
    from . import text

    for name, pattern in (("tokenize_words", text.WORD_FAST), ("pretokens", text.PRE)):
        literal = pattern.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(t, '{literal}', 0)")
    for m in kernels.MODES:
        spark.udf.register(f"encode_{m}", encoder(spark, v, m))
    name = {"Bpe": "bpe_encode", "WordPiece": "wordpiece_encode", "Unigram": "unigram_encode"}[v.algo]
    spark.udf.register(name, encoder(spark, v))
    spark.udtf.register("common_prefix_search", common_prefix_search(v))


def common_prefix_search(v: Vocabulary):
    """A table function: the tokens that are prefixes of a text, by length in bytes."""
    tokens = {t.encode(): (i, v.score_of.get(t)) for t, i in v.vocab.items() if t}
    paths = {t[:k] for t in tokens for k in range(1, len(t) + 1)}

    @F.udtf(returnType="length: bigint, token_id: bigint, score: double")
    class Search:
        def eval(self, text: str):
            raw = (text or "").encode()
            for k in range(1, len(raw) + 1):
                if raw[:k] not in paths:
                    break
                if raw[:k] in tokens:
                    yield (k, *tokens[raw[:k]])

    return Search
