"""Streaming BPE: bytes of many streams in, ids of finished words out.

Input rows are (stream_id, seq, chunk binary, is_final boolean).  A stream's
unfinished word is the state of its key.  Within a micro-batch rows are taken
by seq; a row whose seq comes before one that an earlier micro-batch has
taken makes the query fail, since its word's other part may be gone.  Output
mode: append, a row (stream_id, seq, ids) for each input row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Vocabulary
from ..kernels import StreamEncoder
from ..operators.encode import encode


def encode_stream(df: DataFrame, v: Vocabulary) -> DataFrame:
    """The streaming DataFrame of ids; works on a batch DataFrame alike."""
    known = df.sparkSession.sparkContext.broadcast(v)
    kind = df.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {kind}, seq long, ids array<bigint>"

    def take(encoder: StreamEncoder, pdf: pd.DataFrame, last: int) -> tuple[pd.DataFrame, int]:
        rows = []
        for r in pdf.sort_values("seq").itertuples(index=False):
            if r.seq < last:
                raise ValueError(f"stream {r.stream_id!r}: seq {r.seq} after {last}")
            last = r.seq
            ids = encoder.feed(bytes(r.chunk) if r.chunk is not None else b"")
            rows.append((r.stream_id, r.seq, ids + (encoder.finish() if r.is_final else [])))
        return pd.DataFrame(rows, columns=["stream_id", "seq", "ids"]), last

    if not df.isStreaming:
        return df.groupBy("stream_id").applyInPandas(lambda pdf: take(StreamEncoder(known.value), pdf, -(2**62))[0], schema)

    def run(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, last = state.get if state.exists else (b"", -(2**62))
        encoder = StreamEncoder(known.value, bytes(pending))
        whole = pd.concat(list(pdfs))
        out, last = take(encoder, whole, last)
        if whole["is_final"].fillna(False).any() and not encoder.pending:
            state.remove()
        else:
            state.update((encoder.pending, last))
        yield out

    return df.groupBy("stream_id").applyInPandasWithState(run, schema, "pending binary, last long", "append", "NoTimeout")


def encode_whole(df: DataFrame, v: Vocabulary) -> DataFrame:
    """(stream_id, ids) of a batch of text chunks (stream_id, seq, text): as if each stream were fed and finished.

    A stream's chunks become one text, so it must fit a row.
    """
    chunks = F.sort_array(F.collect_list(F.struct("seq", "text")))
    g = df.groupBy("stream_id").agg(F.array_join(F.transform(chunks, lambda x: x["text"]), "").alias("text"))
    return encode(g, v, mode="stream").select("stream_id", "ids")


def from_texts(df: DataFrame, stream: str, seq: str, text: str) -> DataFrame:
    """Rows of texts as chunks of streams; the last row of a stream ends it (a batch only)."""
    last = df.groupBy(stream).agg(F.max(seq).alias("_last"))
    return df.join(last, stream).select(F.col(stream).alias("stream_id"), F.col(seq).alias("seq"), F.encode(text, "utf-8").alias("chunk"), (F.col(seq) == F.col("_last")).alias("is_final"))
