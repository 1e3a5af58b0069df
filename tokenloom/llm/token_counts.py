"""Offset-mapped token attribution.

A document is encoded once, whole.  Each token covers a span of its bytes;
each section covers one too; the sorted spans are interval-joined, and a token
that crosses sections is allocated by one of three rules:

* ``start``: all of it to the section of its first byte;
* ``most``: all of it to the section with most of its bytes, the first of several;
* ``split``: to each section by its share of the token's bytes (a double).

Sections either are given as an array of (name, start, end) in code points, or
are found: every line with the line break that ends it.  Gaps between given
sections belong to a section named null; overlapping sections are an error of
the caller and raise ValueError.

Defined results: a null text has no sections and no tokens and gives no rows,
an empty one has one empty line; repeated rows are counted as often as they
come; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents
from .token_ids import encoder, vocabulary

RULES = ("start", "most", "split")


def line_bounds(raw: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines: one more than there are lines."""
    return np.concatenate(([0], np.flatnonzero(raw == 10) + 1, [len(raw)]))


def allocate(lengths: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each interval [bounds[i], bounds[i+1]), for tokens of these byte lengths one after another."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = len(bounds) - 1
    # The last interval that begins at or before a place: empty intervals before it hold nothing.
    first = np.searchsorted(bounds[:-1], starts, "right") - 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    last = np.searchsorted(bounds[:-1], np.maximum(ends - 1, starts), "right") - 1
    inside = first == last
    out = np.bincount(first[inside], minlength=n).astype(float)
    for i in np.flatnonzero(~inside):
        parts = np.arange(first[i], last[i] + 1)
        share = np.minimum(bounds[parts + 1], ends[i]) - np.maximum(bounds[parts], starts[i])
        if rule == "most":
            out[parts[int(share.argmax())]] += 1
        else:
            out[parts] += share / lengths[i]
    return out


def _given(raw: np.ndarray, sections) -> tuple[np.ndarray, list]:
    """Byte bounds and names of given sections, with the gaps between them."""
    places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    at, bounds, names = 0, [0], []
    for s in sorted(sections, key=lambda s: (s["start"], s["end"])):
        a, b = (int(places[min(max(x, 0), len(places) - 1)]) for x in (s["start"], s["end"]))
        if a < at or b < a:
            raise ValueError(f"overlapping sections at {s['start']}")
        if a > at:
            bounds.append(a), names.append(None)
        bounds.append(b), names.append(s["name"])
        at = b
    if at < len(raw):
        bounds.append(len(raw)), names.append(None)
    return np.array(bounds, np.int64), names


def count(df: DataFrame, doc: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "start", vocab: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, section, name, start_byte, end_byte, n_tokens) of every section of every text."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    paths = vocab or vocabulary()
    kind = df.schema[doc].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        enc = encoder(*paths)
        for b in batches:
            who, lists = [], [[], [], [], [], []]
            for k in range(b.num_rows):
                t = b.column(1)[k].as_py()
                if t is None:
                    continue
                raw = np.frombuffer(t.encode(), np.uint8)
                if b.num_columns > 2:
                    bounds, names = _given(raw, b.column(2)[k].as_py() or [])
                else:
                    bounds = line_bounds(raw)
                    names = ["line"] * (len(bounds) - 1)
                ids = enc.ids(t)
                got = allocate(enc.byte_lengths(ids), bounds, rule) if names else []
                who += [b.column(0)[k].as_py()] * len(names)
                for c, v in zip(lists, (range(len(names)), names, bounds[:-1].tolist(), bounds[1:].tolist(), got)):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(who, b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(lists, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))]],
                names=["doc_id", "section", "name", "start_byte", "end_byte", "n_tokens"],
            )

    cols = [F.col(doc).alias("doc_id"), F.col(text).alias("text")] + ([F.col(sections).alias("sections")] if sections else [])
    return df.select(*cols).mapInArrow(run, f"doc_id {kind}, section long, name string, start_byte long, end_byte long, n_tokens double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(documents(spark, sf_dir)).select("doc_id", "section", "start_byte", "end_byte", F.col("n_tokens").cast("long").alias("n_tokens"))
