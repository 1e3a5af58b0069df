"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is a bag of sentences.  Sentence s has z = b + the weights of its
hashed words and word beginnings, p = 1 / (1 + exp(-z)); the document's score
is the noisy-or 1 - product(1 - p).  Weights are fitted to document labels
alone, by Adam on the likelihood, over a bounded sample of labelled rows;
scoring then locates the sentences with p >= 0.5.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0.
``SAMPLE`` bounds the rows fitted on, half of each label where there are as
many, and rows are weighted back to the labels' true shares; ``LONGEST`` bounds the bytes
of each, so the driver holds a bounded sample.  One join reads it.

Defined results: a null or empty text has no sentence and score 0; a null id is
scored and never learned from; null labels are left out; a document labelled twice counts as
often as its labels do; with no label, or none of either kind, every weight is
0 and every score is that of the bias; other columns are ignored.  Texts are
read whole, in training and in scoring.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

BITS = 18
SAMPLE = 4000
LONGEST = 1 << 18
MIN_DOCUMENTS = 3
SENTENCE = re.compile(r"[^.!?\n]+")
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-–—…«»“”„’‘"


def features(word: str) -> list[int]:
    """Hashed features of one lower-case word: itself and its beginnings."""
    w = word.strip(_STRIP)
    if not w:
        return []
    mask = (1 << BITS) - 1
    out = [zlib.crc32(("=" + w).encode()) & mask]
    out += [zlib.crc32(("^" + w[:k]).encode()) & mask for k in (4, 5, 6, 7) if len(w) > k]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        return Scorer(self)


class Scorer(dict):
    """Word -> weight, remembered for a bounded number of words."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.w, self.b = model.weights, model.bias

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        v = self[word] = float(sum(self.w[i] for i in features(word)))
        return v

    def sentence(self, s: str) -> float:
        return self.b + sum(map(self.__getitem__, s.split()))

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score, and (start, end, p) in code points of each sentence with p >= 0.5."""
        total, found = 0.0, []
        low = text.lower()
        if len(low) != len(text):  # a few capitals grow when lowered; places must stay
            low = "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text)))
        for m in SENTENCE.finditer(low):
            s = m.group()
            if not s.strip():
                continue
            z = self.sentence(s)
            total += math.log1p(math.exp(z)) if z < 30 else z
            if z >= 0:
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
        return 1 - math.exp(-total), found


def fit(rows: list[tuple[str, int, float]], epochs: int = 60, rate: float = 0.1, decay: float = 0.1) -> Model:
    """Weights from (text, label, weight of the row)."""
    weights = np.zeros(1 << BITS)
    rows = [r for r in rows if r[0] and r[1] is not None]
    if len({int(r[1] > 0) for r in rows}) < 2:
        return Model(weights.astype(np.float32), -6.0)
    cache: dict[str, list[int]] = {}
    feats, instance, bag, n = [], [], [], 0
    for d, (text, _, _) in enumerate(rows):
        for m in SENTENCE.finditer(text.lower()):
            ids = [i for w in m.group().split() for i in (cache.get(w) or cache.setdefault(w, features(w)))]
            if ids:
                feats.append(np.array(ids, np.int32))
                instance.append(np.full(len(ids), n, np.int32))
                bag.append(d)
                n += 1
    if not n:
        return Model(weights.astype(np.float32), -6.0)
    f, inst, bag = np.concatenate(feats), np.concatenate(instance), np.array(bag)
    del feats, instance, cache
    seen = np.unique(f.astype(np.int64) * len(rows) + bag[inst]) // len(rows)
    often = np.bincount(seen, minlength=1 << BITS) >= MIN_DOCUMENTS
    keep = often[f]
    names, f = np.unique(f[keep], return_inverse=True)
    f, inst = f.astype(np.int32), inst[keep]
    del seen, keep
    y = np.array([int(r[1] > 0) for r in rows])
    row_weight = np.array([r[2] for r in rows])
    row_weight = row_weight / row_weight.mean()
    # Weights are learned in units of each feature's log ratio of document shares, so what separates the labels moves first.
    pairs = np.unique(f.astype(np.int64) * len(rows) + bag[inst])
    share = lambda k: (np.bincount(pairs // len(rows), (y == k)[pairs % len(rows)], minlength=len(names)) + 0.5) / ((y == k).sum() + 1)
    unit = np.log(share(1) / share(0))
    del pairs
    v, b = np.full(len(names), 0.5), -10.0
    m1, m2, bm1, bm2 = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.clip(b + np.bincount(inst, (unit * v)[f], minlength=n), -30, 30)
        a = np.maximum(np.bincount(bag, np.logaddexp(0, z), minlength=len(rows)), 1e-9)
        da = np.where(y == 1, -1 / np.expm1(np.minimum(a, 50)), 1.0) * row_weight
        dz = da[bag] / (1 + np.exp(-z))
        g = unit * np.bincount(f, dz[inst], minlength=len(names)) / len(rows) + decay * v / len(rows)
        gb = dz.sum() / len(rows)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        bm1, bm2 = 0.9 * bm1 + 0.1 * gb, 0.99 * bm2 + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        v -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-6)
        b -= rate * (bm1 / c1) / (math.sqrt(bm2 / c2) + 1e-6)
    w = unit * v
    weights[names] = w
    return Model(weights.astype(np.float32), float(b))


def held_out(doc: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    lab = labels.select(F.col(doc).alias("_tl_doc"), F.col(label).alias("_tl_y")).filter(F.col("_tl_doc").isNotNull() & F.col("_tl_y").isNotNull() & ~held_out("_tl_doc"))
    counts = {r["y"]: r["n"] for r in lab.groupBy((F.col("_tl_y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = min(counts.values(), default=0)
    parts = []
    for y, n in counts.items():
        take = min(n, max(sample // 2, sample - least))
        some = lab.filter((F.col("_tl_y") > 0) == F.lit(y)).orderBy(F.xxhash64("_tl_doc"), "_tl_doc").limit(take)
        parts.append(some.select("_tl_doc", F.lit(int(y)).alias("_tl_y"), F.lit(n / take).alias("_tl_w")))
    if not parts:
        return fit([])
    d = docs.select(F.col(doc).alias("_tl_doc"), F.col(text).alias("_tl_text")).filter(F.octet_length("_tl_text") <= longest)
    got = d.join(F.broadcast(reduce(DataFrame.union, parts)), "_tl_doc").select("_tl_text", "_tl_y", "_tl_w").collect()  # `sample` and `longest` bound both
    return fit(sorted(map(tuple, got), key=lambda r: (r[1], r[0] or "")))


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, offending array<struct<start,end,p>>) of every document."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers

    def run(batches):
        import pyarrow as pa

        s = known.value.scorer()
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for b in batches:
            got = [s.document(t.as_py() or "") for t in b.column(1)]
            spans = [[{"start": x[0], "end": x[1], "p": x[2]} for x in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array(spans, span)], names=["doc_id", "score", "offending"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, offending array<struct<start:int,end:int,p:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    model = train(d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(d, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
