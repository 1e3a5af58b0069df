"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: lower case, ASCII punctuation as blanks, white
space as one blank.  An item of n characters has the error budget
k = floor(rate x n) and is cut into k + 1 pieces; a copy within k edits must
hold one piece unchanged (pigeonhole).  All pieces of all items are searched
for at once with an Aho-Corasick automaton; each hit gives the window in which
the item must lie, a count of shared three-character strings (an edit spoils
three at most) drops impossible windows, and Myers' bit-parallel distance
decides.

The items are a test set: they are sent to the workers in blocks of at most
``BLOCK_CHARS`` characters (or one item that is longer by itself), each measured before it is sent, and every block goes
over all documents, so a large test set costs more passes, not more memory.

Items of fewer than ``min_chars`` normalised characters name no passage: a few words
occur by chance in any large corpus, and dropping each text with "the answer is" would
drop clean ones.  They match nothing; ``min_chars=1`` looks for them too.

Defined results: null or empty texts match nothing; null items match nothing; ids may be of any type; very long
texts and items are searched whole; a null doc_id is reported as
null, a null item_id too; repeated rows are reported each; of several matches
of an item in a document the closest, then first, is reported; other columns are ignored by ``matches`` and
carried through by ``clean``.  Texts are searched whole.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import documents

RATE = 0.08
MIN_CHARS = 20
BLOCK_CHARS = 4_000_000
_TABLE = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or i < 33 else i for i in range(256))


def normalise(text: str) -> str:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()).decode()


def distance(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Myers: the least edits to turn the pattern into a stretch of ``text``, and where the first such stretch ends.

    Anchored, stretches begin at the text's start; else anywhere.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | anchored
        mh <<= 1
        pv = full & (mh | ~(xv | ph))
        mv = full & ph & xv
        if score < best:
            best, end = score, j
    return best, end


def _masks(s: str) -> dict[str, int]:
    """For each character, a number with a bit for each of its places."""
    out: dict[str, bytearray] = defaultdict(lambda: bytearray(len(s) // 8 + 1))
    for i, c in enumerate(s):
        out[c][i >> 3] |= 1 << (i & 7)
    return {c: int.from_bytes(b, "little") for c, b in out.items()}


class Finder:
    """Matches of (id, text) items in normalised texts."""

    def __init__(self, items: list[tuple], rate: float = RATE, min_chars: int = MIN_CHARS) -> None:
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for ident, raw in items:
            s = normalise(raw or "")
            n = len(s)
            if n < max(1, min_chars):
                continue
            k = int(rate * n)
            for j in range(k + 1):
                a, b = j * n // (k + 1), (j + 1) * n // (k + 1)
                pieces[s[a:b]].append((len(self.items), b - 1))
            self.items.append((ident, s, k, _masks(s), _masks(s[::-1]), {s[i : i + 3] for i in range(n - 2)}))
        self.automaton = ahocorasick.Automaton()
        for p, v in pieces.items():
            self.automaton.add_word(p, v)
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def hits(self, text: str):
        """(item id, distance, start, end) in the normalised text, by item."""
        if not self.any or not text:
            return
        places: dict[int, set[int]] = defaultdict(set)
        for end, v in self.automaton.iter(text):
            for i, at in v:
                places[i].add(end - at)
        for i in sorted(places):
            ident, s, k, masks, back, grams = self.items[i]
            n, best = len(s), None
            where = sorted(places[i])
            a = 0
            while a < len(where):
                b = a
                while b + 1 < len(where) and where[b + 1] - where[b] <= n + 2 * k:
                    b += 1
                lo, hi = max(0, where[a] - k), where[b] + n + k
                window = text[lo:hi]
                a = b + 1
                if len(grams & {window[j : j + 3] for j in range(len(window) - 2)}) < len(grams) - 3 * k:
                    continue
                d, end = distance(masks, n, window)
                if d <= k and (best is None or d < best[0]):
                    _, length = distance(back, n, window[:end][::-1], True)
                    best = (d, lo + end - length, lo + end)
            if best:
                yield (ident, *best)


def blocks(items: DataFrame, item: str = "item_id", text: str = "text", most: int = BLOCK_CHARS):
    """Lists of distinct (id, text) of at most ``most`` characters each, one after another; a longer item is alone."""
    t = items.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("t is not null").distinct()
    total = t.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    n = max(1, -(-2 * total // most))  # hashed parts differ in size; half full on average
    for k in range(n):
        part = t if n == 1 else t.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        block, size = [], 0
        for i, x in sorted(map(tuple, part.collect()), key=lambda r: (str(r[0]), r[1])):
            if block and size + len(x) > most:
                yield block
                block, size = [], 0
            block.append((i, x))
            size += len(x)
        if block:
            yield block


def matches(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): every item found in every document, places in the normalised text."""
    d = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {docs.schema[doc].dataType.simpleString()}, item_id {items.schema[item].dataType.simpleString()}, distance int, start int, end int"
    kind = to_arrow_type(items.schema[item].dataType)
    parts = []
    for block in blocks(items, item, item_text, block_chars):
        known = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, known=known):
            import pyarrow as pa

            find = Finder(known.value, rate, min_chars)
            names = ["doc_id", "item_id", "distance", "start", "end"]
            for b in batches:
                rows = [(i.as_py(), *h) for i, t in zip(b.column(0), b.column(1)) for h in find.hits(normalise(t.as_py() or ""))]
                cols = list(zip(*rows)) or [()] * 5
                kinds = [b.schema.field(0).type, kind, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        def some(batches, run=run):
            return (b for b in run(batches) if b.num_rows)

        parts.append(d.mapInArrow(some, schema))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    at = docs.columns.index(text)
    for block in blocks(items, item, item_text, block_chars):
        known = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, known=known):
            import pyarrow as pa

            find = Finder(known.value, rate, min_chars)
            for b in batches:
                yield b.filter(pa.array([next(find.hits(normalise(t.as_py() or "")), None) is None for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
