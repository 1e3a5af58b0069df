"""Near duplicates by an LSH forest of MinHash signatures.

1. Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lowered; a document's set is its
   distinct five-word shingles (64-bit hashes).  Equal sets form one class, and
   only one representative of each class goes on.
2. A representative has labels of ``DEPTH`` MinHash values, one for each tree
   (16 trees at a threshold of 0.85, 22 at 0.80).  Each tree is the sorted order of its
   labels.  A region is a run with a common prefix of ``LEAST`` values; only
   regions of two or more members go on.
3. Candidates of the first round are neighbours in the orders: a document and the
   ``NEIGHBOURS`` before it in its region, which are those of the longest common
   prefix with it, so the depth adapts to how crowded a region is.  The orders are
   cut into ranges of like size, with a link over each cut: no region, however
   large, is one task's, and the candidates are linear in the documents.
4. Candidates whose MinHash values agree often enough are confirmed on the full sets;
   links give components.
5. A second round is the exact way for what neighbours leave out: the members of a
   region whose components still differ are compared by their sketches (a byte of each MinHash
   value) in blocks of about ``BLOCK``, inside a task; only pairs of two components that
   agree often enough leave it.  A region of n such members costs n * n / 2
   comparisons of some hundred bytes, spread over tasks, whether or not it has links; a region that is one component costs none.
   For a pair at the threshold, the chance to agree too seldom is under 1e-7.
6. Components of documents follow from those of representatives.

The trees are as many as it takes for a pair at the threshold t to share a region in
one of them at least with probability 1 - (1 - t^4)^trees > 0.99999.  The query
has a threshold of 0.85; the stage of the pipeline, 0.80.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; fewer than five words are one shingle; very long texts are read
whole; repeated rows are each a row of the result; ids may be of any type with an order
(strings too) and are expected to be unique, equal ids make no failure but are one node of the graph; a row with a null id joins the
component of its equal texts, null if none of them has an id;
an empty table gives no rows; other columns are ignored (``dedup`` keeps them, whatever their names).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut, documents
from .wordhash import mix, shingle_sets, slices, text_buffers, word_hashes

WORDS = 5
THRESHOLD, STAGE_THRESHOLD = (85, 100), (80, 100)
DEPTH, LEAST = 8, 4
MISS_TREES, MISS_AGREE = 1e-5, 1e-7
NEIGHBOURS, BLOCK = 2, 512
#: A class of more equal texts is joined by broadcast; there are at most as many as rows / HOT.
HOT = 1_000_000


@dataclass(frozen=True)
class Forest:
    """The sizes that a threshold needs: trees, MinHash values, and how many of these must agree."""

    threshold: tuple[int, int]
    trees: int
    values: int
    agree: int


def forest(threshold: tuple[int, int]) -> Forest:
    t = threshold[0] / threshold[1]
    if not 0 < t <= 1:
        raise ValueError(f"a threshold must be above 0 and at most 1, not {threshold[0]}/{threshold[1]}")
    if t == 1:
        return Forest(threshold, 1, DEPTH, DEPTH)
    trees = math.ceil(math.log(MISS_TREES) / math.log1p(-(t**LEAST)))
    values, below = trees * DEPTH, 0.0
    for agree in range(values):  # the binomial by logarithms; its coefficients can exceed a float
        ways = math.lgamma(values + 1) - math.lgamma(agree + 1) - math.lgamma(values - agree + 1)
        below += math.exp(ways + agree * math.log(t) + (values - agree) * math.log1p(-t))
        if below >= MISS_AGREE:
            break
    return Forest(threshold, trees, values, agree)


def _multipliers(values: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(97))
    return rng.integers(1, 2**62, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(column, lower: bool = True):
    """(first text, sets, begins) for slices of a text column."""
    data, offsets = text_buffers(column)
    for i, j in slices(offsets):
        s, at = shingle_sets(*word_hashes(data, offsets[i : j + 1], lower), WORDS)
        yield i, s, at


def signatures(sets: np.ndarray, at: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """uint16 MinHash values, one row for each non-empty set and a column for each multiplier."""
    out = np.empty((len(at) - 1, len(multipliers)), np.uint16)
    step = 1 << 15
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        x = sets[at[i] : at[j]]
        begins = at[i:j] - at[i]
        for k, m in enumerate(multipliers):
            out[i:j, k] = np.minimum.reduceat(x * m, begins) >> np.uint64(24) & np.uint64(0xFFFF)
        i = j
    return out


def profile(df: DataFrame, doc: str = "doc_id", text: str = "text", values: int = forest(THRESHOLD).values) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, signature, sketch) of every row: s1 and s2 identify the set, the sketch has one byte of each value."""
    multipliers = _multipliers(values)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, s1, s2 = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            sig: list[bytes | None] = [None] * b.num_rows
            sketch: list[bytes | None] = [None] * b.num_rows
            for i, s, at in _sets(b.column(1)):
                size = np.diff(at)
                full = np.flatnonzero(size)
                n[i : i + len(size)] = size
                if len(full):
                    begins = at[:-1][full]
                    s1[i + full] = np.add.reduceat(mix(s), begins).view(np.int64)
                    s2[i + full] = np.add.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), begins).view(np.int64)
                    for k, v in zip(full, signatures(s, np.append(begins, len(s)), multipliers).astype(">u2")):
                        sig[i + k] = v.tobytes()
                        sketch[i + k] = v.astype(np.uint8).tobytes()
            cols = [b.column(0), pa.array(n), pa.array(s1), pa.array(s2), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "s1", "s2", "signature", "sketch"])

    kind = df.schema[doc].dataType.simpleString()
    return df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, s1 long, s2 long, signature binary, sketch binary")


def confirm(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    Pairs are grouped under ``a`` in parts of about 256; each part gets the text
    of ``a`` once and streams the others past it, so no group is held in memory
    and a document with very many pairs is spread over tasks.  The requests for
    texts grow with the corpus, so they are never broadcast.
    """
    kind = dict(pairs.dtypes)["a"]
    parts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / 256) + 1).alias("parts"))
    right = pairs.join(parts, "a").select(F.col("b").alias("rep"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    none = F.lit(None).cast(kind).alias("b")
    left = parts.select(F.col("a").alias("rep"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), none)
    asked = texts.join(left.union(right).hint("merge"), "rep").select("a", "part", "b", "text")
    both = asked.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        at, own = None, []
        for batch in batches:
            a, part, b = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for i, s, begins in _sets(batch.column(3)):
                for q in range(len(begins) - 1):
                    k, x = i + q, s[begins[q] : begins[q + 1]]
                    if b[k] is None:
                        if at != (a[k], part[k]):
                            at, own = (a[k], part[k]), []
                        own.append(x.copy())
                        continue
                    for y in own if at == (a[k], part[k]) else ():
                        both = np.intersect1d(x, y, True).size
                        if both and threshold[1] * both >= threshold[0] * (len(x) + len(y) - both):
                            out.append(k)
                            break
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).take(pa.array(out))

    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def agreeing(pairs: DataFrame, sizes: Forest) -> DataFrame:
    """Pairs (a, b, sa, sb) of which enough MinHash values are equal."""
    values, agree = sizes.values, sizes.agree

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, values)
            y = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, values)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(1) >= agree))

    kind = dict(pairs.dtypes)["a"]
    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def neighbours(members: DataFrame) -> DataFrame:
    """(a, b): members (tree, prefix, rest, rep, n) and those before them in the sorted order of their tree's region."""
    kind = dict(members.dtypes)["rep"]
    width = NEIGHBOURS
    order = ["tree", "prefix", "rest", "rep"]

    def run(batches):
        import pyarrow as pa

        def batch(rows, schema):
            types = [*schema.types, *schema.types[3:5]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*schema.names, "other", "m"])

        before: list[tuple] = []
        last = schema = None
        for b in batches:
            rows, out = list(zip(*(c.to_pylist() for c in b.columns))), []
            for r in rows:
                if last is None:
                    out.append((*r, None, None))  # the ends of a range, for the links over the cuts
                if before and before[-1][:2] != r[:2]:
                    before = []
                out += [(*r, q[3], q[4]) for q in before]
                before = [*before, r][-width:]
                last, schema = r, b.schema
            if out:
                yield batch(out, schema)
        if last:
            yield batch([(*last, None, None)], schema)

    found = cut(members.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"tree int, prefix binary, rest binary, rep {kind}, n long, other {kind}, m long"))
    w = Window.partitionBy("tree", "prefix").orderBy("rest", "rep")  # two rows for each range
    ends = found.filter("other is null").withColumn("other", F.lag("rep").over(w)).withColumn("m", F.lag("n").over(w)).filter("other is not null")
    return found.filter("other is not null").union(ends).select(F.col("rep").alias("a"), F.col("other").alias("b"), F.col("n").alias("na"), F.col("m").alias("nb"))


def across(members: DataFrame, sizes: Forest) -> DataFrame:
    """(a, b): members (tree, prefix, rep, n, label, sketch) of one region but two labels of which enough MinHash values are equal."""
    kind = dict(members.dtypes)["rep"]
    values, agree, (num, den) = sizes.values, sizes.agree, sizes.threshold
    parts = members.groupBy("tree", "prefix").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("parts"))
    m = members.join(parts, ["tree", "prefix"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("parts")))
    m = m.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = ["tree", "prefix", "lo", "hi"]
    m = m.select("tree", "prefix", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "rep", "n", "label", "sketch")

    def pairs(b, x, y):
        """Row pairs x, y of a batch that may be links, a piece at a time."""
        n, label, sketch = b
        ok = (label[x] != label[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        for k in range(0, len(x), 1 << 15):
            p, q = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
            same = (sketch[p] == sketch[q]).sum(1) >= agree
            yield p[same], q[same]

    def group(rows):
        import pyarrow as pa

        rows = rows.combine_chunks()
        ids = rows.column("rep")
        label = rows.column("label").combine_chunks().dictionary_encode().indices
        b = rows.column("n").to_numpy(), label.to_numpy(), np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, values)
        block = rows.column("i").to_numpy()
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        if lo == hi:
            x, y = np.triu_indices(len(block), 1)
        else:
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
        for p, q in pairs(b, x, y):
            if len(p):
                yield pa.table({"a": ids.take(pa.array(p)), "b": ids.take(pa.array(q))})

    def run(batches):
        import pyarrow as pa

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            keys = list(zip(*(held.column(c).to_pylist() for c in key)))
            if not keys:
                continue
            begins = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            for x, y in zip(begins, begins[1:]):  # the last group may go on in the next batch
                for out in group(held.slice(x, y - x)):
                    yield from out.to_batches()
            held = held.slice(begins[-1])
        if held is not None and held.num_rows:
            for out in group(held):
                yield from out.to_batches()

    return m.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the threshold is a fraction, (85, 100) say."""
    p = cut(profile(df, doc, text, forest(threshold).values))
    key = ["n_shingles", "s1", "s2"]
    full = p.filter("n_shingles > 0")
    reps = full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    linked = links(reps, df.select(F.col(doc).alias("rep"), F.col(text).alias("text")), threshold)
    found = cut(reps.join(components(linked).select(F.col("node").alias("rep"), "label"), "rep", "left").select(*key, F.coalesce("label", "rep").alias("component_id"), "copies"))
    hot, cold = F.broadcast(found.filter(F.col("copies") > HOT).drop("copies")), found.filter(F.col("copies") <= HOT).drop("copies")
    full = full.select("doc_id", *key).join(hot, key, "left_outer")
    rest = full.filter("component_id is null").drop("component_id").join(cold, key, "left_outer")
    some = full.filter("component_id is not null").unionByName(rest).select("doc_id", "n_shingles", "component_id")
    return some.union(p.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def links(reps: DataFrame, source: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Confirmed pairs (a, b) of representatives that give the components of the threshold's graph."""
    sizes = forest(threshold)
    f = cut(reps.filter("rep is not null").select("rep", F.col("n_shingles").alias("n"), "signature", "sketch"))
    depth = 2 * DEPTH
    tree = F.explode(F.transform(F.sequence(F.lit(0), F.lit(sizes.trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring(F.col("signature"), t * depth + 1, F.lit(depth)).alias("label"))))
    rows = f.select("rep", "n", tree.alias("x")).select("rep", "n", "x.tree", F.substring("x.label", 1, 2 * LEAST).alias("prefix"), F.substring("x.label", 2 * LEAST + 1, 2 * DEPTH).alias("rest"))
    shared = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    members = cut(rows.join(shared, ["tree", "prefix"]))
    texts = cut(source.join(members.select("rep").distinct().hint("merge"), "rep", "left_semi"))
    may = threshold[1] * F.least("na", "nb") >= threshold[0] * F.greatest("na", "nb")
    candidates = cut(neighbours(members).filter(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sketch = f.select("rep", "sketch")
    close = agreeing(candidates.join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b"), sizes)
    one = cut(confirm(cut(close), texts, threshold))
    labels = components(one)
    m = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("tree", "prefix", "rep", "n", F.coalesce("label", "rep").alias("label"))
    open_ = m.groupBy("tree", "prefix").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("tree", "prefix")
    m = m.join(open_, ["tree", "prefix"]).join(sketch, "rep")
    two = confirm(cut(across(m, sizes).join(candidates, ["a", "b"], "left_anti")), texts, threshold)
    return one.union(two)


def dedup(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One document of each component, with all its columns; rows without an id stay."""
    c = classes(df, doc, text, threshold).filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("who")).distinct()
    own = df.select(*[F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(df.columns)])  # no name of the input can clash
    kept = own.join(c, F.col(f"c{df.columns.index(doc)}") == F.col("who"), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(df.columns)])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup(docs, threshold=STAGE_THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir), threshold=THRESHOLD).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
