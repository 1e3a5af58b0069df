"""Line dedup by a deletion-neighbourhood join: the earliest of equal and nearly equal lines stays.

A line is its sequence of words (``[^\\x20\\x09-\\x0D]+``).  Two lines are near when
at most ``bound`` words replaced, inserted or deleted turn one into the other: one
for each ten words of the shorter line, three at most (``bound``).  A line
occurrence with a word is dropped when an earlier occurrence, by (doc_id, line number),
has the same words or is near.

1. Every line of ten words or more emits deletion variants as hashed keys.  Up to
   19 words: the line without each block of w and of w + 1 words (w between n/4 and n/2)
   and whole; one edit lies inside a block.  From 20 words: its first and its
   last L words (L between n/3 and n/2) without each half, of one word more where an insertion
   shifts them; of three edits one at most lies at one of the ends, so any two lines
   within the bound share a key.
2. Keys travel packed, one row for a bucket and slice of text, and are joined a bucket
   at a time; buckets follow the number of keys, so a task's memory
   doesn't grow with the corpus.  A key of up to ``SMALL`` lines gives its pairs.
3. A key of more lines gives no pairs: each of its lines is compared with the earliest,
   and lines that this leaves undecided go past all the key's lines in
   blocks of about ``BLOCK``, spread over tasks.
4. The edit distance of what shares a key is verified on the words.

Defined results: null texts stay null and have no lines, an empty text has one
empty line; lines without a word are never dropped; very long lines and texts are
read whole; rows without an id have no place in the order, so they keep all their lines and
cost no other row any; repeated rows of one id lose the same lines; an empty table gives no rows;
other columns are kept as they are, whatever their names; an input column ``_dropped`` is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, documents, drop_cut
from .wordhash import mix, slices, text_buffers, word_hashes

RATE, MOST = 10, 3
SMALL, BLOCK = 8, 256
BUCKET_BYTES = 32 << 20
GRID = np.array(sorted([10 << k for k in range(24)] + [15 << k for k in range(24)]))
_C = 0x9E3779B97F4A7C55
_CI = pow(_C, -1, 2**64)
_U = np.uint64


class Lines:
    """Hashes of the lines of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0]
        text = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1))
        begin = np.concatenate((offsets[:-1], breaks + 1))
        order = np.lexsort((begin, text))
        self.text, begin = text[order], begin[order]
        firsts = np.searchsorted(self.text, np.arange(len(offsets) - 1))
        self.number = np.arange(len(begin)) - firsts[self.text]
        words, at = word_hashes(data, np.append(begin, offsets[-1]))
        self.start, self.end = at[:-1], at[1:]
        self.n = self.end - self.start
        self.words = words
        up = np.full(len(words) + 1, _C, np.uint64)
        down = np.full(len(words) + 1, _CI, np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.prefix = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[:-1], out=self.prefix[1:])
        self.hash = sequence_hash(self.range(self.start, self.end), self.n)

    def range(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.prefix[b] - self.prefix[a]) * self.down[a]

    def _rest(self, a, b, c, d, tag) -> np.ndarray:
        """Hash of the words [a, b) and [c, d) with a tag."""
        return mix(self.range(a, b) + mix(self.range(c, d) + (d - c).astype(_U)) * _U(3) + tag.astype(_U) * _U(0x9E3779B1))

    def coarse(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, line's hash) of the deletion variants of all lines that may have a near one."""
        keys, lines = [], []
        short = (self.n >= RATE) & (self.n <= 2 * RATE)
        width = 1 << np.maximum(np.floor(np.log2(np.maximum(self.n, 1))).astype(np.int64) - 1, 0)
        edge = (self.n & (self.n - 1)) == 0  # shares a grain with the next shorter lines
        for w, m in ((width, short), (width // 2, short & edge)):
            s, e, w, h = self.start[m], self.end[m], w[m], self.hash[m]
            n = e - s
            keys.append(self._rest(s, e, e, e, n))
            lines.append(h)
            for k in range(int((-(-n // w)).max(initial=0))):
                for more in (0, 1):
                    a = k * w
                    ok = (a < n) & ((more == 0) | (a + w < n))
                    q = np.minimum(a + w + more, n)
                    keys.append(self._rest(s[ok], s[ok] + a[ok], s[ok] + q[ok], e[ok], a[ok]))
                    lines.append(h[ok])
        long = self.n >= 2 * RATE
        own = GRID[np.searchsorted(GRID, np.maximum(self.n // 2, RATE), "right") - 1]
        less = GRID[np.searchsorted(GRID, np.maximum((self.n - MOST) // 2, RATE), "right") - 1]
        for size, m in ((own, long), (less, long & (less < own))):
            s, e, size, h = self.start[m], self.end[m], size[m], self.hash[m]
            half = (size + 1) // 2
            for more in (0, 1):
                for a, q in ((size * 0, half), (half, size)):
                    q, z = q + more, size + more
                    keys.append(self._rest(s, s + a, s + q, s + z, size * 4 + (a > 0)))
                    keys.append(self._rest(e - a, e, e - z, e - q, size * 4 + 2 + (a > 0)))
                    lines += [h, h]
        return np.concatenate(keys), np.concatenate(lines)


def sequence_hash(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(x + n.astype(np.uint64) * _U(0xABCDEF1234567))


def bound(n: int) -> int:
    """The edits within which lines are near, of which the shorter has n words."""
    return min(MOST, n // RATE)


def _batches(batches):
    for b in batches:
        data, offsets = text_buffers(b.column(1))
        for i, j in slices(offsets):
            yield b, i, Lines(data, offsets[i : j + 1])


def occurrences(df: DataFrame) -> DataFrame:
    """(doc_id, line, h, n) of the lines of (doc_id, text) that can be dropped."""

    def run(batches):
        import pyarrow as pa

        for b, i, x in _batches(batches):
            m = np.flatnonzero(x.n > 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(i + x.text[m])), pa.array(x.number[m].astype(np.int32)), pa.array(x.hash[m].view(np.int64)), pa.array(x.n[m].astype(np.int32))],
                names=["doc_id", "line", "h", "n"],
            )

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, line int, h long, n int")


def joined(df: DataFrame, keys: int) -> DataFrame:
    """(large, a, b): pairs of lines that share a key (false), and (key, line) of keys of very many lines (true).

    ``keys`` is about how many keys there are; the number of buckets follows from it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = SMALL
    buckets = max(2 * parts, -(-16 * keys // BUCKET_BYTES))

    def pack(batches):
        import pyarrow as pa

        for _, _, x in _batches(batches):
            key, line = distinct_pairs(*x.coarse())
            bucket = (key >> _U(40)) % _U(buckets)
            o = np.argsort(bucket, kind="stable")
            key, line, bucket = key[o], line[o], bucket[o]
            begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            cuts = np.append(begins, len(bucket))
            cols = [pa.array(bucket[begins].astype(np.int64)), *(pa.array([v[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for v in (key, line))]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "k", "h"])

    def gather(batches):
        import pyarrow as pa

        def rows(large, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), large)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["large", "a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, size, least = None, 0, 0

        def merge(end: bool):
            nonlocal held, size, least
            k, h = distinct_pairs(*(np.concatenate(x) for x in zip(*held)))
            rank, count = ranks(k)
            out = (count > small) if end else rank > small  # the small + 1 lines that stay show that the key is large
            if out.any():
                yield rows(True, k[out], h[out])
            k, h = k[~out], h[~out]
            held, size = [(k, h)], len(k)
            least = size
            if end:
                pairs = [(h[:-d][same], h[d:][same]) for d in range(1, small) if (same := k[:-d] == k[d:]).any()]
                if pairs:
                    yield rows(False, *distinct_pairs(*(np.concatenate(x) for x in zip(*pairs))))
                held, size, least = [], 0, 0

        for b in batches:
            for bucket, k, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if bucket != at and held:
                    yield from merge(True)
                at = bucket
                held.append((np.frombuffer(k.as_py(), np.uint64), np.frombuffer(h.as_py(), np.uint64)))
                size += len(held[-1][0])
                if size > 1_000_000 + 2 * least:
                    yield from merge(False)
        if held:
            yield from merge(True)

    packed = df.mapInArrow(pack, "bucket long, k binary, h binary")
    return packed.repartition(max(parts, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "large boolean, a long, b long")


def distinct_pairs(k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((h, k))
    k, h = k[o], h[o]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    return k[new], h[new]


def ranks(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys, each one's place among its equals and how many they are."""
    begins = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.append(begins, len(k)))
    return np.arange(len(k)) - np.repeat(begins, count), np.repeat(count, count)


def _mask(lines: str):
    """A byte for each place up to the last of a sorted array of places: 1 at these."""
    gap = F.transform(lines, lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i > 0, F.get(F.col(lines), i - 1)).otherwise(-1) - 1), F.lit("1")))
    return F.array_join(gap, "").cast("binary")


def _at(mask: str, i):
    return F.coalesce(F.substring(F.col(mask), i + 1, F.lit(1)) == F.lit(b"1"), F.lit(False))


def words_of(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, w binary): the word hashes of the lines (h, at) of ``df``."""
    by_doc = wanted.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("at.line", "h"))).alias("wanted"))
    by_doc = by_doc.select("doc_id", "wanted", F.col("wanted.line").alias("places")).select("doc_id", "wanted", _mask("places").alias("mask"))
    picked = F.filter(F.split("text", "\n"), lambda x, i: _at("mask", i))
    lines = df.join(by_doc, "doc_id").select(F.explode(F.arrays_zip(F.col("wanted.h").alias("h"), picked.alias("text"))).alias("x")).select("x.h", "x.text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_buffers(b.column(1))
            hs = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                x = Lines(data, offsets[i : j + 1])
                ok = np.flatnonzero(x.hash.view(np.int64) == hs[i:j]) if len(x.hash) == j - i else []  # another text of the same id gives no line
                yield pa.RecordBatch.from_arrays([pa.array(hs[i:j][ok], pa.int64()), pa.array([x.words[x.start[q] : x.end[q]].tobytes() for q in ok], pa.binary())], names=["h", "w"])

    return lines.filter("h is not null and text is not null").mapInArrow(run, "h long, w binary").dropDuplicates(["h"])


def _counts(words: list[np.ndarray]) -> np.ndarray:
    """How many words of each line fall into each of 16 classes: an edit changes two of them by one at most."""
    at = np.repeat(np.arange(len(words)), [len(w) for w in words])
    all_ = np.concatenate(words) if len(at) else np.zeros(0, np.uint64)
    return np.bincount(at * 16 + (all_ >> _U(60)).astype(np.int64), minlength=16 * len(words)).reshape(-1, 16)


def _verified(x: list[np.ndarray], y: list[np.ndarray]) -> list[bool]:
    if not x:
        return []
    k = np.minimum(MOST, np.minimum([len(v) for v in x], [len(v) for v in y]) // RATE)
    may = np.abs(_counts(x) - _counts(y)).sum(1) <= 2 * k
    return [bool(m) and within(a, b, int(e)) for m, a, b, e in zip(may, x, y, k)]


def verify(pairs: DataFrame) -> DataFrame:
    """Of (h, g, x, y), the (h, g) whose words x and y are near."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, y = ([np.frombuffer(v.as_py(), np.uint64) for v in b.column(c)] for c in (2, 3))
            yield b.select(["h", "g"]).filter(pa.array(_verified(x, y), pa.bool_()))

    return pairs.select("h", "g", "x", "y").mapInArrow(run, "h long, g long")


def within(x: np.ndarray, y: np.ndarray, k: int) -> bool:
    """Whether at most k elements replaced, inserted or deleted turn x into y: furthest places by diagonal."""
    n, m = len(x), len(y)
    if abs(n - m) > k:
        return False

    def slide(i: int, j: int) -> int:
        c = min(n - i, m - j)
        differ = x[i : i + c] != y[j : j + c]
        p = int(differ.argmax()) if c > 0 else 0
        return i + (p if c > 0 and differ[p] else max(c, 0))

    far = {0: slide(0, 0)}
    for e in range(k + 1):
        if far.get(m - n, -1) >= n:
            return True
        if e == k:
            return False
        after = {}
        for d in range(-e - 1, e + 2):
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i >= max(0, -d):
                after[d] = slide(i, i + d)
        far = after
    return False


def past(queries: DataFrame, members: DataFrame) -> DataFrame:
    """(h, g): lines of ``queries`` (key, h, x) with the near lines of ``members`` (key, h, x) of their key.

    Both go in blocks of about ``BLOCK``; every pair of blocks is a group of its own,
    which holds its queries and streams its members.
    """
    size = lambda df: df.groupBy("key").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("parts"))
    nq, nm = size(queries).withColumnRenamed("parts", "q"), size(members).withColumnRenamed("parts", "m")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = queries.join(nq, "key").join(nm, "key").select("key", F.pmod(F.xxhash64("h"), F.col("q")).alias("i"), every("m").alias("j"), F.lit(0).alias("side"), "h", "x")
    right = members.join(nq, "key").join(nm, "key").select("key", F.pmod(F.xxhash64("h"), F.col("m")).alias("j"), every("q").alias("i"), F.lit(1).alias("side"), "h", "x").select("key", "i", "j", "side", "h", "x")
    both = left.union(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def run(batches):
        import pyarrow as pa

        at, own = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for key, i, j, side, h, x in zip(*(b.column(c).to_pylist() for c in range(6))):
                if at != (key, i, j):
                    at, own = (key, i, j), []
                w = np.frombuffer(x, np.uint64)
                if side == 0:
                    own.append((h, w))
                    continue
                other = [(g, v) for g, v in own if g != h]
                out += [(g, h) for (g, _), ok in zip(other, _verified([v for _, v in other], [w] * len(other))) if ok]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["h", "g"])

    return both.mapInArrow(run, "h long, g long")


def near(df: DataFrame, first: DataFrame) -> DataFrame:
    """h of the lines that have an earlier near line; ``first`` has (h, at, n) of the lines that may."""
    found = cut(joined(df, 11 * first.count()))
    meta = first.select("h", "at", "n")
    members = found.filter("large").select(F.col("a").alias("key"), F.col("b").alias("h")).distinct().join(meta, "h")
    some = not members.isEmpty()
    pairs = found.filter("not large").select("a", "b").distinct()
    if some:
        members = cut(members)
        earliest = members.groupBy("key").agg(F.min_by("h", "at").alias("g"))
        pairs = pairs.union(members.join(earliest, "key").filter("h <> g").select(F.col("h").alias("a"), F.col("g").alias("b"))).distinct()
    a, b = (meta.select(F.col("h").alias(c), F.col("at").alias(f"at_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    close = F.abs(F.col("n_a") - F.col("n_b")) <= F.least(F.lit(MOST), F.floor(F.least("n_a", "n_b") / RATE))
    pairs = pairs.join(a, "a").join(b, "b").filter(close)
    late = F.col("at_a") > F.col("at_b")
    pairs = cut(pairs.select(F.when(late, F.col("a")).otherwise(F.col("b")).alias("h"), F.when(late, F.col("b")).otherwise(F.col("a")).alias("g")))
    known = pairs.select("h").union(pairs.select("g"))
    if some:
        known = known.union(members.select("h"))
    words = cut(words_of(df, known.distinct().join(meta, "h").select("h", "at")))
    drop_cut(found)
    x = lambda c, to: words.select(F.col("h").alias(c), F.col("w").alias(to))
    done = verify(pairs.join(x("h", "x"), "h").join(x("g", "y"), "g")).select("h").distinct()
    if not some:
        return done
    done = cut(done)
    open_ = members.join(earliest, "key").filter("h <> g").join(done, "h", "left_anti").select("key", "h")
    rest = past(open_.join(x("h", "x"), "h").select("key", "h", "x"), members.join(open_.select("key").distinct(), "key", "left_semi").join(x("h", "x"), "h").select("key", "h", "x"))
    a, b = (meta.select(F.col("h").alias(c), F.col("at").alias(f"at_{c}")) for c in "hg")
    return done.union(rest.distinct().join(a, "h").join(b, "g").filter("at_g < at_h").select("h")).distinct()


def dropped(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lines array<int>): the lines that each document loses, if any."""
    d = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    occ = cut(occurrences(d))
    first = cut(occ.groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.count(F.lit(1)).alias("count"), F.first("n").alias("n")))
    gone = near(d, first.filter(F.col("n") >= RATE)).withColumn("near", F.lit(True))
    touched = first.filter("count > 1").select("h", "at").join(gone, "h", "full_outer")
    lost = occ.join(touched, "h").filter(F.col("near") | (F.struct("doc_id", "line") != F.col("at")))
    return lost.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with its text's surviving lines and the array<int> _dropped (null: none)."""
    names = [c for c in df.columns if c != "_dropped"]
    own = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # no name of the input can clash
    at, key = f"c{names.index(text)}", f"c{names.index(doc)}"
    lost = dropped(df, doc, text).select(F.col("doc_id").alias("who"), "lines").select("who", "lines", _mask("lines").alias("mask"))
    j = own.join(lost, F.col(key) == F.col("who"), "left")
    kept = F.array_join(F.filter(F.split(F.col(at), "\n"), lambda x, i: ~_at("mask", i)), "\n")
    new = F.when(F.col("mask").isNull(), F.col(at)).otherwise(kept)
    return j.select(*[(new if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)], F.col("lines").alias("_dropped"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = dedup(docs)
    return d.filter(F.col("_dropped").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    lost = F.coalesce(F.array_size("_dropped"), F.lit(0))
    return dedup(d).select("doc_id", lost.alias("n_dropped"), F.col("_dropped").alias("dropped"), "text")
