"""Best-fit packing by a configuration linear program over the length histogram.

1. Every text is tokenized, ended by id 0 and, only if longer than the
   capacity, cut into pieces of the capacity; the first piece holds the rest.
2. The driver gets the histogram of piece lengths: at most ``capacity`` numbers
   whatever the size of the corpus.  The program "fewest sequences that cover
   every length's count" is solved by multiplicative weights; its columns
   (fillings of one sequence) are priced by a knapsack dynamic program.
3. A share of the program is kept, its columns used a whole number of times; what
   is left goes, longest first, into the fullest sequences it fits, again by counts.
4. Each piece gets its rank among the pieces of its length from counts of
   (bucket, length), and looks its place up in the plan.

Defined results: a null or empty text is the single id 0; a null id is kept;
repeated rows are packed as often as they come; an empty table gives no rows;
other columns are ignored.  A very long text is tokenized whole, in one row.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, documents
from .token_ids import encoder, vocabulary

CAPACITY = 2048
BUCKET_ROWS = 1_000_000
GAP, LAST_STEP = 0.0003, 0.01
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)


def pieces(df: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocab: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text."""
    paths = vocab or vocabulary()
    end = np.zeros(1, "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        enc = encoder(*paths)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.ids(t.as_py() or "").tobytes() + end
                n = len(ids) // 4
                first = n if n <= capacity else (n % capacity or capacity)
                a, k = 0, 0
                while a < n:
                    z = first if a == 0 else a + capacity
                    for c, v in zip(cols, (i, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z]))):
                        c.append(v)
                    a, k = z, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[doc].dataType.simpleString()
    return df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity up to this one, the greatest value of a filling and the index of a size in it (-1: leave a place empty)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            gain = best[c - sizes[:k]] + value[:k]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], took[c] = gain[i], i
    return best, took


def price(value: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """The filling of greatest value: {index of a size: copies}, by dynamic programming over the capacity."""
    _, took = knapsack(value, sizes, capacity)
    out: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if (i := int(took[c])) < 0:
            c -= 1
        else:
            out[i] += 1
            c -= int(sizes[i])
    return dict(out)


def _pass(sizes: np.ndarray, need: np.ndarray, weight: np.ndarray, capacity: int, gap: float, step: float, every: int) -> tuple[dict[tuple, float], np.ndarray, float]:
    """Columns of near-best price for the weights, the share of each length that they leave, and the dual bound.

    A phase may use the lengths of which at least its step is left, so that all
    lengths run out together; it ends when no column of them comes within
    ``gap`` of the best price, and the step is halved.
    """
    share, used = np.ones(len(sizes)), defaultdict(float)
    base = sizes * weight
    top = float(knapsack(base, sizes, capacity)[0][capacity])
    while step >= LAST_STEP:
        while True:
            live = np.flatnonzero(share >= step)
            if not len(live):
                break
            sz, nd, sh = sizes[live], need[live], share[live]
            tilt = lambda x: np.exp(np.clip(0.1 * gap * (x - sh.mean()) / step, -1, 1))  # noqa: E731, B023
            value = base[live] * tilt(sh)
            best, _ = knapsack(value, sz, capacity)
            upto = np.searchsorted(sz, np.arange(capacity + 1), "right").tolist()
            done = 0
            for _ in range(every):
                column: dict[int, int] = {}
                c, worth = capacity, 0.0
                while n := upto[c]:
                    gain = np.where(sh[:n] >= step, value[:n] + best[c - sz[:n]], -1)
                    i = int(gain.argmax())
                    if gain[i] < 0:
                        break
                    column[i] = column.get(i, 0) + 1
                    worth += float(base[live[i]])
                    c -= int(sz[i])
                if worth < (1 - gap) * top:
                    break
                x = step * min(float(nd[i]) / a for i, a in column.items())
                for i, a in column.items():
                    sh[i] -= x * a / nd[i]
                    value[i] = base[live[i]] * float(tilt(sh[i]))
                used[tuple((int(sz[i]), a) for i, a in sorted(column.items()))] += x
                done += 1
            share[live] = sh
            if not done:
                break
        step /= 2
    return used, share, float(need @ base) / top


def solve(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, step: float = 0.5, every: int = 32) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(columns {length: copies} and how often each is used, fractionally; the dual bound on sequences).

    Multiplicative weights: a length's value is its size times its weight; a pass
    takes columns by knapsack pricing, and lengths that columns of near-best price
    don't cover have their weights multiplied for the next pass, which pulls the
    dual prices towards them.  Passes end when what is left uncovered is less
    than ``gap`` of the bound or when three of them have raised neither bound nor coverage.
    """
    sizes = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    if not len(sizes):
        return [], 0.0
    need = np.array([histogram[int(n)] for n in sizes], float)
    weight, bound, cost, stale, kept = np.ones(len(sizes)), 0.0, np.inf, 0, {}
    while stale < 3:
        used, share, dual = _pass(sizes, need, weight, capacity, gap, step, every)
        left = float((share * need) @ sizes) / capacity
        now = sum(used.values()) + 2 * left
        stale += 1
        if dual > bound * (1 + gap / 10) or now < cost * (1 - gap / 10):
            stale = 0
        if now < cost:
            cost, kept = now, used
        bound = max(bound, dual)
        if left < 2 * LAST_STEP * bound:
            break
        weight = weight * np.exp(0.5 * share / max(float(share.max()), LAST_STEP))
    return [({n: a for n, a in c}, x) for c, x in sorted(kept.items(), key=lambda kv: -kv[1])], bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Fillings {length: copies} with whole numbers of sequences that hold exactly the histogram.

    Rounding keeps a share of the program, each column a whole number of times,
    and places the other pieces by best fit, which needs small ones to fill up with;
    of the shares ``SHARES`` the one of fewest sequences counts, so a plan never has
    more sequences than best fit alone (the share 0).
    """
    columns, _ = solve({n: k for n, k in histogram.items() if k > 0}, capacity, gap)
    plans = (_rounded(histogram, capacity, [(c, x * part) for c, x in columns if x * part >= 1]) for part in SHARES)
    return min(plans, key=lambda groups: sum(k for _, k in groups))


def _rounded(histogram: dict[int, int], capacity: int, columns: list[tuple[dict[int, int], float]]) -> list[tuple[dict[int, int], int]]:
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    groups: list[tuple[dict[int, int], int]] = []
    if capacity in left:
        groups.append(({capacity: 1}, left.pop(capacity)))
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for column, x in columns:
        k = min([int(x), *(left.get(n, 0) // a for n, a in column.items())])
        if k > 0:
            for n, a in column.items():
                left[n] -= k * a
            open_[capacity - sum(n * a for n, a in column.items())].append((column, k))
    for n in sorted(left, reverse=True):
        rest = left[n]
        while rest:
            room = min((r for r, g in open_.items() if r >= n and g), default=None)
            if room is None:
                per = capacity // n
                if full := rest // per:
                    open_[capacity - per * n].append(({n: per}, full))
                if rest % per:
                    open_[capacity - (rest % per) * n].append(({n: rest % per}, 1))
                break
            filling, k = open_[room].pop()
            take = min(k, rest)
            if k > take:
                open_[room].append((filling, k - take))
            open_[room - n].append(({**filling, n: filling.get(n, 0) + 1}, take))
            rest -= take
    return groups + [g for r in sorted(open_) for g in open_[r]]


def places(groups: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), sorted; a piece's row is the last at or before its (length, rank)."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for filling, k in groups:
        at = 0
        for n, a in sorted(filling.items(), reverse=True):
            rows.append((n, rank[n], a, sequence, at))
            rank[n] += k * a
            at += n * a
        sequence += k
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(df: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocab: tuple[str, str] | None = None, gap: float = GAP) -> DataFrame:
    """Every piece with its sequence and offset."""
    spark = df.sparkSession
    p = cut(pieces(df, doc, text, capacity, vocab))
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity, gap))
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    p = p.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = p.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = p.withColumn("r", F.row_number().over(inside)).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    known = spark.sparkContext.broadcast(table)  # a few rows for each length, never more with more data
    kind = df.schema[doc].dataType.simpleString()

    def look(batches):
        import pyarrow as pa

        t = known.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = t[np.searchsorted(t[:, 0] * (1 << 44) + t[:, 1], length * (1 << 44) + rank, "right") - 1] if len(length) else t[:0]
            q = rank - row[:, 1]
            copies = np.maximum(row[:, 2], 1)
            cols = [*b.columns[:5], pa.array(row[:, 3] + q // copies), pa.array(row[:, 4] + q % copies * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(look, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(df: DataFrame, packed: DataFrame, doc: str = "doc_id", text: str = "text", vocab: tuple[str, str] | None = None) -> DataFrame:
    """(sequence_id, ids array): the packed sequences themselves; ``doc`` must be a key of ``df``."""
    paths = vocab or vocabulary()

    def run(batches):
        enc = encoder(*paths)
        for b in batches:
            ids = [np.append(enc.ids(t or "").astype(np.int64), 0) for t in b["text"]]
            yield b.drop(columns="text").assign(ids=[x[a : a + n] for x, a, n in zip(ids, b["start"], b["length"])])

    kind = df.schema[doc].dataType.simpleString()
    j = packed.join(df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "doc_id").select("sequence_id", "offset", "start", "length", "text")
    cutup = j.mapInPandas(run, "sequence_id long, offset long, start long, length long, ids array<long>")
    return cutup.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
