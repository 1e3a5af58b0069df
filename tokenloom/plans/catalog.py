"""Queries by name, each over whole tables, and the same as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..ir import Vocabulary
from ..operators import encode as E
from ..operators import stats, tables
from ..sources import texts, vocabularies
from ..streaming import encode as streaming
from . import frozen as Z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
THREADS = 4


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return E.spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", *columns))


def vocab(spark: SparkSession, v: Vocabulary = Z.BPE) -> DataFrame:
    return v.tables(spark)["vocab"]


# Splitting and classification


@query("byte_class_counts", "SELECT doc_id, " + ", ".join(f"CAST(strlen(regexp_replace(text, '{p}', '', 'g')) AS BIGINT) AS n_{n}" for n, p in T.CLASSES.items()) + " FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", *[T.class_bytes(F.col("text"), n).alias(f"n_{n}") for n in T.CLASSES])


def _split_sql(pattern: str, name: str) -> str:
    return f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, w[i] AS {name} FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS w FROM documents))"


def _split(f, name):
    return lambda spark, sf: docs(spark, sf).select("doc_id", F.posexplode(f(F.col("text"))).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


query("pretokens", _split_sql(T.PRE, "pretoken"))(_split(T.pretokens, "pretoken"))
query("unicode_words", _split_sql(T.WORD, "word"))(_split(T.words, "word"))
query("blank_words", _split_sql(T.BLANK, "word"))(_split(T.blank_words, "word"))

_SPACED = T.PRE + r"|[\x{09}-\x{0D} ]"


@query(
    "pretoken_spans",
    f"""WITH x AS (SELECT doc_id, unnest(w) AS p, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_SPACED}') AS w FROM documents)),
    q AS (SELECT doc_id, i, p, CAST(sum(strlen(p)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS end_byte FROM x)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS pos, CAST(end_byte - strlen(p) AS BIGINT) AS start_byte, end_byte FROM q WHERE NOT regexp_matches(p, '^[\\x{{09}}-\\x{{0D}} ]')""",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(udfs.pretoken_spans()(F.col("text"))).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), "s.start_byte", "s.end_byte")


@query(
    "pretoken_stats",
    f"""WITH p AS (SELECT lang, list_transform(regexp_extract_all(text, '{T.PRE}'), lambda x: strlen(x)) AS n FROM documents)
    SELECT lang, CAST(sum(len(n)) AS BIGINT) AS n_pretokens, CAST(coalesce(max(list_max(n)), 0) AS BIGINT) AS max_bytes,
           CASE WHEN sum(len(n)) = 0 THEN 0.0 ELSE CAST(sum(coalesce(list_sum(n), 0)) AS DOUBLE) / CAST(sum(len(n)) AS DOUBLE) END AS avg_bytes FROM p GROUP BY lang""",
)
def _(spark, sf):
    return stats.pretoken_stats(docs(spark, sf, "lang"), "lang")


CHUNKS = 7
_UTF8 = f"""n AS (SELECT doc_id, text, CAST(strlen(text) AS BIGINT) AS n FROM documents),
    p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(text, '') AS w FROM n WHERE n > 0)),
    b AS (SELECT doc_id, CAST(sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM p),
    l AS (SELECT doc_id, list(e ORDER BY e) AS ends FROM b GROUP BY doc_id),
    j AS (SELECT n.doc_id, n, CAST(ceil(n / {CHUNKS}.0) AS BIGINT) AS step, coalesce(ends, [0]) AS ends FROM n LEFT JOIN l ON l.doc_id = n.doc_id),
    r AS (SELECT doc_id, n, step, ends, CAST(0 AS BIGINT) AS s, list_min(list_filter(ends, lambda e: e >= least(step, n))) AS e FROM j
          UNION ALL SELECT doc_id, n, step, ends, r.e, list_min(list_filter(ends, lambda x: x >= least(r.e + step, n))) FROM r WHERE r.e < n)"""


@query("utf8_chunks", f"WITH RECURSIVE {_UTF8} SELECT doc_id, s AS start_byte, e AS end_byte FROM r")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(udfs.utf8_chunks(CHUNKS)(F.col("text"))).alias("s")).select("doc_id", "s.start_byte", "s.end_byte")


@query(
    "blank_chunks",
    """WITH RECURSIVE n AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, text FROM documents WHERE strlen(text) > 0),
    p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[ \\n\\t\\r]|[^ \\n\\t\\r]+') AS w FROM n WHERE n > 4096)),
    b AS (SELECT doc_id, e FROM (SELECT doc_id, x, CAST(sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM p) WHERE regexp_matches(x, '^[ \\n\\t\\r]')),
    l AS (SELECT doc_id, list(e ORDER BY e) AS ends FROM b GROUP BY doc_id),
    j AS (SELECT n.doc_id, n, coalesce(ends, []) AS ends FROM n LEFT JOIN l ON l.doc_id = n.doc_id),
    r AS (SELECT doc_id, n, ends, CAST(0 AS BIGINT) AS s, CASE WHEN n <= 4096 THEN n ELSE coalesce(list_min(list_filter(ends, lambda e: e > 4096)), n) END AS e FROM j
          UNION ALL SELECT doc_id, n, ends, r.e, CASE WHEN r.e + 4096 >= n THEN n ELSE coalesce(list_min(list_filter(ends, lambda x: x > r.e + 4096)), n) END FROM r WHERE r.e < n)
    SELECT doc_id, s AS start_byte, e AS end_byte FROM r""",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(udfs.blank_chunks(1)(F.col("text"))).alias("s")).select("doc_id", "s.start_byte", "s.end_byte")


@query("dispatch_target", f"SELECT doc_id, CASE WHEN strlen(text) < 4096 THEN 'low_latency' ELSE 'parallel' END AS target, 'sweep' = CASE WHEN strlen(text) < 4096 THEN 'low_latency' ELSE 'sweep' END AS one_thread_sweeps FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.dispatch_target(F.col("text"), THREADS).alias("target"), (T.dispatch_target(F.col("text"), 1) == "sweep").alias("one_thread_sweeps"))


@query("chunk_size", f"SELECT doc_id, CAST(CASE WHEN strlen(text) = 0 THEN 1 ELSE greatest(least(strlen(text) // {4 * THREADS}, 65536), 4096) END AS BIGINT) AS bytes, CAST(greatest(strlen(text), 1) AS BIGINT) AS one_thread FROM documents")
def _(spark, sf):
    n = F.octet_length("text").cast("long")
    return docs(spark, sf).select("doc_id", T.chunk_size(n, THREADS).cast("long").alias("bytes"), T.chunk_size(n, 1).alias("one_thread"))


@query("byte_sums", None)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", udfs.byte_sum()(F.col("text")).alias("byte_sum"))


SQL["byte_sums"] = """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents), k AS (SELECT doc_id, h, count(*) AS n FROM b GROUP BY doc_id, h)
    SELECT d.doc_id, CAST(coalesce(s, 0) % 4294967296 AS BIGINT) AS byte_sum FROM documents d LEFT JOIN (SELECT doc_id, sum(n * ((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)) AS s FROM k GROUP BY doc_id) USING (doc_id)"""

# Vocabulary tables


@query("byte_vocab", "SELECT CAST(b AS BIGINT) AS byte, CAST(coalesce(token_id, 0) AS BIGINT) AS token_id FROM range(256) r(b) LEFT JOIN " + Z.vocab_sql(Z.BPE) + " v ON b BETWEEN 1 AND 127 AND v.token = CASE WHEN b BETWEEN 1 AND 127 THEN chr(CAST(b AS INTEGER)) END")
def _(spark, sf):
    return tables.byte_vocab(spark, Z.BPE)


_M = Z.values([(r, a, b) for r, (a, b) in enumerate([*Z.MERGES, Z.MERGES[0], ("x", "qq"), ("Q", "Q")])], "rank, l, r")


def _merges(spark):
    rows = [*Z.MERGES, Z.MERGES[0], ("x", "qq"), ("Q", "Q")]  # a repeated rule and two without ids
    return spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(rows)], "rank long, left string, right string")


@query("merge_ranks", f"SELECT l AS \"left\", r AS \"right\", CAST(max(rank) AS BIGINT) AS rank FROM {_M} GROUP BY l, r")
def _(spark, sf):
    return tables.merge_ranks(_merges(spark))


@query("id_merges", f"WITH v AS {Z.vocab_sql(Z.BPE)}, m AS (SELECT l, r, max(rank) AS rank FROM {_M} GROUP BY l, r) SELECT CAST(a.token_id AS BIGINT) AS left_id, CAST(b.token_id AS BIGINT) AS right_id, CAST(c.token_id AS BIGINT) AS merged_id, CAST(rank AS BIGINT) AS rank FROM m JOIN v a ON a.token = l JOIN v b ON b.token = r JOIN v c ON c.token = l || r")
def _(spark, sf):
    return tables.id_merges(_merges(spark), vocab(spark))


_SHORT = f"(SELECT word, arg_min(token_id, (turn, token_id)) AS token_id FROM (SELECT token AS word, token_id, 0 AS turn FROM {Z.vocab_sql(Z.BULK)} UNION ALL SELECT replace(token, 'Ġ', ' '), token_id, 1 FROM {Z.vocab_sql(Z.BULK)} WHERE contains(token, 'Ġ')) WHERE strlen(word) BETWEEN 1 AND 8 GROUP BY word)"


@query("short_words", f"SELECT word, CAST(token_id AS BIGINT) AS token_id FROM {_SHORT}")
def _(spark, sf):
    return tables.short_words(vocab(spark, Z.BULK))


_KEYS = f"SELECT key, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{T.BULK}')) AS key FROM documents) GROUP BY key"
_HITS = f"""WITH v AS {Z.vocab_sql(Z.BULK)}, s AS {_SHORT}, k AS (SELECT key, n, CASE WHEN key[1] = ' ' THEN key[2:] ELSE key END AS word FROM ({_KEYS})),
    h AS (SELECT k.key, k.word, k.n, coalesce(a.token_id, b.token_id, c.token_id, d.token_id) AS token_id FROM k LEFT JOIN s a ON a.word = k.key LEFT JOIN s b ON b.word = k.word LEFT JOIN v c ON c.token = k.key LEFT JOIN v d ON d.token = k.word)"""


def _keys(spark, sf):
    return docs(spark, sf).select(F.explode(T.bulk_words(F.col("text"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("whole_word_hits", _HITS + " SELECT key, n, CAST(token_id AS BIGINT) AS token_id FROM h WHERE token_id IS NOT NULL")
def _(spark, sf):
    return tables.whole_words(_keys(spark, sf), vocab(spark, Z.BULK)).filter("token_id is not null").select("key", "n", "token_id")


@query("whole_word_misses", _HITS + " SELECT word, CAST(sum(n) AS BIGINT) AS n FROM h WHERE token_id IS NULL GROUP BY word")
def _(spark, sf):
    return tables.whole_words(_keys(spark, sf), vocab(spark, Z.BULK)).filter("token_id is null").groupBy("word").agg(F.sum("n").alias("n"))


def _words_of(table: str = "documents") -> str:
    return f"SELECT DISTINCT unnest(regexp_extract_all(text, '{T.WORD}')) AS word FROM {table}"


@query("common_prefixes", f"SELECT word, CAST(strlen(token) AS BIGINT) AS length, CAST(token_id AS BIGINT) AS token_id FROM ({_words_of()}) JOIN {Z.vocab_sql(Z.BPE)} v ON starts_with(word, token)")
def _(spark, sf):
    w = docs(spark, sf).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return tables.common_prefixes(w, vocab(spark))


_STATES = f"""v AS {Z.vocab_sql(Z.TRIE)}, s AS (SELECT DISTINCT substr(h, 1, 2 * k) AS state FROM (SELECT hex(encode(token)) AS h, unnest(range(1, strlen(token) + 1)) AS k FROM v)),
    t AS (SELECT state, token_id FROM s LEFT JOIN v ON hex(encode(v.token)) = state)"""


@query("trie_states", f"WITH {_STATES} SELECT state, CAST(token_id AS BIGINT) AS token_id FROM t WHERE token_id IS NOT NULL UNION ALL SELECT state, -1 FROM t WHERE token_id IS NULL")
def _(spark, sf):
    return tables.trie_states(vocab(spark, Z.TRIE)).select("state", F.coalesce("token_id", F.lit(-1).cast("long")).alias("token_id"))


@query("trie_edges", f"WITH {_STATES} SELECT substr(state, 1, length(state) - 2) AS parent, CAST((instr('0123456789ABCDEF', state[-2]) - 1) * 16 + instr('0123456789ABCDEF', state[-1]) - 1 AS BIGINT) AS byte, state FROM t")
def _(spark, sf):
    return tables.trie_edges(vocab(spark, Z.TRIE))


@query(
    "fail_links",
    f"""WITH {_STATES}, x AS (SELECT state, substr(state, 2 * k + 1) AS suffix FROM (SELECT state, unnest(range(1, length(state) // 2)) AS k FROM s)),
    b AS (SELECT x.state, arg_max(suffix, length(suffix)) AS fail, arg_max(suffix, length(suffix)) FILTER (token_id IS NOT NULL) AS fail_pop FROM x JOIN t ON t.state = suffix GROUP BY x.state)
    SELECT s.state, coalesce(fail, '') AS fail, coalesce(fail_pop, '') AS fail_pop FROM s LEFT JOIN b ON b.state = s.state""",
)
def _(spark, sf):
    return tables.fail_links(vocab(spark, Z.TRIE))


@query("trie_size", f"WITH {_STATES} SELECT count(*) + 1 AS n_states, count(token_id) AS n_tokens FROM t")
def _(spark, sf):
    return tables.trie_states(vocab(spark, Z.TRIE)).agg((F.count(F.lit(1)) + 1).alias("n_states"), F.count("token_id").alias("n_tokens"))


@query("path_exists", f"WITH {_STATES}, w AS ({_words_of()}) SELECT word FROM w WHERE hex(encode(word)) IN (SELECT state FROM s)")
def _(spark, sf):
    return tables.path_exists(docs(spark, sf).select(F.explode(T.words(F.col("text"))).alias("word")).distinct(), vocab(spark, Z.TRIE))


_STEP = f"""WITH {_STATES}, x AS (SELECT state, substr(state, 2 * k + 1) AS suffix FROM (SELECT state, unnest(range(1, length(state) // 2)) AS k FROM s)),
    f AS (SELECT x.state, arg_max(suffix, length(suffix)) AS fail FROM x JOIN s ON s.state = suffix GROUP BY x.state),
    p AS (SELECT state, b FROM (SELECT '' AS state UNION ALL SELECT state FROM s) CROSS JOIN (SELECT CAST(b AS INTEGER) AS b FROM range(256) v(b)))"""


def _steps(spark):
    states = tables.trie_states(vocab(spark, Z.TRIE)).select("state").union(spark.createDataFrame([("",)], "state string"))
    return states.select("state", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("byte"))


@query("transitions", _STEP + " SELECT p.state, CAST(b AS BIGINT) AS byte, coalesce(s.state, 'none') AS next FROM p LEFT JOIN s ON s.state = p.state || printf('%02X', b)")
def _(spark, sf):
    return tables.transitions(_steps(spark), vocab(spark, Z.TRIE)).select("state", "byte", F.coalesce("next", F.lit("none")).alias("next"))


@query("transitions_release", _STEP + " SELECT p.state, CAST(b AS BIGINT) AS byte, coalesce(s.state, fail, '') AS next FROM p LEFT JOIN s ON s.state = p.state || printf('%02X', b) LEFT JOIN f ON f.state = p.state")
def _(spark, sf):
    return tables.transitions(_steps(spark), vocab(spark, Z.TRIE), release=True).select("state", "byte", "next")


@query("trie_annotations", f"SELECT 'Bpe' AS algo, token, CAST(token_id AS BIGINT) AS token_id, CAST(coalesce(rank, -100) AS DOUBLE) AS annotation FROM {Z.vocab_sql(Z.BPE)} LEFT JOIN (SELECT l || r AS token, max(rank) AS rank FROM {Z.values([(r, a, b) for r, (a, b) in enumerate(Z.MERGES)], 'rank, l, r')} GROUP BY 1) USING (token) UNION ALL SELECT 'Unigram', token, CAST(token_id AS BIGINT), CAST(coalesce(score, -100) AS DOUBLE) FROM {Z.vocab_sql(Z.UNIGRAM)} LEFT JOIN {Z.values(Z.UNIGRAM.scores, 'token, score')} USING (token)")
def _(spark, sf):
    parts = [tables.trie_annotations(v, spark).select(F.lit(v.algo).alias("algo"), "token", "token_id", F.coalesce("annotation", F.lit(-100.0)).alias("annotation")) for v in (Z.BPE, Z.UNIGRAM)]
    return parts[0].union(parts[1])


@query(
    "engine_pre",
    f"""WITH RECURSIVE {_UTF8} SELECT r.doc_id, CAST(sum(len(regexp_extract_all(substr(text, coalesce(list_position(ends, s), 0) + 1, list_position(ends, e) - coalesce(list_position(ends, s), 0)), '{T.PRE}'))) AS BIGINT) AS n
    FROM r JOIN n USING (doc_id) GROUP BY r.doc_id""",
)
def _(spark, sf):
    """Pretokens counted over chunks of equal size, whose borders cut words."""
    b = docs(spark, sf).select("doc_id", "text", F.explode(udfs.utf8_chunks(CHUNKS)(F.col("text"))).alias("s"))
    part = F.encode("text", "utf-8").substr(F.col("s.start_byte") + 1, F.col("s.end_byte") - F.col("s.start_byte")).cast("string")
    return b.select("doc_id", F.size(T.pretokens(part)).cast("long").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))


# Encoders

_MARK = "regexp_replace({}, '(?s)(.)', chr(1) || '\\1' || chr(2), 'g')"
_UNMARK = "regexp_extract_all({}, '(?s)\\x01([^\\x02]*)\\x02', 1)"


def _ids_sql(distinct: str, prepared: str = "word") -> str:
    """CTEs ending in e(word, ids, n): the BPE ids of each distinct word as a string, and their count."""
    return f"""v AS {Z.vocab_sql(Z.BPE)}, d AS ({distinct}),
    m AS (SELECT word, {_UNMARK.format(Z.chain_sql(_MARK.format(prepared)))} AS s FROM d),
    u AS (SELECT word, s, unnest(range(1, len(s) + 1)) AS i FROM m),
    e AS (SELECT word, string_agg(CAST(coalesce(token_id, 0) AS VARCHAR), ' ' ORDER BY i) AS ids, count(*) AS n FROM (SELECT word, i, s[i] AS t FROM u) LEFT JOIN v ON token = t GROUP BY word)"""


_AS_BYTES = "array_to_string(list_transform(string_split(word, ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE repeat(chr(3), strlen(c)) END), '')"


def _by_doc(pattern: str, where: str = "true") -> str:
    """Documents' words in order, joined with e, as (doc_id, ids, n_tokens)."""
    return f"""SELECT doc_id, coalesce(string_agg(ids, ' ' ORDER BY i), '') AS ids, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens
    FROM (SELECT doc_id, 0 AS i, NULL AS w FROM documents WHERE {where} UNION ALL
          SELECT doc_id, i, w[i] FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS w FROM documents WHERE {where}))) LEFT JOIN e ON e.word = w GROUP BY doc_id"""


def _distinct(pattern: str) -> str:
    return f"SELECT DISTINCT unnest(regexp_extract_all(text, '{pattern}')) AS word FROM documents"


def _encoded(spark, sf, v=Z.BPE, **how):
    return E.encode(docs(spark, sf), v, **how).select("doc_id", E.joined().alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


_WORD_SQL = f"WITH {_ids_sql(_distinct(T.WORD))} {_by_doc(T.WORD)}"
_PRE_SQL = f"WITH {_ids_sql(_distinct(T.PRE), _AS_BYTES)} {_by_doc(T.PRE)}"


@query("bpe_word", _WORD_SQL)
def _(spark, sf):
    return _encoded(spark, sf)


@query("bpe_block", _WORD_SQL)
def _(spark, sf):
    return _encoded(spark, sf, strategy="block")


@query("bpe_native", _WORD_SQL)
def _(spark, sf):
    return E.encode_native(docs(spark, sf), Z.BPE).select("doc_id", E.joined().alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


@query("bpe_pretoken", _PRE_SQL)
def _(spark, sf):
    return _encoded(spark, sf, mode="pretoken")


@query("bpe_adaptive", f"SELECT * FROM ({_WORD_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE strlen(text) < 4096) UNION ALL SELECT * FROM ({_PRE_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE strlen(text) >= 4096)")
def _(spark, sf):
    return _encoded(spark, sf, mode="adaptive")


_MISSED = f"SELECT DISTINCT word FROM h WHERE token_id IS NULL"
_BULK_CTE = f"""{_HITS}, p AS (SELECT word AS w, ps, unnest(range(1, len(ps) + 1)) AS j FROM (SELECT word, regexp_extract_all(word, '{T.PRE}') AS ps FROM ({_MISSED}))),
    {_ids_sql("SELECT DISTINCT ps[j] AS word FROM p", _AS_BYTES).replace('v AS', 'v2 AS', 1).replace('JOIN v ON', 'JOIN v2 ON')},
    slow AS (SELECT w, string_agg(ids, ' ' ORDER BY j) AS ids, sum(n) AS n FROM p JOIN e ON e.word = ps[j] GROUP BY w),
    k2 AS (SELECT h.key, CASE WHEN h.token_id IS NULL THEN slow.ids ELSE CAST(h.token_id AS VARCHAR) END AS ids, CASE WHEN h.token_id IS NULL THEN slow.n ELSE 1 END AS n FROM h LEFT JOIN slow ON slow.w = h.word)"""


@query("bpe_bulk", f"WITH {_BULK_CTE[5:]} {_by_doc(T.BULK).replace('JOIN e ON e.word = w', 'JOIN k2 ON k2.key = w')}")
def _(spark, sf):
    return _encoded(spark, sf, Z.BULK, mode="bulk")


@query(
    "bulk_stats",
    _HITS + """ SELECT CAST((SELECT sum(strlen(text)) FROM documents) AS BIGINT) AS total_bytes, CAST(sum(n) AS BIGINT) AS total_words, CAST(sum(n) FILTER (token_id IS NOT NULL) AS BIGINT) AS fast_words,
    CAST(sum(n * strlen(word)) FILTER (token_id IS NOT NULL) AS BIGINT) AS fast_bytes, CAST(sum(n) FILTER (token_id IS NULL) AS BIGINT) AS fallback_words, CAST(sum(n * strlen(word)) FILTER (token_id IS NULL) AS BIGINT) AS fallback_bytes FROM h""",
)
def _(spark, sf):
    return stats.bulk_stats(docs(spark, sf), Z.BULK).select(*stats.COUNTERS)


@query("bpe_conformance", f"SELECT lang, CAST(sum(len(regexp_extract_all(text, '{T.WORD}'))) AS BIGINT) AS n_words, CAST(0 AS BIGINT) AS n_differing FROM documents GROUP BY lang")
def _(spark, sf):
    """Words of which the two merge strategies give different ids: none with a well-formed vocabulary."""
    d = docs(spark, sf, "lang").withColumn("words", T.words(F.col("text")))
    both = E.encode(E.encode(d, Z.BPE, out="a"), Z.BPE, out="b", strategy="block")
    return both.groupBy("lang").agg(F.sum(F.size("words")).cast("long").alias("n_words"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(1)).cast("long").alias("n_differing"))


@query("conformance_diff", "SELECT CAST(0 AS BIGINT) AS doc_id, '' AS ids, '' AS side WHERE false")
def _(spark, sf):
    """Rows that only one of the two merge implementations gives."""
    both = E.encode_native(E.encode(docs(spark, sf), Z.BPE, out="a"), Z.BPE, out="b")
    return stats.only_in_one(both.select("doc_id", "a", "b"), "a", "b", "doc_id", sides=("kernel", "native"))


_WP = f"""WITH RECURSIVE v AS {Z.vocab_sql(Z.WORDPIECE)}, d AS ({_distinct(T.WORD)}), longest AS (SELECT max(length(token)) AS n FROM v),
    r(word, s, ids, n, ok) AS (SELECT word, 0, '', 0, true FROM d
      UNION ALL SELECT r.word, CAST(r.s + coalesce(b.k, 0) AS INTEGER), CASE WHEN b.k IS NULL THEN '' ELSE CASE WHEN r.ids = '' THEN '' ELSE r.ids || ' ' END || b.id END, r.n + 1, b.k IS NOT NULL
      FROM r LEFT JOIN (SELECT q.word, q.s, max(k) AS k, arg_max(token_id, k) AS id FROM (SELECT word, s, unnest(range(1, least(CAST((SELECT n FROM longest) AS BIGINT), length(word) - s) + 1)) AS k FROM r WHERE ok AND s < length(word)) q
                        JOIN v ON v.token = (CASE WHEN q.s = 0 THEN '' ELSE '##' END) || substr(q.word, q.s + 1, q.k) GROUP BY q.word, q.s) b ON b.word = r.word AND b.s = r.s
      WHERE r.ok AND r.s < length(r.word)),
    e AS (SELECT word, CASE WHEN ok THEN ids ELSE '0' END AS ids, CASE WHEN ok THEN n ELSE 1 END AS n FROM r WHERE NOT ok OR s = length(word))
    {_by_doc(T.WORD)}"""


@query("wordpiece", _WP)
def _(spark, sf):
    return _encoded(spark, sf, Z.WORDPIECE)


def _unigram_rows():
    return [(t, i, len(t.encode()), Z.UNIGRAM.score_of.get(t, -10.0)) for t, i in Z.UNIGRAM.vocab.items()]


@query(
    "unigram",
    f"""WITH RECURSIVE v AS {Z.values(_unigram_rows(), 'token, token_id, bytes, score')}, d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{T.WORD}')) AS word FROM documents),
    edges AS MATERIALIZED (SELECT word, i, i + length(token) AS j, CAST(token_id AS VARCHAR) AS ids, 1 AS n, CAST(score AS DOUBLE) AS score FROM (SELECT word, unnest(range(0, length(word))) AS i FROM d) JOIN v ON starts_with(substr(word, i + 1), token)),
    gaps AS (SELECT word, i, i + 1 AS j, array_to_string(list_transform(range(strlen(substr(word, i + 1, 1))), lambda x: '0'), ' ') AS ids, strlen(substr(word, i + 1, 1)) AS n, -10.0 * strlen(substr(word, i + 1, 1)) AS score
             FROM (SELECT word, unnest(range(0, length(word))) AS i FROM d) p WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.word = p.word AND x.i = p.i)),
    g AS MATERIALIZED (SELECT * FROM edges UNION ALL SELECT * FROM gaps),
    r(word, done, best) AS (SELECT word, CAST(0 AS BIGINT), [{{'s': CAST(0 AS DOUBLE), 'ids': '', 'n': CAST(0 AS BIGINT)}}] FROM d
      UNION ALL SELECT r.word, r.done + 1, list_append(r.best, (SELECT {{'s': r.best[g.i + 1].s + g.score, 'ids': trim(r.best[g.i + 1].ids || ' ' || g.ids), 'n': CAST(r.best[g.i + 1].n + g.n AS BIGINT)}}
                FROM g WHERE g.word = r.word AND g.j = r.done + 1 ORDER BY r.best[g.i + 1].s + g.score DESC, g.i LIMIT 1)) FROM r WHERE r.done < length(r.word)),
    e AS (SELECT word, best[-1].ids AS ids, best[-1].n AS n FROM r WHERE done = length(word))
    SELECT doc_id, coalesce(string_agg(ids, ' ' ORDER BY i), '') AS ids, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens
    FROM (SELECT doc_id, i, w[i] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{T.WORD}') AS w FROM documents))) JOIN e ON e.word = w GROUP BY doc_id""",
)
def _(spark, sf):
    return _encoded(spark, sf, Z.UNIGRAM)


@query("initial_tokens", f"SELECT coalesce(token_id, 0) AS token_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(w, '')) AS c FROM (SELECT unnest(regexp_extract_all(text, '{T.WORD}')) AS w FROM documents)) GROUP BY c) LEFT JOIN (SELECT token, CAST(token_id AS BIGINT) AS token_id FROM {Z.vocab_sql(Z.BPE)}) v ON v.token = c GROUP BY 1")
def _(spark, sf):
    c = docs(spark, sf).select(F.explode(T.words(F.col("text"))).alias("w")).select(F.explode(F.split("w", "")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return c.join(vocab(spark), "token", "left").groupBy(F.coalesce("token_id", F.lit(0).cast("long")).alias("token_id")).agg(F.sum("n").alias("n"))


@query("encode_batch_csr", f"SELECT doc_id, n_tokens AS length, CAST(sum(n_tokens) OVER (ORDER BY doc_id) - n_tokens AS BIGINT) AS \"offset\" FROM ({_WORD_SQL})")
def _(spark, sf):
    return E.csr(E.counted(docs(spark, sf), Z.BPE), "doc_id", length="n_tokens")


@query("token_counts", f"SELECT lang, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM ({_WORD_SQL}) JOIN documents USING (doc_id) GROUP BY lang")
def _(spark, sf):
    n = E.counted(docs(spark, sf, "lang"), Z.BPE, out="n").select("lang", "n")
    return n.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))


@query("token_frequency_top", f"SELECT token_id, n FROM (SELECT CAST(t AS BIGINT) AS token_id, count(*) AS n FROM (SELECT unnest(string_split(ids, ' ')) AS t FROM ({_WORD_SQL}) WHERE ids <> '') GROUP BY 1) ORDER BY n DESC, token_id LIMIT 20")
def _(spark, sf):
    t = stats.token_frequencies(docs(spark, sf), Z.BPE)
    return t.orderBy(F.desc("n"), "token_id").limit(20)


@query("tokens_long", f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, CAST(w[i] AS BIGINT) AS token_id FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(ids, ' ') AS w FROM ({_WORD_SQL}) WHERE ids <> ''))")
def _(spark, sf):
    return E.long_form(E.encode(docs(spark, sf), Z.BPE), "doc_id")


@query(
    "stream_encode",
    f"WITH documents AS (SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id), {_ids_sql(_distinct(T.BLANK))} {_by_doc(T.BLANK).replace('SELECT doc_id, coalesce(string_agg', 'SELECT doc_id AS stream_id, coalesce(string_agg', 1)}",
)
def _(spark, sf):
    """Every conversation as one stream, its turns as the chunks."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id AS stream_id", "turn AS seq", "text")
    return streaming.encode_whole(c, Z.BPE).select("stream_id", E.joined().alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


@query("stream_encode_rows", SQL["stream_encode"])
def _(spark, sf):
    """The same, chunk by chunk through the operator that micro-batches use."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    s = streaming.encode_stream(streaming.from_texts(c, "conv_id", "turn", "text"), Z.BPE)
    g = s.groupBy("stream_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"])).alias("ids"))
    return g.select("stream_id", E.joined().alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


# Loaders


def _loaded(spark, v: Vocabulary) -> DataFrame:
    """A loaded vocabulary as rows (kind, name, value)."""
    t = v.tables(spark)
    algo = spark.createDataFrame([("algo", v.algo, float(len(v)))], "kind string, name string, value double")
    return algo.union(t["vocab"].selectExpr("'id'", "token", "cast(token_id as double)")).union(t["merges"].selectExpr("'merge'", "concat(left, ' ', right)", "cast(rank as double)")).union(t["scores"].selectExpr("'score'", "concat(ord, ' ', token)", "cast(score as double)"))


def _rows(*rows) -> str:
    return f"SELECT kind, name, CAST(value AS DOUBLE) AS value FROM {Z.values(rows, 'kind, name, value')}"


def _loader(name: str, make, *rows) -> None:
    query(f"loader_{name}", _rows(*rows))(lambda spark, sf: _loaded(spark, make()))


_IDS = lambda s: [("id", t, i) for i, t in enumerate(s.split())]
_loader("hf", lambda: vocabularies.load_hf(Z.HF), ("algo", "Bpe", 7), *_IDS("h e l o he lo helo"), ("merge", "h e", 0), ("merge", "l o", 1), ("merge", "he lo", 2))
_loader("sentencepiece_json", lambda: vocabularies.load_sentencepiece_json(Z.SP_JSON), ("algo", "Unigram", 3), ("id", "<unk>", 0), ("id", "hello", 3), ("id", "lo", 2), ("score", "0 <unk>", 0.0), ("score", "1 hello", -1.5), ("score", "2 lo", -2.25), ("score", "3 hello", -0.5))
_loader("gguf_json", lambda: vocabularies.load_gguf_json(Z.GGUF_JSON), ("algo", "Bpe", 4), *_IDS("<pad> a b ab"), ("merge", "a b", 0), ("score", "0 <pad>", 0.0), ("score", "1 a", -1.0), ("score", "2 b", 0.0), ("score", "3 ab", 0.0))
_loader("tiktoken", lambda: vocabularies.load_tiktoken(Z.TIKTOKEN), ("algo", "Bpe", 5), ("id", "h", 0), ("id", "i", 1), ("id", "hi", 2), ("id", "é", 3), ("id", "�", 5))
_loader("sentencepiece_proto", lambda: vocabularies.load_sentencepiece_proto(Z.sp_proto()), ("algo", "Unigram", 2), ("id", "a", 0), ("id", "b", 1), ("score", "0 a", -1.0), ("score", "1 b", -2.0))
_loader("compiled", lambda: vocabularies.load_compiled(vocabularies.compile_vocabulary(vocabularies.load_hf(Z.HF))), ("algo", "Bpe", 7), *_IDS("h e l o he lo helo"), ("merge", "h e", 0), ("merge", "l o", 1), ("merge", "he lo", 2))


@query(
    "detect_format",
    "SELECT name, kind FROM " + Z.values([(n, k) for (n, _), k in zip(Z.DETECT, "compiled gguf sentencepiece_json sentencepiece_json hf_json hf_json hf_json unknown unknown tiktoken unknown unknown unknown".split())], "name, kind"),
)
def _(spark, sf):
    return spark.createDataFrame(Z.DETECT, "name string, content binary").select("name", vocabularies.detect_column(F.col("content")).alias("kind"))


@query("synthetic_corpus", "SELECT CAST(i AS BIGINT) AS id, substr(repeat('the quick brown fox jumps over the lazy dog ', 24), 1, 1000) AS text FROM range(4) r(i)")
def _(spark, sf):
    return texts.synthetic(spark, 1000, 4)


@query("id_lines", _WORD_SQL.replace("SELECT doc_id, coalesce(string_agg", "SELECT coalesce(string_agg", 1).replace(", CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens", "", 1) .replace(" AS ids\n", " AS value\n", 1))
def _(spark, sf):
    return E.encode(docs(spark, sf), Z.BPE).select(E.joined().alias("value"))


assert set(SQL) <= set(QUERIES)
