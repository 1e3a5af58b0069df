"""Quality rules, line first: DataFrame functions only.

Every line is judged by three rules and failing lines are removed; a document
is then rejected when a base rule fails or when too much of it was removed.

* punctuation: symbols ``[#*$%&|<>]``, or runs of ``!``/``?``, come to more
  than one for ten words of the line;
* navigation: menu separators come to more than one for five words;
* boilerplate: the line has a phrase of licences, cookie notes or menus, in English,
  German, Spanish or French.

Defined results: a null text counts as empty; an empty text has no words,
fails the base and is rejected; lines without a word are neither kept text nor
lost text; very long texts and lines are judged whole; repeated rows are judged alike, each by itself; other columns are
carried through untouched whatever their names are, but for an input column of the name ``out``,
which is replaced.  Windows of three words are compared by 64-bit hashes inside one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·→]"
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|is licensed|released under the|cookie|privacy policy|terms of (use|service)"
    r"|javascript|subscribe|sign (in|up)|log ?in|lorem ipsum|copyright ©|read more|share this"
    r"|alle rechte vorbehalten|lizenziert unter|unter der lizenz|datenschutzerkl[äÄ]rung|nutzungsbedingungen|newsletter abonnieren|jetzt anmelden|weiterlesen"
    r"|todos los derechos reservados|bajo (la|una) licencia|pol[íÍ]tica de privacidad|t[éÉ]rminos (de uso|del servicio)|aviso legal|iniciar sesi[óÓ]n|suscr[íÍ]bete|leer m[áÁ]s"
    r"|tous droits r[éÉ]serv[éÉ]s|sous licence|politique de confidentialit[éÉ]|mentions l[éÉ]gales|conditions d.utilisation|se connecter|abonnez-vous|lire la suite"
)
#: A lower-case text with a phrase has one of these; looking for plain strings is several times as fast as for the pattern.
CORES = (
    "all rights reserved", "licensed", "released under the", "cookie", "privacy policy", "terms of ", "javascript", "subscribe", "sign in", "sign up", "login", "log in",
    "lorem ipsum", "copyright ©", "read more", "share this", "alle rechte vorbehalten", "lizenziert unter", "unter der lizenz", "datenschutzerkl", "nutzungsbedingungen",
    "newsletter abonnieren", "jetzt anmelden", "weiterlesen", "todos los derechos reservados", " licencia", "de privacidad", "rminos de", "aviso legal", "iniciar sesi", "suscr", "leer m",
    "tous droits", "sous licence", "de confidentialit", "mentions l", "conditions d", "se connecter", "abonnez-vous", "lire la suite",
)
RUNS = "[!?]{2,}"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 40


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _line(line: Column, symbols: Column, runs: Column, menus: Column, phrases: Column) -> Column:
    """What a line has: whether it has words and fails, and its characters in words if it fails.

    The flags tell whether the text has such characters or phrases at all; most texts have none, and nothing is looked for there.
    """
    zero = F.lit(0)
    n_symbols = F.when(symbols, _count(line, SYMBOLS)).otherwise(zero)
    n_runs = F.when(runs, F.size(F.regexp_extract_all(line, F.lit(RUNS), F.lit(0)))).otherwise(zero)
    n_menus = F.when(menus, _count(line, SEPARATORS)).otherwise(zero)
    marks = F.greatest(n_symbols * 10, n_runs * 10, n_menus * 5)
    fails = ((marks > 0) & (marks > F.size(_words(line)))) | (phrases & line.rlike(BOILERPLATE))
    counts = line.rlike(r"[^\x20\x09-\x0D]")
    return F.struct(line.alias("line"), counts.alias("counts"), F.when(counts & fails, F.length(F.regexp_replace(line, SPACE, "")).cast("long")).alias("lost"))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + value(x))


def judge(df: DataFrame, text: str = "text", out: str = "quality", *, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Add the struct column ``out`` with counts, verdict and cleaned text."""
    names = [c for c in df.columns if c != out]
    own = [f"c{i}" for i in range(len(names))]  # no name of the input can clash
    t = F.coalesce(F.col("_tl_text"), F.lit(""))
    cored = reduce(lambda a, b: a | b, (F.contains("_tl_low", F.lit(c)) for c in CORES))
    a = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)], F.col(f"`{text}`").alias("_tl_text"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_tl_low"))
    a = a.select(
        *own, _words(t).alias("_tl_w"), F.split(t, "\n").alias("_tl_l"), _count(t, SYMBOLS).cast("long").alias("_tl_s"),
        t.rlike(RUNS).alias("_tl_f"), t.rlike(SEPARATORS).alias("_tl_m"), cored.alias("_tl_b"),
    )
    w, n = F.col("_tl_w"), F.size("_tl_w")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    a = a.select(*own, "_tl_w", "_tl_s", F.transform("_tl_l", lambda x: _line(x, F.col("_tl_s") > 0, F.col("_tl_f"), F.col("_tl_m"), F.col("_tl_b"))).alias("_tl_l"), F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("_tl_h"))
    h = F.col("_tl_h")
    # Only a document that repeats a window has its windows sorted with their places.
    order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    a = a.select(*own, "_tl_w", "_tl_s", "_tl_l", F.when(F.size(F.array_distinct(h)) < F.size(h), order).alias("_tl_o"))
    o = F.col("_tl_o")
    same = lambda e, i, d: F.coalesce(F.get(o, i + d)["h"] == e["h"], F.lit(False))
    twice = F.filter(o, lambda e, i: same(e, i, 1) | ((i > 0) & same(e, F.greatest(i, F.lit(1)), -1)))
    places = F.sort_array(F.transform(twice, lambda e: e["i"]))
    a = a.select(*own, "_tl_w", "_tl_s", "_tl_l", F.when(o.isNotNull(), places).alias("_tl_p"))
    p, lines = F.col("_tl_p"), F.col("_tl_l")
    covered = _sum(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long")), lambda x: x)
    counted = F.filter(lines, lambda x: x["counts"])
    a = a.select(
        *own,
        F.size("_tl_w").cast("long").alias("_tl_n"),
        F.length(F.array_join("_tl_w", "")).cast("long").alias("_tl_c"),
        "_tl_s",
        (F.size(counted) - F.size(F.array_distinct(F.transform(counted, lambda x: x["line"])))).cast("long").alias("_tl_d"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("_tl_r"),
        _sum(lines, lambda x: F.coalesce(x["lost"], F.lit(0).cast("long"))).alias("_tl_x"),
        F.array_join(F.transform(F.filter(lines, lambda x: x["lost"].isNull()), lambda x: x["line"]), "\n").alias("_tl_t"),
    )
    c = {k: F.col(f"_tl_{k}") for k in "ncsdrxt"}
    bad = (c["n"] < min_words) | (c["r"] * 100 > c["n"] * max_repeat_percent)
    lost = c["x"] * 100 > c["c"] * max_lost_percent
    result = F.struct(
        c["n"].alias("n_words"), c["c"].alias("word_chars"), c["s"].alias("n_symbols"), c["d"].alias("n_dup_lines"), c["r"].alias("n_repeat_words"),
        bad.alias("base_failed"), (~bad & ~lost).alias("kept"), c["x"].alias("lost_chars"), c["t"].alias("clean_text"),
    )
    # The row number keeps the optimiser from copying the whole judgement into a filter on its outcome.
    return a.select(*[F.col(o).alias(c) for c, o in zip(names, own)], F.when(F.monotonically_increasing_id() >= 0, result).alias(out))


def clean(df: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """The documents that pass, their text without the failing lines."""
    out = "quality"
    while out in df.columns:
        out += "_"
    q = judge(df, text, out, **limits).filter(F.col(f"`{out}`.kept"))
    return q.select(*[F.col(f"`{out}`.clean_text").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(d).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")])


_SQL_SPACE = r"[\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
m AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM m) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
k AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             len(regexp_extract_all(line, '[#*$%&|<>]')) AS s, len(regexp_extract_all(line, '[!?]{{2,}}')) AS b,
             len(regexp_extract_all(line, '{SEPARATORS}')) AS p, regexp_matches(line, '{BOILERPLATE}') AS o,
             length(regexp_replace(line, '{_SQL_SPACE}', '', 'g')) AS c FROM l),
q AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup,
             sum(CASE WHEN s * 10 > n OR b * 10 > n OR p * 5 > n OR o THEN c ELSE 0 END) AS lost FROM k WHERE n > 0 GROUP BY doc_id),
z AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             coalesce(dup, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars
      FROM w LEFT JOIN q ON q.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept,
       CAST(lost_chars AS BIGINT) AS lost_chars
FROM z
"""
