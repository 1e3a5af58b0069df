"""Chat formatting with typed content parts: DataFrame functions only.

A message has ``parts``, an array of structs (type, text, ref, units).  A
visitor flattens them in order: a text part gives its escaped text; an image,
audio or document part gives a placeholder ``<|type|>`` and an attachment
record (turn, part, type, ref, tokens), where tokens = units x the type's rate,
rounded up (units: image patches, seconds of audio, pages).

A turn is ``<s>[INST]role[/INST]content</s>``.  Control strings inside roles and
texts are escaped: their first character becomes ``&lt;`` or ``&lsb;``, and an
``&`` that already begins such an escape becomes ``&amp;``; reading back undoes
it exactly.  The spans of the contents of turns under the loss (those of the given
roles) come with the string, in its code points.

Defined results: null roles, texts and part arrays count as empty; an unknown
part type gives no output; turns with equal numbers are ordered by role, then
text, and repeated rows stay repeated turns; a null conversation id is a
conversation of its own; other columns are ignored, whatever their names; a very long text
is kept whole.  One conversation is one string, so it must fit a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, ROLE_END, END = "<s>[INST]", "[/INST]", "</s>"
MEDIA = {"image": 1.0, "audio": 25.0, "document": 512.0}
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", *(f"<|{m}|>" for m in MEDIA)]
_ESCAPE = {"<": "&lt;", "[": "&lsb;"}
PARTS = "array<struct<type:string,text:string,ref:string,units:double>>"


def escape(c: Column) -> Column:
    for e in ("&amp;", "&lt;", "&lsb;"):
        c = F.replace(c, F.lit(e), F.lit("&amp;" + e[1:]))
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(_ESCAPE[s[0]] + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in (("<", "&lt;"), ("[", "&lsb;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def visit(parts: Column) -> Column:
    """The flattened content of one message's parts."""
    one = F.lit("")

    def part(p: Column) -> Column:
        out = F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit(""))))
        return reduce(lambda w, m: w.when(p["type"] == m, F.lit(f"<|{m}|>")), MEDIA, out).otherwise(one)

    return F.coalesce(F.array_join(F.transform(parts, part), ""), F.lit(""))


def attachments(parts: Column) -> Column:
    """The attachment records of one message's parts, in order."""
    kept = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("part"), p.alias("p"))), lambda x: x["p"]["type"].isin(*MEDIA))

    def record(x: Column) -> Column:
        p = x["p"]
        rate = reduce(lambda w, m: w.when(p["type"] == m, F.lit(MEDIA[m])), list(MEDIA)[1:], F.when(p["type"] == "image", F.lit(MEDIA["image"])))
        return F.struct(x["part"].alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), F.ceil(F.coalesce(p["units"], F.lit(1.0)) * rate).alias("tokens"))

    return F.coalesce(F.transform(kept, record), F.array().cast("array<struct<part:int,type:string,ref:string,tokens:bigint>>"))


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a message."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("ref"), F.lit(None).cast("double").alias("units")))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted, attachments, loss_spans array<struct<start,length>>) of rows of messages."""
    t = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("content"), attachments(F.col(parts)).alias("media"))
    t = t.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(ROLE_END)))
    chars = (F.length("head") + F.length("content") + len(END)).cast("long")
    before = Window.partitionBy("conv").orderBy("turn", "role", "content", "media").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(chars).over(before), F.lit(0).cast("long")))
    g = t.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "role", "head", "content", "media"))).alias("m"))
    body = F.transform("m", lambda x: F.concat(x["head"], x["content"], F.lit(END)))
    media = F.flatten(F.transform("m", lambda x: F.transform(x["media"], lambda a: F.struct(x["turn"].alias("turn"), *[a[k].alias(k) for k in ("part", "type", "ref", "tokens")]))))
    said = F.filter("m", lambda x: x["role"].isin(*loss))
    spans = F.transform(said, lambda x: F.struct((x["at"] + F.length(x["head"])).alias("start"), F.length(x["content"]).cast("long").alias("length")))
    return g.select(F.col("conv").alias(conv), F.array_join(body, "").alias("formatted"), media.alias("attachments"), spans.alias("loss_spans"))


def under_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss, unescaped, cut out of the string by the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation without media."""
    pieces = F.split(formatted, r"</s>")
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        at = F.instr(x, ROLE_END)
        begin = len(TURN) + 1
        return F.struct(
            unescape(F.substr(x, F.lit(begin), at - begin)).alias("role"),
            unescape(F.substr(x, at + len(ROLE_END))).alias("text"),
        )

    return F.transform(turns, turn)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).selectExpr("explode(array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role))) AS x").selectExpr(
        "-1L AS conv_id", "x.turn AS turn", "x.role AS role", "'</s>[INST] ok [/INST]' AS text"
    )
    both = c.unionByName(probe).withColumn("parts", text_parts(F.col("text")))
    f = format_conversations(both).select("conv_id", "formatted", "loss_spans", "attachments", read_back(F.col("formatted")).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    f = f.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), said.alias("said"), under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), tokens.alias("attachment_tokens"),
    )
    return f.select(
        "conv_id", "n_turns", F.sha2(F.encode("said", "utf-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"), "formatted_chars", "n_attachments", "attachment_tokens",
    )


def _sql_escape(x: str) -> str:
    for e in ("&amp;", "&lt;", "&lsb;"):
        x = f"replace({x}, '{e}', '&amp;{e[1:]}')"
    for s in CONTROLS:
        x = f"replace({x}, '{s}', '{_ESCAPE[s[0]] + s[1:]}')"
    return x


_LINE = "role || chr(10) || text || chr(10)"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n, string_agg({_LINE}, '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(TURN + ROLE_END + END)}) AS chars
      FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM g
"""
