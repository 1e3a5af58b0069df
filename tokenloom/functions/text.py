"""Splitting and classification as column expressions; offsets are in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRE = r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[\x{00}-\x{08}\x{0E}-\x{1F}!-/:-@\[-`{-~\x{7F}]+"
WORD = r"[^\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The same in Java's syntax with printable ASCII first, which spares most characters the rest of the class.
WORD_FAST = r"[!-~" + WORD[:-1] + "]+"
#: What stands between them.
WHITE = "[" + WORD[2:]
BLANK = r"[^ \n\t\r]+"
BULK = r" ?[^ \n\t\r]+"
CLASSES = {
    "letter": r"[^A-Za-z\x{80}-\x{10FFFF}]+",
    "digit": r"[^0-9]+",
    "space": r"[^\x{09}-\x{0D} ]+",
    "punct": r"[^\x{00}-\x{08}\x{0E}-\x{1F}!-/:-@\[-`{-~\x{7F}]+",
}
LOW_LATENCY_BYTES = 4096


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """Runs between Unicode white space."""
    return _all(text, WORD_FAST)


def blank_words(text: Column) -> Column:
    """Runs between blank, line feed, tab and carriage return."""
    return _all(text, BLANK)


def bulk_words(text: Column) -> Column:
    """Those runs, with the blank right before each."""
    return _all(text, BULK)


def pretokens(text: Column) -> Column:
    """Longest runs of one byte class other than space."""
    return _all(text, PRE)


def class_bytes(text: Column, name: str) -> Column:
    """How many bytes of a text are of a class."""
    if name == "letter":  # all bytes that are of no other class: most of them, so the others are taken out
        return F.octet_length(text).cast("long") - sum((class_bytes(text, n) for n in CLASSES if n != "letter"), F.lit(0).cast("long"))
    return F.octet_length(F.regexp_replace(text, CLASSES[name], "")).cast("long")


def dispatch_target(text: Column, threads: int) -> Column:
    """Which path a text of this size takes."""
    return F.when(F.octet_length(text) < LOW_LATENCY_BYTES, "low_latency").otherwise("parallel" if threads > 1 else "sweep")


def chunk_size(n: Column, threads: int) -> Column:
    """Bytes of a work item for n bytes."""
    if threads <= 1:
        return F.greatest(n, F.lit(1).cast("long"))
    return F.when(n == 0, F.lit(1).cast("long")).otherwise(F.greatest(F.least(F.floor(n / (4 * threads)), F.lit(65536).cast("long")), F.lit(4096).cast("long")))


def unknown_id(ids: dict[str, int]) -> int:
    return next((ids[n] for n in ("<unk>", "[UNK]", "<|endoftext|>") if n in ids), 0)
