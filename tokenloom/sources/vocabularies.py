"""Vocabulary files: detection, loaders, and the compiled form.

A vocabulary is one small file, so it is read and decoded on the driver; plans
get it as tables or as a broadcast.
"""

from __future__ import annotations

import base64
import functools
import json
import struct
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import SaveError, VocabularyError
from ..ir import Vocabulary

COMPILED = bytes([0x7F, 0x4F, 0x54, 0x4B])
VERSION = 1
KINDS = ("compiled", "gguf", "sentencepiece_json", "hf_json", "tiktoken", "unknown")


def read_file(path: str, spark: SparkSession | None = None) -> bytes:
    """A whole file: through Spark's file systems if a session is given, else a local path."""
    if spark is not None:
        rows = spark.read.format("binaryFile").load(path).select("content").take(2)
        if len(rows) != 1:
            raise VocabularyError(f"not one file: {path}")
        return bytes(rows[0][0])
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise VocabularyError(f"cannot read {path}: {e}") from e


def detect(content: bytes) -> str:
    """The kind of a vocabulary file by its first bytes; nothing is trimmed."""
    if content.startswith(COMPILED):
        return "compiled"
    if content.startswith(b"GGUF"):
        return "gguf"
    if content[:2] in (b"[{", b'["'):
        return "sentencepiece_json"
    if content[:2] in (b'{"', b"{ ", b"{\n"):
        return "hf_json"
    line, newline, _ = content.partition(b"\n")
    return "tiktoken" if newline and line.count(b" ") == 1 else "unknown"


def detect_column(content: Column) -> Column:
    """``detect`` for a binary column, by built-in functions."""
    h = F.hex(content)
    first = F.substring_index(F.regexp_replace(h, "(..)", "$1,"), "0A,", 1)
    blanks = F.size(F.filter(F.split(first, ","), lambda b: b == "20"))
    newline = F.array_contains(F.split(F.regexp_replace(h, "(..)", "$1,"), ","), "0A")
    two = F.substring(h, 1, 4)
    return (
        F.when(h.startswith(COMPILED.hex().upper()), "compiled")
        .when(h.startswith(b"GGUF".hex().upper()), "gguf")
        .when(two.isin("5B7B", "5B22"), "sentencepiece_json")
        .when(two.isin("7B22", "7B20", "7B0A"), "hf_json")
        .when(newline & (blanks == 1), "tiktoken")
        .otherwise("unknown")
    )


def _json(content: bytes | str):
    try:
        return json.loads(content)
    except ValueError as e:
        raise VocabularyError(f"not JSON: {e}") from e


def _malformed(f):
    """``f``, with every error of a file of another shape as a VocabularyError."""

    @functools.wraps(f)
    def run(content):
        try:
            return f(content)
        except VocabularyError:
            raise
        except (TypeError, KeyError, ValueError, AttributeError, IndexError) as e:
            raise VocabularyError(f"malformed vocabulary: {e!r}") from e

    return run


@_malformed
def load_hf(content: bytes | str) -> Vocabulary:
    """A JSON file with ``model``: BPE, WordPiece or Unigram over a map of tokens."""
    root = _json(content)
    m = root.get("model") if isinstance(root, dict) else None
    if not isinstance(m, dict) or not isinstance(m.get("vocab"), dict):
        raise VocabularyError("model.vocab must be a map of tokens to ids")
    algo = {"BPE": "Bpe", "WordPiece": "WordPiece", "Unigram": "Unigram"}.get(m.get("type"))
    if algo is None:
        raise VocabularyError(f"unknown model type: {m.get('type')!r}")
    merges = []
    for r in m.get("merges") or [] if algo == "Bpe" else []:
        pair = tuple(r.split(" ", 1)) if isinstance(r, str) else tuple(r)
        if len(pair) != 2:
            raise VocabularyError(f"not a pair: {r!r}")
        merges.append(pair)
    scores = tuple((t, float(s)) for t, s in m.get("vocab_scores") or []) if algo == "Unigram" else ()
    return Vocabulary(algo, dict(m["vocab"]), tuple(merges), scores, m.get("continuing_subword_prefix")).validate()


@_malformed
def load_sentencepiece_json(content: bytes | str) -> Vocabulary:
    """A list of {piece, score}: ids are places, the last of equal pieces wins."""
    root = _json(content)
    if not isinstance(root, list) or not all(isinstance(x, dict) and isinstance(x.get("piece"), str) and isinstance(x.get("score"), (int, float)) for x in root):
        raise VocabularyError("must be a list of objects with piece and score")
    return Vocabulary("Unigram", {x["piece"]: i for i, x in enumerate(root)}, (), tuple((x["piece"], float(x["score"])) for x in root)).validate()


@_malformed
def load_gguf_json(content: bytes | str) -> Vocabulary:
    """{tokens, scores, merges}: BPE if there are merges, else Unigram; a missing score is 0."""
    root = _json(content)
    if not isinstance(root, dict) or not isinstance(root.get("tokens"), list):
        raise VocabularyError("must have a list of tokens")
    given = root.get("scores") or []
    scores = tuple((t, float(given[i]) if i < len(given) else 0.0) for i, t in enumerate(root["tokens"]))
    merges = tuple(tuple(x.split(" ", 1)) for x in root.get("merges") or [] if " " in x)
    return Vocabulary("Bpe" if merges else "Unigram", {t: i for i, t in enumerate(root["tokens"])}, merges, scores).validate()


_URL = str.maketrans("-_", "+/")
_B64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def b64_decode(s: str) -> bytes:
    """Standard or URL-safe base64, padding optional; a single left-over character is dropped."""
    t = s.rstrip("=").translate(_URL)
    if bad := next((c for c in t if c not in _B64), None):
        raise VocabularyError(f"not base64: {bad!r}")
    t = t[: len(t) - (len(t) % 4 == 1)]
    return base64.b64decode(t + "=" * (-len(t) % 4))


def load_tiktoken(content: bytes | str, derive_merges: bool = False) -> Vocabulary:
    """Lines of base64 and rank; bytes that aren't UTF-8 become U+FFFD, the last of equal tokens wins.

    The format has no merges, so BPE over it gives single characters.
    ``derive_merges``, an extension of ours, adds for each token its split into
    two tokens of lowest greater rank.
    """
    vocab: dict[str, int] = {}
    for line in (content.decode() if isinstance(content, bytes) else content).splitlines():
        line = line.strip()
        if not line:
            continue
        token, _, rank = line.partition(" ")
        if not rank.strip().isdigit():
            raise VocabularyError(f"no rank: {line!r}")
        vocab[b64_decode(token).decode("utf-8", "replace")] = int(rank)
    merges = []
    if derive_merges:
        for t, _ in sorted(vocab.items(), key=lambda x: x[1]):
            splits = [(max(vocab[t[:k]], vocab[t[k:]]), k) for k in range(1, len(t)) if t[:k] in vocab and t[k:] in vocab]
            if splits:
                k = min(splits)[1]
                merges.append((t[:k], t[k:]))
    return Vocabulary("Bpe", vocab, tuple(merges)).validate()


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    """A little-endian base-128 number and the place behind it."""
    value = shift = 0
    while True:
        if shift >= 64 or at >= len(b):
            raise VocabularyError("bad varint")
        value |= (b[at] & 0x7F) << shift
        at += 1
        if b[at - 1] < 0x80:
            return value, at
        shift += 7


def _fields(b: bytes, strict: bool):
    """(field, wire type, value) of a protobuf message; lengths are clamped, a bad tag ends it unless strict."""
    at = 0
    while at < len(b):
        try:
            key, at = read_varint(b, at)
            kind = key & 7
            if kind == 0:
                value, at = read_varint(b, at)
            elif kind == 2:
                n, at = read_varint(b, at)
                value, at = b[at : at + n], min(at + n, len(b))
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
                value, at = b[at : at + n], min(at + n, len(b))
            else:
                raise VocabularyError("bad wire type")
        except VocabularyError:
            if strict:
                raise
            return
        yield key >> 3, kind, value


def load_sentencepiece_proto(content: bytes) -> Vocabulary:
    """Pieces of a binary model: field 1 holds (1: piece, 2: score); empty pieces take no id."""
    vocab: dict[str, int] = {}
    scores = []
    for number, kind, message in _fields(content, False):
        if (number, kind) != (1, 2):
            continue
        piece, score = "", 0.0
        for n, k, v in _fields(message, True):
            if (n, k) == (1, 2):
                piece = v.decode("utf-8", "replace")
            elif (n, k) == (2, 5) and len(v) == 4:
                score = struct.unpack("<f", v)[0]
        if piece:
            vocab[piece] = len(scores)
            scores.append((piece, score))
    if not scores:
        raise VocabularyError("no pieces")
    return Vocabulary("Unigram", vocab, (), tuple(scores)).validate()


@_malformed
def load_compiled(content: bytes) -> Vocabulary:
    """Magic, version 1 as a little-endian 32-bit number, JSON."""
    if len(content) < 8:
        raise VocabularyError("invalid format: too short")
    if content[:4] != COMPILED:
        raise VocabularyError("invalid format")
    if (version := struct.unpack("<I", content[4:8])[0]) != VERSION:
        raise VocabularyError(f"unsupported version: {version}")
    d = _json(content[8:])
    merges = sorted(d["merge_rules"], key=lambda m: m["rank"])
    return Vocabulary(d["algo"], d["vocab"], tuple((m["left"], m["right"]) for m in merges), tuple((s["token"], s["score"]) for s in d["unigram_scores"]), d["continuation_prefix"]).validate()


def compile_vocabulary(v: Vocabulary) -> bytes:
    d = {
        "algo": v.algo, "vocab": v.vocab, "merge_rules": [{"left": a, "right": b, "rank": r} for r, (a, b) in enumerate(v.merges)],
        "unigram_scores": [{"token": t, "score": s} for t, s in v.scores], "continuation_prefix": v.prefix,
    }
    return COMPILED + struct.pack("<I", VERSION) + json.dumps(d, ensure_ascii=False).encode()


def save(v: Vocabulary, path: str) -> None:
    try:
        with open(path, "wb") as f:
            f.write(compile_vocabulary(v))
    except OSError as e:
        raise SaveError(f"cannot write {path}: {e}") from e


LOADERS: dict[str, Callable[[bytes], Vocabulary]] = {
    "compiled": load_compiled, "hf_json": load_hf, "sentencepiece_json": load_sentencepiece_json, "tiktoken": load_tiktoken,
    "gguf_json": load_gguf_json, "sentencepiece_proto": load_sentencepiece_proto,
}


def load(path: str, format: str | None = None, spark: SparkSession | None = None) -> Vocabulary:
    """A vocabulary file of a given format, or of the one its first bytes tell."""
    content = read_file(path, spark)
    kind = format or detect(content)
    if kind not in LOADERS:
        raise VocabularyError(f"no loader for {kind}: {path}")
    return LOADERS[kind](content)
