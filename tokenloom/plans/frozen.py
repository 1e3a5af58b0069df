"""The fixed vocabularies of the catalogue's queries, and the same as SQL."""

from __future__ import annotations

import json
import struct

from ..ir import Vocabulary

BASE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,éèêç"
_PAIRS = (
    "t+h e+r o+n i+n e+n a+n t+i r+e h+e e+s l+e th+e a+t c+h o+u n+d o+r s+t e+a ti+on h+a e+d l+y in+g w+h b+le n+t s+h o+f c+i i+t a+s "
    "u+e an+d i+e en+t q+ue d+e t+o a+u i+s e+in m+ent u+n d+o o+s b+e a+i"
)
MERGES = tuple(tuple(p.split("+")) for p in _PAIRS.split())
OUTPUTS = [a + b for a, b in MERGES]
BPE = Vocabulary("Bpe", {t: i for i, t in enumerate(["<unk>", *BASE, *OUTPUTS])}, MERGES)
#: With whole words, some of them marked as coming after a blank, for the bulk path.
BULK = Vocabulary("Bpe", {**BPE.vocab, **{t: 200 + i for i, t in enumerate(["Ġthe", "Ġof", "Ġand", "that", "with", "Ġdes", "une", "Ġthatthe", "être"])}}, MERGES)
WORDPIECE = Vocabulary("WordPiece", {t: i for i, t in enumerate(["[UNK]", *BASE, *(f"##{c}" for c in BASE), *(x for o in OUTPUTS for x in (o, f"##{o}"))])}, prefix="##")
UNIGRAM = Vocabulary(
    "Unigram", BPE.vocab, scores=tuple([(c, -3.0) for c in BASE] + [(o, -(1 + r % 8 / 8)) for r, o in enumerate(OUTPUTS)])
)
#: A vocabulary of plain words, for trie queries.
TRIE = Vocabulary("Bpe", {t: i for i, t in enumerate(["he", "she", "his", "hers", "the", "then", "there", "thenthe", "of", "off", "on", "one", "in", "ing", "ion", "tion"])})


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    """A SQL table of literal rows."""
    lit = lambda x: "NULL" if x is None else quote(x) if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names}))"


def vocab_sql(v: Vocabulary) -> str:
    return values(v.vocab.items(), "token, token_id")


def chain_sql(marked: str) -> str:
    """The merges as nested replacements in a string whose symbols stand between the characters 1 and 2."""
    for a, b in MERGES:
        marked = f"replace({marked}, chr(1)||{quote(a)}||chr(2)||chr(1)||{quote(b)}||chr(2), chr(1)||{quote(a + b)}||chr(2))"
    return marked


#: Small files of each format, by name.
HF = json.dumps({"model": {"type": "BPE", "vocab": {"h": 0, "e": 1, "l": 2, "o": 3, "he": 4, "lo": 5, "helo": 6}, "merges": ["h e", ["l", "o"], "he lo"]}})
SP_JSON = json.dumps([{"piece": "<unk>", "score": 0.0}, {"piece": "hello", "score": -1.5}, {"piece": "lo", "score": -2.25}, {"piece": "hello", "score": -0.5}])
GGUF_JSON = json.dumps({"tokens": ["<pad>", "a", "b", "ab"], "scores": [0.0, -1.0], "merges": ["a b"]})
TIKTOKEN = "aA== 0\naQ== 1\naGk= 2\nw6k 3\n/w== 4\n_g== 5\n"


def sp_proto() -> bytes:
    """A binary model of the pieces a (-1), an empty one, and b (-2), with an unknown field."""

    def piece(s: bytes, score: float) -> bytes:
        body = b"\x0a" + bytes([len(s)]) + s + b"\x15" + struct.pack("<f", score)
        return b"\x0a" + bytes([len(body)]) + body

    return piece(b"a", -1.0) + b"\x10\x05" + piece(b"", -3.0) + piece(b"b", -2.0)


DETECT = [
    ("compiled", bytes([0x7F, 0x4F, 0x54, 0x4B, 1, 0, 0, 0])), ("gguf", b"GGUF\x03"), ("list_of_objects", b"[{}]"), ("list_of_strings", b'["a"]'), ("object", b'{"a":1}'), ("object_blank", b"{ }"), ("object_line", b"{\n}"),
    ("object_crlf", b"{\r\n}"), ("empty", b""), ("ranks", b"aA== 0\naQ== 1\n"), ("one_line", b"aA== 0"), ("two_blanks", b"a b c\n"), ("bom", b"\xef\xbb\xbf{}"),
]
