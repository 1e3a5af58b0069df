"""The vocabulary: plain Python on the driver, small tables for plans."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .errors import VocabularyError

VOCAB = "token string, token_id long"
MERGES = "rank long, left string, right string"
SCORES = "ord long, token string, score float"
ALGORITHMS = ("Bpe", "WordPiece", "Unigram")
BPE_UNKNOWN = ("<unk>", "[UNK]", "<|endoftext|>")
WORDPIECE_UNKNOWN = ("[UNK]", "<unk>")
UNIGRAM_UNKNOWN = ("<unk>", "[UNK]")


def f32(x: float) -> float:
    """The nearest 32-bit float."""
    return struct.unpack("<f", struct.pack("<f", x))[0]


@dataclass(frozen=True)
class Vocabulary:
    algo: str
    vocab: dict[str, int]
    merges: tuple[tuple[str, str], ...] = ()
    scores: tuple[tuple[str, float], ...] = ()
    prefix: str | None = None

    def validate(self) -> Vocabulary:
        """Raise unless the algorithm is known, ids are 32-bit and every scored token has an id."""
        if self.algo not in ALGORITHMS:
            raise VocabularyError(f"unknown algorithm: {self.algo}")
        for t, i in self.vocab.items():
            if not isinstance(i, int) or not 0 <= i < 2**32:
                raise VocabularyError(f"token {t!r} has no 32-bit id: {i!r}")
        for t, _ in self.scores:
            if t not in self.vocab:
                raise VocabularyError(f"scored token {t!r} is not in the vocabulary")
        return self

    def __len__(self) -> int:
        return len(self.vocab)

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        """Pair -> rank; a pair that comes twice keeps the later rank."""
        return {m: r for r, m in enumerate(self.merges)}

    @cached_property
    def id_merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left id, right id) -> (rank, merged id), without rules of which a part or the result has no id."""
        v = self.vocab
        return {(v[a], v[b]): (r, v[a + b]) for (a, b), r in self.ranks.items() if a in v and b in v and a + b in v}

    @cached_property
    def score_of(self) -> dict[str, float]:
        return {t: f32(s) for t, s in self.scores}

    def unknown(self, names: tuple[str, ...]) -> int | None:
        return next((self.vocab[n] for n in names if n in self.vocab), None)

    @cached_property
    def byte_table(self) -> list[int]:
        """Id of each byte: only bytes below 128 can be tokens."""
        unk = self.unknown(BPE_UNKNOWN) or 0
        return [self.vocab.get(chr(b), unk) if b < 128 else unk for b in range(256)]

    @cached_property
    def short_words(self) -> dict[str, int]:
        """Tokens of 1 to 8 bytes, and those with U+0120 read as a blank; raw tokens first, then the lowest id."""
        out: dict[str, int] = {}
        for raw in (False, True):
            for t, i in sorted(self.vocab.items(), key=lambda x: -x[1]):
                key = t if raw else t.replace("Ġ", " ")
                if (raw or key != t) and 1 <= len(key.encode()) <= 8:
                    out[key] = i
        return out

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The vocabulary as small tables."""
        return {
            "vocab": spark.createDataFrame(list(self.vocab.items()), VOCAB),
            "merges": spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(self.merges)], MERGES),
            "scores": spark.createDataFrame([(i, t, float(s)) for i, (t, s) in enumerate(self.scores)], SCORES),
        }
