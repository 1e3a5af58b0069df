"""The tokenizer object: load a vocabulary, encode one text, a list, or a column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .ir import Vocabulary
from .kernels import Encoder, StreamEncoder
from .operators import encode as E
from .sources import vocabularies


class Tokenizer:
    """``ValueError`` on loading, ``RuntimeError`` on encoding, ``IOError`` on saving."""

    def __init__(self, vocabulary: Vocabulary, mode: str = "adaptive") -> None:
        self.vocabulary, self.mode = vocabulary.validate(), mode
        self._encoder = Encoder(vocabulary, mode)

    @classmethod
    def load(cls, path: str, format: str | None = None, mode: str = "adaptive", spark: SparkSession | None = None) -> Tokenizer:
        return cls(vocabularies.load(path, format, spark), mode)

    def encode(self, text: str) -> list[int]:
        return self._encoder.encode(text)

    def encode_batch(self, texts: Iterable[str]) -> list[list[int]]:
        return [self.encode(t) for t in texts]

    def transform(self, df: DataFrame, text: str = "text", out: str = "ids", **how) -> DataFrame:
        return E.encode(df, self.vocabulary, text, out, **({"mode": self.mode} | how))

    def stream(self) -> StreamEncoder:
        return StreamEncoder(self.vocabulary)

    def save(self, path: str) -> None:
        vocabularies.save(self.vocabulary, path)

    def __len__(self) -> int:
        return len(self.vocabulary)
