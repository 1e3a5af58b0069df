"""A PySpark-native text tokenization and token-analytics engine."""

from .errors import EncodeError, SaveError, VocabularyError
from .ir import Vocabulary
from .tokenizer import Tokenizer

__all__ = ["EncodeError", "SaveError", "Tokenizer", "Vocabulary", "VocabularyError"]
