"""Exceptions of the engine; their bases are what callers of a tokenizer expect."""


class VocabularyError(ValueError):
    """A vocabulary file can't be read, or isn't one."""


class EncodeError(RuntimeError):
    """A text can't be encoded, as a word has no pieces and there is no unknown token."""


class SaveError(IOError):
    """A vocabulary can't be written."""
