"""Whole-text token ids of a public byte-level BPE.

Special strings inside a text become their special ids, as they do by default
in the library of the vocabulary's ``.json`` file; tests hold the ids of the
two libraries against each other.

The split pattern looks ahead behind white space, and its engine fails on runs
of about a million blanks.  Long runs are therefore cut out before it, at the
very borders at which the pattern would cut: a run is one piece without its last
character, or whole where the text or a special string ends it.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

DEFAULT = "byte_bpe_50k"
LONG_RUN = 10_000
_RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")


def vocabulary(name: str = DEFAULT) -> tuple[str, str]:
    """Paths of the vocabulary's ``.json`` and ``.tiktoken`` files."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.special = tuple(special)
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for b, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.lengths[i] = len(b)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit numbers."""
        if len(text) <= LONG_RUN:
            return self._split(text)
        parts, at = [], 0
        for m in _RUNS.finditer(text):
            a, b = m.span()
            if b - a > LONG_RUN:
                if b < len(text) and not text.startswith(self.special, b):
                    b -= 1
                parts += [self._split(text[at:a]), np.array(self.core._encode_single_piece(text[a:b]), "<u4")]
                at = b
        return np.concatenate([*parts, self._split(text[at:])])

    def _split(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4")

    def byte_lengths(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes that each id stands for."""
        return self.lengths[ids]


_made: dict[tuple[str, str], Encoder] = {}


def encoder(json_path: str, ranks_path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    import public_tokenizers

    key = (json_path, ranks_path)
    if key not in _made:
        _made[key] = Encoder(json_path, ranks_path, public_tokenizers.PATTERN)
    return _made[key]
