"""Encoders of one word or text, in plain Python: no Spark here.

Ids come first, merging second: an unknown symbol that falls back to the id of a
real token merges like that token.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable
from heapq import heapify, heappop, heappush

from .errors import EncodeError
from .ir import BPE_UNKNOWN, UNIGRAM_UNKNOWN, WORDPIECE_UNKNOWN, Vocabulary, f32

WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PRE = re.compile("[A-Za-z\x80-\U0010ffff]+|[0-9]+|[\x00-\x08\x0e-\x1f!-/:-@\\[-`{-~\x7f]+")
PRE_BYTES = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[\x00-\x08\x0e-\x1f!-/:-@\[-`{-~\x7f]+")
BLANK = re.compile("[^ \n\t\r]+")
MEMO = 200_000
MEMO_CHARS = 4_000_000
ADAPTIVE_BYTES = 4096
MODES = ("word", "pretoken", "bulk", "stream", "adaptive")


SHORT = 24


def merge_stepwise(ids: list[int], table: dict) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of several, one at a time.

    Long words keep their pairs in a heap by (rank, place) over linked symbols, so
    the time is n log n; for short ones a scan for the lowest rank is faster.
    """
    get = table.get
    if len(ids) <= SHORT:
        ids = list(ids)
        known = [get(p) for p in zip(ids, ids[1:])]
        while True:
            low, at = None, -1
            for i, r in enumerate(known):
                if r is not None and (low is None or r[0] < low):
                    low, at = r[0], i
            if low is None:
                return ids
            ids[at : at + 2] = [known[at][1]]
            known[at : at + 1] = []
            if at:
                known[at - 1] = get((ids[at - 1], ids[at]))
            if at < len(known):
                known[at] = get((ids[at], ids[at + 1]))
    n = len(ids)
    symbol: list[int | None] = list(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r[0], i, *p, r[1]) for i, p in enumerate(zip(ids, ids[1:])) if (r := get(p)) is not None]
    heapify(heap)
    while heap:
        _, i, a, b, merged = heappop(heap)
        j = after[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue  # one of the two has been merged meanwhile
        symbol[i], symbol[j] = merged, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get((merged, symbol[k]))) is not None:
                heappush(heap, (r[0], i, merged, symbol[k], r[1]))
        h = before[i]
        if h >= 0 and (r := get((symbol[h], merged))) is not None:
            heappush(heap, (r[0], h, symbol[h], merged, r[1]))
    return [x for x in symbol if x is not None]


def merge_sweep(ids: list[int], table: dict) -> list[int]:
    """In turn, merge every pair of the lowest rank there is, from the left and without overlap.

    A sweep costs the word's length, and there are as many as ranks that occur in it, however long it is.
    """
    ids, get = list(ids), table.get
    while len(ids) > 1:
        known = [get(p) for p in zip(ids, ids[1:])]
        low = min((r[0] for r in known if r is not None), default=None)
        if low is None:
            break
        out, i, last = [], 0, len(ids) - 1
        while i <= last:
            r = known[i] if i < last else None
            if r is not None and r[0] == low:
                out.append(r[1])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


STRATEGIES = {"stepwise": merge_stepwise, "block": merge_sweep}


def initial(word: str, v: Vocabulary) -> list[int]:
    """The id of each character; unknown ones get the first unknown token there is, else 0."""
    unk = v.unknown(BPE_UNKNOWN) or 0
    return [v.vocab.get(c, unk) for c in word]


def wordpiece(word: str, v: Vocabulary) -> list[int]:
    """Greedy longest pieces from the left; a word with a gap is one unknown token."""
    unk = v.unknown(WORDPIECE_UNKNOWN)
    prefix = "##" if v.prefix is None else v.prefix
    longest = _longest(v)
    out, at = [], 0
    while at < len(word):
        head = prefix if at else ""
        for end in range(min(len(word), at + longest), at, -1):
            if (i := v.vocab.get(head + word[at:end])) is not None:
                out.append(i)
                at = end
                break
        else:
            if unk is None:
                raise EncodeError(f"no pieces for {word!r} and no unknown token")
            return [unk]
    return out


def _longest(v: Vocabulary) -> int:
    n = v.__dict__.get("_longest")
    if n is None:
        n = v.__dict__["_longest"] = max(map(len, v.vocab), default=0)
    return n


def _byte_tokens(v: Vocabulary) -> dict[int, tuple[list[int], dict[bytes, tuple[int, float]]]]:
    """By first byte: the lengths of its tokens, and (id, score) of each."""
    t = v.__dict__.get("_bytes")
    if t is None:
        t = {}
        for token, i in sorted(((s.encode(), i) for s, i in v.vocab.items() if s), key=lambda x: len(x[0])):
            t.setdefault(token[0], []).append((len(token), token, i, f32(v.score_of.get(token.decode(), -10.0))))
        t = v.__dict__["_bytes"] = {first: _trie(tokens) for first, tokens in t.items()}
    return t


def _trie(tokens: list[tuple[int, bytes, int, float]]) -> tuple[list, dict]:
    """(lengths there are, {bytes: (id, score)}) of tokens of one first byte."""
    return sorted({n for n, *_ in tokens}), {b: (i, s) for _, b, i, s in tokens}


_round = struct.Struct("f")


def unigram(word: str, v: Vocabulary) -> list[int]:
    """Best path over bytes in 32-bit sums; a tie keeps the earlier start, an unknown byte costs 10."""
    raw = word.encode()
    n = len(raw)
    tokens = _byte_tokens(v)
    unk = v.unknown(UNIGRAM_UNKNOWN)
    best: list = [None] * (n + 1)
    back: list = [None] * (n + 1)
    best[0] = 0.0
    pack, unpack = _round.pack, _round.unpack
    for i in range(n):
        at = best[i]
        if at is None:
            continue
        lengths, known = tokens.get(raw[i], ((), {}))
        some = False
        for k in lengths:
            e = i + k
            if e > n:
                break
            hit = known.get(raw[i:e])
            if hit is not None:
                some = True
                s = unpack(pack(at + hit[1]))[0]
                if best[e] is None or s > best[e]:
                    best[e], back[e] = s, (i, hit[0])
        if not some and unk is not None:
            s, e = unpack(pack(at - 10.0))[0], i + 1
            if best[e] is None or s > best[e]:
                best[e], back[e] = s, (i, unk)
    if best[n] is None:
        if unk is None:
            raise EncodeError(f"no path for {word!r} and no unknown token")
        return [unk]
    out = []
    while n:
        n, ident = back[n]
        out.append(ident)
    return out[::-1]


class Encoder:
    """``encode(text)`` in one mode, with a memo of words that belongs to this vocabulary and is bounded."""

    def __init__(self, v: Vocabulary, mode: str = "word", strategy: str = "stepwise") -> None:
        if mode not in MODES or strategy not in STRATEGIES:
            raise ValueError(f"mode: one of {MODES}; strategy: one of {tuple(STRATEGIES)}")
        self.v, self.mode = v, mode
        self.merge = STRATEGIES["block" if mode == "stream" else strategy]
        self.pieces: dict[str, list[int]] = {}
        self.hits: dict[str, tuple[int, bool]] = {}
        self.piece_chars = self.hit_chars = 0
        self._forget()

    def _forget(self) -> None:
        """An empty memo: the place of each word or piece, and the ids of all one after another."""
        self.words: dict[str, int] = {}
        self.places: dict[str, int] = {}
        self.starts, self.sizes, self.pool = array("q"), array("q"), array("q")
        self.chars = 0

    def _make_room(self) -> None:
        """Forgets all once there are ``MEMO`` words, or long ones: a word has as many ids as bytes at most, but any length."""
        if len(self.sizes) >= MEMO or self.chars + len(self.pool) >= MEMO_CHARS:
            self._forget()

    def _piece_ids(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= MEMO or self.piece_chars >= MEMO_CHARS:
                self.pieces.clear()
                self.piece_chars = 0
            ids = self.pieces[piece] = self._piece(piece)
            self.piece_chars += len(piece) + len(ids)
        return ids

    def _learn(self, memo: dict[str, int], word: str, make: Callable[[str], list[int]]) -> int:
        ids = make(word)
        self.chars += len(word)
        self.starts.append(len(self.pool))
        self.sizes.append(len(ids))
        self.pool.extend(ids)
        memo[word] = len(self.sizes) - 1
        return memo[word]

    def _word(self, word: str) -> list[int]:
        if self.v.algo == "WordPiece":
            return wordpiece(word, self.v)
        if self.v.algo == "Unigram":
            return unigram(word, self.v)
        return self.merge(initial(word, self.v), self.v.id_merges)

    def _piece(self, piece: str) -> list[int]:
        table = self.v.byte_table
        return self.merge([table[b] for b in piece.encode()], self.v.id_merges)

    def _bulk(self, key: str) -> list[int]:
        """Ids of a word; a leading blank in the key tells that one comes before it in the text."""
        word = key[1:] if key[0] == " " else key
        hit = self.hit(key)
        if hit is not None:
            return [hit]
        return [i for p in PRE.findall(word) for i in self._piece_ids(p)]

    def hit(self, key: str) -> int | None:
        """The one id of a whole word, if it has one."""
        short, vocab = self.v.short_words, self.v.vocab
        word = key[1:] if key[0] == " " else key
        for table, k in ((short, key), (short, word), (vocab, key), (vocab, word)):
            if k in table:
                return table[k]
        return None

    def _split(self, text: str):
        """(words, their memo, what encodes one) of a text."""
        mode = self.mode
        if mode == "adaptive":
            mode = "pretoken" if len(text.encode()) >= ADAPTIVE_BYTES else "word"
        if self.v.algo != "Bpe" and mode != "bulk":
            mode = "word"  # the other algorithms have one split
        if mode == "pretoken":
            return PRE.findall(text), self.places, self._piece
        if mode == "bulk":
            return bulk_words(text), self.words, self._bulk
        return (BLANK if mode == "stream" else WORD).findall(text), self.words, self._word

    def encode(self, text: str) -> list[int]:
        self._make_room()
        split, memo, make = self._split(text)
        starts, sizes, pool = self.starts, self.sizes, self.pool
        out: list[int] = []
        for w in split:
            k = memo.get(w)
            if k is None:
                k = self._learn(memo, w, make)
            out += pool[starts[k] : starts[k] + sizes[k]]
        return out

    def _places(self, texts: list[str | None], skip_errors: bool = False) -> tuple[list[int], list[int], list[bool]]:
        """(the memo's place of every word of all texts, where each text's words begin, which texts have ids): each distinct word is encoded once."""
        self._make_room()
        words: list[int] = []
        ends, good = [0], []
        for t in texts:
            ok = t is not None
            if ok:
                split, memo, make = self._split(t)
                found = list(map(memo.get, split))
                if None in found:
                    try:
                        found = [self._learn(memo, w, make) if (k := memo.get(w)) is None else k for w in split]
                    except EncodeError:
                        if not skip_errors:
                            raise
                        ok, found = False, []
                words += found
            ends.append(len(words))
            good.append(ok)
        return words, ends, good

    def _gather(self, at):
        """(ids of the words at these places one after another, where each word's begin) as numpy arrays."""
        import numpy as np

        starts, sizes, pool = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (self.starts, self.sizes, self.pool))
        size = sizes[at]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = pool[np.repeat(starts[at] - total[:-1], size) + np.arange(total[-1])] if len(at) else pool[:0].copy()
        return ids, total

    def encode_all(self, texts: list[str | None], skip_errors: bool = False):
        """(ids one after another, where each text's begin, which texts have ids) as numpy arrays."""
        import numpy as np

        words, ends, good = self._places(texts, skip_errors)
        ids, total = self._gather(np.array(words, np.int64))
        return ids, total[np.array(ends)], np.array(good, bool)

    def count_all(self, texts: list[str | None]):
        """(ids there are in all texts, how many times each) as numpy arrays; only the ids of distinct words are laid out."""
        import numpy as np

        at, times = np.unique(np.array(self._places(texts)[0], np.int64), return_counts=True)
        ids, total = self._gather(at)
        known, place = np.unique(ids, return_inverse=True)
        n = np.zeros(len(known), np.int64)
        np.add.at(n, place, np.repeat(times, np.diff(total)))
        return known, n

    def stats(self, text: str) -> tuple[int, int, int, int, int, int]:
        """total bytes, words, fast words, fast bytes, fallback words, fallback bytes of the bulk mode."""
        words = bulk_words(text)
        if len(self.hits) >= MEMO or self.hit_chars >= MEMO_CHARS:
            self.hits.clear()
            self.hit_chars = 0
        known = self.hits
        fast = fast_bytes = slow_bytes = 0
        for k in words:
            h = known.get(k)
            if h is None:
                h = known[k] = len(k.encode()) - (k[0] == " "), self.hit(k) is not None
                self.hit_chars += len(k)
            if h[1]:
                fast += 1
                fast_bytes += h[0]
            else:
                slow_bytes += h[0]
        return len(text.encode()), len(words), fast, fast_bytes, len(words) - fast, slow_bytes


_BULK = re.compile(" ?[^ \n\t\r]+")


def bulk_words(text: str) -> list[str]:
    """Words between the four blanks, with the blank 0x20 right before them if there is one."""
    return _BULK.findall(text)


class StreamEncoder:
    """Feed bytes in any pieces, get the ids of finished words; ``finish`` ends the last word."""

    def __init__(self, v: Vocabulary, pending: bytes = b"") -> None:
        self.encoder, self.pending = Encoder(v, "stream"), pending

    def _ids(self, word: bytes) -> list[int]:
        try:
            text = word.decode()
        except UnicodeDecodeError:
            return []
        return self.encoder.encode(text) if text else []

    def feed(self, chunk: bytes) -> list[int]:
        *words, self.pending = re.split(rb"[ \n\t\r]", self.pending + chunk)
        return [i for w in words for i in self._ids(w)]

    def finish(self) -> list[int]:
        word, self.pending = self.pending, b""
        return self._ids(word)

    def reset(self) -> None:
        self.pending = b""


def pretoken_spans(texts: list[bytes]):
    """(starts, ends, where each text's spans begin) of ``PRE_BYTES`` in all texts, as numpy arrays; offsets are a text's own."""
    import numpy as np

    classes = np.zeros(256, np.uint8)
    for k, pattern in enumerate((rb"[A-Za-z\x80-\xff]", rb"[0-9]", rb"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-~\x7f]"), 1):
        classes[[b for b in range(256) if re.fullmatch(pattern, bytes([b]))]] = k
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])  # with a blank behind each, so no span reaches over two
    c = classes[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)]
    turn = np.flatnonzero(c[1:] != c[:-1])
    starts, ends = turn[c[turn + 1] != 0], turn[c[turn] != 0]
    begins = np.searchsorted(starts, firsts)
    own = np.repeat(firsts[:-1], np.diff(begins))
    return starts - own, ends - own, begins


def utf8_chunks(raw: bytes, n: int) -> list[tuple[int, int]]:
    """About n byte ranges of equal size, each end moved right to a character's border."""
    size = len(raw)
    if not size or n <= 1:
        return [(0, size)]
    step, out, a = -(-size // n), [], 0
    while a < size:
        b = min(a + step, size)
        while b < size and raw[b] & 0xC0 == 0x80:
            b += 1
        out.append((a, b))
        a = b
    return out


def chunk_target(size: int, chunk_kb: int | None = None, threads: int = 1) -> int:
    """Bytes aimed at for a chunk that ends at a blank."""
    return max(chunk_kb * 1024, 4096) if chunk_kb is not None else max(size // max(4 * threads, 8), 4096)


_STOP = re.compile(rb"[ \n\t\r]")


def blank_chunks(raw: bytes, target: int) -> list[tuple[int, int]]:
    """Byte ranges of at least ``target`` bytes that end behind one of the four blanks."""
    out, a = [], 0
    while a < len(raw):
        m = _STOP.search(raw, a + target) if a + target < len(raw) else None
        b = m.end() if m else len(raw)
        out.append((a, b))
        a = b
    return out
