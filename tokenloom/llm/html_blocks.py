"""HTML into leaf blocks: one linear pass, no tree (pure Python and numpy).

A leaf block is the text between two block-level tags, with the path of open
elements above it, all of them, however many.  Scripts, styles, the head, form controls with text and
other elements that aren't shown, comments and declarations give no text; a script or style
that isn't closed ends with the page, as in browsers, and of the others only the
tag is ignored then.  Closing tags without an opening one are ignored,
unclosed elements end with the page, a ``<`` that begins no tag is text.  The time
is linear in the page: paths are shared by their blocks, and tags that aren't open are not looked for.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

from .wordhash import text_buffers, word_hashes

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title select head".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SUBWORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
SPACE = re.compile(r"[ \t\n\r\f\v]+")
HEAD = re.compile(r"<body\b", re.I)
CLOSE = {tag: re.compile(rf"</{tag}\s*>" + ("" if tag == "head" else "?"), re.I) for tag in RAW}

PATH_DIMS, WORD_DIMS, NUMBERS = 64, 32, 12
DIMS = PATH_DIMS + WORD_DIMS + NUMBERS


class Path:
    """An open element with those above it."""

    __slots__ = ("element", "above", "depth", "_sum")

    def __init__(self, element: tuple, above: Path | None) -> None:
        self.element, self.above, self._sum = element, above, None
        self.depth = above.depth + 1 if above else 1

    def __iter__(self):
        """The elements from the inmost to the outmost."""
        p = self
        while p:
            yield p.element
            p = p.above

    def __eq__(self, other) -> bool:
        return isinstance(other, Path) and self.depth == other.depth and all(a == b for a, b in zip(self, other))

    __hash__ = None

    def sum(self) -> np.ndarray:
        """The sum of the elements' vectors, remembered by each path."""
        todo, p = [], self
        while p and p._sum is None:
            todo.append(p)
            p = p.above
        v = p._sum if p else np.zeros(PATH_DIMS, np.float32)
        for q in reversed(todo):
            v = q._sum = v + element_vectors(q.element)[0]
        return v


@dataclass
class Block:
    text: str
    path: Path | None
    linked: int
    label: int | None = None


def _element(tag: str, attributes: str) -> tuple:
    """A path element: its tag and the words of its class, id, role and label."""
    words = [tag]
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            words += [f".{w.lower()}" for w in SUBWORD.findall(m[2] or m[3] or m[4] or "") if len(w) > 1]
    return tuple(words)


def blocks(page: str, labels: bool = False) -> list[Block]:
    """The leaf blocks with text of a page, in order; with ``labels``, comments ``=N`` are labels of a training page."""
    out: list[Block] = []
    stack: list[Path] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    label: int | None = None
    at, end = 0, len(page)
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).replace("\xa0", " ").strip()
            text = SPACE.sub(" ", text)
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text)), label))
            parts.clear()
        linked = 0

    def close(i: int) -> None:
        for e in stack[i:]:
            open_[e.element[0]] -= 1
        del stack[i:]

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            t = page[at : m.start()]
            parts.append(t)
            if open_["a"]:
                linked += len(t)
        at = m.end()
        tag = m[3]
        if tag is None:
            if labels and m[1] is not None and m[1][:1] == "=":
                flush()
                label = int(m[1][1:])
            continue
        tag = tag.lower()
        if m[2]:
            if tag not in INLINE:
                flush()
            if open_[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].element[0] == tag))
            continue
        if tag not in INLINE:
            flush()
        if tag in RAW:
            if tag == "head":
                b, done = (x.search(page, at) if tag not in unclosed else None for x in (HEAD, CLOSE["head"]))
                if b is None and done is None:
                    unclosed.add(tag)
                    continue
                at = min(x for x in (b and b.start(), done and done.end()) if x is not None)
                continue
            if m[0].endswith("/>"):
                continue
            done = CLOSE[tag].search(page, at) if tag not in unclosed else None
            if done is not None:
                at = done.end()
            elif tag in ("script", "style"):
                at = end
            else:
                unclosed.add(tag)
            continue
        if tag in VOID or m[0].endswith("/>"):
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1) if open_["p"] else ():
                if stack[i].element[0] == "p":
                    close(i)
                    break
                if stack[i].element[0] not in INLINE:
                    break
        elif tag in ("li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1].element[0] == tag:
            close(len(stack) - 1)
        stack.append(Path(_element(tag, m[4]), stack[-1] if stack else None))
        open_[tag] += 1
    flush()
    return out


_elements: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def element_vectors(element: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Hashed vectors of an element: as any one of a path, and as its last."""
    v = _elements.get(element)
    if v is None:
        if len(_elements) > 20_000:
            _elements.clear()
        v = np.zeros(PATH_DIMS, np.float32), np.zeros(PATH_DIMS, np.float32)
        for w in element:
            for x, mark in zip(v, ("", "$")):
                h = zlib.crc32((mark + w).encode())
                x[h % PATH_DIMS] += 1 if h & 1 << 20 else -1
        _elements[element] = v
    return v


def path_vector(path: Path | None) -> np.ndarray:
    """A hashed vector of a tag path: its elements anywhere, and the last element by itself."""
    if path is None:
        return np.zeros(PATH_DIMS, np.float32)
    return np.clip(path.sum() + element_vectors(path.element)[1], -3, 3)


def vectors(found: list[Block]) -> np.ndarray:
    """One row of DIMS numbers for each block."""
    import pyarrow as pa

    n = len(found)
    x = np.zeros((n, DIMS), np.float32)
    if not n:
        return x
    data, offsets = text_buffers(pa.array([b.text for b in found], pa.large_string()))
    h, at = word_hashes(data, offsets, True)
    words = np.diff(at)
    row = np.repeat(np.arange(n), words)
    hist = np.bincount(row * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64), minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    x[:, :PATH_DIMS] = np.stack([path_vector(b.path) for b in found])
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.minimum(hist / np.sqrt(np.maximum(words, 1))[:, None], 1)
    size = np.array([len(b.text) for b in found], np.float32)
    z = x[:, PATH_DIMS + WORD_DIMS :]
    z[:, 0] = np.log1p(words) / 3
    z[:, 1] = np.log1p(size) / 5
    z[:, 2] = np.array([b.linked for b in found]) / size
    z[:, 3] = [b.text[-1] in ".!?…:;\"'”»)" for b in found]
    z[:, 4] = [min(1.0, b.text.count(".") / 5) for b in found]
    z[:, 5] = [min(1.0, b.text.count(",") / 5) for b in found]
    z[:, 6] = [("©" in b.text) or ("·" in b.text) for b in found]
    z[:, 7] = np.minimum([b.path.depth if b.path else 0 for b in found], 12) / 6
    z[:, 8] = [b.path.element[0] in ("h1", "h2", "h3") if b.path else False for b in found]
    z[:, 9] = words < 5
    z[:, 10] = words > 20
    z[:, 11] = [b.text[:1].isupper() for b in found]
    return x
