"""Main-text extraction by a recurrent block labeller.

A bidirectional LSTM in numpy reads, for each page, the sequence of its leaf
blocks as vectors (hashed tag path, hashed words, a few numbers) and labels every
block as main text or not, seeing the whole page in both directions.  It is
trained here, on pages that a seeded generator builds with known labels;
``PAGES`` bounds them.  Kept blocks are joined in page order by one space.

Defined results: a null or empty page has the text "" and no block; a page
without markup is one block; pages are read whole, whatever their length; repeated rows give repeated
results; an empty table gives no rows; other columns are kept by ``extract``.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .html_blocks import DIMS, blocks, vectors

HIDDEN = 16
PAGES = 2000
EPOCHS = 6


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Parameters and passes of the network; sequences are (time, page, dims) with a mask."""

    def __init__(self, seed: int = 5, dims: int = DIMS, hidden: int = HIDDEN) -> None:
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"W{d}"] = r.normal(0, 1 / np.sqrt(dims), (dims, 4 * hidden)).astype(np.float32)
            self.p[f"U{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"B{d}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"B{d}"][hidden : 2 * hidden] = 1
        self.p["V"] = r.normal(0, 0.3, (2 * hidden + dims,)).astype(np.float32) * 0.3
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x, mask, d, keep=False):
        steps, pages, _ = x.shape
        n = self.h
        xw = x @ self.p[f"W{d}"] + self.p[f"B{d}"]
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        out = np.zeros((steps, pages, n), np.float32)
        saved = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            m = mask[t][:, None]
            z = xw[t] + h @ self.p[f"U{d}"]
            i, f, o = (_sigmoid(z[:, k * n : (k + 1) * n]) for k in range(3))
            g = np.tanh(z[:, 3 * n :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                saved.append((t, h, c, i, f, o, g, tc))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        return out, saved

    def scores(self, x, mask):
        a, _ = self._run(x, mask, "f")
        b, _ = self._run(x, mask, "b")
        return np.concatenate((a, b, x), 2) @ self.p["V"] + self.p["c"]

    def gradients(self, x, mask, y):
        a, sa = self._run(x, mask, "f", True)
        b, sb = self._run(x, mask, "b", True)
        both = np.concatenate((a, b, x), 2)
        dz = (_sigmoid(both @ self.p["V"] + self.p["c"]) - y) * mask / mask.sum()
        g = {"V": np.einsum("tb,tbk->k", dz, both), "c": np.array([dz.sum()], np.float32)}
        n = self.h
        for d, saved, part in (("f", sa, slice(0, n)), ("b", sb, slice(n, 2 * n))):
            dout = dz[:, :, None] * self.p["V"][part]
            dxw = np.zeros((*x.shape[:2], 4 * n), np.float32)
            du = np.zeros_like(self.p[f"U{d}"])
            dh, dc = np.zeros(a.shape[1:], np.float32), np.zeros(a.shape[1:], np.float32)
            for t, h, c, i, f, o, gg, tc in reversed(saved):
                m = mask[t][:, None]
                dh = dh + dout[t]
                dhn, dcn = dh * m, dc * m
                do = dhn * tc
                dcn = dcn + dhn * o * (1 - tc * tc)
                q = np.concatenate((dcn * gg * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - gg * gg)), 1)
                dxw[t] = q
                du += h.T @ q
                dh = dh * (1 - m) + q @ self.p[f"U{d}"].T
                dc = dc * (1 - m) + dcn * f
            g[f"W{d}"] = np.einsum("tbd,tbk->dk", x, dxw, optimize=True)
            g[f"U{d}"] = du
            g[f"B{d}"] = dxw.sum((0, 1))
        return g

    def label(self, sequences: list[np.ndarray], most: int = 1 << 15) -> list[np.ndarray]:
        """A score for each block of each page; pages of like length go together, padded size bounded by ``most``."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(sequences)
        order = [i for i in sorted(range(len(sequences)), key=lambda i: len(sequences[i])) if len(sequences[i])]
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * len(sequences[order[b]]) <= most:
                b += 1
            x, mask = pad([sequences[i] for i in order[a:b]])
            s = self.scores(x, mask)
            for k, i in enumerate(order[a:b]):
                out[i] = s[: len(sequences[i]), k]
            a = b
        return out


def pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, sequences))
    x = np.zeros((steps, len(sequences), sequences[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(sequences)), np.float32)
    for k, s in enumerate(sequences):
        x[: len(s), k] = s
        mask[: len(s), k] = 1
    return x, mask


_SYLLABLES = "an the er ion re ti on es st ou in ed ly th or ing ent ver che lan ich ung sch que eau ment os ció aux é ü ñ ra be to mi".split()
_MENU = "home news about contact login shop blog sport help search menu products services team careers".split()
_KEEP_CLASS = ["content", "article-body", "post", "entry-content", "story", "main-text", "body", "post-content", "text", "article__text", ""]


def training_page(r: random.Random) -> str:
    """A page with labels (``<!--=1-->``: main text follows, ``<!--=0-->``: it doesn't)."""
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3))))
    noise = r.choice(["", "", "", "", "###", "&amp;&amp;&amp;", "%%%", " |", " |", "!!"])

    same = r.random() < 0.12  # a page of repeated words

    def sentence(n: int) -> str:
        if same and r.random() < 0.6:
            return " ".join([word() + r.choice(("", ",", "."))] * r.randint(5, 60)) + r.choice(("", "."))
        w = [word() + (noise if r.random() < 0.7 else "") for _ in range(n)]
        if noise == "!!":
            w = [x.upper() for x in w]
        w[0] = w[0][:1].upper() + w[0][1:]
        if n > 6 and r.random() < 0.6:
            w[n // 2] += ","
        return " ".join(w) + "."

    def text(lo: int, hi: int) -> str:
        s = " ".join(sentence(r.randint(3, 16)) for _ in range(r.randint(lo, hi)))
        if r.random() < 0.25:
            s = s.replace(" ", " <a href='#'>", 1).replace(".", "</a>.", 1) if r.random() < 0.5 else f"<b>{s}</b>"
        return s

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{r.choice(_MENU).title() if r.random() < 0.3 else word()}</a></li>' for _ in range(n))

    hashed = f"css-{r.randrange(16**5):x}"
    cls = lambda *names: (f' class="{r.choice(names) if r.random() < 0.9 else hashed}"')
    short = lambda: r.choice([text(1, 1), text(1, 3), word().title(), f"{word()} {word()}".title()])
    boiler = {
        "nav": lambda: f"<nav{cls('menu', 'navbar', 'main-nav', 'nav') if r.random() < 0.5 else ''}><ul>{links(r.randint(2, 9))}</ul></nav>",
        "menu": lambda: f"<div{cls('menu', 'navigation', 'breadcrumb', 'topnav', 'tabs')}><ul>{links(r.randint(2, 7))}</ul></div>",
        "header": lambda: f"<header{cls('header', 'site-header', 'masthead', 'top') if r.random() < 0.5 else ''}><a href='/'>{word().title()}</a><p>{short()}</p></header>",
        "headdiv": lambda: f"<div id='{r.choice(('header', 'masthead', 'banner', 'topbar'))}'><h2>{word().title()}</h2><span>{short()}</span></div>",
        "footer": lambda: f"<footer{cls('footer', 'site-footer') if r.random() < 0.4 else ''}>&copy; {r.choice((word() + '.example.com', '2024 ' + word()))} {r.choice(('&middot; ', '| ', ''))}{short()}</footer>",
        "footdiv": lambda: f"<div id='{r.choice(('footer', 'bottom', 'colophon'))}'><p>&copy; {word()} {short()}</p><ul>{links(3)}</ul></div>",
        "aside": lambda: f"<aside{cls('sidebar', 'related', 'widget') if r.random() < 0.5 else ''}><h3>{short()}</h3><p>{text(1, 4)}</p><ul>{links(r.randint(0, 5))}</ul></aside>",
        "sidebar": lambda: f"<div{cls('sidebar', 'side', 'widget', 'related-posts', 'recommended', 'trending', 'right-column')}><h4>{short()}</h4><p>{text(1, 3)}</p><p>{text(1, 2)}</p></div>",
        "ad": lambda: f"<div{cls('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad', 'sponsor')}>{r.choice((text(1, 2), '<p>' + text(1, 3) + '</p>', '<a href=#>' + text(1, 1) + '</a>'))}</div>",
        "notice": lambda: f"<div{cls('notice', 'cookie-banner', 'cookies', 'alert', 'consent', 'gdpr', 'warning', 'paywall', 'message')}><p>{text(1, 3)}</p><button>{word().title()}</button></div>",
        "form": lambda: f"<form action='/x'{cls('search', 'subscribe', 'newsletter', 'signup', 'login-form') if r.random() < 0.6 else ''}><label>{short()}</label><input name=q><p>{short()}</p><button>{word()}</button></form>",
        "newsletter": lambda: f"<section{cls('newsletter', 'signup', 'subscribe-box')}><p>{text(1, 2)}</p><input><button>{word()}</button></section>",
        "share": lambda: f"<div{cls('share', 'social', 'share-buttons', 'tags', 'byline', 'meta', 'author-box')}><a href='#'>{word()}</a> <a href='#'>{word()}</a></div>",
        "comments": lambda: f"<{(e := r.choice(('section', 'div', 'ol')))}{cls('comments', 'comment-list', 'discussion', 'responses', 'reader-comments')}>" + "".join(f"<{(k := r.choice(('div', 'li', 'p', 'article')))}{cls('comment', 'reply', 'comment-body')}><b>{word().title()}</b> <p>{text(1, 4)}</p></{k}>" for _ in range(r.randint(1, 6))) + f"</{e}>",
        "bare": lambda: f"<{(e := r.choice(('aside', 'nav', 'header', 'footer', 'form')))}>{r.choice((text(1, 2), '<p>' + text(1, 3) + '</p>', '<div>' + text(1, 1) + '</div>'))}</{e}>",
        "script": lambda: f"<script>var t=\"</p>\";{word()}({r.randint(0, 9)});</script><style>p{{margin:0}}</style>",
    }

    def some(names: list[str], most: int) -> str:
        out = "".join(boiler[r.choice(names)]() for _ in range(r.randint(0, most)))
        return f"<!--=0-->{out}" if out else ""

    def body() -> str:
        out = f"<h{(k := r.choice((1, 1, 1, 2)))}>{r.choice((short(), text(1, 1)))}</h{k}>" if r.random() < 0.85 else ""
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14, 25, 40))):
            kind = r.random()
            if kind < 0.70:
                p = text(1, r.choice((2, 6, 6, 20)))
                out += r.choice((f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br>", f"<div>{p}</div>"))
            elif kind < 0.76:
                out += f"<h{(k := r.choice((2, 3)))}>{short()}</h{k}>"
            elif kind < 0.82:
                out += "<ul>" + "".join(f"<li>{text(1, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            elif kind < 0.86:
                out += f"<blockquote><p>{text(1, 2)}</p></blockquote>"
            elif kind < 0.90:
                out += "<table>" + "".join(f"<tr><td>{word()}</td><td>{text(1, 1)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
            elif kind < 0.94:
                out += f"<p>{r.choice((word(), short()))}</p>"
            else:
                out += some(["ad", "share", "form", "newsletter", "notice", "script", "aside"], 1) + "<!--=1-->"
        return f"<!--=1-->{out}<!--=0-->"

    e = r.choice(("article", "article", "article", "main", "div", "div", "section"))
    attr = "" if e in ("article", "main") and r.random() < 0.7 else f' class="{r.choice(_KEEP_CLASS) or hashed}"'
    head = r.choice(("<html><head><title>x</title></head><body>",) * 3 + ("<body>", ""))
    before = some(["nav", "menu", "header", "headdiv", "ad", "notice", "form", "script", "sidebar", "aside", "bare"], 5)
    tail = some(["comments", "share", "newsletter"], 2) if r.random() < 0.4 else ""
    after = some(["footer", "footdiv", "aside", "sidebar", "comments", "ad", "newsletter", "nav", "form", "bare", "header"], 5)
    inner = f"<{e}{attr}>{body()}{tail}</{e}>"
    if r.random() < 0.4:
        inner = f"<div class=\"{r.choice(('wrapper', 'container', 'page', 'layout', hashed))}\">{inner}</div>"
    return head + before + inner + after + ("</body></html>" if head and r.random() < 0.9 else "")


def training_set(pages: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    r = random.Random(seed)
    out = []
    for _ in range(pages):
        found = [b for b in blocks(training_page(r), labels=True) if b.label is not None]
        if found:
            out.append((vectors(found), np.array([b.label for b in found], np.float32)))
    return out


@cache
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    """The labeller, fitted on ``pages`` generated pages; alike for equal arguments."""
    data = training_set(pages, seed)
    net, r = Labeller(), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, size = 0, 32
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + r.random() * 4)
        batches = [order[i : i + size] for i in range(0, len(order), size)]
        for k in r.permutation(len(batches)):
            x, mask = pad([data[i][0] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batches[k]):
                y[: len(data[i][1]), j] = data[i][1]
            g = net.gradients(x, mask, y)
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for name, v in g.items():
                v = v * min(1, 5 / (norm + 1e-9))
                m1[name] = 0.9 * m1[name] + 0.1 * v
                m2[name] = 0.99 * m2[name] + 0.01 * v * v
                net.p[name] -= (rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    """The main text of each page."""
    found = [blocks(p) for p in pages]
    x = vectors([b for f in found for b in f])
    cuts = np.cumsum([len(f) for f in found])[:-1]
    return [" ".join(b.text for b, s in zip(f, s) if s > 0) for f, s in zip(found, net.label(np.split(x, cuts)))]


def extract(df: DataFrame, html: str = "html", out: str = "text", net: Labeller | None = None, at_once: int = 512) -> DataFrame:
    """``df`` with the column ``out``: the main text of each page."""
    known = df.sparkSession.sparkContext.broadcast(net or trained())  # a few thousand numbers
    columns, at = df.columns, df.columns.index(html)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, at_once):
                part = b.slice(i, at_once)
                texts = main_texts([x.as_py() or "" for x in part.column(at)], known.value)
                cols = [c for c, n in zip(part.columns, columns) if n != out] + [pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[n for n in columns if n != out] + [out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out) + f"{', ' if len(df.columns) > (out in df.columns) else ''}`{out}` string"
    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(p).selectExpr("page_id", "url", "text", "cast(length(text) as long) as n_chars")
