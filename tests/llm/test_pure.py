"""Brute force for the parts that need no Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import decontaminate, html_blocks, html_extract, line_dedup, packing, sharding, token_counts, token_ids, toxicity, wordhash

R = random.Random(1)


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def test_myers_against_the_table():
    for _ in range(300):
        p = "".join(R.choice("abc") for _ in range(R.randint(1, 90)))
        t = "".join(R.choice("abc") for _ in range(R.randint(0, 60)))
        assert decontaminate.distance(decontaminate._masks(p), len(p), t) == edits(p, t)


def test_finder_against_all_windows():
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    for _ in range(60):
        items = [(i, " ".join(R.choice(words) for _ in range(R.randint(5, 12)))) for i in range(4)]
        find = decontaminate.Finder(items, 0.1, 20)
        text = list(" ".join(R.choice(words) for _ in range(20)))
        at = R.randint(0, len(text))
        text[at:at] = " " + items[R.randrange(4)][1] + " "
        for _ in range(R.randint(0, 6)):
            text[R.randrange(len(text))] = R.choice("abcxyz ")
        norm = decontaminate.normalise("".join(text))
        want = {i for i, s in items if edits(s, norm)[0] <= int(0.1 * len(s))}
        assert {h[0] for h in find.hits(norm)} == want


def test_finder_edges():
    find = decontaminate.Finder([(1, None), (2, ""), (3, "too short"), (None, "An item that is long, long enough!")])
    assert list(find.hits("")) == [] and list(decontaminate.Finder([]).hits("any text")) == []
    [(ident, d, a, b)] = find.hits(decontaminate.normalise("x AN item; that is LONG long enough y"))
    assert (ident, d, a) == (None, 0, 2)


def test_word_hashes_by_python():
    texts = ["a b  c", "", "A\tb\n", " x", "é a b", "b", "\x0b\x0c", "word " * 50]
    data, off = wordhash.text_buffers(pa.array(texts))
    h, at = wordhash.word_hashes(data, off, True)
    seen = {}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in t)
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        assert at[i + 1] - at[i] == len(w)
        for k, v in zip(w, h[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(k, v) == v
    assert len(set(seen.values())) == len(seen)
    old, wordhash.BLOCK = wordhash.BLOCK, 8
    try:
        assert (wordhash.word_hashes(data, off, True)[0] == h).all()
    finally:
        wordhash.BLOCK = old


def test_plan_holds_the_histogram():
    for _ in range(30):
        cap = R.choice([10, 64, 200])
        hist = {R.randint(1, cap): R.randint(1, 40) for _ in range(R.randint(0, 25))}
        plan = packing.plan(hist, cap)
        got = {}
        for filling, k in plan:
            assert k > 0 and sum(n * a for n, a in filling.items()) <= cap
            for n, a in filling.items():
                got[n] = got.get(n, 0) + a * k
        assert got == hist
        room = []
        for n in sorted((n for n, k in hist.items() for _ in range(k)), reverse=True):  # best fit, piece by piece
            i = min((i for i, r in enumerate(room) if r >= n), key=lambda i: room[i], default=None)
            if i is None:
                room.append(cap - n)
            else:
                room[i] -= n
        assert sum(k for _, k in plan) <= len(room)
        bound = packing.solve(hist, cap)[1] + hist.get(cap, 0)
        assert sum(k for _, k in plan) >= bound - 1e-6


def fewest(pieces, cap):
    """The optimum, by trying every sequence for every piece."""
    best = len(pieces)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(pieces):
            best = len(room)
            return
        for i in range(len(room)):
            if room[i] >= pieces[k] and room[i] not in room[:i]:
                place(k + 1, [*room[:i], room[i] - pieces[k], *room[i + 1 :]])
        place(k + 1, [*room, cap - pieces[k]])

    place(0, [])
    return best


def test_bound_and_plan_around_the_optimum():
    for _ in range(25):
        cap = R.choice([10, 24])
        pieces = sorted((R.randint(1, cap) for _ in range(R.randint(1, 9))), reverse=True)
        hist = {n: pieces.count(n) for n in pieces}
        best = fewest(pieces, cap)
        assert packing.solve(hist, cap)[1] + hist.get(cap, 0) <= best + 1e-6
        assert best <= sum(k for _, k in packing.plan(hist, cap)) <= best + 1


def test_plan_is_no_worse_than_its_parts():
    hist = {int(n): 400 for n in np.random.default_rng(4).integers(20, 700, 60)}
    columns, bound = packing.solve(hist, 1000)
    used, alone = (sum(k for _, k in packing._rounded(hist, 1000, c)) for c in (columns, []))
    plan = sum(k for _, k in packing.plan(hist, 1000))
    assert bound <= plan <= min(used, alone)
    assert sum(x * sum(n * a for n, a in c.items()) for c, x in columns) > 0.25 * sum(n * k for n, k in hist.items())


def test_price_against_all_fillings():
    for _ in range(30):
        sizes = np.array(sorted(R.sample(range(1, 12), 4)))
        value = np.array([R.random() for _ in sizes])
        best = {0: 0.0}
        for c in range(1, 21):
            best[c] = max([best[c - 1]] + [best[c - s] + v for s, v in zip(sizes, value) if s <= c])
        got = packing.price(value, sizes, 20)
        assert sum(sizes[i] * a for i, a in got.items()) <= 20
        assert abs(sum(value[i] * a for i, a in got.items()) - best[20]) < 1e-9


@pytest.mark.parametrize("run", [" ", "\n", "\u3000", "a", "="])
def test_ids_of_very_long_runs(run):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(token_ids.vocabulary()[0])
    text = "x" + run * 1_200_000 + "y" + run * 30_000 + "<|endoftext|>" + run * 20_000
    assert token_ids.encoder(*token_ids.vocabulary()).ids(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_borders_of_long_runs(monkeypatch):
    """The cuts around runs, at a limit so low that every run is cut out."""
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(token_ids.vocabulary()[0])
    monkeypatch.setattr(token_ids, "LONG_RUN", 3)
    enc = token_ids.encoder(*token_ids.vocabulary())
    bits = ["a", "é", " ", "  ", "\n", "\t", "\x85", "\xa0", "\u3000", "\x1c", "<|endoftext|>", "1", "!", "'s", " " * 5, "\n" * 5]
    for _ in range(2000):
        t = "".join(R.choice(bits) for _ in range(R.randint(0, 14)))
        assert enc.ids(t).tolist() == own.encode(t, add_special_tokens=False).ids


def test_ids_are_those_of_the_json_file():
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(token_ids.vocabulary()[0])
    enc = token_ids.encoder(*token_ids.vocabulary())
    for t in ["", "a  b", "x <|endoftext|> y", "don't 5% 日本 é\u0085\n\n z ", "\x00\x1c�"]:
        ids = enc.ids(t)
        assert ids.tolist() == own.encode(t, add_special_tokens=False).ids
        assert enc.byte_lengths(ids).sum() == len(t.encode())


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_by_bytes(rule):
    for _ in range(100):
        lengths = np.array([R.randint(1, 5) for _ in range(R.randint(1, 12))])
        n = int(lengths.sum())
        bounds = np.array([0, *sorted(R.randint(0, n) for _ in range(4)), n])
        want = np.zeros(5)
        at = 0
        for k in lengths:
            owner = [max(i for i in range(5) if bounds[i] <= b) for b in range(at, at + k)]
            if rule == "start":
                want[owner[0]] += 1
            elif rule == "most":
                want[max(sorted(set(owner)), key=owner.count)] += 1
            else:
                for o in owner:
                    want[o] += 1 / k
            at += k
        assert np.allclose(token_counts.allocate(lengths, bounds, rule), want)


def test_fisher_yates_is_a_fixed_permutation():
    a = sharding.fisher_yates(100, 1, 2)
    assert sorted(a.tolist()) == list(range(100)) and (a == sharding.fisher_yates(100, 1, 2)).all() and (a != sharding.fisher_yates(100, 1, 3)).any()


def word_edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, old = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return row[-1]


def test_near_lines_share_a_key():
    """As many edits as the bound allows, anywhere, of lines of every length up to 140 words."""
    for n in list(range(10, 141)) * 4:
        x = [R.choice("abcdefgh") + str(R.randrange(9)) for _ in range(n)]
        y = list(x)
        for _ in range(line_dedup.bound(n)):
            i = R.choice([0, len(y) - 1, R.randrange(len(y)), len(y) // 2])
            kind = R.choice("rid")
            y[i : i + (kind != "i")] = [] if kind == "d" else [f"z{R.randrange(9)}"]
        k = line_dedup.bound(min(n, len(y)))
        lines = [line_dedup.Lines(*wordhash.text_buffers(pa.array([" ".join(t)]))) for t in (x, y)]
        want = word_edits(x, y) <= k
        assert line_dedup.within(lines[0].words, lines[1].words, k) == want
        if want and k:
            assert line_dedup._verified([lines[0].words], [lines[1].words]) == [True]
            keys = [set(v.coarse()[0].tolist()) for v in lines]
            assert keys[0] & keys[1], (n, len(y))


def test_blocks():
    page = "<title>t</title><body><nav class='mainMenu'><a href=x>one</a></nav><script>var t='</p>';</script><p>a &amp; b<b>c</b>\n d<p>e<br>f<!-- no --><div>1 < 2</div></body>"
    got = [(b.text, b.linked > 0) for b in html_blocks.blocks(page)]
    assert got == [("one", True), ("a & bc d", False), ("e", False), ("f", False), ("1 < 2", False)]
    assert html_blocks.blocks(page)[0].path.element == ("nav", ".main", ".menu")
    for odd in ("", "<", "</", "<p", "<!--", "text", "<script>x", "</p></p>", "<a <b>", "&#x41;&bogus;"):
        html_blocks.blocks(odd)
    assert html_blocks.vectors([]).shape == (0, html_blocks.DIMS)


def test_deep_and_malformed_pages():
    """Nothing of a path is cut off, elements of an article that are shown keep their text, and the time is linear."""
    import time

    page = "<article><p>Where <math>x + y</math> is <canvas>a <object>b.<p>The <svg><text>c</text></svg> end<select><p>of it"
    assert " ".join(b.text for b in html_blocks.blocks(page)) == "Where x + y is a b. The c end of it"
    deep = html_blocks.blocks("<nav>" + "<font>" * 60 + "<div>in</div></nav><p>out")
    assert [b.path.depth for b in deep] == [62, 1] and ("nav",) in list(deep[0].path) and ("nav",) not in list(deep[1].path)
    began = time.perf_counter()
    for odd in ("<div>a" * 100_000, "<p>a" * 100_000, "<font>" * 50_000 + "<div>a</div>" * 5_000, "<select><p>a" * 20_000, "<!--" * 50_000, "&" * 300_000):
        html_blocks.vectors(html_blocks.blocks(odd))
    assert time.perf_counter() - began < 60


def test_comments_that_look_like_labels():
    page = "<p>one<!--====== header ======--> two<!--=1--> three</p><!--=--><p>four</p>"
    assert html_blocks.blocks(page) == html_blocks.blocks(page.replace("=", "-"))
    assert [(b.text, b.label) for b in html_blocks.blocks(page)] == [("one two three", None), ("four", None)]
    assert [(b.text, b.label) for b in html_blocks.blocks("<!--=1--><p>a</p><!--=0--><p>b</p>", labels=True)] == [("a", 1), ("b", 0)]


def test_labeller_gradients():
    r = np.random.default_rng(0)
    net = html_extract.Labeller(1, 5, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = html_extract.pad([r.normal(size=(4, 5)), r.normal(size=(2, 5))])
    x, mask = x.astype(np.float64), mask.astype(np.float64)
    y = (r.random(mask.shape) > 0.5) * mask

    def loss():
        z = net.scores(x, mask)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    g = net.gradients(x, mask, y)
    for name, v in net.p.items():
        i = tuple(int(r.integers(n)) for n in v.shape)
        old = v[i]
        v[i] = old + 1e-3
        up = loss()
        v[i] = old - 1e-3
        down = loss()
        v[i] = old
        assert abs((up - down) / 2e-3 - g[name][i]) < 2e-3, name


def test_labeller_on_unseen_pages():
    net = html_extract.trained(400, 4)
    right = total = 0
    test = html_extract.training_set(60, 77)
    for (_, y), s in zip(test, net.label([x for x, _ in test])):
        right += ((s > 0) == (y > 0)).sum()
        total += len(y)
    assert right / total > 0.95


def test_toxicity_learns_from_documents():
    r = random.Random(2)
    common = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        s = [" ".join(r.choice(common) for _ in range(8)) for _ in range(5)]
        y = i % 4 == 0
        if y:
            s[r.randrange(5)] += r.choice([" vilest", " grubbyish", " grubbyer"])
        rows.append((". ".join(s) + ".", int(y), 1.0))
    m = toxicity.fit(rows[:300])
    s = m.scorer()
    assert all((s.document(t)[0] >= 0.5) == bool(y) for t, y, _ in rows[300:])
    text = "w1 w2. You vilest w3! w4."
    [(a, b, p)] = s.document(text)[1]
    assert text[a:b] == " You vilest w3" and p > 0.5
    assert s.document("")[0] == 0 and 0 <= s.document("İ vilest. " * 2000)[0] <= 1
    for none in ([], [("a", 1, 1.0)], [(None, 1, 1.0), ("", 0, 1.0)]):
        assert toxicity.fit(none).scorer().document("any text")[0] < 0.5
