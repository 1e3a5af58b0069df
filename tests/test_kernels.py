"""Goldens and edge cases of the encoders, and brute force on random words."""

import random

import pytest

from tokenloom import EncodeError, Tokenizer, Vocabulary, VocabularyError
from tokenloom import kernels as K
from tokenloom.plans import frozen as Z

LOW = Vocabulary("Bpe", dict(l=0, o=1, w=2, lo=3, low=4), (("l", "o"), ("lo", "w")))
AFFORD = {"un": 0, "##afford": 1, "##able": 2, "[UNK]": 3}


@pytest.mark.parametrize("text, ids", [("low", [4]), ("lox", [3, 0]), ("xow", [4]), ("lo w low", [3, 2, 4]), ("", []), ("  ", [])])
def test_bpe_words(text, ids):
    assert K.Encoder(LOW).encode(text) == ids
    assert K.Encoder(LOW, strategy="block").encode(text) == ids


def test_bpe_order():
    aa = Vocabulary("Bpe", {"a": 0, "aa": 1}, (("a", "a"),))
    assert K.Encoder(aa).encode("aaaaa") == [1, 1, 0]
    ill = Vocabulary("Bpe", dict(a=0, b=1, ab=2, aba=3), (("ab", "a"), ("a", "b")))
    assert K.Encoder(ill).encode("abab") == [3, 1]
    assert K.Encoder(ill, strategy="block").encode("abab") == [2, 2]
    assert Vocabulary("Bpe", {}, (("a", "b"), ("c", "d"), ("a", "b"))).ranks == {("a", "b"): 2, ("c", "d"): 1}
    assert Vocabulary("Bpe", dict(a=0, b=1), (("a", "b"),)).id_merges == {}


def test_wordpiece():
    v = Vocabulary("WordPiece", AFFORD, prefix="##")
    assert K.Encoder(v).encode("unaffordable unaffordables") == [0, 1, 2, 3]
    assert K.Encoder(Vocabulary("WordPiece", AFFORD)).encode("unaffordable") == [0, 1, 2]
    with pytest.raises(EncodeError, match="xyz"):
        K.Encoder(Vocabulary("WordPiece", {"un": 0})).encode("xyz")


def test_unigram():
    v = Vocabulary("Unigram", {"sub": 0, "word": 1, "subword": 2, "<unk>": 3}, scores=(("sub", -2.0), ("word", -2.0), ("subword", -0.5)))
    assert K.Encoder(v).encode("subword") == [2]
    assert K.Encoder(v).encode("é") == [3, 3]
    assert K.Encoder(Vocabulary("Unigram", dict(a=0, b=1, ab=2), scores=(("a", -1), ("b", -1), ("ab", -2)))).encode("ab") == [2]
    assert K.Encoder(Vocabulary("Unigram", {"x": 0})).encode("x") == [0]


def test_modes():
    e = Vocabulary("Bpe", {"é": 0, "<unk>": 1})
    assert K.Encoder(e).encode("é") == [0]
    assert K.Encoder(e, "pretoken").encode("é") == [1, 1]
    whole = Vocabulary("Bpe", dict(a=0, b=1, ab=2))
    assert K.Encoder(whole, "bulk").encode("ab") == [2]
    assert K.Encoder(whole).encode("ab") == [0, 1]
    fox = Vocabulary("Bpe", {"Ġfox": 5, "fox": 6})
    b = K.Encoder(fox, "bulk")
    assert b.encode("fox fox") == [6, 5]
    assert b.stats("fox fox") == (7, 2, 2, 6, 0, 0)
    adaptive, word, pre = (K.Encoder(Z.BPE, m) for m in ("adaptive", "word", "pretoken"))
    assert adaptive.encode("Hello,é " * 100) == word.encode("Hello,é " * 100)
    long = "Hello,é world! " * 300
    assert adaptive.encode(long) == pre.encode(long) != word.encode(long)
    with pytest.raises(ValueError):
        K.Encoder(LOW, "other")


def test_splits():
    t = "a\x0bb\x0cc\x1cd\x85e\xa0f　g h"
    assert K.WORD.findall(t) == ["a", "b", "c\x1cd", "e", "f", "g", "h"]
    assert K.BLANK.findall(t) == [t[:-2], "h"]
    assert K.PRE.findall(t) == ["a", "b", "c", "\x1c", "d\x85e\xa0f　g", "h"]
    assert [m.span() for m in K.PRE_BYTES.finditer(b"Hello, world!")] == [(0, 5), (5, 6), (7, 12), (12, 13)]


@pytest.mark.parametrize("n", range(1, 7))
def test_utf8_chunks(n):
    raw = "héllo wörld".encode()
    parts = [raw[a:b] for a, b in K.utf8_chunks(raw, n)]
    assert b"".join(parts) == raw
    assert all(p.decode() for p in parts)


def test_blank_chunks():
    raw = b"aa bb cc dd"
    assert [raw[a:b] for a, b in K.blank_chunks(raw, 4)] == [b"aa bb ", b"cc dd"]
    assert K.chunk_target(10, 1) == 4096 and K.chunk_target(1 << 20, None, 4) == 65536


def test_stream():
    s = K.StreamEncoder(LOW)
    assert [s.feed(b"lo"), s.feed(b"w lo"), s.finish()] == [[], [4], [3]]
    assert s.feed(b"\xff ") == [] and s.feed(b"lo\x0bw") == [] and s.finish() == [3, 0, 2]
    s.feed(b"lo")
    s.reset()
    assert s.finish() == []


def test_random_words_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        symbols = list("abcd")
        merges = []
        for _ in range(r.randint(0, 8)):
            a, b = r.choice(symbols), r.choice(symbols)
            if a + b not in symbols:
                merges.append((a, b))
                symbols.append(a + b)
        v = Vocabulary("Bpe", {s: i for i, s in enumerate(symbols)}, tuple(merges))
        for _ in range(20):
            w = "".join(r.choice("abcd") for _ in range(r.randint(1, 14)))
            parts = list(w)
            for a, b in merges:  # a well-formed list: rule after rule, from the left
                i = 0
                while i + 1 < len(parts):
                    if (parts[i], parts[i + 1]) == (a, b):
                        parts[i : i + 2] = [a + b]
                    i += 1
            want = [v.vocab[p] for p in parts]
            assert K.Encoder(v, strategy="block").encode(w) == want
            assert K.Encoder(v).encode(w) == want


def test_random_unigram_against_all_paths():
    r = random.Random(4)
    for _ in range(40):
        tokens = {"".join(r.choice("ab") for _ in range(r.randint(1, 3))) for _ in range(5)} | {"a", "b"}
        scores = {t: -r.randint(1, 16) / 4 for t in tokens}
        v = Vocabulary("Unigram", {t: i for i, t in enumerate(sorted(tokens))}, scores=tuple(scores.items()))
        w = "".join(r.choice("ab") for _ in range(r.randint(1, 8)))

        def best(x):
            return 0 if not x else max(scores[x[:k]] + best(x[k:]) for k in range(1, len(x) + 1) if x[:k] in scores)

        ids = K.Encoder(v).encode(w)
        names = {i: t for t, i in v.vocab.items()}
        assert "".join(names[i] for i in ids) == w
        assert sum(scores[names[i]] for i in ids) == best(w)


def test_tokenizer(tmp_path):
    t = Tokenizer(LOW)
    assert t.encode_batch(["low", "lo"]) == [[4], [3]]
    t.save(str(tmp_path / "v"))
    assert Tokenizer.load(str(tmp_path / "v")).vocabulary == LOW
    with pytest.raises(IOError):
        t.save(str(tmp_path / "none" / "v"))
    with pytest.raises(ValueError):
        Tokenizer.load(str(tmp_path / "none"))
    with pytest.raises(VocabularyError):
        Vocabulary("Unigram", {}, scores=(("a", 0.0),)).validate()
    with pytest.raises(VocabularyError):
        Vocabulary("Bpe", {"a": 2**32}).validate()


@pytest.mark.parametrize("mode, v", [*((m, Z.BULK) for m in K.MODES), ("word", Z.UNIGRAM), ("word", Z.WORDPIECE)])
def test_memo_is_bounded_in_characters(monkeypatch, mode, v):
    """Few words, but long ones: a memo bounded by their number alone would hold all of the input."""
    monkeypatch.setattr(K, "MEMO_CHARS", 2000, raising=False)
    rng = random.Random(7)
    texts = ["".join(rng.choice("theraion") for _ in range(400)) for _ in range(60)]
    e = K.Encoder(v, mode)
    own = [K.Encoder(v, mode).encode(t) for t in texts]
    for t, ids in zip(texts, own):
        got, begins, good = e.encode_all([t, None, t])
        assert got.tolist() == ids * 2 and begins.tolist() == [0, len(ids), len(ids), 2 * len(ids)] and good.tolist() == [True, False, True]
        assert e.encode(t) == ids
        if v.algo == "Bpe":
            e.stats(t)
        held = sum(map(len, [*e.words, *e.places])) + len(e.pool)
        assert held <= 2000 + 3 * 400 and sum(map(len, e.pieces)) <= 2000 + 400 and sum(map(len, e.hits)) <= 2000 + 400


def test_count_all():
    e = K.Encoder(Z.BPE)
    texts = ["then the then", None, "", "other then"]
    want = [i for t in texts if t for i in K.Encoder(Z.BPE).encode(t)]
    ids, n = e.count_all(texts)
    assert dict(zip(ids.tolist(), n.tolist())) == {i: want.count(i) for i in want}
    assert [x.tolist() for x in e.count_all([None, ""])] == [[], []]
