import json

import pytest

from tokenloom import VocabularyError
from tokenloom.plans import frozen as Z
from tokenloom.sources import vocabularies as S


def test_detect():
    kinds = dict(zip((n for n, _ in Z.DETECT), "compiled gguf sentencepiece_json sentencepiece_json hf_json hf_json hf_json unknown unknown tiktoken unknown unknown unknown".split()))
    assert {n: S.detect(c) for n, c in Z.DETECT} == kinds


def test_hf():
    v = S.load_hf(Z.HF)
    assert (v.algo, len(v.merges), len(v)) == ("Bpe", 3, 7)
    u = S.load_hf(json.dumps({"model": {"type": "Unigram", "vocab": {"a": 0}, "vocab_scores": [["a", -1.0]]}}))
    assert u.scores == (("a", -1.0),)
    for bad in ("[]", "{}", "x", '{"model":{"type":"Unigram","vocab":[["a",0]]}}', '{"model":{"type":"Other","vocab":{}}}'):
        with pytest.raises(VocabularyError):
            S.load_hf(bad)


def test_sentencepiece_and_gguf():
    assert S.load_sentencepiece_json(Z.SP_JSON).vocab["hello"] == 3
    with pytest.raises(VocabularyError):
        S.load_sentencepiece_json('["a"]')
    assert S.load_gguf_json(Z.GGUF_JSON).vocab["ab"] == 3
    assert S.load_gguf_json('{"tokens":["a"]}').algo == "Unigram"
    p = S.load_sentencepiece_proto(Z.sp_proto())
    assert p.vocab == {"a": 0, "b": 1} and p.scores[1] == ("b", -2.0)
    with pytest.raises(VocabularyError):
        S.load_sentencepiece_proto(b"")
    with pytest.raises(VocabularyError):
        S.read_varint(b"\x80" * 10, 0)
    assert S.read_varint(b"\xac\x02", 0) == (300, 2)


def test_base64_and_tiktoken():
    assert S.b64_decode("aGVsbG8=") == S.b64_decode("aGVsbG8") == b"hello"
    assert S.b64_decode("_w") == S.b64_decode("/w==") == b"\xff"
    assert S.b64_decode("aGVsb") == b"hel"
    with pytest.raises(VocabularyError):
        S.b64_decode("a b")
    v = S.load_tiktoken("aA== 0\naQ== 1\naGk= 2\n")
    assert v.vocab == {"h": 0, "i": 1, "hi": 2} and v.merges == ()
    assert S.load_tiktoken("aA== 0\naQ== 1\naGk= 2\n", derive_merges=True).merges == (("h", "i"),)


def test_compiled(tmp_path):
    v = S.load_hf(Z.HF)
    assert S.load_compiled(S.compile_vocabulary(v)) == v
    for bad, word in ((b"1234567", "short"), (b"xxxx\x01\0\0\0{}", "format"), (S.COMPILED + b"\x02\0\0\0{}", "version: 2")):
        with pytest.raises(VocabularyError, match=word):
            S.load_compiled(bad)
    (tmp_path / "one").write_bytes(b"aA== 0")
    with pytest.raises(VocabularyError, match="unknown"):
        S.load(str(tmp_path / "one"))
    assert S.load(str(tmp_path / "one"), "tiktoken").vocab == {"h": 0}


def test_public_vocabulary_against_its_own_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    v = S.load(path)
    own = tokenizers.Tokenizer.from_file(path)
    assert len(v) >= 49_000 and v.algo == "Bpe"
    assert len(own.encode("hello").ids) >= 1


@pytest.mark.parametrize(
    "load, content",
    [
        (S.load_hf, b'{"model": {"type": "BPE", "vocab": {"a": 0}, "merges": [5]}}'),
        (S.load_hf, b'{"model": {"type": "Unigram", "vocab": {"a": 0}, "vocab_scores": [["a", "x"]]}}'),
        (S.load_gguf_json, b'{"tokens": ["a"], "merges": [7]}'),
        (S.load_gguf_json, b'{"tokens": [["a"]], "scores": ["x"]}'),
        (S.load_compiled, S.COMPILED + b"\x01\x00\x00\x00{}"),
        (S.load_compiled, S.COMPILED + b"\x01\x00\x00\x00[]"),
    ],
)
def test_malformed_files_are_value_errors(load, content):
    with pytest.raises(ValueError):
        load(content)
