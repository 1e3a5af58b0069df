"""DataFrame operators: edge rows, native against kernel, sinks, streaming, the CLI."""

import io
import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from tokenloom import Tokenizer, Vocabulary, kernels
from tokenloom import __main__ as cli
from tokenloom.functions import text as T
from tokenloom.functions import udfs
from tokenloom.operators import encode as E
from tokenloom.operators import stats, tables
from tokenloom.plans import frozen as Z
from tokenloom.sources import sinks, texts, vocabularies
from tokenloom.streaming import encode as streaming

ROWS = [(1, "the ring, of Ünits"), (2, ""), (3, None), (4, "then  there\n\n5"), (4, "then  there\n\n5")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, text string")


def test_encode(df):
    e = Tokenizer(Z.BPE, "word")
    for mode in ("word", "pretoken", "bulk", "stream", "adaptive"):
        got = sorted(map(str, E.encode(df, Z.BPE, mode=mode).select("id", "ids").collect()))
        own = Tokenizer(Z.BPE, mode)
        assert got == sorted(f"Row(id={r[0]}, ids={None if r[1] is None else own.encode(r[1])})" for r in ROWS)
    native = E.encode_native(df, Z.BPE).filter("text is not null").select("id", "ids").collect()
    assert sorted((r[0], r[1]) for r in native) == sorted((i, e.encode(t)) for i, t in ROWS if t is not None)


def test_on_error(spark, df):
    v = Vocabulary("WordPiece", {"the": 0})
    assert all(r[0] is None or r[0] == [] for r in E.encode(df, v, on_error="null").select("ids").collect())
    with pytest.raises(Exception, match="no unknown token"):
        E.encode(df, v).collect()


def test_csr_and_lines(df, tmp_path):
    ids = E.encode(df.filter("id < 3"), Z.BPE)
    rows = sorted(map(tuple, E.csr(ids, "id").collect()))
    assert rows[0][2] == 0 and rows[1] == (2, 0, rows[0][1])
    sinks.id_lines(ids, str(tmp_path / "out"))
    lines = [r[0] for r in df.sparkSession.read.text(str(tmp_path / "out")).collect()]
    assert " ".join(map(str, Tokenizer(Z.BPE, "word").encode(ROWS[0][1]))) in lines
    assert len(sinks.numpy_ids(ids)) == rows[0][1]


def test_stats_of_nothing(spark, df):
    none = df.filter("false")
    assert tuple(stats.bulk_stats(none, Z.BULK).first()) == (0, 0, 0, 0, 0, 0, 0.0, 0.0)
    assert stats.pretoken_stats(none).first()["avg_bytes"] == 0.0
    assert stats.upper_median([3, 1, 2, 4]) == 3


def test_columns(spark, df):
    r = df.filter("id = 1").select(*[T.class_bytes(F.col("text"), c).alias(c) for c in T.CLASSES]).first()
    assert tuple(r) == (15, 0, 3, 1)
    sizes = spark.createDataFrame([(100000,), (1000000,), (1000,), (100000000,)], "n long")
    assert [r[0] for r in sizes.select(T.chunk_size(F.col("n"), 16)).collect()] == [4096, 15625, 4096, 65536]
    assert sizes.select(T.chunk_size(F.col("n"), 1)).first()[0] == 100000


def test_tables(spark):
    t = Z.TRIE.tables(spark)["vocab"]
    assert tables.trie_states(Vocabulary("Bpe", dict(he=0, she=1, his=2, hers=3)).tables(spark)["vocab"]).count() == 9
    got = tables.common_prefixes(spark.createDataFrame([("there",), ("",), (None,)], "word string"), t).collect()
    assert sorted(r["length"] for r in got) == [3, 5]
    fail = {r[0]: r[1:] for r in tables.fail_links(t).collect()}
    assert fail["she".encode().hex().upper()] == ("6865", "6865")


def test_sql_functions(spark, df):
    udfs.register(spark, Z.BPE)
    df.createOrReplaceTempView("some_texts")
    assert spark.sql("SELECT bpe_encode(text) AS ids FROM some_texts WHERE id = 1").first()[0] == Tokenizer(Z.BPE, "word").encode(ROWS[0][1])
    assert spark.sql("SELECT pretokens('a1 b')").first()[0] == ["a", "1", "b"]
    assert [tuple(r)[:2] for r in spark.sql("SELECT * FROM common_prefix_search('there')").collect()] == [(1, Z.BPE.vocab["t"]), (2, Z.BPE.vocab["th"]), (3, Z.BPE.vocab["the"])]


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"one\r\ntwo\n\xffthree")
    assert [r[0] for r in texts.lines(spark, str(tmp_path)).collect()][:2] == ["one", "two"]
    assert texts.whole_files(spark, str(tmp_path)).first()["text"] == "one\r\ntwo\n"
    assert texts.synthetic(spark, 50).first()["text"] == (texts.PANGRAM * 2)[:50]
    raw = spark.createDataFrame([(b"ok",), (b"\xff",)], "raw binary")
    assert texts.checked(raw.filter("raw = cast('ok' as binary)")).first()["text"] == "ok"
    with pytest.raises(Exception, match="invalid UTF-8"):
        texts.checked(raw).collect()


def test_bundle(spark, tmp_path):
    sinks.bundle(Z.UNIGRAM, spark, str(tmp_path / "b"))
    got = sinks.load_bundle(spark, str(tmp_path / "b"))
    assert got.vocab == Z.UNIGRAM.vocab and got.scores == Z.UNIGRAM.scores and got.algo == "Unigram"
    path = tmp_path / "v"
    path.write_text(Z.HF)
    assert vocabularies.load(str(path), spark=spark).algo == "Bpe"


def test_cli(tmp_path, monkeypatch, capsys):
    (tmp_path / "v.json").write_text(json.dumps({"model": {"type": "BPE", "vocab": dict(l=0, o=1, w=2, lo=3, low=4), "merges": ["l o", "lo w"]}}))
    assert cli.main(["compile", "--vocab", str(tmp_path / "v.json"), "--out", str(tmp_path / "v")]) == 0
    monkeypatch.setattr(sys, "stdin", io.StringIO("low lo\r\n\nw"))
    cli.main(["encode", "--vocab", str(tmp_path / "v")])
    assert capsys.readouterr().out == "4 3\n\n2\n"


def test_streaming(spark, tmp_path):
    """A word and a character that micro-batches cut come out whole; recovery goes on from the checkpoint."""
    low = Vocabulary("Bpe", {"l": 0, "o": 1, "w": 2, "lo": 3, "low": 4, "é": 5}, (("l", "o"), ("lo", "w")))
    schema = "stream_id string, seq long, chunk binary, is_final boolean"
    parts = [[("a", 0, b"lo", False), ("b", 0, "é".encode()[:1], False)], [("a", 1, b"w lo", False), ("b", 1, "é".encode()[1:], False)], [("a", 2, b"", True), ("b", 2, b" l", True)]]

    def step(i):
        spark.createDataFrame(parts[i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = streaming.encode_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), low)
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    for i in range(3):
        step(i)
    got = {(r[0], r[1]): r[2] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): [], ("a", 1): [4], ("a", 2): [3], ("b", 0): [], ("b", 1): [], ("b", 2): [5, 0]}
    batch = streaming.encode_stream(spark.createDataFrame([r for p in parts for r in p], schema), low)
    assert {(r[0], r[1]): r[2] for r in batch.collect()} == got


def test_only_in_one(spark):
    """As EXCEPT ALL either way, with repeated rows and nulls; rows that agree are not shuffled."""
    rows = [(1, [1, 2], [1, 2]), (2, [1], [3]), (2, [1], [3]), (2, [3], [1]), (3, None, [4]), (4, None, None), (5, [], [5]), (5, [5], [])]
    df = spark.createDataFrame(rows, "id long, a array<bigint>, b array<bigint>")
    a, b = (df.select("id", E.joined(c).alias("ids")) for c in "ab")
    want = a.exceptAll(b).withColumn("side", F.lit("l")).union(b.exceptAll(a).withColumn("side", F.lit("r")))
    got = stats.only_in_one(df, "a", "b", "id", sides=("l", "r"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_conformance_diff_shuffles_no_equal_rows(spark):
    from tokenloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no supplied tables")
    plan = catalog.QUERIES["conformance_diff"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("ArrowEvalPython") == 1


def test_native_takes_any_text(spark):
    """Control characters, blanks of all kinds, characters beyond 16 bits, unknown ones that are a real token: as the kernel has it."""
    ab = Vocabulary("Bpe", {"a": 0, "b": 1, "ab": 2}, (("a", "b"),))
    wide = Vocabulary("Bpe", {"<unk>": 9, "t": 3, "h": 4, "th": 5, "語": 6, "t語": 7, "$": 8, "\\": 10, "$\\": 11, "]": 12, "^": 13, "-": 14}, (("t", "h"), ("t", "語"), ("$", "\\")))
    many = ["t\x01h\x02th", "\x02\x01 \x03th\x00e", "the　then\x85on  in\r\n", " ", "", "𝄞th𝄞e éthé", "t語th語 $\\ ]^-$$\\\\", "xb ab\tb", "th" * 5000, "aaaa", None]
    df = spark.createDataFrame(list(enumerate(many)), "id long, text string")
    for v in (Z.BPE, ab, wide):
        e = Tokenizer(v, "word")
        got = {r["id"]: r["ids"] for r in E.encode_native(df, v).collect()}
        assert got == {i: None if t is None else e.encode(t) for i, t in enumerate(many)}


def test_slices_bound_what_a_worker_holds(monkeypatch):
    """Rows come in order and whole, few bytes at a time; one long text is a slice of its own."""
    import pyarrow as pa

    monkeypatch.setattr(udfs, "SLICE_BYTES", 10)
    texts = ["abc", None, "éé", "", "x" * 50, None, "defghij", "klm", "nopqrstuvw", "z"]
    got = [s.to_pylist() for s in udfs._slices(iter([pa.array(texts), pa.array([], pa.string()), pa.array(texts).slice(6)]))]
    assert [t for s in got for t in s] == texts + texts[6:]
    assert all(len(s) == 1 or sum(len((t or "").encode()) for t in s) <= 10 for s in got) and len(got) == 8


def test_every_text_function_takes_slices(spark, monkeypatch):
    """The same rows whatever the slice; no function takes a batch at once."""
    import inspect

    source = inspect.getsource(udfs)
    assert source.count("in _slices(batches)") == source.count("def run(batches") == 6 and "in batches:" not in source.replace(inspect.getsource(udfs._slices), "")
    texts = ["then, there 5é " * 9, None, "", " \t", "x", "Ünits—the 1st", None]
    df = spark.createDataFrame([(i, texts[i % 7]) for i in range(700)], "id long, text string").coalesce(1)
    monkeypatch.setattr(udfs, "SLICE_BYTES", 10)
    spans = {r["id"]: None if r["s"] is None else [tuple(x) for x in r["s"]] for r in df.withColumn("s", udfs.pretoken_spans()(F.col("text"))).collect()}
    assert spans == {i: None if (t := texts[i % 7]) is None else [m.span() for m in kernels.PRE_BYTES.finditer(t.encode())] for i in range(700)}
    e = kernels.Encoder(Z.BULK, "bulk")
    want = [sum(x) for x in zip(*(e.stats(texts[i % 7] or "") for i in range(700)))]
    assert list(stats.bulk_stats(df, Z.BULK).first())[:6] == want


def test_token_frequencies(spark, monkeypatch):
    """As by counting the rows of all ids, whatever the slice; null and empty texts count nothing; workers send counts, not ids."""
    texts = ["then, there 5é " * 9, None, "", " \t", "x", "Ünits—the 1st", None]
    df = spark.createDataFrame([(i, texts[i % 7]) for i in range(700)], "id long, text string").coalesce(2)
    for size in (10, 1 << 20):
        monkeypatch.setattr(udfs, "SLICE_BYTES", size)
        for v, mode in ((Z.BPE, "word"), (Z.BPE, "adaptive"), (Z.BULK, "bulk"), (Z.UNIGRAM, "word")):
            want = E.encode(df, v, mode=mode).select(F.explode("ids").alias("token_id")).groupBy("token_id").count()
            got = stats.token_frequencies(df, v, mode=mode)
            assert dict(map(tuple, got.collect())) == dict(map(tuple, want.collect())) != {}
    assert stats.token_frequencies(df.filter("text is null"), Z.BPE).collect() == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_token_frequency_top_sends_no_ids(spark):
    from tokenloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no supplied tables")
    plan = catalog.QUERIES["token_frequency_top"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "array<bigint>" not in plan
