"""Queries that SQL can express against their SQL, on the smallest supplied tables; digests by Python."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import pytest

from tokenloom.llm import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    rel = c.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()) == sorted(tuple(map(str, r)) for r in rel.select(*sorted(rel.columns)).fetchall())


def test_chat_digests(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in catalog.QUERIES["op5_chat_format"](spark, SF).collect()}
    assert set(got) == set(turns)
    for i, t in turns.items():
        said = "".join(f"{role}\n{text}\n" for _, role, text in sorted(t))
        loss = "".join(text for _, role, text in sorted(t) if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i]["n_turns"], got[i]["turns_sha256"], got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(t), sha(said), len(loss), sha(loss))


def test_sharding_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.QUERIES["op3_sharding"](spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_leaks_by_brute_force(spark):
    from tokenloom.llm.decontaminate import normalise

    items = {r["item_id"]: normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: normalise(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}
    got = {(r["doc_id"], r["item_id"]): r for r in catalog.QUERIES["op1_decontamination"](spark, SF).collect()}
    assert exact <= set(got) and all((d, i) in exact for (d, i), r in got.items() if r["distance"] == 0)
    assert all(docs[d][r["start"] : r["end"]] == items[i] for (d, i), r in got.items() if r["distance"] == 0)


def test_extraction_of_articles(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in catalog.QUERIES["op7_html_extraction"](spark, SF).collect()}
    assert set(got) == set(pages)
    right = 0
    for i, p in pages.items():
        article = re.sub(r"</?(p|h1|br)>", " ", p.split("<article>")[1].split("</article>")[0].split("<footer>")[0])
        right += got[i]["text"] == " ".join(html.unescape(re.sub(r"</?b>", "", article)).split())
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert right == len(pages)


def test_toxicity_columns(spark):
    got = catalog.QUERIES["op2_toxicity"](spark, SF).collect()
    assert len(got) == 200
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_on_held_out_labels(spark):
    """Of the supplied labels, on the documents that the fit has not seen: few of the clean ones flagged, most of the toxic ones found."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["predicted"]) for r in catalog.QUERIES["op2_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(y == p for y, p in got) >= 0.95 * len(got)
    assert sum(p for y, p in got if y) >= 0.8 * sum(y for y, _ in got)
