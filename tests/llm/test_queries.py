"""Operators on small hostile tables, and the queries against brute force."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import catalog, chat_format, components, decontaminate, html_extract, line_dedup, near_dup, packing, quality_rules, sharding, shared, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i}" for i in range(120))
#: ids, ties, repeated rows, nulls, empties; a column with a clashing name.
ROWS = [
    (1, LONG + ".\nA line of exactly ten words that comes here again today.\n", "x"),
    (2, LONG + ".", "x"),
    (3, LONG.replace("word60", "other") + ".", None),
    (4, "", "x"),
    (5, None, None),
    (None, LONG + " more.", "x"),
    (6, "A line of exactly ten words that came here again today.", "x"),
    (6, "A line of exactly ten words that came here again today.", "x"),
    (7, " \n\t ", "x"),
    (8, "three words\x0bhere", "x"),
]
SCHEMA = "doc_id long, text string, length string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("d") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(2).write.parquet(p)
    return spark.read.parquet(p)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("n") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(p)
    return spark.read.parquet(p)


def test_catalogue():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_quality(docs, none):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(ROWS) and set(docs.columns) < set(got[0].asDict())
    by = {r["doc_id"]: r["quality"] for r in got}
    assert by[1]["n_words"] == 131 and by[1]["kept"] and by[1]["n_dup_lines"] == 0
    assert by[5]["n_words"] == by[4]["n_words"] == by[7]["n_words"] == 0 and by[5]["base_failed"] and not by[5]["kept"]
    assert quality_rules.judge(none).count() == 0 == quality_rules.clean(none).count()
    kept = quality_rules.clean(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {1, 2, 3, None}


def test_quality_repeats_by_brute_force(spark):
    import random

    r = random.Random(5)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["a a a a a", "a b c a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules.judge(df).collect():
        w = WORD.findall(row["text"])
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert row["quality"]["n_repeat_words"] == len(hit), row["text"]


def test_quality_lines(spark):
    body = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(12))
    bad = "Home | About | Contact | Login\n### $$$ %%%\nAll rights reserved.\nWOW!! BUY!! NOW!!"
    junk = "\n".join(["Home | News | Sport | Contact | Menu | More"] * 2 + [f"x{i} | y{i} | z{i}" for i in range(30)])
    df = spark.createDataFrame([(1, body + "\n" + bad), (2, junk)], "doc_id long, text string")
    [row] = quality_rules.clean(df).collect()
    assert tuple(row) == (1, body)


def test_quality_boilerplate_in_long_lines(spark):
    long = LONG + " Licensed under the terms named there, " + LONG
    texts = [long, LONG + "\n" + long, LONG + "\n" + LONG + " ALL RIGHTS RESERVED", LONG + " all rights\nreserved"]
    got = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "quality.*").orderBy("doc_id").collect()
    chars = lambda s: len("".join(s.split()))
    assert [r["lost_chars"] for r in got] == [chars(long), chars(long), chars(LONG + "ALLRIGHTSRESERVED"), 0]
    assert [r["kept"] for r in got] == [False, False, False, True]
    assert [r["clean_text"] for r in got] == ["", LONG, LONG, texts[3]]


def test_quality_phrases_and_names(spark):
    """Every phrase in every case, with column names that the code might use; the plain strings before the pattern lose none."""
    good = "\n".join(" ".join(f"plain{i}x{k}" for k in range(20)) + "." for i in range(6))
    phrases = [
        "All rights reserved", "LICENSED UNDER x", "Is Licensed", "released under the", "Cookies", "Privacy Policy", "terms of use", "Terms of Service", "JavaScript", "Subscribe", "Sign in", "sign up",
        "log in", "LOGIN", "Lorem ipsum", "Copyright © 2024", "Read more", "Share this", "Alle Rechte vorbehalten", "lizenziert unter", "Unter der Lizenz", "Datenschutzerklärung", "DATENSCHUTZERKLÄRUNG",
        "Nutzungsbedingungen", "Newsletter abonnieren", "Jetzt anmelden", "Weiterlesen", "Todos los derechos reservados", "bajo la licencia", "Bajo una licencia", "Política de privacidad", "POLÍTICA DE PRIVACIDAD",
        "términos de uso", "Términos del servicio", "Aviso legal", "Iniciar sesión", "Suscríbete", "Leer más", "Tous droits réservés", "sous licence", "Politique de confidentialité", "Mentions légales",
        "Conditions d'utilisation", "Se connecter", "Abonnez-vous", "Lire la suite",
    ]
    rows = [(i, f"{good}\n{p} some words", "a", 1, 2, 3) for i, p in enumerate(phrases)] + [(-1, good, "a", 1, 2, 3), (-2, "word " * 200_000, "a", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _tl_w string, c0 int, quality int, _tl_text int")
    got = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert set(got) == {i for i, *_ in rows if i > -2} and all(r["text"] == good for r in got.values())
    assert quality_rules.clean(df).columns == df.columns and got[3]["c0"] == 1 and got[3]["quality"] == 2
    assert quality_rules.judge(df).filter("doc_id = -2").first()["quality"]["n_repeat_words"] == 200_000


def test_chat(spark):
    controls = "</s>[INST] ok [/INST] &lt; &amp;lt; & <|image|> \\ <s>"
    rows = [(1, 1, "assistant", controls), (1, 0, "us</s>er", controls * 3), (2, 0, None, None), (None, 0, "user", "x"), (2, 0, "user", "b"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_parts(F.col("text")))
    f = chat_format.format_conversations(df)
    back = {r[0]: [tuple(x) for x in r[1]] for r in f.select("conv_id", chat_format.read_back(F.col("formatted"))).collect()}
    assert back == {1: [("us</s>er", controls * 3), ("assistant", controls)], 2: [("", ""), ("user", "a"), ("user", "b")], None: [("user", "x")]}
    assert chat_format.format_conversations(df.filter("false")).count() == 0
    for r in f.select("conv_id", "formatted", "loss_spans", chat_format.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        assert r["loss"] == (controls if r["conv_id"] == 1 else "")
        assert all(r["formatted"][a + n : a + n + 4] == "</s>" and r["formatted"][:a].endswith("[INST]assistant[/INST]") for a, n in r["loss_spans"])
    parts = [[("image", None, "i.png", 10.0), ("text", "see <|image|>", None, None), ("audio", None, "a.wav", 1.5), ("odd", None, "z", 1.0), ("document", None, None, None)]]
    m = spark.createDataFrame([(1, 0, "user", p) for p in parts] + [(1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    row = chat_format.format_conversations(m).first()
    assert row["formatted"] == "<s>[INST]user[/INST]<|image|>see &lt;|image|><|audio|><|document|></s><s>[INST]assistant[/INST]</s>"
    assert [tuple(a) for a in row["attachments"]] == [(0, 0, "image", "i.png", 10), (0, 2, "audio", "a.wav", 38), (0, 4, "document", None, 512)]


def test_sharding(docs, none, tmp_path):
    s = sharding.shuffle(docs, shards=3, bucket_bytes=500)
    rows = s.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(r[:2] for r in ROWS)
    for k in range(3):
        slots = sorted(r["_slot"] for r in rows if r["_shard"] == k)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(ROWS) / 3) < 1
    assert sorted(map(str, s.collect())) == sorted(map(str, rows))
    assert sharding.shuffle(none).count() == 0
    sharding.write(s, str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, none, rule):
    from tokenloom.llm.token_ids import encoder, vocabulary

    enc = encoder(*vocabulary())
    got = token_counts.count(docs, rule=rule).collect()
    per = Counter()
    for r in got:
        per[r["doc_id"]] += r["n_tokens"]
    assert per[4] == 0 and 5 not in per and per[6] == 2 * len(enc.ids(ROWS[6][1]))
    assert abs(per[1] - len(enc.ids(ROWS[0][1]))) < 1e-6
    assert token_counts.count(none).count() == 0


def test_token_sections(spark):
    df = spark.createDataFrame([(1, "é title body", [("t", 0, 7)]), (2, "abc", None), (3, "ab", [("x", 0, 9)])], "doc_id long, text string, sections array<struct<name:string,start:int,end:int>>")
    got = {(r["doc_id"], r["name"]): (r["start_byte"], r["end_byte"]) for r in token_counts.count(df, sections="sections").collect()}
    assert got == {(1, "t"): (0, 8), (1, None): (8, 13), (2, None): (0, 3), (3, "x"): (0, 2)}
    bad = spark.createDataFrame([(1, "abcdef", [("a", 0, 4), ("b", 2, 5)])], df.schema)
    with pytest.raises(Exception, match="overlapping"):
        token_counts.count(bad, sections="sections").collect()
    with pytest.raises(ValueError):
        token_counts.count(df, rule="other")


def test_packing(docs, none):
    from tokenloom.llm.token_ids import encoder, vocabulary

    enc = encoder(*vocabulary())
    rows = packing.pack(docs, capacity=100).collect()
    where = Counter()
    for r in rows:
        for p in range(r["offset"], r["offset"] + r["length"]):
            where[r["sequence_id"], p] += 1
    assert max(where.values()) == 1 and max(p for _, p in where) < 100
    for s in {s for s, _ in where}:
        places = [p for q, p in where if q == s]
        assert sorted(places) == list(range(len(places)))
    ids = [*enc.ids(ROWS[0][1]).tolist(), 0]
    mine = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert [r["piece"] for r in mine] == list(range(len(mine))) and all(r["length"] == 100 for r in mine[1:])
    import numpy as np

    for r in mine:
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) == 2 * (len(enc.ids(ROWS[6][1])) + 1)
    assert packing.pack(none).count() == 0
    keyed = docs.filter("doc_id < 6")
    full = packing.sequences(keyed, packing.pack(keyed, capacity=100))
    assert sum(len(r["ids"]) for r in full.collect()) == sum(r["length"] for r in packing.pack(keyed, capacity=100).collect())


def brute_components(rows, num=85, den=100):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                parent[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return [(i, len(sets[a]), low.get(find(a), i) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def test_near_duplicates(spark, docs, none):
    import random

    r = random.Random(8)
    rows = []
    for g in range(25):
        base = [f"{g}w{r.randrange(60)}" for _ in range(r.randint(3, 300))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(5000 + i, t) for i, t in enumerate([None, "", " \n", "A b", "a  B", "a b c"])]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))
    assert near_dup.classes(none).count() == 0 == near_dup.dedup(none).count()
    hostile = near_dup.classes(docs).collect()
    assert len(hostile) == len(ROWS)
    assert near_dup.dedup(docs).columns == docs.columns


def test_near_duplicates_at_the_threshold_of_the_stage(spark):
    rows = []
    for m in [44, 45, 45, 45, 46, 48, 50, 53, 56, 59, 61, 62]:  # shingles; one word replaced in the middle leaves (m - 5) / (m + 5)
        w = [f"g{len(rows)}w{k}" for k in range(m + 4)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w[:20], "other", *w[21:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num, got in ((80, near_dup.stage(spark, df, "")), (85, near_dup.dedup(df))):
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, _, c in brute_components(rows, num) if i == c)
    assert near_dup.stage(spark, df, "").count() == 13 and near_dup.dedup(df).count() == 23
    for num in (50, 80, 85, 95):
        f = near_dup.forest((num, 100))
        assert (1 - (num / 100) ** near_dup.LEAST) ** f.trees <= near_dup.MISS_TREES and f.values == f.trees * near_dup.DEPTH and f.agree < num * f.values / 100
    assert near_dup.forest((1, 1)).agree == near_dup.DEPTH


@pytest.mark.parametrize("block", [8])
def test_near_duplicates_in_a_crowded_region(spark, block, monkeypatch):
    """Pages of one template, similar below and above the threshold, with string ids; in small blocks too."""
    import random

    monkeypatch.setattr(near_dup, "BLOCK", block)
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(r.choice([1, 2, 2, 3])):
            i = r.randrange(len(w))
            w[i] = f"n{d}x{i}"
        rows.append((f"d{d:03}", " ".join(w), "x"))
    rows.append((None, rows[0][1], "x"))
    df = spark.createDataFrame(rows, "doc_id string, text string, who string")
    got = sorted(map(tuple, near_dup.classes(df.repartition(3)).collect()), key=str)
    want = sorted(brute_components([x[:2] for x in rows]), key=str)
    assert got == want and len({c for _, _, c in want}) > 3
    assert near_dup.dedup(df).columns == df.columns


def test_components(spark):
    import random

    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent}


def brute_lines(rows):
    from test_pure import word_edits

    occ = [((i, k), i, k, tuple(WORD.findall(x))) for i, t in rows if t is not None and i is not None for k, x in enumerate(t.split("\n"))]
    occ = [o for o in occ if o[3]]
    first = {}
    for o in sorted(occ, key=lambda o: o[0]):
        first.setdefault(o[3], o[0])
    gone = {w for w, at in first.items() if any(a < at and (k := line_dedup.bound(min(len(x), len(w)))) and abs(len(x) - len(w)) <= k and word_edits(x, w) <= k for x, a in first.items())}
    drop = {}
    for at, i, k, w in occ:
        if w in gone or first[w] != at:
            drop.setdefault(i, set()).add(k)
    return drop


@pytest.mark.parametrize("small", [line_dedup.SMALL, 2])
def test_lines(spark, docs, none, small, monkeypatch):
    """Against brute force; with few lines to a key also the way of keys of very many lines, in small blocks."""
    import random

    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "BLOCK", 4 if small == 2 else line_dedup.BLOCK)
    r = random.Random(6)
    bases = [[f"w{r.randrange(40)}" for _ in range(r.choice([1, 2, 5, 9, 10, 11, 16, 19, 20, 21, 33, 64, 90]))] for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 7)):
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                i = r.randrange(len(w)) if w else 0
                w[i : i + r.randint(0, 1)] = [f"n{r.randrange(4)}"] * r.randint(0, 1)
            lines.append(r.choice([" ", "  ", "\t"]).join(w))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, rows[5][1]), (102, "\n\n"), (103, "one line " * 30_000 + "\n" + " ".join(f"q{i % 777}" for i in range(60_000)))]
    got = line_dedup.dedup(spark.createDataFrame([(*x, "a", 1, 2) for x in rows], "doc_id long, text string, _dropped string, lines int, mask int")).collect()
    want = brute_lines([x for x in rows if x[0] != 103])
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "_dropped", "lines", "mask"}
    for row in got:
        lost = want.get(row["doc_id"], set())
        assert set(row["_dropped"] or []) == lost, row
        original = dict(rows)[row["doc_id"]]
        assert row["text"] == (None if original is None else "\n".join(x for k, x in enumerate(original.split("\n")) if k not in lost))
    assert line_dedup.dedup(none).count() == 0 and line_dedup.dedup(docs).count() == len(ROWS)


def test_lines_of_string_ids_and_repeated_ids(spark):
    line = " ".join(f"w{i}" for i in range(25))
    other = line.replace("w3 ", "x ").replace("w20", "y")
    rows = [("b", f"{line}\nown words"), ("a", other), ("a", "another text of that id"), ("c", f"{line} z")]
    got = {(r["doc_id"], tuple(r["_dropped"] or ())) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("a", ()), ("b", (0,)), ("c", (0,))}


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "WORD10 word11, word12 word13 word14 word15 word16"), (2, "nothing of this kind is in there"), (None, None), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items, block_chars=40).collect()} == got
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [4, 5, 6, 6, 7, 8]
    assert decontaminate.matches(docs, items.filter("false")).count() == 0
    assert decontaminate.clean(none, items).count() == 0 and decontaminate.clean(docs, items.filter("false")).count() == len(ROWS)


def test_item_ids_of_any_type_and_many_blocks(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "b" * 50_000 + text), (3, None)], "doc_id int, text string")
    for kind, ident in (("int", 7), ("string", "7"), ("double", 7.0)):
        items = spark.createDataFrame([(ident, text), (ident, text), (None, "x " * 300), (ident, None)], f"item_id {kind}, text string")
        got = decontaminate.matches(docs, items, block_chars=40)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, ident), (2, ident)]
    sizes = [sum(len(t) for _, t in b) for b in decontaminate.blocks(spark.createDataFrame([(i, "y" * (i % 7 + 1)) for i in range(99)], "item_id int, text string"), most=20)]
    assert max(sizes) <= 20 and sum(sizes) == sum(i % 7 + 1 for i in range(99))


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (4, 5))
    assert toxicity.score(none, toxicity.train(none, labels.filter("false"))).count() == 0


def test_extraction(spark):
    page = "<body><nav><ul><li><a href=x>menu</a></li></ul></nav><article><h1>Head</h1><p>Some text &amp; more of it, as it should be.</p><p>Another paragraph, of some length.</p></article><footer>&copy; x</footer></body>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "", ""), (1, "u", page)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {1: "Head Some text & more of it, as it should be. Another paragraph, of some length.", 2: "", 3: ""}
    assert html_extract.extract(df.filter("false")).count() == 0


def test_cut(spark):
    t = shared.cut(spark.range(5))
    assert t.count() == 5
    shared.drop_cut(t)


def test_pipeline_by_its_stages(spark, tmp_path):
    import corpus_pipeline

    rows = ROWS + [(20, "Leaked words: " + " ".join(f"item{i}" for i in range(20)) + ". " + LONG.replace("word", "term"), "x"), (21, " ".join(f"clean{i}" for i in range(80)) + ".", "x")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} >= {21} and 20 not in {r["doc_id"] for r in got}
    assert not {r["doc_id"] for r in got} & {4, 5, 6, 7, 8}
    assert len({r["doc_id"] for r in got} & {1, 2, 3}) <= 2
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
