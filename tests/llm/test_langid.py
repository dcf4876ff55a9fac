import math
import zlib

import numpy as np
import pytest

from lodestone.llm import langid

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = langid.op10_subword_softmax(spark, DATA).join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.9 * len(held) and sum(r.lang == r.lang_pred for r in sure) / len(sure) > 0.98


def test_table_equals_direct_sums():
    model = langid.train(["the house is big", "das haus ist gross"] * 20, ["en", "de"] * 20)
    texts = ["the big house", "das grosse haus", "x" * 500 + " the", "the " * 30, "ÄÖ é"]
    words = langid.Words(model)
    for _ in range(2):
        got = words.predict(texts)
        for i, t in enumerate(texts):
            alone = langid.Words(model).predict([t])
            assert alone[0][0] == got[0][i] and alone[1][0] == pytest.approx(got[1][i])
    assert [model.langs[i] for i in got[0][:2]] == ["en", "de"]


def test_cases(spark):
    texts = [None, "", "123 _ !", "the house", "a" * 100_000, "the house"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, language int")
    model = langid.learn(docs)
    got = [r.found for r in langid.identify(docs, model, out="found").orderBy("doc_id").collect()]
    assert [r.lang for r in got] == ["und", "und", "und", "en", "en", "en"] and got[3] == got[5]
    assert langid.learn(docs.limit(0)) is None
    assert langid.identify(docs, None, out="found").where("found.lang = 'und' and found.score = 0").count() == 6
    assert langid.identify(docs.limit(0), model, out="found").count() == 0


def by_definition(model, text):
    """Probabilities from one n-gram after the other, in plain Python."""
    total, n = [0.0] * len(model.langs), 0
    for word in text.lower().split():
        raw = f"<{word}>".encode()
        for size in (3, 4):
            for i in range(len(raw) - size + 1):
                h = size
                for c in raw[i : i + size]:
                    h = ((h ^ c) * 0x9E3779B97F4A7C15) & (2**64 - 1)
                    h ^= h >> 29
                n += 1
                for j in range(len(total)):
                    total[j] += float(model.table[h % langid.BUCKETS, j])
    z = [(t / max(1, n) + float(b)) / model.temperature for t, b in zip(total, model.bias, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_query_equals_the_definition(spark, tmp_path):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(100_000 + i, t, None, "s", 1) for i, t in enumerate(["É è 中文 words", "", "x" * 3000, "tie", "tie"])], source.schema)
    source.limit(300).unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.op10_subword_softmax(spark, str(tmp_path)).collect()}
    for r in docs.collect():
        found = got[r.doc_id]
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (found.lang_pred, found.score) == ("und", 0.0)
            continue
        p = by_definition(model, r.text)
        assert found.score == pytest.approx(max(p), abs=1e-5) and p[model.langs.index(found.lang_pred)] == pytest.approx(max(p), abs=1e-5)


def test_ties_long_texts_and_clashing_columns(spark):
    model = langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS, 2)), np.zeros(2))
    df = spark.createDataFrame([(1, "any words", "x")], "i int, text string, language string")
    found = langid.identify(df, model)
    assert found.columns[-1] == "_language" and found.first()._language.lang == "aa"
    # a language that has long texts only is learned too
    rows = [(i, f"{name}word{name} " * 6000, name) for i in range(40) for name in ("qa", "zb")] + [(1000 + i, f"l{i}l{i} k{i}", f"lang{i}") for i in range(300)]
    assert set(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) >= {"qa", "zb"}
    assert len(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) > 200


def test_letters(spark):
    texts = ["½", "²", "①", "Ⅷ", "१२", "_ 7", "ª", "ʰ", "中", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = langid.Model(["aa"], np.zeros((langid.BUCKETS, 1)), np.zeros(1))
    got = [r.language.lang for r in langid.identify(df, model).orderBy("doc_id").collect()]
    assert got == ["und"] * 6 + ["aa"] * 4


def test_labels_without_end(spark):
    # a language for each text: no more are learned than the bound on labelled rows allows
    df = spark.range(50_000).selectExpr("id AS doc_id", "concat('word', id, ' text') AS text", "CASE WHEN id % 2 = 0 THEN 'most' ELSE concat('lang', id) END AS lang")
    model = langid.learn(df, total=320)
    assert len(model.langs) <= 20 and "most" in model.langs


def test_pieces_come_from_all_over_a_text(spark):
    text = "".join(chr(0x4E00 + i) for i in range(20_000))
    df = spark.createDataFrame([(text,), (text[:12_000],), ("short",), ("",)], "text string")
    whole, edge, short, empty = (r[0] for r in df.select(langid._pieces("text", 12_000)).collect())
    assert len(whole) == 12_007 and whole[0] == text[0] and whole[-1] == text[-1]
    assert {text.index(p[0]) // 2_500 for p in whole.split(" ")} == set(range(8))
    assert (edge, short, empty) == (text[:12_000], "short", "")
