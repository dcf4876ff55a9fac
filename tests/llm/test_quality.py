import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(9)
PARTS = ["a", "bb", "ccc", "é😀", "#", "*$", " ", "  ", "\n", "\n\n", "\t", "\x0b", " ", "\x1c"]
TEXTS = [None, "", " \n ", "a b c d e f g h i j", "w " * 20_000, "x" * 200_000, "a b c d e\n" * 30, "l1 a\nl1 a\n\n\nl1 a \n"]
TEXTS += ["".join(random.choices(PARTS, k=random.randint(1, 120))) for _ in range(150)]


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, made int")


def test_features_equal_brute_force(spark, tmp_path):
    docs(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    for r in quality.op3_quality_cascade(spark, str(tmp_path)).collect():
        n, chars, symbols, lines, repeats = brute(TEXTS[r.doc_id])
        assert tuple(r)[1:6] == (n, chars, symbols, lines, repeats), repr(TEXTS[r.doc_id])[:80]
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)


def test_cascade_keeps_what_features_keep_in_any_order(spark):
    df = docs(spark, TEXTS)
    kept = {r.doc_id for r in quality.quality_filter(df).collect()}
    assert kept == {r.doc_id for r in quality.quality_filter(df, rules=quality.RULES[::-1]).collect()}
    assert kept == {r.doc_id for r in quality.quality_scores(df).where(F.col("quality.failed").isNull()).collect()}
    assert quality.quality_filter(df).columns == df.columns


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = quality.op3_quality_cascade(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.sql(quality.OP3_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got.astype(str).equals(want[list(got.columns)].astype(str))


def test_rules_are_ordered_by_rejections(spark):
    rules = (quality.Rule("never", ("n_words",), lambda f: f["n_words"] < 0), quality.Rule("always", ("n_words",), lambda f: f["n_words"] >= 0))
    assert [r.name for r in quality.order_rules(docs(spark, TEXTS), rules=rules)] == ["always", "never"]


@pytest.mark.parametrize("texts", [[], ["aaa bbb ccc ddd eee fff ggg hhh iii jjj kkk"] * 3])
def test_empty_and_repeated(spark, texts):
    assert quality.quality_filter(docs(spark, texts) if texts else docs(spark, ["a"]).limit(0)).count() == len(texts)


def test_rules_behind_a_rejection_are_not_computed(spark):
    """A rule that raises where an earlier one rejects: it is never computed there."""
    df = docs(spark, ["short"] * 5 + ["aaa bbb ccc ddd eee fff ggg hhh iii jjj kkk lll %d" % i for i in range(20)])
    short = lambda f: f["n_words"] < 10
    first = quality.Rule("short", ("n_words",), short)
    quality.FEATURES["trap"] = lambda t, w: F.when(F.size(w) < 10, F.raise_error(F.lit("computed"))).otherwise(F.size(w)).cast("int")
    try:
        trap = quality.Rule("trap", ("trap",), lambda f: f["trap"] < 0)
        made = lambda ordered: df.where(quality.let(quality.words_of(F.col("text")), lambda w: quality.cascade(ordered, quality.Features(F.col("text"), w))).isNull())
        assert made([first, trap]).count() == 20
        with pytest.raises(Exception, match="computed"):
            made([trap, first]).count()
        # in the query's scores too, whose base features are known
        order = quality.order_rules
        quality.order_rules = lambda *a, **k: [first, trap]
        try:
            assert quality.quality_scores(df).where("quality.failed IS NULL").count() == 20
        finally:
            quality.order_rules = order
    finally:
        del quality.FEATURES["trap"]


def test_order_is_stable_and_by_cost(spark):
    texts = ["word%d and others that go on for a while " % i * 200 for i in range(60)]
    dear = quality.Rule("dear", ("n_words", "n_repeat_words"), lambda f: f["n_repeat_words"] >= 0)
    cheap = quality.Rule("cheap", ("n_words",), lambda f: f["n_words"] >= 0)
    for _ in range(3):
        assert [r.name for r in quality.order_rules(docs(spark, texts), rules=(dear, cheap))] == ["cheap", "dear"]
    # a feature that is computed anyway costs nothing
    assert [r.name for r in quality.order_rules(docs(spark, TEXTS), known=quality.BASE)][0] in ("few_words", "repeated_words", "word_length", "symbols")
