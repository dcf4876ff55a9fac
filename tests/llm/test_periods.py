import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm.periods import collapse, op13_all_lags, periodic_runs, planted, runs_of


def brute_runs(words, min_length=12, min_exp=2):
    """Every stretch by every lag, one word at a time; the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exp * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def brute_kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def split(text):
    return (text or "").encode().split()


def brute_planted(doc_id, text):
    words = split(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_row(doc_id, words):
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(brute_kept(words, runs))).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, kept)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), max_size=6), st.sampled_from([(12, 2), (2, 2), (5, 3), (1, 2)]))
def test_runs_of_small_alphabets(texts, bounds):
    words = [[c.encode() for c in t] for t in texts]
    for got, w in zip(runs_of(words, [(1, None)] * len(words), *bounds), words, strict=True):
        assert sorted((s, e - s, q) for s, e, q in got.tolist()) == brute_runs(w, *bounds)


def periodic(rng, n):
    out = []
    while len(out) < n:
        unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))]
        out += (unit * rng.randint(1, 6))[: rng.randint(1, 200)]
    return [c.encode() for c in out[:n]]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_repetitive_texts(seed):
    rng = random.Random(seed)
    words = [periodic(rng, rng.randint(1, 600)) for _ in range(8)]
    for got, w in zip(runs_of(words, [(1, None)] * 8, 12, 2), words, strict=True):
        runs = [(s, e - s, q) for s, e, q in got.tolist()]
        assert sorted(runs) == brute_runs(w)
        assert collapse(w, got).split() == brute_kept(w, runs)


def test_lags_dealt_out_give_the_same(spark):
    rng = random.Random(9)
    texts = [b" ".join(periodic(rng, n)).decode() for n in (5, 60, 300, 500, 500)]
    texts += [texts[-1], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "low long, text string").withColumn("runs", F.lit("mine")).repartition(3, "low")
    whole, dealt = ({(r["low"]): (r["_runs"], r["collapsed"], r["runs"]) for r in periodic_runs(df, range_lags=k).collect()} for k in (1000, 20))
    assert whole == dealt and len(whole) == len(texts)
    for at, text in enumerate(texts):
        assert sorted(tuple(x) for x in whole[at][0]) == brute_runs(split(text))


def test_query_on_tables_against_brute_force(spark):
    table = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in op13_all_lags(spark, table).collect()}
    assert len(got) == len(rows)
    for r in short:
        assert got[r.doc_id] == brute_row(r.doc_id, brute_planted(r.doc_id, r.text))


def test_planted_words(spark):
    texts = [(i, t) for i in range(60) for t in ("one two three four five six seven eight nine ten", "", None, " \n")] + [(None, "a b c")]
    got = planted(spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit(1)))
    assert got.columns == ["doc_id", "text", "n"]
    assert [split(r.text) for r in got.collect()] == [brute_planted(*t) for t in texts]


def test_cases(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a " * 30, 3), (1, "a " * 30, 3), (2, "\t\n ", 4)], "doc_id long, text string, collapsed int")
    out = periodic_runs(df)
    assert out.columns == ["doc_id", "text", "collapsed", "runs", "_collapsed"]
    found = sorted((r["collapsed"], r["_collapsed"], [tuple(x) for x in r["runs"]]) for r in out.collect())
    assert found == [(1, "", []), (2, "", []), (3, "a", [(0, 30, 1)]), (3, "a", [(0, 30, 1)]), (4, "", [])]
    assert periodic_runs(df.where(F.lit(False))).count() == 0


def test_only_ascii_white_space_parts_words(spark):
    words = "a\u00a0b \x1cc"
    (row,) = periodic_runs(spark.createDataFrame([(" ".join([words] * 12),)], "text string")).collect()
    assert [tuple(x) for x in row.runs] == [(0, 24, 2)] and row.collapsed == words


def test_a_very_long_text_is_scanned_fast():
    rng = np.random.default_rng(1)
    words = [b"%d" % i for i in (rng.zipf(1.3, 60_000) % 5000).tolist()]
    words += words[:30_000]
    words[100:140] = [b"x", b"y"] * 20
    (got,) = runs_of([words], [(1, None)], 12, 2)
    assert [100, 140, 2] in got.tolist()
