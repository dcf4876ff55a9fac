import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import common
from lodestone.llm import neardup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(6)
VOCABULARY = ["".join(random.choices("abcdefgé", k=random.randint(1, 8))) for _ in range(2000)]


def words(n):
    return random.choices(VOCABULARY, k=n)


def corpus():
    out = [None, "", "one two", "one two", "a b c d e", "a b c d e f", " \n a b c d e \t"]
    for _ in range(12):
        base = words(random.randint(60, 300))
        for _ in range(random.randint(1, 12)):
            copy = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 3, 5, 8])):
                copy[random.randrange(len(copy))] = random.choice(VOCABULARY)
            out.append(" ".join(copy))
    passage = words(80)
    out += [" ".join(words(60) + passage + words(60)) for _ in range(30)]
    out += [" ".join(words(4) * 40), " ".join(words(200)), "x" * 5000]
    random.shuffle(out)
    return out


def sets(texts):
    return [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (WORD.findall(t or "") for t in texts)]


def brute(texts, idf_of_set, threshold=0.8):
    """Classes by all pairs, given each set's weights."""
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = []
    for i in range(len(texts)):
        for j in range(i):
            a, b = idf_of_set[i], idf_of_set[j]
            if (texts[i] or "") == (texts[j] or ""):
                s = 1.0
            elif not a or not b:
                continue
            else:
                shared = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
                s = shared / (sum(a.values()) + sum(b.values()) - shared)
            if abs(s - threshold) < 1e-4:
                near.append((i, j))
            if s >= threshold:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], near


def weighted(texts):
    """Sets with the operator's own weights, its hashes taken one text at a time."""
    every = sets(texts)
    frequency = np.zeros(nd.FEATURES, np.int64)
    hashed = [nd.shingles([t]) for t in texts]
    for h, _, _ in hashed:
        np.add.at(frequency, (h & np.uint64(nd.FEATURES - 1)).astype(int), 1)
    idf = nd.idf_of(len(texts), frequency)
    for s, (h, n, _) in zip(every, hashed, strict=True):
        assert sorted(s.values()) == sorted(n.tolist())
    return [dict(zip(h.tolist(), nd.weights(h, n, idf).tolist(), strict=True)) for h, n, _ in hashed]


@pytest.mark.parametrize("members,rounds", [(512, 3), (4, 1)])
def test_classes_equal_all_pairs(spark, monkeypatch, members, rounds):
    monkeypatch.setattr(nd, "MEMBERS", members)
    monkeypatch.setattr(nd, "ROUNDS", rounds)
    texts = corpus()
    want, near = brute(texts, weighted(texts))
    assert not near
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, k int").repartition(5)
    got = {r.k: r["class"] for r in nd.near_duplicates(docs).collect()}
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []
    kept = nd.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    old = nd._SEEDS
    try:
        nd._SEEDS = rng.integers(0, 2**64, (3000, 2), dtype=np.uint64) | np.uint64(1)
        for shared, own in ((50, 10), (20, 40), (5, 60)):
            h = rng.integers(0, 2**44, shared + 2 * own, dtype=np.uint64)
            a, b = np.sort(np.r_[h[:shared], h[shared : shared + own]]), np.sort(np.r_[h[:shared], h[shared + own :]])
            wa, wb = (rng.uniform(0.5, 3, len(x)).astype(np.float32) for x in (a, b))
            sig = nd.signatures(np.r_[a, b], np.r_[wa, wb], np.array([0, len(a), len(a) + len(b)]))
            assert (sig[0] == sig[1]).mean() == pytest.approx(nd.similarity((a, wa), (b, wb)), abs=0.04)
    finally:
        nd._SEEDS = old


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 101), (200, 201)] + [(1000, i) for i in range(900, 1000)]
    got = {r.u: r["class"] for r in nd.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {**{i: 0 for i in range(1, 31)}, 105: 100, 101: 100, 201: 200, **{i: 900 for i in range(901, 1001)}}
    assert got == want


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e g h")], "doc_id long, text string")
    assert sorted((r.k, r["class"]) for r in nd.near_duplicates(docs).collect()) == [(nd.NULL_KEY, nd.NULL_KEY), (1, 1), (1, 1), (2, 1)]
    assert sorted(str(r.doc_id) for r in nd.keep_first(docs).collect()) == ["1", "None"]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_texts_without_an_id_of_their_own(spark, tmp_path):
    one, other = " ".join(words(120)), " ".join(words(120))
    near = one.rsplit(" ", 1)[0] + " end"
    rows = [(None, one), (None, other), (None, other), (None, None), (5, "a b c d e f g"), (5, "h i j k l m n"), (7, near), (8, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(None, None), (None, one), (None, other), (5, "a b c d e f g"), (5, "h i j k l m n")]
    assert sorted(map(str, map(tuple, nd.keep_first(docs).collect()))) == sorted(map(str, want))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = nd.op2_weighted_minhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len({r.class_label for r in got}) == len(want)
    assert [sorted(str(r.doc_id) for r in got if r.class_label == c) for c in sorted({r.class_label for r in got}, key=lambda c: sorted(str(r.doc_id) for r in got if r.class_label == c))] == [["5"], ["5"], ["7", "None"], ["8", "None", "None"], ["None"]]


def test_names_that_two_texts_share_are_taken_anew(spark, monkeypatch):
    name = nd._name
    monkeypatch.setattr(nd, "_name", lambda text, salt: name(text, salt) if salt else name(nd.F.substring(text, 1, 1), salt))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a h i j k l"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(r.doc_id for r in nd.keep_first(docs).collect()) == [1, 2]


def test_query_equals_the_definition(spark, tmp_path):
    """The query against TF-IDF by the words themselves: nothing of the operator's but the formula."""
    texts = corpus()
    every = sets(texts)
    df = Counter(x for s in every for x in s)
    n = len(texts)
    idf = {x: 1 + math.log((1 + n) / (1 + d)) / math.log(1 + n) for x, d in df.items()}
    want, near = brute(texts, [{x: c * idf[x] for x, c in s.items()} for s in every])
    assert not near
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in nd.op2_weighted_minhash(spark, str(tmp_path)).collect()}
    assert [i for i in range(n) if got[i].class_id != want[i]] == []
    assert sorted(i for i in got if got[i].kept) == sorted(set(want))


def test_hot_keys_are_dealt(spark, monkeypatch):
    """Salted joins, with bounds small enough for a small table, give what plain ones give."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    many = spark.createDataFrame([(i % 4 if i % 3 else None, i) for i in range(200)] + [(9, 1)], "k int, i int")
    one = spark.createDataFrame([(k, f"v{k}", 60) for k in (0, 1, 2, 7)], "k int, v string, n int")
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(one.drop("n"), "k", how).collect()))
        assert sorted(map(str, common.salted_join(many, one.drop("n"), ["k"], "i", None, how).collect())) == want
        assert sorted(map(str, common.salted_join(many, one, ["k"], "i", "n", how).collect())) == want
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    assert common.salted_join(many, one, ["k"], "i", "n").count() == many.join(one, "k").count()


def test_counts_merge_in_levels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(words(30))) for i in range(90)], "k long, text string").repartition(9)
    want = nd.document_frequencies(docs)
    monkeypatch.setattr(nd, "MERGE", 2)
    got = nd.document_frequencies(docs)
    assert want[0] == got[0] == 90 and (want[1] == got[1]).all() and want[1].sum() > 0
