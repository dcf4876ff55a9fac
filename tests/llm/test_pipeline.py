import random
import re
from collections import Counter

import test_neardup
import test_packing
import test_pii
import test_suffixes

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    n, size = len(words), sum(map(len, words))
    plain = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    further = 2 * sum(not any(c.isalpha() for c in w) for w in words) > n or 2 * sum(x.endswith(("...", "…")) for x in plain) > len(lines) or 10 * sum(x[0] in "-*•‣" for x in plain) > 9 * len(lines)
    return not (further or n < 10 or 100 * len(covered) > 20 * n or size < 2 * n or size > 20 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or 2 * (len(lines) - len(set(lines))) > len(lines))


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, stages = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        stages.append({r.doc_id: r for r in docs.collect()})
        if len(stages) < 5:
            assert docs.columns == columns and docs.count() == len(stages[-1])
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {k: t for k, t in source.items() if good(t)}
    assert {k: r.text for k, r in stages[0].items()} == want

    keys = sorted(want)
    classes, near = test_neardup.brute([want[k] for k in keys], test_neardup.weighted([want[k] for k in keys]))
    assert not near
    want = {keys[i]: want[keys[i]] for i in set(classes)}
    assert {k: r.text for k, r in stages[1].items()} == want

    left = test_suffixes.brute(want)
    gone = {k for k, (n, removed, _, _) in left.items() if n == removed}
    assert set(stages[2]) == set(want) - gone
    for k, r in stages[2].items():
        assert r.n_chars == len(r.text) and 0 <= left[k][0] - left[k][1] - len(r.text.encode()) <= 6 * left[k][2]

    assert set(stages[3]) == set(stages[2])
    for k, r in stages[3].items():
        assert r.n_chars == len(r.text)
        if not test_pii.brute(stages[2][k].text) and '"' not in r.text:
            assert r.text == stages[2][k].text
    assert sum(bool(re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text)) for r in stages[3].values()) > 0
    texts = {k: r.text for k, r in stages[3].items()}

    rows = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), DATA).collect()
    order = {k: i for i, k in enumerate(sorted(texts))}
    renamed = [type("R", (), {**r.asDict(), "doc_id": order[r.doc_id]}) for r in rows]
    test_packing.check(renamed, [texts[k] for k in sorted(texts)], 2048)


def test_run_has_the_last_stage_s_rows(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 50


def test_cases(spark):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vat") for c in ("", "is", "or", "em")]
    t = [" ".join(rng.choice(words) for _ in range(80)) + "." for _ in range(5)]
    rows = [(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (8, t[2]), (9, None), (10, ""), (11, t[4]), (11, t[4])]
    extra = {"deduplicated": 1, "pii": 2, "_k": 3, "u": 4, "runs": 5}
    rows = [(k, text, "en", "s", len(text or ""), *extra.values()) for k, text in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in extra))
    columns, empty, kept = docs.columns, docs.limit(0), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs, empty = stage(spark, docs, DATA).cache(), stage(spark, empty, DATA).cache()
        assert docs.columns == columns and empty.columns == columns and empty.count() == 0
        kept.append(sorted((r.doc_id or 0, r.text) for r in docs.collect()))
        assert all(tuple(r)[5:] == tuple(extra.values()) and r.n_chars == len(r.text) for r in docs.collect())
    assert len(kept[0]) == 7
    assert kept[1] == kept[2] == kept[3] == sorted([(0, t[0]), (0, t[1]), (7, t[2]), (7, t[3]), (11, t[4])])
    last = corpus_pipeline.STAGES[4][1]
    assert sorted(r.doc_id or 0 for r in last(spark, docs, DATA).collect()) == [0, 0, 7, 7, 11]
    assert last(spark, empty, DATA).count() == 0
