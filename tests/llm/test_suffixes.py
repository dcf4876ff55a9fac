import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffixes

random.seed(8)


def brute(docs, length=100):
    """(n_removed, n_spans, sha) of each document, by a dictionary of all windows."""
    seen, out = {}, {}
    for k, t in sorted(docs.items()):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            else:
                seen[w] = 1
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[k] = (len(raw), int(gone[: len(raw)].sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def words(n, alphabet="abcdefghij é"):
    return "".join(random.choices(alphabet, k=n))


def texts():
    passage, other, long = words(400), words(150), words(30_000)
    out = [None, "", words(50), "a" * 99, "a" * 100, "a" * 350, "ab" * 300, "abcdefg" * 100, passage, passage, long, long[5000:9000] + words(200) + long[100:20_000]]
    for i in range(60):
        out.append(words(random.randint(0, 200)) + (passage if i % 2 else passage[i : i + 180]) + words(random.randint(0, 200)) + (other if i % 3 == 0 else ""))
    base = words(900)
    for _ in range(40):
        at = random.randint(0, 880)
        out.append(base[:at] + words(3) + base[at + 3 :])
    out += [words(60) + "xy" * random.randint(40, 90) + words(60) for _ in range(10)] + ["é" * 70 + words(20)] * 3
    random.shuffle(out)
    return {3 * i - 7: t for i, t in enumerate(out)}


@pytest.mark.parametrize("block,common,sort", [(1 << 20, 16, 200_000), (500, 2, 50)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, block, common, sort):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "COMMON", common)
    monkeypatch.setattr(suffixes, "SORT_WINDOWS", sort)
    docs = texts()
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op5_suffix_array(spark, str(tmp_path)).collect()}
    assert len(got) == len(want)
    assert [k for k in want if got[k] != want[k]] == []


def test_segments_in_small_blocks(monkeypatch):
    """In one process, without Spark: blocks and thresholds of any size give the same answer."""
    docs = texts()
    for block, common in ((300, 1), (2000, 3)):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        monkeypatch.setattr(suffixes, "COMMON", common)
        rows = [np.concatenate(c) for c in zip(*(suffixes.segments_of(b) for b in suffixes._slices(list(docs), list(docs.values()), 100)), strict=True)]
        assert rows[4].sum() <= sum(max(0, len((t or "").encode()) - 99) for t in docs.values())


def test_multikey():
    words_ = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.uint64)
    first = np.random.default_rng(2).integers(0, 2, 500)
    order, group = suffixes.multikey_groups(words_, first)
    rows = [(first[i], *words_[i]) for i in order]
    assert all((rows[i] == rows[i - 1]) == (group[i] == group[i - 1]) for i in range(1, 500)) and len(set(rows)) == group[-1] + 1


def test_cases(spark):
    t = words(300)
    df = spark.createDataFrame([(1, t, 5), (1, t, 5), (2, t, 6), (None, t[:150], 7)], "doc_id long, text string, _k int")
    rows = sorted((r._k, len(r.deduplicated.kept), len(r.deduplicated.spans)) for r in suffixes.remove_repeats(df).collect())
    left = len(t.encode()) - len(t[:150].encode())
    assert rows == [(5, left, 1), (5, left, 1), (6, 0, 1), (7, len(t[:150].encode()), 0)]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_texts_without_an_id_of_their_own(spark, monkeypatch, broadcast):
    """Nothing is cut out of texts because another text of their id has it, and strings at equal places of them are repeats."""
    monkeypatch.setattr(suffixes, "BROADCAST_IDS", broadcast)
    shared, start, own = words(200), words(150), [words(300) for _ in range(6)]
    docs = [(None, own[0] + shared), (None, own[1] + own[2]), (None, start + own[3]), (None, start + own[4]), (5, own[5] + shared), (5, shared), (9, own[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    left = {(r.doc_id, r.text): bytes(r.deduplicated.kept) for r in suffixes.remove_repeats(df).collect()}
    assert len(left) == len(docs)
    size = lambda i: len(docs[i][1].encode()) - len(left[docs[i]])
    assert [size(0), size(1)] == [0, 0] and left[docs[5]] == left[docs[6]] == b""
    assert min(size(2), size(3)) == 0 and len(start.encode()) <= max(size(2), size(3)) < len(start.encode()) + 8
    assert len(shared.encode()) <= size(4) < len(shared.encode()) + 8


def test_a_column_of_the_result_s_name(spark):
    text = "".join(random.choice("abcdefgh") for _ in range(300))
    done = suffixes.remove_repeats(spark.createDataFrame([(1, text, 5), (2, text, 6)], "doc_id long, text string, deduplicated int"))
    assert done.columns == ["doc_id", "text", "deduplicated", "_deduplicated"]
    assert {(r.deduplicated, len(r._deduplicated.kept)) for r in done.collect()} == {(5, 300), (6, 0)}
