import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing
from lodestone.llm.common import tokenizer_path

TOK = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
random.seed(4)
PARTS = ["word", " ", "  ", "\n", "\t ", "é", "😀", "한국어", "don't", "'ll", "1234", "!?", " ", "\x1c", "\x85", "　", "the", "\n\n "]
TEXTS = [None, "", " ", "  a", "a ", "x" * 9000, "ab " * 7000] + ["".join(random.choices(PARTS, k=random.randint(1, 60))) for _ in range(500)]


def test_tokens_equal_the_library():
    tokens = packing.Tokens(tokenizer_path(packing.TOKENIZER), tokenizer_path(packing.RANKS))
    for t in [*TEXTS, " " * 20000, "a<|endoftext|> b", "z" * 50000, "\n" * 299]:
        raw = tokens(t or "")
        assert np.frombuffer(raw, "<u4").tolist() == TOK.encode(t or "", add_special_tokens=False).ids, repr(t)


def check(rows, texts, capacity):
    places = {}
    for i, t in enumerate(texts):
        ids = TOK.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted([r for r in rows if r.doc_id == i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0
        assert all(r.length == capacity for r in own[1:]) and sum(r.length for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_places(spark, capacity):
    texts = TEXTS[:120] + ["same text here"] * 600
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, capacity=capacity).collect()
    bins = check(rows, texts, capacity)
    assert bins <= 1.02 * -(-sum(r.length for r in rows) // capacity) + 1


def test_operators_keep_every_piece():
    rng = random.Random(2)
    counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(60)}
    a, b = packing.best_fit({}, counts, 100), packing.best_fit({}, counts, 100, rng.sample(sorted(counts), len(counts)))
    for _ in range(30):
        a, b = packing.crossover(a, b, counts, 100, rng), packing.mutate(b, 100, rng)
        assert packing._used(a) == counts and packing._used(b) == counts
        assert max(map(packing._fill, a)) <= 100
    assert packing.score(packing.evolve(counts, [a, b], 100, rng)[0], 100) <= packing.score(a, 100)


def triplets(bins, capacity, seed):
    """Pieces that fill ``bins`` bins by threes, where the longest two of a bin leave no room for what best fit takes next."""
    rng, counts = random.Random(seed), Counter()
    for _ in range(bins):
        a = rng.randint(38 * capacity // 100, 49 * capacity // 100)
        b = rng.randint(capacity // 4, (capacity - a) // 2)
        counts.update((a, b, capacity - a - b))
    return dict(counts)


@pytest.mark.parametrize("seed", range(3))
def test_search_beats_best_fit(spark, seed):
    counts = triplets(20, 1000, seed)
    plain = sum(packing.best_fit({}, counts, 1000).values())
    found = packing.pack_histogram(spark, counts, 1000)
    assert packing._used(found) == counts and max(map(packing._fill, found)) <= 1000
    assert 20 <= sum(found.values()) < plain


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "some text"), (1, "some text"), (2, None)], "length long, text string")
    rows = packing.pack_documents(df, key="length").collect()
    assert rows[0].asDict().keys() == {"length", "piece", "start", "_length", "ids_crc32", "sequence_id", "offset"}
    assert sorted((r["length"], r._length) for r in rows) == sorted([(1, rows[0]._length if rows[0]["length"] == 1 else 3)] * 2 + [(2, 1)])
    assert sorted(r.offset for r in rows)[0] == 0 and len({r.sequence_id for r in rows}) == 1


def test_query(spark, tmp_path):
    texts = [None, "", "a b c " * 900, "words " * 2500] + ["a text of some words"] * 40
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id int").write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.op6_grouping_genetic(spark, str(tmp_path)).collect()
    ids = {i: [*TOK.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and (r.start > 0) == (r.piece > 0)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
    assert len(bins) == -(-sum(r.length for r in rows) // 2048)
