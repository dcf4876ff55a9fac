import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lodestone.llm import alignment
from lodestone.llm.alignment import Sides, align_texts, elementary, link_statistics, op11_elementary_intervals, pair_counts
from lodestone.llm.common import tokenizer_path

TEXTS = [
    None, "", " ", "  ", "\n", "a", "The cat sat on the mat.", "The cat sat on the mat.", "two  spaces and\ttabs \n\n  lines  \r\n end ",
    "it's we'll I'd 'quoted' don't", "naïve café – ½ ① 語 日本語テキスト العربية", "bad ▁ marker", "<|endoftext|> and </s> <s> <unk> <0x41> [CLS]",
    "x" * 300 + " " + "=" * 200 + "   wide \x1c sep \x85 next", "12345 67,890.12 1 2 3", "emoji 👩‍👩‍👧 🏳️‍🌈 ‍", "\x00 nul \x01", "the the the the cat cat sat",
    "word " * 500, "a" + " " * 2000 + "b", "x" + "\n" * 1500 + " y", " lead", "trail ", " \n bar", "foo \nbar", "foo\n bar",
]


@pytest.fixture(scope="module")
def sides():
    return Sides(tokenizer_path("byte_bpe_50k"), tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def first():
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def brute(sides, first, texts):
    """Whole texts by the libraries, groups by sets of ends, every link by itself."""
    docs = []
    for text in texts:
        a = first(" " + text) if text else []
        b = sides.b.encode(text) if text else []
        if not text or not sides.faithful(" " + text, a, b):
            docs.append(([], [], []))
            continue
        ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((sides.a_bytes, a), (sides.b_bytes, b))]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, begin = [], 0
        for end in shared:
            groups.append(tuple([i for i, e in zip(ids, es, strict=True) if begin < e <= end] for ids, es in ((a, ends[0]), (b, ends[1]))))
            begin = end
        docs.append((a, b, groups))
    held = Counter(p for _, _, groups in docs for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        digest = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(digest.encode()).hexdigest() if a else ""))
    return out, held


def rows(df, at="at"):
    return [tuple(r)[1:] for r in df.orderBy(at).collect()]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "at long, text string").repartition(3, "at")


def test_against_whole_texts(spark, sides, first):
    expected, held = brute(sides, first, TEXTS)
    assert rows(link_statistics(frame(spark, TEXTS))) == expected
    found = {(r.a_id, r.b_id): r.documents for r in pair_counts(frame(spark, TEXTS)).collect()}
    assert found == dict(held)


def test_small_tables_and_blocks(spark, sides, first, monkeypatch):
    # one document a block, tables that start anew, keys made distinct in parts
    expected, _ = brute(sides, first, TEXTS)
    aligner = alignment.Aligner(sides)
    monkeypatch.setattr(alignment, "PIECE_CHARS", 30)
    monkeypatch.setattr(alignment, "_AT_ONCE", 3)
    block = alignment.Block(aligner)
    for text in TEXTS:
        cut = alignment.chunks_of(text) if text else []
        aligner.add(set(cut))
        block.add([cut])
    import pyarrow as pa

    block.records = [pa.RecordBatch.from_pydict({"at": list(range(len(TEXTS)))})]
    row = block.row(7, ["at"]).to_pydict()
    assert [tuple(x) for x in zip(row["n_a"][0], row["n_b"][0], row["n_groups"][0], row["n_links"][0], strict=True)] == [e[:4] for e in expected]
    assert row["hashes"][0] == [e[6] for e in expected]
    assert {p: n for p, n in zip(row["pairs"][0], row["pair_docs"][0], strict=True)} == {(a << 32) | b: n for (a, b), n in brute(sides, first, TEXTS)[1].items()}


def test_a_table_that_starts_anew(spark, sides, first, monkeypatch):
    # read where the plan is made, so the function that goes to the workers has them
    monkeypatch.setattr(alignment, "TABLE_ROWS", 5)
    aligner = alignment.Aligner(sides)
    for text in TEXTS[5:12]:
        if aligner.full():
            aligner.clear()
        aligner.add(set(alignment.chunks_of(text)))
        block = alignment.Block(aligner)
        block.add([alignment.chunks_of(text)])
        assert block.hashes == [brute(sides, first, [text])[0][0][6]]


def test_documents_of_the_tables(spark, sides, first):
    table = "/root/testdata/sf0.001"
    docs = [r.text for r in spark.read.parquet(f"{table}/documents.parquet").orderBy("doc_id").collect()]
    expected, _ = brute(sides, first, docs)
    got = op11_elementary_intervals(spark, table)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got, "doc_id") == expected


def test_groups_of_spans(spark, sides, first):
    kept = [t for t in TEXTS if t]
    for r in align_texts(frame(spark, kept)).collect():
        a = [i for g in r.groups for i in g.a]
        if r.groups:
            assert a == first(" " + r.text)
            assert [i for g in r.groups for i in g.b] == sides.b.encode(r.text)
            assert r.groups[-1].end == len((" " + r.text).encode())
        else:
            assert "▁" in r.text


def test_long_white_space(sides, first):
    for text in (" x" + "\n" * 300_000 + " y", " " * 300_000, " a" + " " * 299 + "b"):
        (a,), (b,) = sides.encode([text])
        assert a == first(text) and b == sides.b.encode(text[1:]) and sides.faithful(text, a, b)


def test_elementary_intervals():
    ends, a, b, group = elementary(np.array([2, 5, 6]), np.array([1, 4, 5, 6]))
    assert ends.tolist() == [1, 2, 4, 5, 6]
    assert a.tolist() == [0, 0, 1, 1, 2] and b.tolist() == [0, 1, 1, 2, 3]
    assert group.tolist() == [0, 0, 0, 0, 1]


def test_a_long_group_is_counted_by_distinct_ids():
    n = 30_000
    g = np.zeros(n, np.int64)
    group, pairs, links = alignment.products(g, np.arange(n) % 3, g, np.arange(n) % 2, 1)
    assert len(pairs) == 6 and int(links.sum()) == n * n


def test_cases(spark):
    schema = T.StructType([T.StructField("n_a", T.StringType()), T.StructField("text", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("docs", T.StringType())])
    df = spark.createDataFrame([("x", "same text", 1, None), ("x", "same text", 1, None), (None, None, None, "y")], schema)
    out = link_statistics(df)
    assert out.columns[:4] == ["n_a", "block", "docs", "_n_a"]
    found = sorted((r["n_a"] or "", r["_n_a"], r["count_sum"]) for r in out.collect())
    assert found[0] == ("", 0, 0) and found[1] == found[2] and found[1][2] == 4
    assert link_statistics(df.where(F.lit(False))).count() == 0
    assert pair_counts(df.where(F.lit(False))).count() == 0
    assert link_statistics(df.select("text")).count() == 3


def test_blocks_are_written_few_to_a_file(spark, monkeypatch):
    # a file's blocks are held together by its writer and decoded together by its reader
    written = []
    plain = alignment.materialize

    def spied(df, name, *bounds):
        written.append((name, bounds))
        return plain(df, name, *bounds)

    monkeypatch.setattr(alignment, "materialize", spied)
    link_statistics(frame(spark, TEXTS))
    assert written[0] == ("aligned-blocks", (alignment.FILE_BLOCKS,)) and alignment.FILE_BLOCKS * alignment.BLOCK_BYTES <= 8 << 20
    assert len(plain(spark.range(20).coalesce(1), "few", 4).inputFiles()) == 5
