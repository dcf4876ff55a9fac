import hashlib
import random

import sentencepiece
from pyspark.sql import functions as F

from lodestone.llm import pieces
from lodestone.llm.common import tokenizer_path

SP = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))
random.seed(3)
PARTS = ["word", " ", "  ", "▁", "▁▁", "\n", "\t ", "é", "😀", "한국어", "\x00", "<s>", "</s>", "1234", "Ḁ", "　", "the"]
TEXTS = [None, "", " ", "  ", "▁", "a ", " a", "a  b ", "x" * 5000, "ab " * 3000, "\n \n"] + ["".join(random.choices(PARTS, k=random.randint(1, 40))) for _ in range(400)]


def test_whole_texts_equal_the_library(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pieces.op1_distinct_chunks(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = SP.encode(t or "") + [SP.eos_id()]
        assert got[i].n_tokens == len(ids), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(t)
        assert got[i].decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest(), repr(t)


def test_decoding_any_ids(spark):
    rows = [(i, random.choices([1, 2, 28705, 259, 264, 287, 13, 200, 230, 241, 28708, 1000, 5000], k=random.randint(0, 12))) for i in range(200)] + [(200, None), (201, []), (202, [259, 264])]
    found = pieces.decode_ids(spark.createDataFrame(rows, "i int, ids array<int>")).collect()
    assert [r.decoded for r in sorted(found)] == [SP.decode(ids or []) for _, ids in rows]
    some = pieces.decode_ids(spark.createDataFrame([(1, [259, None, 264]), (2, [None])], "i int, ids array<int>"))
    assert [r.decoded for r in sorted(some.collect())] == [SP.decode([259, 264]), ""]


def test_clashing_columns_and_slices(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS[:60])], "doc_id long, text string, ids string, decoded int")
    coded = pieces.encode_texts(docs)
    assert coded.columns == [*docs.columns, "_ids"] and pieces.decode_ids(coded, "_ids").columns[-1] == "_decoded"
    assert [r._decoded for r in pieces.decode_ids(coded, "_ids").orderBy("doc_id").collect()] == [SP.decode(SP.encode(t or "")) for t in TEXTS[:60]]


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7)], "doc_id long, text string, n int")
    assert pieces.decode_ids(pieces.encode_texts(docs)).select("decoded", "n").collect() == [("a b", 7)] * 2
    assert pieces.encode_texts(docs.limit(0)).count() == 0
