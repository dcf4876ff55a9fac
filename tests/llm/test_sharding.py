import zlib
from collections import Counter

import pytest

from lodestone.llm import sharding


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, rec string")


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 400])
def test_law_and_columns(spark, bucket_bytes):
    rows = [(i, t, 7, "r") for i, t in enumerate([None, "", "é" * 50, "x" * 5000] + ["same"] * 300 + [f"text {i}" for i in range(200)])] + [(3, "twice", 7, "r")] * 50
    df = docs(spark, rows).repartition(5)
    got = sharding.shard_rows(df, 24, bucket_bytes=bucket_bytes).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    sizes = Counter(r._shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r._shard == s) == list(range(sizes[s]))
    # in random order: neighbours in a shard are not neighbours in the table
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r._shard))]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < 60


def test_query(spark, tmp_path):
    texts = [None, "", "é", "x" * 100_000] * 20
    docs(spark, [(i, t, 0, "") for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    for r in sharding.op7_two_pass_shuffle(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_files_and_empty_table(spark, tmp_path):
    df = docs(spark, [(i, f"t{i}", 0, "") for i in range(60)])
    sharding.write_shards(df, str(tmp_path / "out"), 6)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60 and len(list((tmp_path / "out").glob("_shard=*"))) == 6
    assert sharding.shard_rows(df.limit(0)).count() == 0


def test_another_run_gives_the_same_order(spark):
    df = docs(spark, [(i % 50, f"t{i}", 0, "") for i in range(3000)]).repartition(7).cache()
    df.count()
    runs = [{(r.doc_id, r.text): (r._shard, r.slot) for r in sharding.shard_rows(df, bucket_bytes=2000).collect()} for _ in range(3)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 3000
    df.unpersist()
