"""Buckets, running sums, postings and pivots against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import buckets, calibration, gram_index, pivots, ranking, retrieval

SCHEMA = "path string, n int"


def table(spark, path):
    return sorted((r.path, r.n) for r in buckets.read_table(spark, path, SCHEMA, "path").collect())


def test_an_update_rewrites_its_buckets_only(spark, tmp_path):
    path, count = str(tmp_path / "t"), buckets.bucket_count(10_000)
    rows = [(f"src/f{i}.py", i) for i in range(10_000)]
    assert count == 40
    buckets.write_table(spark.createDataFrame(rows, SCHEMA), path, "path", count)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    sizes = buckets.sizes(spark, path)
    one = spark.createDataFrame([("src/f77.py", -1), ("src/f77.py", -2)], SCHEMA)
    done = buckets.replace_rows(spark, path, SCHEMA, "path", count, one.limit(0).select("path"), one)
    assert len(done.buckets) == 1 and done.of == 40
    assert len(files() & before) == len(before) - 1 == 39
    # bytes that were written, of all
    written = buckets.sizes(spark, path)[done.buckets[0]]
    assert written < 2 * sizes[done.buckets[0]] and written < sum(sizes.values()) / 20
    assert table(spark, path) == sorted([r for r in rows if r[1] != 77] + [("src/f77.py", -1), ("src/f77.py", -2)])
    plan = buckets.read_table(spark, path, SCHEMA, "path", [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and plan.count("bucket") > 0


def test_updates_of_any_kind(spark, tmp_path):
    rng, path, have = random.Random(2), str(tmp_path / "t"), {f"p{i}": i for i in range(12)}
    buckets.write_table(spark.createDataFrame(list(have.items()), SCHEMA), path, "path", 5)
    for turn in range(4):
        gone = rng.sample(sorted(have), min(len(have), 4)) + ["never there"]
        new = {f"p{rng.randrange(30)}": 100 * turn + i for i in range(3)} if turn != 2 else {}
        have = {k: v for k, v in have.items() if k not in gone} | new
        for _ in range(2):  # an update that is run again changes nothing
            buckets.replace_rows(spark, path, SCHEMA, "path", 5, spark.createDataFrame([(g,) for g in gone], "path string"), spark.createDataFrame(list(new.items()), SCHEMA))
        assert table(spark, path) == sorted(have.items())
    # the last row of every bucket goes, and none comes back
    buckets.replace_rows(spark, path, SCHEMA, "path", 5, spark.createDataFrame([(k,) for k in have], "path string"), spark.createDataFrame([], SCHEMA))
    assert table(spark, path) == []
    none = buckets.replace_rows(spark, path, SCHEMA, "path", 5, spark.createDataFrame([], "path string"), spark.createDataFrame([], SCHEMA))
    assert none.buckets == []


def test_a_failed_update_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.write_table(spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA), path, "path", 3)
    bad = spark.createDataFrame([("a", 1)], SCHEMA).withColumn("n", F.when(F.col("n") == 1, F.raise_error("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        buckets.replace_rows(spark, path, SCHEMA, "path", 3, bad.select("path").limit(0), bad)
    assert table(spark, path) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("block_rows", [10_000, 20])
def test_ranks_and_running_sums(spark, block_rows):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 1, 1, 2, 7, rng.randint(0, 99)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(5)
    got = {r.id: r["rank"] for r in ranking.ranked(df, ["v", "id"], ["g"], block_rows=block_rows).collect()}
    order = sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    for g in ("a", "b", None):
        assert [got[r[2]] for r in order if r[0] == g] == list(range(1, sum(r[0] == g for r in rows) + 1))
    blocked = ranking.order_blocks(df, ["v", "id"], "at", block_rows)
    assert blocked.select("at").distinct().count() == (1 if block_rows > 300 else 15)
    sums, total = {}, 0
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        total += r[1] or 0
        sums[r[2]] = total
    assert {r.id: r.s for r in ranking.running_sums(blocked, "v", ["v", "id"], [], "at", "s").collect()} == sums
    assert ranking.ranked(df.limit(0), ["v"]).count() == 0


def test_percentiles_have_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 50)
    values = spark.range(1000).select((F.col("id") * 7 % 400).alias("n"))
    monkeypatch.setattr(calibration, "order_blocks", lambda df, order, name: ranking.order_blocks(df, order, name, 50))
    found = calibration.percentiles(values, "n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in "".join(x for x in plan.splitlines() if "Exchange" in x and "sum" not in x and "partial" not in x and "Broadcast" not in x) or "Window [sum(n" not in plan
    values = sorted(i * 7 % 400 for i in range(1000))
    assert {r.p: r.value for r in found.collect()} == {p: values[min(999, 1000 * p // 100)] for p in calibration.PERCENTILES}


def chunk_rows(spark, n=60):
    rng = random.Random(6)
    words = ["Order", "status", "ÄÖ", "x_y", "%", "it's", "straße", "a\\b", "TOKEN", "\n"]
    rows = [(i, f"name{i}", " ".join(rng.choice(words) + rng.choice(["", "1"]) for _ in range(rng.randint(0, 12))) or None, f"d/{i % 7}.py") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, name string, text string, file_path string").repartition(3)


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    chunks, path = chunk_rows(spark), str(tmp_path / "p")
    gram_index.write_postings(gram_index.postings(chunks, ("name", "text", "file_path"), "chunk_id"), path)
    find = lambda wanted: gram_index.read_postings(spark, path, wanted)
    for tokens in (["Order"], ["status", "ORDER"], ["Äö1"], ["ÄÖ1 "], ["nowhere to be", "name7"], ["d/3.py"], ["it's x_y", "a\\b"], ["\n1 "]):
        held = gram_index.candidates(find, tokens, "chunk_id")
        got, want = ([tuple(r) for r in retrieval.literal_search(c, tokens).collect()] for c in (chunks.join(held, "chunk_id", "left_semi").select(*chunks.columns), chunks))
        assert got == want
    assert gram_index.candidates(find, ["status", "x_"], "chunk_id") is None
    plan = find(["ord"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part", "part") or "PartitionFilters" in plan
    assert "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "") or "EqualTo(gram" in plan
    literals = spark.createDataFrame([(x,) for x in ("order", "x_y", "%", "", "stra\x00x", "status1", "straße", "zzzz", "Äö")], "literal string")
    texts = chunks.select("chunk_id", "text")
    got, want = (sorted(tuple(r) for r in j.select("chunk_id", "literal").collect()) for j in (gram_index.indexed_join(gram_index.read_postings(spark, path), texts, literals, "chunk_id"), retrieval.substring_join(texts, literals)))
    assert got == want and len({x[1] for x in got}) > 4
    # a text is folded once, not for each literal that may stand in it
    joined = gram_index.indexed_join(gram_index.read_postings(spark, path), texts, literals, "chunk_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(_folded" in joined and "Contains(translate(" not in joined
    empty = chunks.limit(0)
    assert gram_index.postings(empty, ("text",), "chunk_id").count() == 0


@pytest.mark.parametrize("shape", ["unit", "clusters", "any length", "ties"])
def test_pruned_neighbours_equal_a_scan(spark, tmp_path, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    if shape == "clusters":
        x = 0.02 * x + np.repeat(rng.normal(size=(12, 8)), 50, axis=0)
    if shape == "ties":
        x = np.round(x)
    if shape != "any length":
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    df = spark.createDataFrame([(i, [float(v) for v in row], f"l{i % 3}") for i, row in enumerate(x)] + [(9999, None, "none")], "chunk_id long, embedding array<float>, layer string")
    path = str(tmp_path / "v")
    pivots.write_vectors(df, path, pivots=24)
    full = df.where("embedding IS NOT NULL")
    shares = []
    for q in (x[0], x[17], -x[5], np.zeros(8)):
        for k in (1, 5, 100, 1000):
            found, read = pivots.nearest_pruned(spark, path, q.tolist(), k)
            assert [(r.chunk_id, r.distance, r.layer) for r in found.collect()] == [(r.chunk_id, r.distance, r.layer) for r in retrieval.nearest(full, q.tolist(), k).collect()]
            shares.append((k, read.rows / read.of_rows))
    if shape == "clusters":
        assert min(s for k, s in shares if k == 5) < 0.3
    pivots.write_vectors(df.limit(0), str(tmp_path / "none"))
    assert pivots.nearest_pruned(spark, str(tmp_path / "none"), [1.0] * 8, 3)[0].count() == 0


def test_tasks_of_the_expansion_follow_the_rows(spark, monkeypatch):
    imports = spark.range(400).select((F.col("id") % 40).alias("source_file"), (F.col("id") % 23).alias("target_file"), F.lit("m").alias("module"))
    chunks = spark.range(300).select((F.col("id") % 23).alias("file_path"), F.lit("class").alias("node_type"), F.col("id").alias("start_line"), F.col("id").alias("chunk_id"))
    seeds = spark.range(5).select(F.col("id").alias("source_file"))
    found = []
    for rows in (500_000, 50):
        monkeypatch.setattr(retrieval, "TASK_ROWS", rows)
        found.append(retrieval.expand_imports(imports, seeds, chunks, 2, 100))
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect())) != []
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in found]
    assert "REPARTITION_BY_NUM" not in plans[0] and ", 14), REPARTITION_BY_NUM" in plans[1]
