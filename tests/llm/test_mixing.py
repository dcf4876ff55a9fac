import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing
from lodestone.llm.mixing import KEYS, counted, mix_sources, op12_prefix_sums, targets


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by handing the excess on until no source is above what it can take."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        goal = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in full and goal[s] > most * sizes[s]}
        if not above:
            return goal
        full |= above


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 7, 50, 1000, 40_000]) for i in range(17)} | {None: 30}
    rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r.source: r.target for r in rows} == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def brute(rows, bucket=None):
    """One source after the other, documents by key, copies one by one."""
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = filled(sizes), []
    for s in sizes:
        budget = int(goal[s] + 0.5)
        epochs = budget // sizes[s] if sizes[s] else 0
        left = budget - epochs * sizes[s]
        for i, _, n, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0], r[2])):
            part = min(n, left)
            left -= part
            out.append((i, n, sizes[s], round(goal[s], 6), epochs * n + part))
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [100_000, 7])
def test_against_brute_force(spark, bucket_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([0, 3, 10, 200]), rng.randrange(int(KEYS))) for i in range(400)]
    rows += [rows[5]] * 30  # copies in every column
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, draw long").repartition(3)
    first, again = (sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(df, bucket_rows=bucket_rows).collect()) for _ in range(2))
    assert first == again == brute(rows)


def test_hot_source_is_split(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.common.HOT_ROWS", 16)
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", rng.randint(0, 9), rng.randrange(int(KEYS))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, draw long")
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(df, bucket_rows=20).collect())
    assert got == brute(rows)


def test_budgets_are_met(spark):
    rows = op12_prefix_sums(spark, "/root/testdata/sf0.001").collect()
    by_target = {}
    for r in rows:
        by_target.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for (_, target), docs in by_target.items():
        assert abs(sum(r.taken for r in docs) - target * round(sum(r.size for r in docs) / docs[0].source_size)) <= 1


def test_cases(spark):
    df = spark.createDataFrame([(None, None, None, 1), (None, "a", "", 2), (1, "a", "x y z", 3), (1, "a", "x y z", 3), (2, None, "w", 4)], "doc_id long, source string, text string, target int")
    made = counted(df)
    assert made.columns == ["doc_id", "source", "target", "size", "draw"]
    out = mix_sources(made)
    assert out.columns == ["doc_id", "source", "target", "size", "source_size", "_target", "taken"]
    rows = sorted((r.target, r.source, r.size, r.source_size, r.taken) for r in out.select("*").collect())
    # a has weight 1 of 3, the null source 2 of 3 of 7 words, of which it can take 3
    assert [r[1] for r in rows] == [None, "a", "a", "a", None]
    assert rows[4][2:] == (1, 1, 3) and sum(r[4] for r in rows[1:4]) == 4
    assert mix_sources(counted(df.where(F.lit(False)))).count() == 0
    assert [r.taken for r in mix_sources(counted(df.where("size(split(text, ' ')) = 1 and text = ''"))).collect()] == [0]
    assert mixing.counted(df.drop("target")).select("size").agg(F.sum("size")).first()[0] == 7
