import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import paths, text, vectors
from lodestone.functions.vectors import MODELS, cosine_distance, dimension, embed, hashed_embedding, prefixes
from lodestone.operators import calibration, graph, maintenance, resolution, retrieval
from lodestone.sources.json_tree import chunk_rows, cut_tree, leaves


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "query,want",
    [
        ("handler that updates user_status in 'task status'", ["task status", "user_status"]),
        ("GET /api/v1 and MAX_SIZE of FooBar, ok", ["MAX_SIZE", "api/v1", "FooBar", "GET"]),
        ("plain words only", []),
        ("status. a_b a_b 'x' \"ab\"", ["status.", "a_b", "ab"]),
        ("", []),
    ],
)
def test_query_tokens(spark, query, want):
    assert value(spark, text.query_tokens(F.lit(query))) == want


def test_chunk_literals(spark):
    code = """f('route/one', '12345', ', - ', 'route/one', 'ab', "longest literal", 'abc', 'défg')"""
    assert value(spark, text.chunk_literals(F.lit(code), 8)) == ["longest literal", "route/one", "défg", "abc"]
    assert value(spark, text.chunk_literals(F.lit(code), 2)) == ["longest literal", "route/one"]


def test_folding_and_escaping(spark):
    assert value(spark, text.contains_folded(F.lit("Ünïcode HELLO 50%"), F.lit("hello 50%")))
    assert not value(spark, text.contains_folded(F.lit("ПРИВЕТ"), F.lit("привет")))
    assert value(spark, text.escape_like(F.lit(r"50%_\x"))) == r"50\%\_\\x"


def test_snippet(spark):
    assert value(spark, text.snippet(F.lit("a\nb\n"))) == "        a\n        b"
    assert value(spark, text.snippet(F.lit("x" * 801))) == "        " + "x" * 800 + "\n        ..."
    assert value(spark, text.snippet(F.lit("\n".join("abcdefghijklmnopq")))).endswith("        o\n        ...")


def test_paths(spark):
    rules = [("front", ["Web"], []), ("api", [], ["views.py"])]
    rows = spark.createDataFrame([("shop/web/a.js",), ("shop/x/VIEWS.py",), ("lone.py",), ("a/b/c.py",), (".hidden",), ("a/x.MIN.JS",)], "p string")
    got = rows.select("p", paths.classify_layer(F.col("p"), rules, "rest"), paths.classify_module(F.col("p"), 2), paths.suffix(F.col("p")), paths.stem(F.col("p"))).collect()
    assert [tuple(r)[1:] for r in got] == [("front", "shop/web", ".js", "a"), ("api", "shop/x", ".py", "VIEWS"), ("rest", "lone.py", ".py", "lone"), ("rest", "a/b", ".py", "c"), ("rest", ".hidden", "", ".hidden"), ("rest", "a", ".js", "x.MIN")]
    files = spark.createDataFrame([("a/b.py", 10), ("node_modules/x.js", 10), ("target/x.rs", 10), ("lib/ui/x.js", 1), ("other/lib/ui/x.js", 1), ("a.min.js", 1), ("big.c", 600_000), ("a.txt", 1)], "p string, n long")
    kept = files.where(paths.is_source(F.col("p"), F.col("n"), ["lib/ui"], ["target"])).select("p")
    assert [r.p for r in kept.collect()] == ["a/b.py", "target/x.rs", "other/lib/ui/x.js"]


def test_vectors(spark):
    a, b = hashed_embedding("update user status"), hashed_embedding("user status update")
    assert a.tolist() == b.tolist() and abs(float((a * a).sum()) - 1) < 1e-6 and not hashed_embedding("").any()
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>").select(cosine_distance(F.col("a"), F.col("b")), cosine_distance(F.col("a"), F.col("a"))).first()
    assert tuple(d) == (1.0, 0.0)
    rows = embed(spark.createDataFrame([("x y",), (None,)], "text string")).collect()
    assert len(rows[0].embedding) == dimension("hashed-words") and not any(rows[1].embedding)
    assert prefixes("unknown") == ("", "") and all(len(v) == 3 for v in MODELS.values())


def loop_top(rows, k, margin):
    """Rows by distance; a module is let in by its first row, later ones are not tested."""
    best, out = {}, {}
    for layer, module, d, i in sorted(rows, key=lambda r: (r[2], r[3])):
        best.setdefault(layer, d)
        if (layer, module) not in out:
            if d > best[layer] * (1 + margin):
                continue
            out[layer, module] = []
        if len(out[layer, module]) < k:
            out[layer, module].append(i)
    return out


def test_grouped_top_k_equals_a_loop(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows = [(rng.choice("AB"), rng.choice("xyz"), rng.randint(1, 40) / 32, i) for i in range(60)]
        df = spark.createDataFrame(rows, "layer string, module string, distance double, chunk_id int")
        got = {}
        for r in retrieval.grouped_top_k(df).orderBy("rn").collect():
            got.setdefault((r.layer, r.module), []).append(r.chunk_id)
        assert got == loop_top(rows, 3, 0.15)


def test_literal_search_ranks_and_dedupes(spark):
    rows = [(1, "update", "x", "a.py"), (2, "update_status", "y", "b.py"), (3, "z", "calls UPDATE here", "c.py"), (4, "z", "none", "update/d.py"), (5, "q", "update_status", "e.py")]
    chunks = spark.createDataFrame(rows, "chunk_id int, name string, text string, file_path string")
    got = [(r.chunk_id, r.token, r["rank"]) for r in retrieval.literal_search(chunks, ["update_status", "update"]).collect()]
    # what the longer token finds keeps that token's rank
    assert got == [(2, "update_status", 0), (1, "update", 0), (4, "update", 1), (5, "update_status", 2), (3, "update", 2)]
    assert retrieval.literal_search(chunks, ["update_status", "update"], 2).count() == 2
    assert retrieval.literal_search(chunks, []).count() == 0


def test_substring_join_by_scan_and_by_trigram(spark):
    rng = random.Random(3)
    texts = spark.createDataFrame([(i, "".join(rng.choices("abAB_%é", k=12))) for i in range(80)], "i int, text string")
    literals = spark.createDataFrame([(x,) for x in {"".join(rng.choices("abAB_%é", k=rng.randint(1, 4))) for _ in range(30)}], "literal string")
    few = {tuple(r) for r in retrieval.substring_join(texts, literals).select("i", "literal").collect()}
    long = literals.where("length(literal) >= 3")
    many = {tuple(r) for r in retrieval.substring_join(texts, long, scanned=1).select("i", "literal").collect()}
    assert many == {x for x in few if len(x[1]) >= 3} and few


def test_expand_drops_noise(spark):
    imports = spark.createDataFrame([("a", "t", "m"), ("b", "t", "m"), ("a", "u", "n"), ("a", "u", "n")], "source_file string, target_file string, module string")
    chunks = spark.createDataFrame([("t", "function", 1, 1), ("u", "function", 1, 2), ("u", "class", 9, 3)], "file_path string, node_type string, start_line int, chunk_id int")
    seeds = spark.createDataFrame([("a",)], "source_file string")
    assert [(r.target_file, r.chunk_id) for r in retrieval.expand_imports(imports, seeds, chunks, noise=1).collect()] == [("u", 3)]


def test_percentiles(spark):
    def ranks(values):
        return {r.p: r.value for r in calibration.percentiles(spark.createDataFrame([(v,) for v in values], "n int")).collect()}

    assert ranks(range(1, 101)) == {50: 51, 75: 76, 90: 91, 95: 96, 99: 100, 100: 100}
    assert ranks([1, 1, 1, 2, 2, 50, 60])[50] == 2 and set(ranks([]).values()) == {0}
    share = calibration.fraction_at_or_below(spark.createDataFrame([(v,) for v in [1, 1, 5]], "n int"), [0, 1, 9])
    assert [round(r.fraction, 3) for r in share.collect()] == [0, 0.667, 1]
    assert [r.fraction for r in calibration.fraction_at_or_below(spark.createDataFrame([], "n int"), [3]).collect()] == [0]
    assert "nothing to calibrate" in calibration.format_report([], [("a", 3)], 30, 15)


def test_module_roles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), ("", "c"), ("a", "b")], "source string, target string")
    assert {r.module: (r.role, r.imported_by, r.imports_from) for r in graph.module_stats(edges).collect()} == {"a": ("extension", [], ["b"]), "b": ("application", ["a"], ["c"]), "c": ("foundation", ["b"], [])}


def test_maintenance(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string")
    assert sorted(map(tuple, maintenance.latest_per_key(rows, ["k"], ["v"]).collect())) == [(1, 2, "b"), (2, 1, "c")]
    assert sorted(map(tuple, maintenance.upsert(rows, spark.createDataFrame([(1, 9, "z")], rows.schema), ["k"]).collect())) == [(1, 9, "z"), (2, 1, "c")]
    chunks = spark.createDataFrame([("rest", "m")], "layer string, module string")
    assert len(maintenance.warnings(chunks, 2, "rest")) == 2 and maintenance.warnings(chunks.limit(0), 2, "rest") == []


def test_json_leaves():
    assert list(leaves({"a": {"b": "hello", "c": None}, "items": ["x", True, 1.5], "e": {}, "z": []})) == [("a.b", "hello"), ("a.c", ""), ("items[0]", "x"), ("items[1]", "True"), ("items[2]", "1.5")]
    assert list(leaves("root")) == [("", "root")]


def test_json_chunks():
    tree = {"big": {f"k{i}": "v" for i in range(30)}, "small": {"x": "1"}, "s": "t"}
    names = [(n, len(x)) for n, x in cut_tree(tree, "en")]
    assert names == [("big#1", 25), ("big#2", 5), ("small", 1), ("en#1", 1)]
    rows = list(chunk_rows(json.dumps({f"k{i}": "x" * 500 for i in range(5)}, indent=1), "f"))
    assert [r[1] for r in rows] == [2, 4, 6] and rows[0][2].startswith("k0: xxx")
    assert list(chunk_rows("{}", "f")) == [] and list(chunk_rows("[1]", "f")) == [("f", 1, "[0]: 1")]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.integers(), st.text(max_size=40)), lambda x: st.one_of(st.lists(x, max_size=6), st.dictionaries(st.text("abc", min_size=1, max_size=3), x, max_size=6)), max_leaves=80))
def test_json_chunks_hold_every_leaf_once(tree):
    cut = cut_tree(tree, "f", 4, 60)
    assert [x for _, found in cut for x in found] == list(leaves(tree))
    assert all(found and (len(found) <= 4 or not name) for name, found in cut)


def test_grams_and_joins_by_them(spark):
    texts = spark.createDataFrame([(1, "Abc def"), (2, "xy"), (3, ""), (4, None), (5, "z😀y abcabc")], "i int, text string")
    literals = spark.createDataFrame([(x,) for x in ("bc", "ABC", "y", "", "😀y", "no such", "c d")], "literal string")
    pairs = {s: {(r.i, r.literal) for r in retrieval.substring_join(texts, literals, scanned=s).collect()} for s in (0, 512)}
    assert pairs[0] == pairs[512] and (5, "😀y") in pairs[0] and (1, "c d") in pairs[0] and (3, "") in pairs[0]
    assert sorted(value(spark, retrieval.grams(F.lit("abcab")))) == ["abc", "bca", "cab"]


def test_nearest_ranks_by_the_exact_distance(spark):
    rows = spark.createDataFrame([(1, [1.0 - 2e-9, 0.0]), (2, [1.0, 0.0])], "chunk_id long, embedding array<double>")
    assert [r.chunk_id for r in retrieval.nearest(rows, [1.0, 0.0]).collect()] == [2, 1]


def test_module_graph(spark):
    edges = spark.createDataFrame([("main.py", "a/x.py"), ("main.py", "b/y.py"), ("a/x.py", "b/y.py"), ("a/x.py", "a/z.py"), ("sub/main.py", "a/x.py"), ("one.py", "a/x.py")], "source_file string, target_file string")
    assert {(r.module, r.role) for r in graph.module_graph(edges).collect()} == {("a", "application"), ("b", "foundation"), ("main.py", "extension"), ("sub", "extension"), ("one.py", "extension")}
    assert [tuple(r) for r in graph.entry_points(edges).collect()] == [("main.py", ["a", "b"])]


def test_local_models(tmp_path, monkeypatch):
    import onnxruntime
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"[UNK]": 0, "one": 1, "two": 2}, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    (tmp_path / "org" / "small").mkdir(parents=True)
    made.save(str(tmp_path / "org" / "small" / "tokenizer.json"))
    (tmp_path / "org" / "small" / "model.onnx").write_bytes(b"")

    class Session:
        """States that are the one-hot vectors of the ids."""

        def __init__(self, path, providers):
            pass

        def get_inputs(self):
            return [type("Input", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, names, feed):
            assert set(feed) == {"input_ids", "attention_mask"}
            return [np.eye(3)[feed["input_ids"]]]

    monkeypatch.setattr(onnxruntime, "InferenceSession", Session)
    monkeypatch.setenv("LODESTONE_MODELS", str(tmp_path))
    encode = vectors.load_embedder("org/small")
    found = np.array(encode(["one", "one two", "other"]))
    assert np.allclose(found, [[0, 1, 0], [0, 0.5**0.5, 0.5**0.5], [1, 0, 0]]) and vectors.dimension("org/small") == 3
    with pytest.raises(vectors.ModelNotCachedError):
        vectors.load_embedder("org/none")


def test_normalize_path(spark):
    import posixpath

    given = ["a/b/../c", "./a//b/", "../../x/..", "/../a/./b/..", "", ".", "a/../..", "..", "/", "a/b/c/../../../d", "x/.../y", None]
    rows = spark.createDataFrame([(p,) for p in given], "path string").select(paths.normalize_path(F.col("path"))).collect()
    assert [r[0] for r in rows] == [None if p is None else posixpath.normpath(p) for p in given]


def test_filter_of_paths_and_prefix_hashes(spark):
    files = spark.createDataFrame([(f"d/f{i}.py",) for i in range(500)] + [(None,)], "path string")
    asked = spark.createDataFrame([(f"d/f{i}.py",) for i in range(0, 3000, 3)], "path string")
    kept = {r.path for r in resolution.perhaps_existing(asked, resolution.path_filter(files)).collect()}
    assert {f"d/f{i}.py" for i in range(0, 500, 3)} <= kept and len(kept) < 180
    known = spark.createDataFrame([(["a"], 1), (["a", "b"], 2), ([], 3), (["b", "a"], 4)], "prefix array<string>, value int")
    asked = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b"]), (3, []), (4, ["ab"]), (5, None), (6, ["b", "a", "b"])], "id int, segments array<string>")
    got = {r.id: (r.prefix, r.value, r.depth) for r in resolution.longest_prefix(asked, known).collect()}
    assert got == {1: (["a", "b"], 2, 2), 2: ([], 3, 0), 3: ([], 3, 0), 4: ([], 3, 0), 6: (["b", "a"], 4, 2)}


def test_many_literals_move_no_text(spark):
    words = ["Order", "status here", "ÄÖ", "x", "a longer one", "%", "Straße 12"]
    rows = [(i, f"{words[i % 7]} and {words[i * 3 % 7]}{i}" if i % 9 else None) for i in range(60)] + [(60, "Order"), (61, "Order"), (62, "")]
    texts = spark.createDataFrame(rows, "i int, text string")
    literals = spark.createDataFrame([(x,) for x in (*words, "ORDER AND", "12 and", "", "nowhere to be found", None)], "literal string")
    found = [retrieval.substring_join(texts, literals, **how) for how in ({}, {"scanned": 0}, {"scanned": 0, "handed": 0})]
    pairs = [sorted((r.i, r.literal) for r in f.select("i", "literal").collect()) for f in found]
    assert pairs[0] == pairs[1] == pairs[2] and len({x for _, x in pairs[0]}) == 10
    plan = found[1]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
