import io
import json
import shutil

import pytest

from lodestone import server
from lodestone.config import ProjectConfig, load_config, parse_config
from lodestone.functions.vectors import ModelNotCachedError
from pyspark.sql import functions as F

from lodestone.plans import calibrate, hybrid, model_check, wizard
from lodestone.sources.manifests import cmake_targets
from lodestone.store import Index, WrongModelError

FILES = {
    "shop/api/orders.py": "from shop.models import order\n\ndef update_order_status(x):\n    return route('/orders/update_status', x)\n",
    "shop/models/order.py": "TABLE = 'orders_table'\n\n\nclass Order:\n    '''An order.'''\n    def save(self):\n        return TABLE\n",
    "shop/models/__init__.py": "",
    "web/app.tsx": "export const send = (x) => {\n  return post('/orders/update_status', x);\n};\n",
    "web/node_modules/x/index.js": "function vendored() {}\n",
    "i18n/en.json": json.dumps({"order": {"status": "Order status", "n": None}, "list": ["a", 1.5, True]}),
    "broken.py": "def half(:\n    pass\n",
}
CONFIG = {"layers": [{"name": "api", "dirs": ["api"]}, {"name": "web", "dirs": ["web"]}, {"name": "none", "files": ["no.py"]}], "default_layer": "rest", "translations": {"files": ["i18n/en.json"]}}


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".lodestone.json").write_text(json.dumps(CONFIG))
    return root


def test_index_search_and_changes(spark, project):
    index, config = Index(spark, str(project)), load_config(str(project))
    assert config == parse_config(CONFIG, config.source) and config.layers == ["api", "web", "none", "rest"]
    assert not index.exists()
    run = index.update(config)
    assert (run.changed_files, run.unchanged_files, run.deleted_files, run.parse_errors) == (5, 0, 0, [])
    rows = {(r.layer, r.module, r.name) for r in index.table("chunks").collect()}
    assert {("api", "shop", "update_order_status"), ("rest", "shop", "Order.save"), ("web", "web", "send"), ("rest", "i18n", "en"), ("rest", "broken.py", "half")} <= rows
    assert [tuple(r) for r in index.table("imports").collect()] == [("shop/api/orders.py", "shop/models/order.py", "shop.models")]
    assert {(r.key_path, r.value) for r in index.table("json_entries").collect()} == {("order.status", "Order status"), ("order.n", ""), ("list[0]", "a"), ("list[1]", "1.5"), ("list[2]", "True")}

    found = hybrid.search_hybrid(index, "where is update_order_status", config)
    assert found["literal"][0].name == "update_order_status" and found["literal"][0]["rank"] == 0
    assert {r.layer for r in found["by_layer"]} == {"api", "web", "none", "rest"}
    assert [r.target_file for r in found["imports"]][:1] == ["shop/models/order.py"]
    assert any(r.literal == "/orders/update_status" and r.match_layer == "web" for r in found["links"])
    text = hybrid.render("where is update_order_status", found)
    assert "(empty)" in text and "[module: shop]" in text and "also in [web]" in text
    assert hybrid.search_hybrid(index, "Order status", config, expand=False)["json_literal"][0].key_path == "order.status"
    assert "currently configured: 30" in calibrate.report(index, config)

    # changed rules take effect without another run, and no chunk is lost
    changed = parse_config(CONFIG | {"layers": [{"name": "store", "dirs": ["models"]}, {"name": "web", "dirs": ["web"]}]})
    again = {(r.layer, r.name) for r in index.open(changed)["chunks"].collect()}
    assert {("rest", "update_order_status"), ("store", "Order.save"), ("web", "send")} <= again and len(again) == index.table("chunks").select("name").distinct().count()
    assert "update_order_status" in {r.name for r in hybrid.search_hybrid(index, "update_order_status", changed)["by_layer"]}
    assert index.warnings(config) == [] and len(index.warnings(parse_config({"layers": [{"name": "x", "dirs": ["nowhere"]}]}))) == 1
    assert index.module_graph(config).count() >= 0 and index.entry_points(config).count() == 0

    (project / "web/app.tsx").write_text("export const other = () => 1;\n")
    shutil.rmtree(project / "shop/api")
    run = index.update(config)
    assert (run.changed_files, run.unchanged_files, run.deleted_files, run.new_chunks) == (1, 3, 1, 1)
    assert {r.name for r in index.table("chunks").where("layer in ('web', 'api')").collect()} == {"other"} and index.table("imports").count() == 0
    assert index.update(config, force=True).changed_files == 4

    with pytest.raises(ModelNotCachedError):
        Index(spark, str(project), "no/model").update(config)
    assert len([x for x in (project / ".lodestone" / "hashed-words").iterdir() if x.is_dir()]) == 2
    # no notice where another version of the program left no rows
    index._write(f"{index.version}/facts.json", json.dumps(index.facts() | {"imports": index.facts()["imports"] | {"rust": 0}}))
    assert index.notice() is None
    index._write(f"{index.version}/facts.json", json.dumps(index.facts() | {"chunks": 0}))
    assert index.notice() and index.open()["chunks"].count() == 0
    assert index.update(config).changed_files == 4 and index.notice() is None
    index._write(f"{index.version}/facts.json", json.dumps(index.facts() | {"model": "x"}))
    with pytest.raises(WrongModelError):
        index.open()


def test_server(spark, project):
    calls = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "index_codebase"}}, {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "Order"}}}, {"id": 5, "method": "no"}]
    sink = io.StringIO()
    server.serve(spark, str(project), "hashed-words", io.StringIO("\n".join(json.dumps(c) for c in calls)), sink)
    replies = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5] and "error" in replies[4]
    assert "api, web, none, rest" in replies[1]["result"]["tools"][0]["description"]
    assert replies[2]["result"]["content"][0]["text"].startswith("changed=5") and "[class] Order" in replies[3]["result"]["content"][0]["text"]


def test_wizard_lists_all_catalogs(spark):
    tree = spark.range(10_001).select(F.format_string("i18n/%05d.json", "id").alias("path"), F.lit(None).cast("string").alias("content"))
    draft = wizard.suggest_config(tree)
    assert draft["translations"]["files"] == [f"i18n/{i:05d}.json" for i in range(10_001)]
    assert draft["layers"] == [] and draft["default_layer"] == "other"


def test_wizard(spark, tmp_path):
    names = ["api/views.py", "Models/x.py", "app/a.tsx", "node_modules/frontend/x.js", "i18n/en.json", "i18n/sub/no.json", "libs/core/src/lib.rs", "tests/t.rs", "src/a.c", "unix/b.c"]
    rows = [(n, None) for n in names] + [("libs/core/Cargo.toml", '[package]\nname = "core"\n[[bin]]\nname = "tool"\n'), ("src/CMakeLists.txt", "add_library(lib STATIC a.c gone.c $<X:y>) # )\nadd_executable(all ${SOURCES} a.c)\n"), ("unix/CMakeLists.txt", "add_library(lib b.c)")]
    tree = spark.createDataFrame(rows, "path string, content string").where("path not like 'node_modules/%'")
    draft = wizard.suggest_config(tree)
    assert [x["name"] for x in draft["layers"]] == ["frontend", "backend/api", "models", "tests", "tool", "tests", "platform"]
    assert draft["layers"][1] == {"name": "backend/api", "dirs": ["api"], "files": ["views.py"]} and draft["layers"][2]["dirs"] == ["Models"]
    assert draft["modules"] == [{"name": "lib", "dirs": [], "files": ["a.c", "b.c"]}] and draft["module_depth"] == 2
    assert draft["translations"]["files"] == ["i18n/en.json"] and draft["_detected_languages"] == ["C", "Python", "Rust", "TypeScript"]
    assert wizard.write_draft(str(tmp_path), draft) and wizard.write_draft(str(tmp_path), draft) is None
    assert isinstance(load_config(str(tmp_path)), ProjectConfig)
    assert list(cmake_targets('cuda_add_library(a b.c) ADD_EXECUTABLE ( x WIN32 "y z.c"\n # ) \n w.c')) == []


def test_an_update_touches_its_buckets(spark, tmp_path):
    root = tmp_path / "many"
    for i in range(600):
        (root / f"d{i % 7}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 7}/f{i}.py").write_text(f"import os\n\ndef fun{i}():\n    return 'text number {i}'\n")
    index, config = Index(spark, str(root)), load_config(str(root))
    run = index.update(config)
    assert (run.changed_files, run.rewritten_buckets, run.buckets) == (600, 3, 3)
    version = index.version
    (root / "d3/f3.py").write_text("def other():\n    return 'Unheard_of words'\n")
    (root / "d4/f4.py").unlink()
    files = lambda: {str(p) for p in (root / ".lodestone").rglob("*.parquet")}
    before = files()
    run = index.update(config)
    assert (run.changed_files, run.unchanged_files, run.deleted_files, run.new_chunks, run.buckets) == (1, 598, 1, 1, 3)
    assert 1 <= run.rewritten_buckets <= 2 and index.version == version
    assert len(before - files()) <= 5 * run.rewritten_buckets
    names = {r.name for r in index.table("chunks").collect()}
    assert "other" in names and not {"fun3", "fun4"} & names and len(names) == 599
    assert index.table("files").count() == 599
    found = hybrid.search_hybrid(index, "where is 'Unheard_of words'", config, expand=False)
    assert [r.name for r in found["literal"]] == ["other"]
    assert index.postings(["unh"]).count() == 1 and index.postings(["fun"]).count() == 598
    assert index.update(config).rewritten_buckets == 0


def test_model_check(spark, project, capsys):
    rows = model_check.ranked_chunks(spark, str(project), ["shop/models/order.py", "web/app.tsx"], ["an order table", "post update status"], top=2).collect()
    assert [(r.question, r["rank"]) for r in rows] == [(0, 1), (0, 2), (1, 1), (1, 2)] and rows[0].similarity >= rows[1].similarity
    text = model_check.report(rows, {"a": "an order table", "b": "x"}, "m")
    assert "=== a: 'an order table' ===" in text and f"  {rows[0].similarity:.4f}  {rows[0].node_type}:{rows[0].name}" in text


def test_calibration_takes_whole_chunks(spark, project):
    index, config = Index(spark, str(project)), load_config(str(project))
    index.update(config)
    assert "sampled literals" in calibrate.report(index, config, sample=1)
