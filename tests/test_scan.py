import os

import pytest
from pyspark.sql import functions as F

from lodestone.plans import wizard
from lodestone.sources import scan


def written(root, files):
    for name, raw in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)


def by_walk(root, pruned):
    out = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in pruned]
        out |= {os.path.relpath(os.path.join(folder, n), root): os.path.getsize(os.path.join(folder, n)) for n in names}
    return out


@pytest.mark.parametrize("folders", [1, 3, 256])
def test_listing_equals_a_walk(spark, tmp_path, monkeypatch, folders):
    monkeypatch.setattr(scan, "FOLDERS", folders)
    root = tmp_path / "a b%20_é"
    written(root, {f"{d}{n}": n.encode() for d in ("", "x/", "x/y/z/", "x/_p/", ".h/", "node_modules/m/", ".git/o/", "w%41 é/") for n in ("__init__.py", "e.py", ".d.py", "o,k=1.rs")} | {"x/empty.py": b"", "x/big.py": b"a" * 300_000})
    os.symlink(root, root / "x/loop")
    os.symlink(root / "gone", root / "x/broken.py")
    rows = {r.path: r.length for r in scan.list_files(spark, str(root), pruned=["node_modules"]).collect()}
    os.unlink(root / "x/broken.py")
    os.unlink(root / "x/loop")
    want = {p: n for p, n in by_walk(root, {"node_modules", ".git"}).items() if n <= 200_000}
    assert rows == want and "x/_p/__init__.py" in rows and rows["x/empty.py"] == 0


def test_scan_reads_what_it_keeps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "BATCH_BYTES", 50)
    files = {f"m{i}/__init__.py": (b"x = %d\n" % i) * i for i in range(30)} | {"bad.py": b"\xff\xfea", "venv/v.py": b"1", "target/t.rs": b"2", "own/o.py": b"3", "z.min.js": b"4", "t.txt": b"5"}
    written(tmp_path, files)
    rows = {r.path: r.content for r in scan.scan_tree(spark, str(tmp_path), ["own"], ["target"]).collect()}
    assert set(rows) == {p for p in files if p.endswith("__init__.py")} | {"bad.py", "target/t.rs"}
    assert rows["m7/__init__.py"] == "x = 7\n" * 7 and rows["bad.py"].endswith("a") and rows["m0/__init__.py"] == ""
    hashed = scan.scan_tree(spark, str(tmp_path)).where(F.col("content_hash") != F.sha2("content", 256)).select("path").collect()
    assert [r.path for r in hashed] == ["bad.py"]


def test_no_tree(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan.list_files(spark, str(tmp_path / "no"))
    assert scan.scan_tree(spark, str(tmp_path)).count() == 0


def test_wizard_reads_manifests_only(spark, tmp_path):
    written(tmp_path, {"a/Cargo.toml": b"[package]\nname = 'a'\n", "a/src/lib.rs": b"mod x;", "node_modules/b.js": b""})
    assert {r.path: r.content for r in wizard.list_tree(spark, str(tmp_path)).collect()} == {"a/Cargo.toml": "[package]\nname = 'a'\n", "a/src/lib.rs": None}
