import shutil

import pytest

from lodestone.streaming import listing


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    return root


def names(spark, out):
    return sorted((r.path, r.name) for r in listing.current(spark, out).collect())


def test_add_change_delete_rerun_and_compact(spark, tree, tmp_path):
    listings, out, ck = (str(tmp_path / n) for n in ("listings", "out", "ck"))

    def tick(seconds):
        listing.write_listing(spark, str(tree), listings, seconds)
        listing.follow_listings(spark, listings, out, ck, once=True).awaitTermination(180)

    (tree / "a/__init__.py").write_text("def first(): pass\n")
    (tree / "a/x.py").write_text("def one(): pass\n")
    (tree / "a/y.rs").write_text("fn two() {}\n")
    tick(100)
    assert names(spark, out) == [("a/__init__.py", "first"), ("a/x.py", "one"), ("a/y.rs", "two")]

    (tree / "a/x.py").write_text("def three(): pass\n\n\nclass Four:\n    pass\n")
    (tree / "a/y.rs").unlink()
    (tree / "z.py").write_text("")
    tick(200)
    want = [("a/__init__.py", "first"), ("a/x.py", "Four"), ("a/x.py", "three")]
    assert names(spark, out) == want
    changed = spark.read.parquet(f"{out}/batch_*/changes").select("path", "status", "seconds").collect()
    # one row a change, and none for what stayed
    assert sorted((r.path, r.status) for r in changed) == [("a/__init__.py", "new"), ("a/x.py", "changed"), ("a/x.py", "new"), ("a/y.rs", "deleted"), ("a/y.rs", "new"), ("z.py", "new")]

    tick(300)
    assert names(spark, out) == want and spark.read.parquet(f"{out}/batch_*/changes").count() == len(changed)

    # a batch that is run again replaces itself
    batches = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch_"))
    saved = tmp_path / "saved"
    shutil.copytree(tmp_path / "out" / batches[0], saved)
    listing.compact(spark, out)
    assert names(spark, out) == want
    assert [p.name.split("_")[0] for p in (tmp_path / "out").iterdir()] == ["folded"]
    # and one that had been folded doesn't count again
    shutil.copytree(saved, tmp_path / "out" / batches[0])
    assert names(spark, out) == want

    (tree / "a/y.rs").write_text("fn back() {}\n")
    (tree / "a/__init__.py").unlink()
    tick(400)
    want = [("a/x.py", "Four"), ("a/x.py", "three"), ("a/y.rs", "back")]
    assert names(spark, out) == want
    listing.compact(spark, out)
    listing.compact(spark, out)
    assert names(spark, out) == want

    shutil.rmtree(tree)
    tree.mkdir()
    tick(500)
    assert names(spark, out) == []
