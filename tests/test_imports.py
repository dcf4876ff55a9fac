from lodestone.sources.import_specs import import_edges, python_specs, rust_modules, rust_mods, use_paths

FILES = {
    "pkg/__init__.py": "", "pkg/a.py": "import pkg.b.c as x\nfrom . import b, nothing\nfrom .b import c\nfrom ..other import thing\nimport os\nfrom pkg import a\n",
    "pkg/b/__init__.py": "from TYPE import y\nif TYPE_CHECKING:\n    import pkg.a\nelse:\n    import other\n", "pkg/b/c.py": "from proj.pkg.a import z\n", "other.py": "def broken(:\n",
    "ns/x.py": "from . import y\n", "ns/y.py": "",
    "web/app.js": "import A from './lib/a';\nexport * from \"./lib\";\nconst z = require('../web/util.ts');\nimport 'react';\n// import './no';\nconst s = \"import './lib/a'\";\n",
    "web/lib/a.tsx": "", "web/lib/index.js": "", "web/util.ts": "",
    "c/src/m.c": '#include "m.h"\n#include <stdio.h>\n#include "deep.h"\n#include "twice.h"\n// #include "no.h"\n', "c/src/m.h": "", "c/inc/deep.h": "", "c/a/twice.h": "", "c/b/twice.h": "",
    "rs/src/lib.rs": "pub mod net;\nmod util;\nmod inline { pub mod deep; }\n", "rs/src/net/mod.rs": "mod tcp;\nuse super::util::{self, helper};\n", "rs/src/net/tcp.rs": "use crate::net::Conn;\nuse super::*;\nuse std::io;\n",
    "rs/src/util.rs": "use my_crate::inline::deep::X as Y;\n", "rs/src/inline/deep.rs": "use self::a::b;\n", "rs/src/main.rs": "use my_crate::net::tcp::T;\n", "rs/src/orphan.rs": "use crate::net::A;\n",
}

EDGES = {
    ("pkg/a.py", "pkg/b/c.py", "pkg.b.c"), ("pkg/a.py", "pkg/b/__init__.py", "."), ("pkg/a.py", "pkg/b/c.py", ".b"), ("pkg/a.py", "other.py", "..other"), ("pkg/a.py", "pkg/a.py", "pkg"),
    ("pkg/b/__init__.py", "other.py", "other"), ("pkg/b/c.py", "pkg/a.py", "proj.pkg.a"),
    ("web/app.js", "web/lib/a.tsx", "./lib/a"), ("web/app.js", "web/lib/index.js", "./lib"), ("web/app.js", "web/util.ts", "../web/util.ts"),
    ("c/src/m.c", "c/src/m.h", "m.h"), ("c/src/m.c", "c/inc/deep.h", "deep.h"),
    ("rs/src/net/mod.rs", "rs/src/util.rs", "super::util"), ("rs/src/net/mod.rs", "rs/src/util.rs", "super::util::helper"), ("rs/src/net/tcp.rs", "rs/src/net/mod.rs", "crate::net::Conn"), ("rs/src/net/tcp.rs", "rs/src/net/mod.rs", "super"),
    ("rs/src/util.rs", "rs/src/inline/deep.rs", "my_crate::inline::deep::X"), ("rs/src/inline/deep.rs", "rs/src/inline/deep.rs", "self::a::b"), ("rs/src/main.rs", "rs/src/net/tcp.rs", "my_crate::net::tcp::T"),
}


def test_edges(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    manifests = spark.createDataFrame([("rs/Cargo.toml", '[package]\nname = "my-crate"\n'), ("bad/Cargo.toml", "[")], "path string, content string")
    got = {tuple(r) for r in import_edges(files, manifests, "proj").collect()}
    assert got - EDGES == set() and EDGES - got == set()


def test_parsing():
    assert use_paths("a::{b::{c, d as e}, self, f::*}") == [["a", "b", "c"], ["a", "b", "d"], ["a"], ["a", "f"]]
    assert list(rust_mods("mod a; mod b { mod c; fn f() { mod no; } } fn g() { mod no; }")) == [(["a"], True), (["b"], False), (["b", "c"], True)]


def test_files_that_do_not_parse():
    text = "\ufeffimport a.b\nfrom . import (x,\n  y)  # c\ndef broken(:\nif TYPE_CHECKING:\n    import no\ndef g():\n    import inside\nimport more of it\n"
    assert [x[0] for x in python_specs("p/a.py", text.removeprefix("\ufeff"))] == ["a.b", ".", "inside"]


def test_modules_nested_deep(spark):
    depth = 40
    files = [("deep/src/lib.rs", "mod m0;\n")] + [("deep/src/" + "/".join(f"m{j}" for j in range(i + 1)) + ".rs", f"mod m{i + 1};\nuse crate::m0::x;\n") for i in range(depth)]
    tree = spark.createDataFrame(files, "path string, content string")
    manifests = spark.createDataFrame([("deep/Cargo.toml", '[package]\nname = "deep"\n')], "path string, content string")
    modules = rust_modules(tree, manifests).collect()
    assert len(modules) == depth + 1 and max(len(r.module) for r in modules) == depth
    edges = import_edges(tree, manifests).collect()
    assert len(edges) == depth and {r.target_file for r in edges} == {"deep/src/m0.rs"}


def test_modules_that_declare_each_other_end(spark):
    files = [("r/src/lib.rs", "mod a;\nmod b;\n"), ("r/src/a.rs", "mod lib;\n"), ("r/src/a/lib.rs", "mod x;\n"), ("r/src/b.rs", "mod c { mod d { mod e; } }\n"), ("r/src/b/c/d/e.rs", "")]
    manifests = spark.createDataFrame([("r/Cargo.toml", '[package]\nname = "r"\n')], "path string, content string")
    got = {("::".join(r.module), r.file) for r in rust_modules(spark.createDataFrame(files, "path string, content string"), manifests).collect()}
    assert got == {("", "r/src/lib.rs"), ("a", "r/src/a.rs"), ("b", "r/src/b.rs"), ("a::lib", "r/src/a/lib.rs"), ("b::c", "r/src/b.rs"), ("b::c::d", "r/src/b.rs"), ("b::c::d::e", "r/src/b/c/d/e.rs")}
