import pytest

from lodestone.sources.chunking import chunk_text, with_source_chunks


def names(path, text):
    return [(c.node_type, c.name) for c in chunk_text(path, text)]


CASES = [
    ("m.py", "def foo(x):\n    return x\n", [("function", "foo")]),
    ("m.py", "import functools\n\n@functools.cache\ndef foo():\n    pass\n\nclass Bar:\n    x = 1\n    @staticmethod\n    def baz():\n        pass\n", [("function", "foo"), ("class", "Bar"), ("method", "Bar.baz")]),
    ("m.py", "class Outer:\n    class Inner:\n        def m(self): pass\n", [("class", "Outer"), ("class", "Outer.Inner"), ("method", "Outer.Inner.m")]),
    ("m.py", "A = 1\nB = 2\n\nC = 3\n", [("block", "A"), ("block", "C")]),
    ("m.py", "with router('/x'):\n    router('GET')\n", [("block", "m#1")]),
    ("m.py", "if True:\n    x = 1\n", []),
    ("m.py", "def broken(:\n    pass\n\nclass K:\n    def m(self):\n        return 1\n\nX = 1\n", [("function", "broken"), ("class", "K"), ("method", "K.m"), ("block", "X")]),
    ("m.js", "import a from 'a';\nconst add = (a, b) => {\n  return a + b;\n};\n", [("function", "add")]),
    ("m.js", "export class W extends Base {\n  count = 0;\n  onClick = (e) => {\n    log(e);\n  }\n  async run() { if (x) { y(); } }\n}\n", [("class", "W"), ("method", "W.onClick"), ("method", "W.run")]),
    ("m.ts", "export const A: number = 1\nexport const B = 2\n\nexport async function go(): Promise<void> {}\n", [("block", "A"), ("function", "go")]),
    ("m.js", "window.x = {a: 1};\nfoo('}');\nif (a) { b() } else { c() }\nlet p = 1, q = () => 2\n", [("block", "m#1"), ("block", "p")]),
    ("app.tsx", "const App = () => {\n  return null;\n};\n", [("function", "App")]),
    ("m.rs", "/// Doc.\n#[allow(dead_code)]\npub fn foo() -> u32 { 1 }\n", [("function", "foo")]),
    ("m.rs", "struct P {\n    x: f32,\n}\nimpl P {\n    fn m(&self) -> f32 { self.x }\n}\nimpl<T> Default for F<T> {\n    fn default() -> Self { F }\n}\n", [("class", "P"), ("class", "P"), ("method", "P.m"), ("class", "Default for F<T>"), ("method", "Default for F<T>.default")]),
    ("m.rs", "use a::b;\npub mod utils;\nstruct U;\nconst MAX: usize = 4;\nstatic MIN: usize = 1;\n#[cfg(test)]\nmod tests {\n    use super::*;\n    #[test]\n    fn t() { assert_eq!('{', '{'); }\n}\n", [("block", "MAX"), ("class", "tests"), ("method", "tests.t")]),
    ("m.c", "#include <a.h>\nint *make(void) {\n    return 0;\n}\n", [("function", "make")]),
    ("m.c", "typedef struct {\n    int w;\n} Rect;\nenum Color { RED, GREEN };\nunion V { int i; };\n", [("class", "Rect"), ("class", "Color"), ("class", "V")]),
    ("m.h", "#ifndef S_H\n#define S_H\n\n#ifdef __cplusplus\nextern \"C\" {\n#endif\nint foo(void) {\n  return 1;\n}\n#ifdef __cplusplus\n}\n#endif\n#endif\n", [("block", "S_H"), ("function", "foo")]),
    ("m.c", "#define MAX 10\n#define MIN 1\nint add(int a, int b);\nstatic int counter = 0;\n", [("block", "MAX")]),
    ("m.c", "void report(const char *f, ...)\n    PRINTF_LIKE(1, 2);\n\nint real(void) {\n    return 1;\n}\n", [("function", "real")]),
    ("m.cpp", "class Point {\npublic:\n    Point(int x) : x_(x) {}\n    ~Point() {}\n    Point operator+(const Point& o) const { return o; }\nprivate:\n    int x_;\n};\n", [("class", "Point"), ("method", "Point.Point"), ("method", "Point.~Point"), ("method", "Point.operator+")]),
    ("m.cpp", "namespace app {\nint free(int a) { return a; }\nclass W {\npublic:\n    void run() {}\n};\n}\nnamespace {\nint hidden() { return 1; }\n}\n", [("class", "app"), ("method", "app.free"), ("class", "app.W"), ("method", "app.W.run"), ("class", "<anonymous>"), ("method", "<anonymous>.hidden")]),
    ("m.cpp", "template <typename T>\nT max_value(T a, T b) {\n    return a;\n}\ntemplate <typename T>\nclass Box {\npublic:\n    T get() const { return v; }\n};\n", [("function", "max_value"), ("class", "Box"), ("method", "Box.get")]),
    ("m.cpp", "using namespace std;\nusing MyInt = int;\nvoid Widget::run()\n{\n    x = 1;\n}\n", [("block", "MyInt"), ("function", "Widget::run")]),
    ("m.cpp", "// c\n\nclass MYLIB_API Widget : public Base\n{\npublic:\n    void run() {}\n};\n", [("class", "Widget"), ("method", "Widget.run")]),
    ("m.js", "const f = async <T,>(x) => {\n  return x;\n};\nlet a = () => 1, b = 2;\n", [("function", "f"), ("block", "a")]),
    ("m.rs", "/* a /* b */ c */\nfn next() {}\n", [("function", "next")]),
    ("m.py", "\ufeffdef f(): pass\n", [("function", "f")]),
    ("m.c", "int old(a, b)\n  int a;\n  char *b;\n{\n  return a;\n}\nint next(void) { return 1; }\n", [("function", "old"), ("function", "next")]),
    ("m.c", "#if A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  return a;\n}\nint g(void) { return 2; }\n", [("function", "f"), ("function", "g")]),
]


@pytest.mark.parametrize("path,text,want", CASES)
def test_names(path, text, want):
    assert names(path, text) == want


def test_texts_and_lines():
    c = chunk_text("m.py", "# does it\ndef foo():\n    pass\n\nT = 30  # seconds\n\n\nclass K:\n    '''doc'''\n    x = 1\n    # about m\n    def m(self): pass\n")
    assert [(x.start_line, x.end_line) for x in c] == [(1, 3), (5, 5), (8, 12), (11, 12)]
    assert c[0].text.startswith("# does it\ndef foo") and c[1].text == "T = 30  # seconds"
    assert c[2].text == "class K:\n'''doc'''\nx = 1\n" and c[3].text.startswith("# about m\ndef m")
    w = {x.name: x for x in chunk_text("m.cpp", "// c\n\nclass MYLIB_API W\n{\npublic:\n    void run() {}\n};\n")}
    assert w["W.run"].start_line == 6


def test_udtf(spark):
    files = spark.createDataFrame([("a/m.py", "def f(): pass\n"), ("b.txt", "x"), ("c.rs", None)], "path string, content string")
    rows = {(r.path, r.name, r.error is None) for r in with_source_chunks(files).collect()}
    assert rows == {("a/m.py", "f", True), ("b.txt", None, False)}
