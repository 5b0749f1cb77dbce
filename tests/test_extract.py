"""Golden values on a hand-written sample and edge literals."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SAMPLE_CPP, SF_SMALL
from quarry.functions import headers as H
from quarry.operators.extract import brace_match, extract_functions, function_spans
from quarry.sources import corpus


def _extract(spark, files_df, src, path="/uploads/sample.cpp"):
    fns = extract_functions(files_df([(path, path.split("/")[-1], src)]))
    return [r.asDict() for r in fns.orderBy("open_off").collect()]


def test_sample_goldens(spark, files_df):
    got = _extract(spark, files_df, SAMPLE_CPP)
    summary = [(f["function_name"], f["return_type"], f["parameters"], f["line_start"], f["line_end"],
                f["complexity"], f["calls"], f["tags"]) for f in got]
    assert summary == [
        ("add", "int", "int a, int b", 5, 7, 1, [], []),
        ("bfs_order", "vector<int>", "vector<vector<int>>& graph, int start", 9, 16, 3,
         ["add", "empty", "push_back"], ["graph"]),
        ("memo_fib", "static int", "int n", 18, 20, 2, ["memo_fib"], ["dp"]),
        ("main", "int", "", 22, 26, 2, ["bfs_order", "g", "memo_fib", "size"], ["graph", "dp"]),
    ]
    assert got[0]["body"] == "{\n    return a + b;\n}"
    assert all(f["language"] == "cpp" for f in got)


def test_unclosed_body_runs_to_end(spark, files_df):
    got = _extract(spark, files_df, "int f(int x) { if (x) {\n  return 1;\n")
    assert len(got) == 1
    assert got[0]["body"] == "{ if (x) {\n  return 1;\n"
    assert got[0]["line_end"] == 3


def test_quoted_brace_counts(spark, files_df):
    got = _extract(spark, files_df, 'int f() { s = "}"; }\nint g() { }')
    assert got[0]["function_name"] == "f"
    assert got[0]["body"] == '{ s = "}'


def test_braces_in_parameters(spark, files_df):
    got = _extract(spark, files_df, "void f(V v = {}, W w = {1, {2}}) { g(); }\nint h(A a = A{}) { }")
    assert [(f["function_name"], f["parameters"], f["body"]) for f in got] == [
        ("f", "V v = {}, W w = {1, {2}}", "{ g(); }"), ("h", "A a = A{}", "{ }")]


CPP = """#include <x>
// costs O(n)
class Foo : public Bar {
 public:
  Foo(int a) : a_(a), b_(f(a)) { }
  ~Foo() { }
  int get() const { return a_; }
  int h() noexcept override { return 1; }
  Foo& operator=(const Foo& o) { return *this; }
  bool operator()(int a) const { return a; }
  operator bool() const { return true; }
  template <typename T, class U = std::map<int, T>> T conv(U u = {}) { return T(u); }
};
Foo::Foo(int a) : a_(a) { }
Foo::~Foo() { }
int Foo::bar(int x) { if (x) { y(); } else if (z) { } return 1; }
auto g(int a) -> std::vector<int> { return {}; }
char *name(void (*cb)(int), int n) /* note */ { FOREACH(x, y) { } switch (n) { } do { } while (x); }
static inline const std::map<int, int>& Ns::Outer<T<int>>::get(int a) noexcept(true) { for (;;) { } }
struct point origin(void) { struct point p = { 1, f(2) }; return p; }
if constexpr (a) { }
x = foo(a) { }
y = a ? f(x) : g(y) { }
return foo(a) { }
int last() { auto l = [&](int q) { return q; }; run([](int z) { }); }
"""


def test_c_declarators(spark, files_df):
    got = _extract(spark, files_df, CPP, "/u/a.cc")
    assert [(f["function_name"], f["return_type"], f["parameters"], f["line_start"]) for f in got] == [
        ("Foo", "", "int a", 5), ("~Foo", "", "", 6), ("get", "int", "", 7), ("h", "int", "", 8),
        ("operator=", "Foo&", "const Foo& o", 9), ("operator()", "bool", "int a", 10), ("operator bool", "", "", 11),
        ("conv", "T", "U u = {}", 12), ("Foo::Foo", "", "int a", 14), ("Foo::~Foo", "", "", 15), ("Foo::bar", "int", "int x", 16),
        ("g", "std::vector<int>", "int a", 17), ("name", "char *", "void (*cb)(int), int n", 18),
        ("Ns::Outer<T<int>>::get", "static inline const std::map<int, int>&", "int a", 19),
        ("origin", "struct point", "void", 20), ("last", "int", "", 25)]


def test_multi_line_python_headers(spark, files_df):
    py = ("import os\n\n@deco\ndef f(a,\n      b=(1, 2),  # )\n) -> Dict[str, int]:\n    \'\'\'doc\nnot the end\n    \'\'\'\n"
          "    if a:\n        return b\n\n    def g(x='):'):\n        return x\n    return a\n\n# trailing\nx = [\n1\n]\n"
          "async def h():\n    pass\nopen_ = (\ndef late(): pass\nclass A:\n    def m(\n        self\n    ):\n        return \"\"\"\n"
          "def not_code():\n\"\"\"\n")
    got = _extract(spark, files_df, py, "/u/a.py")
    assert [(f["function_name"], f["parameters"], f["line_start"], f["line_end"]) for f in got] == [
        ("f", "a,\n      b=(1, 2),  # )\n", 4, 15), ("g", "x='):'", 13, 14), ("h", "", 21, 22), ("late", "", 24, 24),
        ("m", "\n        self\n    ", 26, 31)]
    assert got[1]["body"] == "def g(x='):'):\n        return x"


def test_one_pass_without_exchange(spark):
    """On the derived corpus: one scan, and nothing that moves source text."""
    for fn in (extract_functions, function_spans):
        plan = fn(corpus.part_corpus(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_spans_are_the_functions_without_bodies(spark):
    files = corpus.part_corpus(spark, SF_SMALL)
    spans = function_spans(files)
    assert sorted(map(str, spans.collect())) == sorted(map(str, extract_functions(files).select(*spans.columns).collect()))


def test_headers_take_linear_time():
    """Long texts in which many places look like the start of a header."""
    cases = {
        "java": lambda n: "class A { int[] a = {" + "1, " * n + "}; }", "javascript": lambda n: "const o = {" + "a: f(1), " * n + "};",
        "cpp": lambda n: "int x[] = {" + " f(1) +" * n + "}; " + "a " * n + "f(){}", "typescript": lambda n: "a : b = " * n + "{ }",
        "go": lambda n: "func f(a) " * n + "{ }", "rust": lambda n: "fn f(a) " * n + "{ }", "php": lambda n: "function f(a) " * n + "{ }",
        "c": lambda n: "x" * (8 * n) + "(a){ }", "unknown": lambda n: "a b(c" * n + "){ }",
        "python": lambda n: "def f(" + "(a, 'b')," * n + "): pass\n" + "x = [\n" * n, "ruby": lambda n: "  def a(b)\n" * n}

    def seconds(lang, n):
        src, t = cases[lang](n), time.perf_counter()
        (H.indented if lang in ("python", "ruby") else H.braced)(src, lang)
        return time.perf_counter() - t

    for lang in cases:
        few, many = min(seconds(lang, 5_000) for _ in range(3)), seconds(lang, 50_000)
        assert many < 0.2 + 25 * few, (lang, few, many)


def test_else_if_skipped_and_nested_emitted(spark, files_df):
    src = "void outer(int a) {\n  if (a) { x(); } else if (a > 1) { y(); }\n  int inner(int b) { return b; }\n}\n"
    names = [f["function_name"] for f in _extract(spark, files_df, src)]
    assert names == ["outer", "inner"]


def test_crlf_and_language_tag(spark, files_df):
    src = "int f(int x) {\r\n  return x;\r\n}\r\n"
    got = _extract(spark, files_df, src, "/uploads/a.java")
    assert got[0]["line_start"] == 1 and got[0]["line_end"] == 3
    assert got[0]["tags"] == ["java"] and got[0]["language"] == "java"


def test_language_header_rules(spark, files_df):
    cases = {
        "/u/a.java": ("@Override\npublic static String greet(String who) throws IOException { return who; }\n"
                      "Object o = new Runnable() { }; public Made(int a) { } Map<String, Integer> t(int[] xs) { synchronized (x) { } }",
                      [("greet", "String", "String who"), ("t", "Map<String, Integer>", "int[] xs")]),
        "/u/a.js": ("function render(a, b) { return a(b); }\nconst add = (x, y) => { return x + y; };\n"
                    "list.map(x => { return x; }); this.go = async (a) => { }; const one = z => { foo(function() { }); };",
                    [("render", "", "a, b"), ("add", "", "x, y"), ("go", "", "a"), ("one", "", "z")]),
        "/u/a.tsx": ("const Card: FC<P> = ({ title }) => { return wrap(title); };\nfunction o<T>(a, { b } = {}): Map<number, T> { }",
                     [("Card", "", "{ title }"), ("o", "Map<number, T>", "a, { b } = {}")]),
        "/u/a.ts": ("const load = async (q: string): Promise<void> => { await f(q); };",
                    [("load", "Promise<void>", "q: string")]),
        "/u/a.go": ("func asm(x int) int\ntype T struct { }\nfunc handler(w int) (int, error) { return w, nil }\nfunc (s *Srv) method() { }",
                    [("handler", "(int, error)", "w int")]),
        "/u/a.rs": ("pub fn compute<T>(v: Vec<T>) -> usize { v.len() }", [("compute", "usize", "v: Vec<T>")]),
        "/u/a.php": ("function &php_fn($a) : ?int { return strlen($a); }", [("php_fn", "?int", "$a")]),
    }
    rows = [(p, p.split("/")[-1], src) for p, (src, _) in cases.items()]
    fns = extract_functions(files_df(rows)).orderBy("file_path", "open_off").collect()
    got = {}
    for r in fns:
        got.setdefault(r.file_path, []).append((r.function_name, r.return_type, r.parameters))
    assert got == {p: want for p, (_, want) in cases.items()}


def test_indentation_blocks(spark, files_df):
    py = ("import os\n\n@deco\ndef f(a, b=1) -> int:\n    # note\n    if a:\n        return b\n\n"
          "    def g(x):\n        return x\n    return a\n\n# trailing\nx = 1\nasync def h():\n    pass\n")
    rb = "class A\n  def self.run(a)\n    if a\n      puts(a)\n    end\n  end\nend\n"
    fns = extract_functions(files_df([("/u/a.py", "a.py", py), ("/u/b.rb", "b.rb", rb)]))
    got = [(r.function_name, r.parameters, r.line_start, r.line_end) for r in fns.orderBy("file_path", "open_off").collect()]
    assert got == [("f", "a, b=1", 4, 11), ("g", "x", 9, 10), ("h", "", 15, 16), ("run", "a", 2, 6)]


def test_ruby_one_line_def_leaves_the_end_of_its_class(spark, files_df):
    rb = "class A\n  def x; 1; end\nend\n\nclass B\n  def y\n    2\n  end\nend\n"
    fns = extract_functions(files_df([("/u/c.rb", "c.rb", rb)]))
    got = [(r.function_name, r.line_start, r.line_end, r.body) for r in fns.orderBy("open_off").collect()]
    assert got == [("x", 2, 2, "def x; 1; end"), ("y", 6, 8, "def y\n    2\n  end")]


def test_a_very_deep_def_does_not_multiply_the_file(spark, files_df):
    src = "def a():\n    return 1\n" + " " * 5000 + "def b():\n" + " " * 5001 + "return 2\n"
    got = [(r.function_name, r.line_start, r.line_end)
           for r in extract_functions(files_df([("/u/d.py", "d.py", src)])).orderBy("open_off").collect()]
    assert got == [("a", 1, 4), ("b", 3, 4)]


def test_empty_and_braceless_files(spark, files_df):
    assert _extract(spark, files_df, "") == []
    assert _extract(spark, files_df, "just text, no code") == []


def test_unicode_identifiers(spark, files_df):
    got = _extract(spark, files_df, "int f() { naïve(x); café (y); }")
    assert got[0]["calls"] == ["café", "naïve"]


def test_duplicate_names_both_extracted(spark, files_df):
    got = _extract(spark, files_df, "void f() { a(); }\nvoid f() { b(); }\n")
    assert [(f["function_name"], f["calls"]) for f in got] == [("f", ["a"]), ("f", ["b"])]


def _scan_pairs(text):
    """One pass with a stack of open offsets: '{' offset -> '}' offset or None."""
    pairs, waiting = {}, []
    for at, ch in enumerate(text):
        if ch == "{":
            pairs[at] = None
            waiting.append(at)
        elif ch == "}" and waiting:
            pairs[waiting.pop()] = at
    return pairs


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="{}ab\n", min_size=0, max_size=40), min_size=1, max_size=4))
def test_brace_matching_property(spark, texts):
    rows = [(f"/f{i}.c", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_path string, source_code string")
    got = {}
    for r in brace_match(df).collect():
        got[(r.file_path, r.open_off)] = r.close_off
    want = {}
    for path, t in rows:
        for k, v in _scan_pairs(t).items():
            want[(path, k)] = v
    assert got == want


def test_random_headers_are_those_written(spark, files_df):
    """Files put together from headers and other statements: the functions
    found are the headers the generator wrote."""
    rnd = random.Random(3)
    types = ["int", "void", "static const char*", "std::vector<int>", "unsigned\n  long", "T&"]
    other = ["x = 1;\n", "g(a, b);\n", "if (x) { g(); }\n", "for (;;) { }\n", "a[0] = f(1) + 2;\n", "{ }\n",
             "int y;\n", "while (x > 0) { x--; }\n", "int h(int a);\n"]
    gaps = ["", " ", "\n", "\t "]
    rows, want = [], []
    for i in range(60):
        path, src = f"/r{i}.c", ""
        for j in range(rnd.randint(0, 4)):
            src += "".join(rnd.choice(other) for _ in range(rnd.randint(0, 3)))
            ret, name, params = rnd.choice(types), f"f_{i}_{j}", rnd.choice(["", "int a", "int a,\n  T* b", " x "])
            inner = "".join(rnd.choice(other) for _ in range(rnd.randint(0, 2)))
            src += f"{ret} {name}{rnd.choice(gaps)}({params}){rnd.choice(gaps)}{{ {inner}}}\n"
            want.append((path, name, ret, params, f"{{ {inner}}}"))
        rows.append((path, path[1:], src))
    fns = extract_functions(files_df(rows))
    got = sorted((r.file_path, r.function_name, r.return_type, r.parameters, r.body) for r in fns.collect())
    assert got == sorted(want)


def test_first_by_name_picks_before_the_shuffle(spark):
    from quarry.operators.graph import functions_by_name

    rows = [("main", f"/u/{i % 7}.c", 50 - i, i, [f"c{i}"]) for i in range(50)] + [("one", "/u/z.c", 1, 0, None), ("off", "/u/a.c", 1, 0, []),
                                                                                  (None, "/u/a.c", 1, 0, [])]
    fns = spark.createDataFrame(rows, "function_name string, file_path string, line_start int, open_off long, calls array<string>")
    names = spark.createDataFrame([("main",), ("main",), ("one",), ("none",), (None,)], "function_name string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = functions_by_name(fns, names)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == [("main", "/u/0.c", 1, 49, ["c49"]), ("one", "/u/z.c", 1, 0, None)]
    assert "partial_min_by" in plan and "Window" not in plan


def test_part_files_are_dealt_out(spark, tmp_path, monkeypatch):
    """One split of ``part`` holds every row here; its files still spread over tasks, each once."""
    from quarry.sources import corpus

    rows = [(i, f"red ring{i}", "Brand#1", "PROMO" if i % 2 else "SMALL", i % 30) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int") \
        .coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    whole = corpus.part_corpus(spark, str(tmp_path))
    monkeypatch.setattr(corpus, "FILES_PER_TASK", 4, raising=False)
    dealt = corpus.part_corpus(spark, str(tmp_path))
    assert whole.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 10
    assert sorted(dealt.collect()) == sorted(whole.collect()) and dealt.count() == 40
    assert corpus.part_corpus(spark, str(tmp_path), 2, corpus.REUPLOAD_WHERE).count() == 20
