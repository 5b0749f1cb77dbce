"""C1-C10 and F1-F4 on literals."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import languages as L


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_find_calls(spark):
    assert one(spark, T.find_calls(F.col("x")), "if (a) f(1); g (2); return(h(3)); len(x); O(n^2)") == ["O", "f", "g", "h"]


@pytest.mark.parametrize("src,n", [("a && b || c ? d : e", 2), ("if x else y elif z except w", 3),
                                   ("switch(x){case 1: case 2:} catch while for", 7), ("ifx forx", 1)])
def test_complexity(spark, src, n):
    assert one(spark, T.complexity(F.col("x")), src) == n


def test_tags(spark):
    df = spark.createDataFrame([("quickSort", "memo[x] = new int;", "java"), ("f", "bst tree", "cpp"),
                                ("g", "nothing here", "c")], "n string, b string, l string")
    got = [r["t"] for r in df.select(T.make_tags(F.col("n"), F.col("b"), F.col("l")).alias("t")).collect()]
    assert got == [["sort", "dp", "memory", "java"], ["tree"], []]


def test_strip_matches_python(spark):
    s = " \t\n  body \x1c\r\n　"
    assert one(spark, T.strip(F.col("x")), s) == s.strip()


def test_document(spark):
    df = spark.createDataFrame([("f", "int", "int a", "{ return a; }\n\n", [])],
                               "n string, r string, p string, b string, t array<string>")
    doc = df.select(T.function_document(*[F.col(c) for c in "nrpbt"]).alias("d")).first()["d"]
    assert doc == "Function: f\nSignature: int f(int a)\nTags: general\nCode:\n{ return a; }"


def test_extract_code_and_explanation(spark):
    r = "## Root Cause\nx\n```c++\n  fixed();  \n```\n## Explanation\n first \n## Explanation\nsecond"
    assert one(spark, T.extract_code(F.col("x")), r) == "fixed();"
    assert one(spark, T.extract_explanation(F.col("x")), r) == "first \n## Explanation\nsecond"
    assert one(spark, T.extract_code(F.col("x")), "no fence") == ""
    assert one(spark, T.extract_explanation(F.col("x")), "plain") == "plain"


@pytest.mark.parametrize("d,s", [(0.875, "0.12"), (0.125, "0.88"), (0.0, "1.00"), (None, "0.00"), (0.5, "0.50")])
def test_similarity_half_even(spark, d, s):
    assert one(spark, T.format_similarity(F.col("x")), d, "x double") == s


def test_framework_names(spark):
    df = spark.createDataFrame([("gtest",), ("catch2",), ("junit",), ("other",)], "x string")
    assert [r[0] for r in df.select(T.framework_name(F.col("x"))).collect()] == \
        ["Google Test", "Catch2", "JUnit 5", "other"]


def test_languages_and_rejects(spark, files_df):
    df = files_df([("/uploads/FOO.CPP", "FOO.CPP", ""), ("/uploads/foo.cxx", "foo.cxx", ""),
                   ("/uploads/foo.txt", "foo.txt", ""), ("/uploads/cpp", "cpp", ""),
                   ("/uploads/a.tsx", "a.tsx", "")])
    tagged = {r.file_name: (r.lang, r.display_lang) for r in L.with_language(df).collect()}
    assert tagged == {"FOO.CPP": ("cpp", "C++"), "foo.cxx": ("cpp", "C++"), "foo.txt": (None, None),
                      "cpp": (None, None), "a.tsx": ("typescript", "TypeScript")}
    acc, rej = L.split_supported(df)
    assert sorted(r.file_name for r in acc.collect()) == ["FOO.CPP", "a.tsx", "foo.cxx"]
    errs = {r.file_name: (r.error_code, r.error) for r in rej.collect()}
    assert errs["foo.txt"][0] == 400
    assert errs["foo.txt"][1].startswith("Unsupported file type: 'foo.txt'. Supported: .c, .cc, .cpp, .cxx, .go")
    lint_ok = {r.file_name: r.a for r in df.select("file_name", L.is_analyzable(F.col("file_path")).alias("a")).collect()}
    assert lint_ok == {"FOO.CPP": True, "foo.cxx": False, "foo.txt": False, "cpp": False, "a.tsx": False}


def test_invalid_utf8_decoding(spark):
    df = spark.createDataFrame([(bytearray(b"A\xffB"),)], "content binary")
    assert df.select(F.make_valid_utf8(F.col("content").cast("string"))).first()[0] == "A�B"
