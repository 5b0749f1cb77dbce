"""L1-L6 on edge literals."""

from quarry.operators import lint


def findings(spark, files_df, src, path="/uploads/a.cpp"):
    df = files_df([(path, path.split("/")[-1], src)])
    return [(r.seq, r.type, r.line, r.severity) for r in lint.analyze(df).orderBy("seq").collect()]


def test_line_rules_order_and_fgets(spark, files_df):
    assert findings(spark, files_df, "x;\ngets(a); strcpy(b, c);\nfgets(b, n, f);\n") == [
        (1, "buffer_overflow", 2, "high"), (2, "buffer_overflow", 2, "medium"), (3, "buffer_overflow", 3, "high")]


def test_file_rules(spark, files_df):
    assert findings(spark, files_df, "int* p = new int;\nFILE* f = fopen(a, b);\n") == [
        (1, "memory_leak", 0, "high"), (2, "resource_leak", 0, "high")]
    assert findings(spark, files_df, "x = new\nT;\n") == []                  # new at line end
    assert findings(spark, files_df, "x = new T; // deleted later\n") == []   # 'delete' substring
    assert findings(spark, files_df, "renew x;\n") == []                      # word boundary
    assert findings(spark, files_df, "gets(a);", "/uploads/a.cxx") == []     # .cxx is not linted


def test_code_lines_getline_semantics(spark, files_df):
    df = files_df([("/a", "a", "x\ny\n"), ("/b", "b", ""), ("/c", "c", "x\n\ny")])
    got = sorted((r.file_path, r.line_no, r.line) for r in lint.code_lines(df).collect())
    assert got == [("/a", 1, "x"), ("/a", 2, "y"), ("/c", 1, "x"), ("/c", 2, ""), ("/c", 3, "y")]


def test_counts_and_prompt_text(spark, files_df):
    df = files_df([("/uploads/a.cpp", "a.cpp", "gets(x);\nint* p = new int;\n"), ("/uploads/b.cpp", "b.cpp", "ok")])
    fs = lint.analyze(df)
    counts = {r.file_path: r.finding_count for r in lint.finding_counts(df, fs).collect()}
    assert counts == {"/uploads/a.cpp": 2, "/uploads/b.cpp": 0}
    text = lint.format_findings(fs).first()["findings_text"]
    assert text == ("## Static Analysis Findings:\n\n- [HIGH] Line 1: gets() is unsafe, use fgets()\n"
                    "- [HIGH] Line 0: new used without delete, possible memory leak\n\n"
                    "Use these confirmed findings to provide more accurate fixes.")
