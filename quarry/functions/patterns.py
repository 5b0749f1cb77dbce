"""Fixed values and regular expressions.

Everything in the "fixed values" blocks must stay equal to the behaviour being
reproduced (keyword sets, extension table, rule texts, prompt templates).  The
regular expressions below are written so that the *same string* runs in Java
(Spark) and in RE2 (DuckDB, used by the oracle checks), and so that both give
Python ``re`` semantics for ``str`` patterns:

* Python ``\\w`` on ``str`` is ``[\\p{L}\\p{N}_]`` (letters, numbers, underscore);
* Python ``\\s`` on ``str`` is every character for which ``str.isspace()`` holds,
  which is Unicode White_Space plus U+001C..U+001F.

Java's ``\\w`` is ASCII-only and RE2's is too, so the classes are spelled out.
Word boundaries are expressed by the shape of the match (maximal runs) or by a
look-behind on the Spark side; RE2 has no look-around, so the oracle twins use
the run formulation.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Character classes (engine-neutral spelling of Python's \w and \s)
# ---------------------------------------------------------------------------
W = r"\p{L}\p{N}_"
WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# ---------------------------------------------------------------------------
# languages
# ---------------------------------------------------------------------------
# extension -> (language id, display name), in the order they are tried
EXTENSION_TABLE = [
    (".cpp", "cpp", "C++"), (".cc", "cpp", "C++"), (".cxx", "cpp", "C++"),
    (".c", "c", "C"), (".h", "cpp", "C++"), (".hpp", "cpp", "C++"),
    (".py", "python", "Python"), (".js", "javascript", "JavaScript"),
    (".ts", "typescript", "TypeScript"), (".jsx", "javascript", "JavaScript"),
    (".tsx", "typescript", "TypeScript"), (".java", "java", "Java"),
    (".go", "go", "Go"), (".rs", "rust", "Rust"),
    (".rb", "ruby", "Ruby"), (".php", "php", "PHP"),
]
SUPPORTED_EXTENSIONS = sorted(e for e, _, _ in EXTENSION_TABLE)

# extensions the static analyzer accepts (".cxx" is indexed but not linted)
ANALYZABLE_EXTENSIONS = [".cpp", ".c", ".h", ".hpp", ".cc"]

# language vote table for prompts: language id -> (display name, fence tag),
# in the order ties are broken
PROMPT_LANGUAGES = [
    ("python", "Python", "python"), ("javascript", "JavaScript", "javascript"),
    ("typescript", "TypeScript", "typescript"), ("java", "Java", "java"),
    ("go", "Go", "go"), ("rust", "Rust", "rust"), ("ruby", "Ruby", "ruby"),
    ("php", "PHP", "php"),
]
DEFAULT_PROMPT_LANGUAGE = ("C++", "cpp")

# test framework display names
FRAMEWORK_NAMES = [
    ("catch2", "Catch2"), ("gtest", "Google Test"), ("pytest", "pytest"),
    ("jest", "Jest"), ("junit", "JUnit 5"),
]
ACCEPTED_FRAMEWORKS = ["catch2", "gtest"]

# ---------------------------------------------------------------------------
# Extraction and metrics
# ---------------------------------------------------------------------------
HEADER_SKIP_NAMES = ["if", "while", "for", "switch", "catch"]
CALL_SKIP_NAMES = ["if", "while", "for", "switch", "return", "sizeof", "print", "len"]
# keywords that add one to complexity; "&&" and "||" are in the set but the
# tokenizer never produces them, so they never count
COMPLEXITY_KEYWORDS = ["if", "else", "for", "while", "switch", "case", "catch", "&&", "||", "?"]
COMPLEXITY_WORDS = [k for k in COMPLEXITY_KEYWORDS if k.isalpha()]

# tag -> substrings of lower(name + body), in output order
TAG_RULES = [
    ("graph", ["graph", "edge", "dijkstra", "bfs", "dfs"]),
    ("sort", ["sort", "merge", "quick"]),
    ("tree", ["tree", "bst", "inorder"]),
    ("dp", ["dp[", "memo", "knapsack"]),
    ("memory", ["new ", "delete", "malloc", "free"]),
]
UNTAGGED_LANGUAGES = ["cpp", "c"]

BODY_PREVIEW_CHARS = 500
DEFAULT_TOP_K = 5
MAX_TOP_K = 20
TEST_TOP_K = 3

# ---------------------------------------------------------------------------
# Lint rules
# ---------------------------------------------------------------------------
# (substring, type, severity, detail), checked per line in this order
LINE_RULES = [
    ("gets(", "buffer_overflow", "high", "gets() is unsafe, use fgets()"),
    ("strcpy(", "buffer_overflow", "medium", "strcpy has no bounds check, use strncpy"),
]
MEMORY_LEAK = ("memory_leak", "high", "new used without delete, possible memory leak")
RESOURCE_LEAK = ("resource_leak", "high", "fopen without fclose, file handle leaked")
FINDINGS_HEADING = "## Static Analysis Findings:"
FINDINGS_FOOTER = "Use these confirmed findings to provide more accurate fixes."

# ---------------------------------------------------------------------------
# messages
# ---------------------------------------------------------------------------
UNSUPPORTED_MESSAGE = "Unsupported file type: '{name}'. Supported: {exts}"
NO_FUNCTIONS_MESSAGE = ("No functions found in the uploaded {lang} file. "
                        "Make sure it contains valid function definitions.")
INDEXED_MESSAGE = ("✅ Successfully indexed {n} {lang} functions. "
                   "You can now query: POST /debug_function or /generate_tests")
EMPTY_INDEX_MESSAGE = "No code indexed yet. Upload a file first: POST /upload_code"
BAD_FRAMEWORK_MESSAGE = "Invalid framework. Use 'catch2' or 'gtest'"
NO_CHUNKS_TEXT = "No relevant code found."
SYSTEM_MESSAGE = ("You are an expert software engineer with deep knowledge of data "
                  "structures, algorithms, and debugging.")

DEBUG_PROMPT_TEMPLATE = '''You are an expert {language} engineer.

A developer asked: "{query}"

Relevant {language} functions from their codebase:

{code_chunks}

{static_analysis}

Instructions:
1. Check static analysis findings first (if any) - these are confirmed issues.
2. Identify any additional bugs.
3. Provide corrected code as a complete function.
4. Explain what was wrong and why.

## Root Cause
[bug explanation]

## Fixed Code
```{lang_tag}
[corrected function]
```

## Explanation
[why this fix works]
'''

TEST_PROMPT_TEMPLATE = '''Generate unit tests for this {language} code using {framework}:

{code_chunks}

Cover normal cases, edge cases, and error conditions.
Output ONLY the test code:

```{lang_tag}
[tests here]
```
'''

# ---------------------------------------------------------------------------
# Regular expressions (fixed semantics; see module doc for the spelling)
# ---------------------------------------------------------------------------
# file -> pieces that each start at a brace (the first may start with text)
P_SEGMENT = r"[{}][^{}]*|\A[^{}]+"

# identifiers followed by "(": Spark form with a look-behind word boundary
P_CALL = rf"(?<![{W}])([a-zA-Z_][{W}]*)[{WS}]*\("
# RE2 twin: every maximal word run, with the "(" that may follow it
P_CALL_RUNS = rf"[{W}]+[{WS}]*\(?"

# complexity: keyword runs and "?"
P_COMPLEXITY = rf"(?<![{W}])(?:{'|'.join(COMPLEXITY_WORDS)})(?![{W}])|\?"
P_TOKEN_RUNS = rf"[{W}]+|[&|?]"

P_STRIP = rf"\A[{WS}]+|[{WS}]+\z"
P_LSTRIP = rf"\A[{WS}]+"

P_FENCE = r"(?s)```[\p{L}\p{N}_+]*\n(.*?)```"

# "new" followed by blank on the same line, ASCII word boundary before it
P_NEW_SPARK = r"(?<![A-Za-z0-9_])new[ \t\x{0B}\f\r]"
P_NEW_RE2 = r"(^|[^A-Za-z0-9_])new[ \t\x{0B}\f\r]"

# hashing embedder tokens: lower-cased word runs
P_EMBED_TOKEN = rf"[{W}]+"

# ---------------------------------------------------------------------------
# Words that header rules turn away (X4) and indentation languages
# ---------------------------------------------------------------------------
# a word here is no return type
JAVA_NOT_RETURN_TYPES = ["new", "return", "else", "throw"]
# with a modifier in place of the type it is a constructor
JAVA_MODIFIERS = ["public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp"]
# C and C++: after one of these comes an expression or a block, no function name
NOT_BEFORE_A_NAME = HEADER_SKIP_NAMES + [
    "return", "else", "new", "throw", "case", "goto", "delete", "do", "typedef", "using", "co_return", "co_await", "co_yield",
    "struct", "class", "union", "enum", "namespace"]
INDENT_LANGUAGES = ["python", "ruby"]
