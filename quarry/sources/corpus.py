"""Code corpora derived from the given tables.

The provided tables hold no source code, so the engine's inputs are derived
from them by SQL that Spark and DuckDB evaluate identically (the same text is
the base view of both sides of every oracle check).  Every row of the source
table becomes one file, so the corpus grows with the table.

``part`` gives a C-like corpus with one file per part: functions named after
the part, branches, loops, ternaries, calls to a helper shared by one file in
seven, duplicate definitions, an unclosed body, a quoted brace, CRLF line
ends, a non-ASCII identifier in a comment and the lint triggers
(``new``/``delete``, ``gets``/``fgets``/``strcpy``, ``fopen``/``fclose``).
Extensions cycle through every supported one plus ``.txt`` (rejected) and an
upper-case ``.CPP``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

FILES_PER_TASK = 8192         # files that one task makes and reads

_EXTENSIONS = [".cpp", ".c", ".cxx", ".py", ".java", ".txt", ".h", ".hpp", ".cc",
               ".js", ".ts", ".go", ".rs", ".rb", ".php", ".CPP", ".tsx", ".jsx"]


def _ext_case(key: str) -> str:
    whens = " ".join(f"when {i} then '{e}'" for i, e in enumerate(_EXTENSIONS))
    return f"case {key} % {len(_EXTENSIONS)} {whens} end"


def part_corpus_sql(part: str = "part", version: int = 1, where: str | None = None) -> str:
    """SQL for ``code_files(file_path, file_name, source_code)`` over ``part``.

    ``version`` > 1 renames the main function (``…_v2``), as a re-upload of
    changed code would; ``where`` picks the parts of a later batch by a data
    predicate (e.g. ``p_type = 'PROMO'``).
    """
    nl = "chr(10)"
    k = "cast(p_partkey as string)"
    h = "cast(p_partkey % 7 as string)"
    fname = f"replace(p_name, ' ', '_') || '_' || {k}"
    if version > 1:
        fname += f" || '_v{version}'"
    body = f"""
 '// ' || p_type || ' part ' || p_brand || ' costs O(n)' || {nl}
 || '#include <x>' || {nl}
 || 'int ' || {fname} || '(int x, int y) {{' || {nl}
 || '  if (x > ' || cast(p_size as string) || ') {{ return helper_' || {h} || '(x); }}' || {nl}
 || '  else if (y < 0) {{ y = -y; }}' || {nl}
 || case when p_size % 3 = 0 then '  int* p = new int[4];' || {nl} else '' end
 || case when p_size % 6 = 0 then '  delete p;' || {nl} else '' end
 || case when p_size % 5 = 0 then '  gets(buf); strcpy(a, b);' || {nl} else '' end
 || case when p_size % 7 = 0 then '  fgets(buf, n, f);' || {nl} else '' end
 || case when p_size % 4 = 0 then '  FILE* h = fopen(n, m);' || {nl} else '' end
 || case when p_size % 8 = 0 then '  fclose(h);' || {nl} else '' end
 || case when p_size % 11 = 0 then '  const char* s = "}}";' || {nl} else '' end
 || case when p_size % 12 = 0 then '  dp[x] = 1;' || {nl} else '' end
 || case when p_size % 15 = 0 then '  // naïve(x) café' || {nl} else '' end
 || case when p_size % 9 = 0 then '  y = ' || {fname} || '(x - 1, y) + memo[x];' || {nl} else '' end
 || '  for (int i = 0; i < x; i++) {{ y += i % 2 == 0 ? 1 : 2; }}' || {nl}
 || '  return x ? y : 2;' || {nl} || '}}' || {nl}
 || 'void helper_' || {h} || '(int y) {{ while (y > 0) {{ y--; }} sort_it(y); }}' || {nl}
 || case when p_size % 13 = 0
         then 'void helper_' || {h} || '(int z) {{ switch (z) {{ case 1: break; }} }}' || {nl}
         else '' end
 || case when p_size % 10 = 0
         then 'int tail_' || {k} || '(int z) {{ if (z) {{' || {nl} || '  return bfs(z);' || {nl}
         else '' end"""
    # one function in the file's own language syntax (X4), by extension slot
    ext_idx = f"p_partkey % {len(_EXTENSIONS)}"
    idx = {e: i for i, e in enumerate(_EXTENSIONS)}
    lang_fn = f"""
 || case {ext_idx}
      when {idx['.cpp']} then 'class Box_' || {k} || ' : public Shape {{' || {nl} || ' public:' || {nl}
           || '  int get() const {{ return v_; }}' || {nl}
           || '  int grow(int q) noexcept override {{ return q ? 1 : get(); }}' || {nl}
           || '  ~Box_' || {k} || '() {{ free(v_); }}' || {nl} || '  int v_;' || {nl} || '}};' || {nl}
           || 'int Box_' || {k} || '::area(int w) const {{ return get() * w; }}' || {nl}
           || 'Box_' || {k} || '::Box_' || {k} || '(int a) : v_(a), w_(twice(a)) {{ init(a); }}' || {nl}
           || 'void fill_' || {k} || '(V v = {{}}, int n = 0) {{ use(v); }}' || {nl}
      when {idx['.hpp']} then 'template <typename T>' || {nl}
           || 'T pick_' || {k} || '(const std::map<int, T>& m, int k) {{ return m.at(k); }}' || {nl}
           || 'auto len_' || {k} || '(int a) -> std::size_t {{ return a; }}' || {nl}
      when {idx['.cc']} then 'bool Key_' || {k} || '::operator==(const Key_' || {k} || '& o) const {{ return same(o); }}' || {nl}
           || 'char *name_' || {k} || '(void (*cb)(int), int n) {{ cb(n); return 0; }}' || {nl}
      when {idx['.java']} then 'public Made_' || {k} || '(int a) {{ this.a = a; }}' || {nl}
           || 'Map<String, Integer> table_' || {k} || '(List<String> xs) {{ return of(xs); }}' || {nl} || '@Override' || {nl} || 'public static String greet_' || {k}
           || '(String who) throws IOException {{ return who.trim(); }}' || {nl}
      when {idx['.js']} then 'function render_' || {k} || '(a, b) {{ return a(b); }}' || {nl}
           || 'const add_' || {k} || ' = (x, y) => {{ return x + y; }};' || {nl}
      when {idx['.jsx']} then 'export default function View_' || {k} || '(props) {{ return h(props); }}' || {nl}
      when {idx['.ts']} then 'function opts_' || {k} || '(a: A, options = {{}}): Map<string, A> {{ return mk(a); }}' || {nl} || 'function typed_' || {k} || '(a: number): number {{ return a * 2; }}' || {nl}
           || 'const load_' || {k} || ' = async (q: string): Promise<void> => {{ await fetch(q); }};' || {nl}
      when {idx['.tsx']} then 'const Card_' || {k} || ': FC<P> = ({{ title }}) => {{ return wrap(title); }};' || {nl}
      when {idx['.go']} then 'func handler_' || {k} || '(w int, r int) (int, error) {{ return w, nil }}' || {nl}
           || 'func (s *Srv) method_' || {k} || '() {{ s.run() }}' || {nl}
      when {idx['.rs']} then 'pub fn compute_' || {k} || '<T>(v: Vec<T>) -> usize {{ v.len() }}' || {nl}
      when {idx['.php']} then 'function &php_' || {k} || '($a) : ?int {{ return strlen($a); }}' || {nl}
      when {idx['.py']} then 'def wide_' || {k} || '(' || {nl} || '    a,' || {nl} || '    b=(1, 2),' || {nl} || ') -> int:' || {nl}
           || '    return pick(a,' || {nl} || 'b)' || {nl} || '@cache' || {nl} || 'def py_' || {k} || '(a, b=1) -> int:' || {nl}
           || '    if a:  # branch' || {nl} || '        return sort_it(b)' || {nl} || {nl}
           || '    def inner(x):' || {nl} || '        return x' || {nl} || '    return inner(a)' || {nl}
           || '# done' || {nl} || 'async def fetch_' || {k} || '(url):' || {nl} || '    return await get(url)' || {nl}
      when {idx['.rb']} then 'def rb_' || {k} || '(a)' || {nl} || '  if a' || {nl} || '    puts(a)' || {nl}
           || '  end' || {nl} || 'end' || {nl} || 'class Rb_' || {k} || {nl}
           || '  def one_' || {k} || '; 1; end' || {nl} || 'end' || {nl}
           || 'def self.ok_' || {k} || '?' || {nl} || '  true' || {nl}
      else '' end"""
    body += lang_fn
    return f"""
select '/uploads/' || file_name as file_path, file_name,
       case when p_size % 14 = 0 then replace(src, chr(10), chr(13) || chr(10)) else src end
         as source_code
from (
  select 'part_' || {k} || {_ext_case('p_partkey')} as file_name, p_size,
         {body} as src
  from {part}{f" where {where}" if where else ""}
) t"""


def spark_table_ref(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir.rstrip('/')}/{name}.parquet`"


def part_corpus(spark: SparkSession, sf_dir: str, version: int = 1, where: str | None = None) -> DataFrame:
    """The ``part``-derived code corpus as a DataFrame.

    A row of ``part`` is far smaller than its file, so one split of the table
    can hold every file; the rows are dealt out before they become files.
    """
    part = spark_table_ref(sf_dir, "part")
    tasks = math.ceil(spark.sql(f"select count(*) from {part}").first()[0] / FILES_PER_TASK)
    if tasks > 1:
        part = f"(select /*+ repartition({tasks}) */ p_partkey, p_name, p_brand, p_type, p_size from {part})"
    return spark.sql(part_corpus_sql(part, version, where))


# Index batches used by the store checks: everything, then a re-upload of one
# part type with changed code, then a delete of one brand.  The predicates are
# data values, so each batch grows with the table.
REUPLOAD_WHERE = "p_type = 'PROMO'"
DELETE_WHERE = "p_brand = 'Brand#3'"
CLEAR_WHERE = "p_brand = 'Brand#2'"
BATCH_TIMES = {1: "2024-01-01 00:00:00", 2: "2024-01-02 00:00:00", 3: "2024-01-03 00:00:00"}


def pages_corpus_sql(pages: str = "pages") -> str:
    """Raw web pages as code files (inline script and CSS carry braces)."""
    return f"select url as file_path, url as file_name, html as source_code from {pages}"


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(pages_corpus_sql(spark_table_ref(sf_dir, "pages")))


def documents_corpus_sql(documents: str = "documents") -> str:
    """Prose documents as text files (whole texts, four languages)."""
    return (f"select '/docs/' || cast(doc_id as string) || '.txt' as file_path, "
            f"cast(doc_id as string) || '.txt' as file_name, text as source_code from {documents}")


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(documents_corpus_sql(spark_table_ref(sf_dir, "documents")))


def document_files_sql(documents: str = "documents") -> str:
    """Documents named as Go files: a code table under other column names
    (S2); prose defines no function, so F3 turns such files away."""
    return f"select '/docs/' || cast(doc_id as string) || '.go' as path, text as content from {documents}"


def responses_sql(conversations: str = "conversations") -> str:
    """Model responses: assistant turns put their text into a fenced block and
    an explanation, user turns are plain texts."""
    return f"""
select conv_id, turn, case when role = 'assistant'
  then '## Fixed Code' || chr(10) || '```cpp' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10)
       || '## Explanation' || chr(10) || text
  else text end as text
from {conversations}"""


def debug_requests_sql(conversations: str = "conversations") -> str:
    """Debug questions: every user turn of ``conversations``.  Every fourth
    turn names a file (which may not be indexed); ``top_k`` comes from the
    text length and covers the invalid values 0 and 21 and NULL (default)."""
    return f"""
select cast(conv_id * 1000 + turn as bigint) as request_id, text as query,
  case when turn % 4 = 0
       then '/uploads/part_' || cast(conv_id + 1 as string) || {_ext_case('(conv_id + 1)')} end as file_filter,
  case when length(text) % 23 = 22 then null else cast(length(text) % 23 as integer) end as top_k
from {conversations} where role = 'user'"""


def test_requests_sql(part: str = "part") -> str:
    """Test-generation requests: one per distinct part name, asking for the
    main function of the part with the smallest key of that name."""
    return f"""
select min(p_partkey) as request_id,
  replace(p_name, ' ', '_') || '_' || cast(min(p_partkey) as string) as function_name,
  case min(p_size) % 4 when 0 then 'catch2' when 1 then 'gtest' when 2 then null else 'pytest' end as framework
from {part} group by p_name"""
