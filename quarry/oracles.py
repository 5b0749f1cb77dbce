"""DuckDB twins of the registered queries (the correctness oracle).

Each entry is plain SQL over the driver's views (``part``, ``pages``,
``documents``, ``embeddings``, ``conversations``, …).  The same corpus SQL and
the same regular-expression strings as the Spark side are used, so the twin
is an independent *evaluation*, not an independent *spec*.  RE2 has no
look-around, so word-boundary rules are written with maximal word runs.
"""

from __future__ import annotations

from quarry.functions import patterns as P
from quarry.sources.corpus import documents_corpus_sql, pages_corpus_sql, part_corpus_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def nl(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(P.P_STRIP)}, '', 'g')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, {q(P.P_LSTRIP)}, '', 'g')"


def lang_of_name(name: str) -> str:
    ext = f"regexp_extract(lower({name}), '\\.[^./]*$', 0)"
    whens = " ".join(f"when {q(e)} then {q(lang)}" for e, lang, _ in P.EXTENSION_TABLE)
    return f"(case {ext} {whens} end)"


def display_of_name(name: str) -> str:
    ext = f"regexp_extract(lower({name}), '\\.[^./]*$', 0)"
    whens = " ".join(f"when {q(e)} then {q(d)}" for e, _, d in P.EXTENSION_TABLE)
    return f"(case {ext} {whens} end)"


def analyzable(path: str) -> str:
    suffix = f"lower(regexp_extract(regexp_extract({path}, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1))"
    return f"({suffix} in ({', '.join(q(e) for e in P.ANALYZABLE_EXTENSIONS)}))"


def calls(body: str) -> str:
    runs = f"regexp_extract_all(coalesce({body}, ''), {q(P.P_CALL_RUNS)}, 0)"
    called = (f"list_filter({runs}, lambda t: right(t, 1) = '(' and regexp_matches(t, '^[a-zA-Z_]'))")
    names = f"list_transform({called}, lambda t: regexp_extract(t, {q('^[' + P.W + ']+')}, 0))"
    kept = f"list_filter({names}, lambda n: not list_contains({sql_list(P.CALL_SKIP_NAMES)}, n))"
    return f"list_sort(list_distinct({kept}))"


def complexity(body: str) -> str:
    toks = f"regexp_extract_all(coalesce({body}, ''), {q(P.P_TOKEN_RUNS)}, 0)"
    kws = sql_list(P.COMPLEXITY_KEYWORDS)
    return f"cast(1 + len(list_filter({toks}, lambda t: list_contains({kws}, t))) as integer)"


def tags(name: str, body: str, lang: str) -> str:
    text = f"lower(coalesce({name}, '') || coalesce({body}, ''))"
    parts = []
    for tag, needles in P.TAG_RULES:
        cond = " or ".join(f"contains({text}, {q(n)})" for n in needles)
        parts.append(f"case when {cond} then {q(tag)} end")
    parts.append(f"case when {lang} not in ({', '.join(q(x) for x in P.UNTAGGED_LANGUAGES)}) then {lang} end")
    return f"list_filter([{', '.join(parts)}], lambda x: x is not null)"


def join_list(x: str, sep: str = ",") -> str:
    return f"array_to_string({x}, {q(sep)})"


# Header rules of the twin (X4), on the text back to the last cut of the same
# level; brackets inside parenthesised groups are encoded, so a group is
# \(([^()]*)\).  language -> [(pattern, group of the return type, name, parameters)]
_S = r"[ \t\n\x{0B}\f\r]"
_I = r"[A-Za-z0-9_]"
_B = r"(?:\A|[^A-Za-z0-9_$.])"
_G = r"\(([^()]*)\)"
HEADERS = {
    "java": [(rf"({_I}[A-Za-z0-9_\[\].?]*(?:<[^()]*>)?(?:\[\])*){_S}+({_I}+){_S}*{_G}{_S}*(?:throws{_S}+[A-Za-z0-9_., \t\n\r]+?)?{_S}*\z",
              1, 2, 3)],
    "javascript": [
        (rf"(?s){_B}function{_S}*\*?{_S}*({_I}+){_S}*(?:<[^()]*>)?{_S}*{_G}{_S}*(?::{_S}*([^=]+?))?{_S}*\z", 3, 1, 2),
        (rf"(?s){_B}({_I}+){_S}*(?::[^=]+)?={_S}*(?:async{_S}*)?(?:{_G}|{_I}+){_S}*(?::{_S}*([^=]+?))?{_S}*=>{_S}*\z", 3, 1, 2),
    ],
    "go": [(rf"{_B}func{_S}+({_I}+){_S}*(?:\[[^()]*\])?{_S}*{_G}{_S}*([^\n]*?){_S}*\z", 3, 1, 2)],
    "rust": [(rf"(?s){_B}fn{_S}+({_I}+){_S}*(?:<[^()]*>)?{_S}*{_G}{_S}*(?:->{_S}*(.*?))?{_S}*(?:where\b.*)?\z", 3, 1, 2)],
    "php": [(rf"{_B}function{_S}+&?({_I}+){_S}*{_G}{_S}*(?::{_S}*([?A-Za-z0-9_\\|]+))?{_S}*\z", 3, 1, 2)],
}
HEADERS["typescript"] = HEADERS["javascript"]
# C and C++, on what follows the last comment, directive or access label: leading blanks and template, return type,
# name, parameters, trailing return type
C_HEADER = (rf"(?s)\A({_S}*(?:template{_S}*<[^<>]*>{_S}*)?)((?:[A-Za-z0-9_:*&<>, \t\n\r]*[ \t\n\r*&])?)"
            rf"((?:{_I}+(?:<[^()]*>)?::)*(?:operator[^A-Za-z0-9_ \t\n()]{{1,3}}|~?{_I}+)){_S}*{_G}{_S}*"
            rf"(?:(?:const|noexcept|override|final){_S}*)*(?::[^:].*|->{_S}*(.*?))?{_S}*\z")
C_CUT = rf"(?s)\A(?:.*(?:(?://|#)[^\n]*\n|(?:public|private|protected){_S}*:))?(.*)\z"
# the scanner's own pattern for files of no known language, on reversed text: parameters, name, return type
ANY_REVERSED = rf"\A[{P.WS}]*\)([^)]*)\([{P.WS}]*([{P.W}]+)[{P.WS}]+([{P.W}:*&<>{P.WS}]+)"
PY_DEF = r"(?s)^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*\((.*)\)[ \t\r\n]*(?:->[^:]*)?:"
RB_DEF = r"^[ \t]*def[ \t]+(?:self\.)?([A-Za-z_][A-Za-z0-9_]*[?!=]?)[ \t]*(?:\((.*)\))?"
RB_END = r"^[ \t]*end\b"
INDENT = r"^[ \t]*"
COMMENT_OR_BLANK = r"^[ \t\r]*(#.*)?$"


def lang_of_path(path: str = "file_path") -> str:
    return "coalesce(" + lang_of_name(f"regexp_extract({path}, '[^/]*$', 0)") + ", 'unknown')"


def header_case(h: str) -> str:
    """X4 rules in SQL: a struct(m, ret, name, params) or NULL; ``m`` is the end of the header that matched."""
    whens = []
    for lang, rules in HEADERS.items():
        alts = [f"case when regexp_matches({h}, {q(pat)}) then struct_pack(m := regexp_extract({h}, {q(pat)}, 0), "
                f"ret := regexp_extract({h}, {q(pat)}, {r}), name := regexp_extract({h}, {q(pat)}, {n}), "
                f"params := regexp_extract({h}, {q(pat)}, {k})) end" for pat, r, n, k in rules]
        whens.append(f"when {q(lang)} then coalesce({', '.join(alts)}, null)")
    c = f"regexp_extract({h}, {q(C_CUT)}, 1)"
    part = lambda k: f"regexp_extract({c}, {q(C_HEADER)}, {k})"
    words = f"regexp_extract({part(2)}, '([A-Za-z0-9_]+){_S}*$', 1)"
    no_type = f"{strip(part(2))} = ''"
    c_rule = (f"case when regexp_matches({c}, {q(C_HEADER)}) and {words} not in ({', '.join(q(x) for x in P.NOT_BEFORE_A_NAME)}) "
              f"and (not {no_type} or regexp_matches({part(3)}, '::|^~|^operator')) "
              f"then struct_pack(m := substr({c}, length({part(1)}) + 1), ret := case when {part(5)} <> '' then {part(5)} else {part(2)} end, "
              f"name := {part(3)}, params := {part(4)}) end")
    return f"(case lang {' '.join(whens)} when 'cpp' then {c_rule} when 'c' then {c_rule} end)"


def indented_ctes(files: str, p: str) -> str:
    """X5 in SQL: Python/Ruby blocks by indentation, ending in ``{p}ifn``.  Python lines are joined while a
    bracket is open (per physical line, strings left out; a def or class line starts anew)."""
    ind = ", ".join(q(x) for x in P.INDENT_LANGUAGES)
    py, rb = q(PY_DEF), q(RB_DEF)
    bare = r"""regexp_replace(text, '"[^"]*"|#.*', '', 'g')"""
    count = lambda cs: f"length(regexp_replace({bare}, '[^{cs}]', '', 'g'))"
    return f"""
{p}ifiles as (select * from (select file_path, source_code, {lang_of_path()} as lang from {files}) t where lang in ({ind})),
{p}pl0 as (select file_path, lang, string_split(coalesce(source_code, ''), chr(10)) as arr from {p}ifiles),
{p}pl1 as (select file_path, lang, unnest(arr) as text, unnest(range(0, len(arr))) as pos from {p}pl0),
{p}pl2 as (select *, regexp_matches(text, '^[ \\t]*(async[ \\t]+def|def|class)\\b') as opens_new,
             {count('(\\[{{')} - {count(')\\]}}')} as net from {p}pl1),
{p}pl3 as (select *, sum(case when opens_new then 1 else 0 end) over (partition by file_path order by pos) as grp from {p}pl2),
{p}pl4 as (select *, sum(net) over (partition by file_path, grp order by pos) as run from {p}pl3),
{p}pl5 as (select *, run - least(0, min(run) over (partition by file_path, grp order by pos)) as depth from {p}pl4),
{p}pl6 as (select *, case when lang = 'python' and lag(depth) over (partition by file_path, grp order by pos) > 0
                        then 0 else 1 end as starts from {p}pl5),
{p}pl7 as (select *, sum(starts) over (partition by file_path order by pos) as logical from {p}pl6),
{p}il as (select file_path, lang, min(pos) as pos, string_agg(text, chr(10) order by pos) as text
          from {p}pl7 group by file_path, lang, logical),
{p}if0 as (
  select file_path, lang, pos, cast(pos + 1 as integer) as line_no, {nl('text')} as more,
    length(regexp_extract(text, {q(INDENT)}, 0)) as indent,
    regexp_matches(text, {q(COMMENT_OR_BLANK)}) as blank,
    case when lang = 'python' then regexp_extract(text, {py}, 1) else regexp_extract(text, {rb}, 1) end as nm,
    case when lang = 'python' then regexp_extract(text, {py}, 2) else regexp_extract(text, {rb}, 2) end as pr,
    regexp_matches(text, {q(RB_END)}) as is_end, length(text) as len
  from {p}il),
{p}if1 as (
  select *,
    sum(len + 1) over (partition by file_path order by pos) - len - 1 as off,
    max(case when not blank then line_no end) over (partition by file_path order by pos
        rows between unbounded preceding and 1 preceding) as prev_nonblank,
    max(case when nm <> '' then indent end) over (partition by file_path) as max_hdr_indent,
    max(case when not blank then line_no end) over (partition by file_path) as last_nonblank
  from {p}if0),
{p}icl as (select file_path, line_no, unnest(range(indent, max_hdr_indent + 1)) as t, false as is_hdr
           from {p}if1 where not blank and indent <= max_hdr_indent),
{p}ihd as (select file_path, line_no, indent as t, true as is_hdr from {p}if1 where nm <> ''),
{p}inx as (
  select file_path, line_no, is_hdr,
    min(case when not is_hdr then line_no end) over (partition by file_path, t order by line_no desc, is_hdr desc
        rows between unbounded preceding and 1 preceding) as closer
  from (select * from {p}icl union all select * from {p}ihd) u),
{p}ih as (
  select f.file_path, f.line_no, f.nm, f.pr, f.indent, f.off, f.lang, f.last_nonblank, n.closer
  from {p}if1 f join {p}inx n on f.file_path = n.file_path and f.line_no = n.line_no and n.is_hdr
  where f.nm <> ''),
{p}ih2 as (
  select h.*, c.prev_nonblank as c_prev, c.is_end and c.indent = h.indent as c_is_end
  from {p}ih h left join {p}if1 c on c.file_path = h.file_path and c.line_no = h.closer),
{p}ih3 as (select *, case when closer is null then last_nonblank when lang = 'ruby' and c_is_end then closer
                          else c_prev end as end_line from {p}ih2),
{p}ifn as (
  select h.file_path, h.nm as function_name, '' as return_type, coalesce(h.pr, '') as parameters,
    h.line_no as line_start, cast(h.end_line + e.more as integer) as line_end, cast(h.off + h.indent as bigint) as open_off,
    h.lang as language,
    substr(f.source_code, cast(h.off + h.indent + 1 as bigint), cast(e.off + e.len - h.off - h.indent as bigint)) as body
  from {p}ih3 h left join {p}if1 e on e.file_path = h.file_path and e.line_no = h.end_line
    join {p}ifiles f on f.file_path = h.file_path)"""


def brace_ctes(files: str = "files", p: str = "") -> str:
    """CTEs ending in ``{p}opens``."""
    return f"""
{p}seg0 as (select file_path, regexp_extract_all(coalesce(source_code, ''), {q(P.P_SEGMENT)}, 0) as arr from {files}),
{p}seg1 as (select file_path, unnest(arr) as seg, unnest(range(0, len(arr))) as pos from {p}seg0),
{p}facts as (
  select file_path, pos, case when left(seg, 1) in ('{{', '}}') then left(seg, 1) else 'x' end as kind,
    length(seg) as seg_len, {nl('seg')} as seg_nl from {p}seg1),
{p}staged as (
  select file_path, pos, kind,
    sum(seg_len) over w - seg_len as off,
    sum(seg_nl) over w - seg_nl as nl_before,
    sum(case kind when '{{' then 1 when '}}' then -1 else 0 end) over w as depth
  from {p}facts window w as (partition by file_path order by pos)),
{p}braces as (
  select *, case when kind = '{{' then depth - 1 else depth end as level from {p}staged where kind <> 'x'),
{p}matched as (
  select file_path, pos, kind, level, off as open_off,
    case when lead(kind) over w2 = '}}' then lead(off) over w2 end as close_off,
    nl_before + 1 as open_line,
    case when lead(kind) over w2 = '}}' then lead(nl_before) over w2 + 1 end as close_line
  from {p}braces window w2 as (partition by file_path, level order by pos)),
{p}opens as (select * from {p}matched where kind = '{{')"""


def functions_ctes(files: str = "files", p: str = "") -> str:
    """CTEs ending in ``{p}fns`` (X1-X5 + C1-C3) over a ``files`` relation."""
    skip = ", ".join(q(s) for s in P.HEADER_SKIP_NAMES)
    ind_langs = ", ".join(q(x) for x in P.INDENT_LANGUAGES)
    java_skip = ", ".join(q(x) for x in P.JAVA_NOT_RETURN_TYPES + P.JAVA_MODIFIERS)
    any_ = q(ANY_REVERSED)
    decode = lambda x: f"translate({x}, chr(1) || chr(2) || chr(3) || chr(4) || chr(5), '(){{}};')"
    # t: text of a token, d: joint depth after it, level: of the header it may belong to
    encoded = """case t when '(' then case when d = level + 1 then '(' else chr(1) end
      when ')' then case when d = level then ')' else chr(2) end
      when '{{' then chr(3) when '}}' then chr(4) when ';' then chr(5) else t end"""
    return indented_ctes(files, p) + "," + brace_ctes(files, p) + f""",
{p}code as (select * from (select file_path, coalesce(source_code, '') as s, {lang_of_path()} as lang from {files}) t
            where lang not in ({ind_langs})),
{p}tk0 as (select file_path, lang, regexp_extract_all(s, '[(){{}};]|[^(){{}};]+', 0) as arr from {p}code),
{p}tk1 as (select file_path, lang, unnest(arr) as t, unnest(range(0, len(arr))) as pos from {p}tk0),
{p}tk as (
  select *, sum(length(t)) over w - length(t) as off, sum({nl('t')}) over w - {nl('t')} as nl_before,
    sum(case when t in ('(', '{{') then 1 when t in (')', '}}') then -1 else 0 end) over w as d,
    max(case when t in ('{{', '}}') then pos end) over (partition by file_path order by pos
        rows between unbounded preceding and 1 preceding) as last_brace
  from {p}tk1 window w as (partition by file_path order by pos)),
{p}ev as (
  select file_path, pos, d as level, true as is_cut, null as last_brace from {p}tk where t in ('(', '{{', '}}', ';')
  union all select file_path, pos, d - 1, false, last_brace from {p}tk where t = '{{'),
{p}hd0 as (
  select *, max(case when is_cut then pos end) over (partition by file_path, level order by pos
      rows between unbounded preceding and 1 preceding) as cut
  from {p}ev),
{p}hd1 as (
  select h.file_path, h.pos, any_value(k.lang) as lang, min(k.nl_before) as nl_start,
    string_agg({encoded.replace('{{', '{').replace('}}', '}')}, '' order by k.pos) as h
  from {p}hd0 h join {p}tk k on k.file_path = h.file_path and k.pos > coalesce(h.cut, -1) and k.pos < h.pos
  where not h.is_cut and k.lang <> 'unknown' group by h.file_path, h.pos),
{p}hd2 as (
  select h.file_path, h.pos, min(k.nl_before) as nl_start, string_agg(k.t, '' order by k.pos) as h
  from {p}hd0 h join {p}tk k on k.file_path = h.file_path and k.pos > coalesce(h.last_brace, -1) and k.pos < h.pos
  where not h.is_cut and k.lang = 'unknown' group by h.file_path, h.pos),
{p}heads as (
  select file_path, pos, h, nl_start, x from (select *, {header_case('h')} as x from {p}hd1) t
  where x is not null and not (lang = 'java' and x.ret in ({java_skip}))
  union all
  select file_path, pos, h, nl_start, struct_pack(m := reverse(r), ret := reverse(regexp_extract(r, {any_}, 3)),
      name := reverse(regexp_extract(r, {any_}, 2)), params := reverse(regexp_extract(r, {any_}, 1)))
  from (select *, regexp_extract(reverse(h), {any_}, 0) as r from {p}hd2) t where r <> ''),
{p}spans as (
  select k.file_path, k.off as open_off, {decode('x.ret')} as ret, x.name as name, {decode('x.params')} as params,
    nl_start + {nl("left(h, length(h) - length(lstrip_m))")} + 1 as line_start
  from (select *, {lstrip('x.m')} as lstrip_m from {p}heads) hh
    join {p}tk k on k.file_path = hh.file_path and k.pos = hh.pos
  where x.name not in ({skip})),
{p}fns0 as (
  select s.file_path, s.name as function_name, {strip('s.ret')} as return_type, s.params as parameters,
    cast(s.line_start as integer) as line_start,
    cast(coalesce(close_line, {nl('f.source_code')} + 1) as integer) as line_end,
    cast(o.open_off as bigint) as open_off,
    {lang_of_path('s.file_path')} as language,
    case when close_off is not null then substr(f.source_code, cast(o.open_off + 1 as bigint), cast(close_off - o.open_off + 1 as bigint))
         else substr(f.source_code, cast(o.open_off + 1 as bigint)) end as body
  from {p}spans s join {p}opens o on o.file_path = s.file_path and o.open_off = s.open_off
    join {files} f on s.file_path = f.file_path
  union all by name select * from {p}ifn),
{p}fns as (
  select *, {calls('body')} as calls, {complexity('body')} as complexity,
         {tags('function_name', 'body', 'language')} as tags
  from {p}fns0)"""


def findings_ctes(files: str = "files") -> str:
    """CTEs ending in ``findings``."""
    line_rules = []
    for i, (needle, t, sev, det) in enumerate(P.LINE_RULES):
        line_rules.append(
            f"select file_path, 0 as grp, line_no as line, {i} as rule, {q(t)} as type, {q(sev)} as severity, "
            f"{q(det)} as detail from lines where contains(line, {q(needle)})")
    mt, ms, md = P.MEMORY_LEAK
    rt, rs, rd = P.RESOURCE_LEAK
    return f"""
afiles as (select file_path, coalesce(source_code, '') as s from {files} where {analyzable('file_path')}),
larr as (select file_path, case when s = '' then []::varchar[]
           else string_split(case when ends_with(s, chr(10)) then left(s, length(s) - 1) else s end, chr(10)) end as arr
         from afiles),
lines as (select file_path, unnest(arr) as line, unnest(range(1, len(arr) + 1)) as line_no from larr),
raw as (
  {' union all '.join(line_rules)}
  union all
  select file_path, 1, 0, 0, {q(mt)}, {q(ms)}, {q(md)} from afiles
    where regexp_matches(s, {q(P.P_NEW_RE2)}) and not contains(s, 'delete')
  union all
  select file_path, 1, 0, 1, {q(rt)}, {q(rs)}, {q(rd)} from afiles
    where contains(s, 'fopen') and not contains(s, 'fclose')),
findings as (
  select file_path,
    cast(row_number() over (partition by file_path order by grp, line, rule) as integer) as seq,
    type, cast(line as integer) as line, severity, detail
  from raw)"""


def _part_files() -> str:
    return f"files as ({part_corpus_sql('part')})"


def _corpus(name: str) -> str:
    if name == "part":
        return _part_files()
    if name == "pages":
        return f"files as ({pages_corpus_sql('pages')})"
    if name == "documents":
        return f"files as ({documents_corpus_sql('documents')})"
    raise KeyError(name)


FUNCTION_COLUMNS = ("file_path, function_name, return_type, parameters, line_start, line_end, "
                    "body, cast(length(body) as integer) as body_chars, "
                    f"{join_list('calls')} as calls, complexity, {join_list('tags')} as tags, language")


def _functions_query(corpus: str) -> str:
    return f"with {_corpus(corpus)}, {functions_ctes()} select {FUNCTION_COLUMNS} from fns"


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    o["corpus_languages"] = f"""with {_part_files()}
select file_path, file_name, {lang_of_name('file_name')} as lang, {display_of_name('file_name')} as display_lang,
       {analyzable('file_path')} as analyzable
from files"""

    msg_head = P.UNSUPPORTED_MESSAGE.replace("{exts}", ", ".join(P.SUPPORTED_EXTENSIONS)).split("{name}")
    o["upload_rejects"] = f"""with {_part_files()}
select file_path, file_name, 400 as error_code, {q(msg_head[0])} || file_name || {q(msg_head[1])} as error
from files where {lang_of_name('file_name')} is null"""

    o["functions"] = _functions_query("part")
    o["page_functions"] = _functions_query("pages")

    o["page_brace_pairs"] = f"""with {_corpus('pages')}, {brace_ctes()}
select file_path, cast(pos as integer) as pos, cast(open_off as bigint) as open_off, cast(close_off as bigint) as close_off,
       cast(open_line as integer) as open_line, cast(close_line as integer) as close_line,
       cast(level as integer) as level
from opens"""

    o["document_lines"] = f"""with {_corpus('documents')},
larr as (select file_path, coalesce(source_code, '') as s from files),
arrs as (select file_path, case when s = '' then []::varchar[]
           else string_split(case when ends_with(s, chr(10)) then left(s, length(s) - 1) else s end, chr(10)) end as arr
         from larr)
select file_path, cast(line_no as integer) as line_no, line
from (select file_path, unnest(arr) as line, unnest(range(1, len(arr) + 1)) as line_no from arrs)"""

    o["document_metrics"] = f"""with {_corpus('documents')}
select file_path, {join_list(calls('source_code'))} as calls, {complexity('source_code')} as complexity,
       cast(length({strip('source_code')}) as integer) as stripped_chars
from files"""

    o["findings"] = f"with {_part_files()}, {findings_ctes()} select * from findings"

    o["finding_counts"] = f"""with {_part_files()}, {findings_ctes()}
select f.file_path, cast(coalesce(n, 0) as integer) as finding_count
from files f left join (select file_path, count(*) as n from findings group by file_path) c
  on f.file_path = c.file_path"""

    heading = q(P.FINDINGS_HEADING + "\n\n")
    footer = q("\n\n" + P.FINDINGS_FOOTER)
    o["findings_text"] = f"""with {_part_files()}, {findings_ctes()}
select file_path,
  {heading} || string_agg('- [' || upper(severity) || '] Line ' || cast(line as varchar) || ': ' || detail, chr(10) order by seq)
    || {footer} as findings_text
from findings group by file_path"""

    o["call_edges"] = f"""with {_part_files()}, {functions_ctes()}
select file_path, function_name as caller, line_start as caller_line, callee_name
from (select file_path, function_name, line_start, unnest(calls) as callee_name from fns)"""

    o["call_graph"] = f"""with {_part_files()}, {functions_ctes()},
last as (select file_path, function_name, max_by(calls, open_off) as calls from fns group by file_path, function_name),
names as (select distinct file_path, function_name as callee from fns),
internal as (
  select e.file_path, e.function_name, list_sort(list(e.callee)) as callees
  from (select file_path, function_name, unnest(calls) as callee from last) e
  where exists (select 1 from names n where n.file_path = e.file_path and n.callee = e.callee)
  group by e.file_path, e.function_name)
select l.file_path, l.function_name, {join_list('coalesce(i.callees, []::varchar[])')} as callees
from last l left join internal i on l.file_path = i.file_path and l.function_name = i.function_name"""

    o["functions_per_file"] = f"""with {_part_files()}, {functions_ctes()}
select file_path, cast(count(*) as integer) as function_count from fns group by file_path"""

    o["complexity_report"] = f"""with {_part_files()}, {functions_ctes()}, {findings_ctes()},
counts as (select file_path, count(*) as n from findings group by file_path)
select f.file_path, f.function_name, f.line_start, f.line_end, f.complexity,
       {join_list('f.tags')} as tags, cast(coalesce(c.n, 0) as integer) as file_findings
from fns f left join counts c on f.file_path = c.file_path"""

    _index_oracles(o)
    o["approx_recall"] = "select 'all' as search, true as recall_reached union all select 'label', true"
    return o


# ----------------------------------------------------------------- the index
def embedding(text: str, dim: int = 64) -> str:
    """The hashing embedder (md5 buckets -> counts -> unit vector) in SQL."""
    toks = f"regexp_extract_all(lower(coalesce({text}, '')), {q('[' + P.W + ']+')}, 0)"
    buckets = f"list_transform({toks}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim})"
    counts = f"list_transform(range(0, {dim}), lambda d: len(list_filter({buckets}, lambda b: b = d)))"
    return counts   # normalised by ``unit_vector`` in a later CTE


def unit_vector(counts: str) -> str:
    norm = f"sqrt(list_sum(list_transform({counts}, lambda c: c * c)))"
    return f"list_transform({counts}, lambda c: case when {norm} > 0 then (c / {norm})::FLOAT else 0::FLOAT end)"


def document(name, ret, params, body, tags_) -> str:
    tag_str = f"case when len({tags_}) > 0 then array_to_string({tags_}, ', ') else 'general' end"
    raw = (f"chr(10) || 'Function: ' || {name} || chr(10) || 'Signature: ' || {ret} || ' ' || {name} || '(' || {params} "
           f"|| ')' || chr(10) || 'Tags: ' || {tag_str} || chr(10) || 'Code:' || chr(10) || {body} || chr(10)")
    return strip(raw)


def template_sql(template: str, values: dict[str, str]) -> str:
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(q(template[pos:m.start()]))
        parts.append(f"({values[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        parts.append(q(template[pos:]))
    return " || ".join(parts)


def zero_fix(x: str) -> str:
    return f"(case when {x} = 0 then 0.0 else {x} end)"


def similarity(d: str) -> str:
    return f"cast(cast(round_even(cast(1.0 - coalesce({d}, 1.0) as decimal(38,18)), 2) as decimal(38,2)) as varchar)"


def index_ctes() -> str:
    from quarry.sources import corpus as C

    t1, t2, t3 = (C.BATCH_TIMES[i] for i in (1, 2, 3))
    parts = []
    for b, (ver, where, ts) in {1: (1, None, t1), 2: (2, C.REUPLOAD_WHERE, t2)}.items():
        parts.append(f"b{b}files as ({part_corpus_sql('part', ver, where)})")
        parts.append(f"b{b}acc as (select * from b{b}files where {lang_of_name('file_name')} is not null)")
        parts.append(functions_ctes(f"b{b}acc", f"b{b}_").strip())
        parts.append(f"""b{b}frows as (
  select f.file_path, f.file_name, c.n as function_count, timestamp '{ts}' as upload_time,
         cast({b} as bigint) as ingest_seq, 'upsert' as op
  from b{b}acc f join (select file_path, cast(count(*) as integer) as n from b{b}_fns group by file_path) c
    on f.file_path = c.file_path)""")
        parts.append(f"""b{b}vec0 as (
  select file_path || '::' || function_name as vector_id, file_path, cast({b} as bigint) as ingest_seq,
    {document('function_name', 'return_type', 'parameters', 'body', 'tags')} as document,
    function_name as meta_function_name, complexity as meta_complexity, {join_list('tags')} as meta_tags,
    line_start as meta_line_start, line_end as meta_line_end,
    row_number() over (partition by file_path, function_name order by line_start desc, open_off desc) as rn
  from b{b}_fns)""")
    parts.append(f"dels as (select file_path from ({part_corpus_sql('part', 1, C.DELETE_WHERE)}) d)")
    parts.append(f"""files_log as (
  select * from b1frows union all select * from b2frows union all
  select distinct file_path, cast(null as varchar), 0, timestamp '{t3}', cast(3 as bigint), 'delete' from dels)""")
    parts.append("""cur_files as (
  select * exclude (rn) from (
    select *, row_number() over (partition by file_path order by ingest_seq desc) as rn from files_log) t
  where rn = 1 and op = 'upsert')""")
    parts.append("""live_before_delete as (
  select * exclude (rn) from (
    select *, row_number() over (partition by file_path order by ingest_seq desc) as rn
    from files_log where op = 'upsert') t where rn = 1)""")
    parts.append("""fn_log as (
  select *, cast(1 as bigint) as ingest_seq from b1_fns union all by name
  select *, cast(2 as bigint) as ingest_seq from b2_fns)""")
    parts.append("""cur_fns as (
  select f.* from fn_log f where exists (
    select 1 from cur_files c where c.file_path = f.file_path and c.ingest_seq = f.ingest_seq))""")
    parts.append(f"""vec_log0 as (
  select * exclude (rn) from b1vec0 where rn = 1 union all
  select * exclude (rn) from b2vec0 where rn = 1),
vec_log1 as (select *, {embedding('document')} as counts from vec_log0),
vec_log as (select * exclude (counts), {unit_vector('counts')} as embedding from vec_log1)""")
    parts.append("""cur_vecs as (
  select v.* from vec_log v where exists (
    select 1 from cur_files c where c.file_path = v.file_path and c.ingest_seq = v.ingest_seq))""")
    return ",\n".join(parts)


def current_sources_ctes() -> str:
    """Sources of the live file versions, and their findings text."""
    return f"""cur_src as (
  select s.* from (select *, cast(1 as bigint) as ingest_seq from b1files union all
                   select *, cast(2 as bigint) as ingest_seq from b2files) s
  where exists (select 1 from cur_files c where c.file_path = s.file_path and c.ingest_seq = s.ingest_seq)),
{findings_ctes('cur_src').strip()},
ftext as (
  select file_path,
    {q(P.FINDINGS_HEADING + chr(10) + chr(10))} || string_agg('- [' || upper(severity) || '] Line ' || cast(line as varchar)
      || ': ' || detail, chr(10) order by seq) || {q(chr(10) + chr(10) + P.FINDINGS_FOOTER)} as findings_text,
    cast(count(*) as integer) as finding_count
  from findings group by file_path)"""


def hits_ctes(req: str, scope: str | None, k: str) -> str:
    """Top-k hits, language vote and chunks for request relation ``req``
    (request_id, qvec[, scope], top_k)."""
    cond = f"(r.{scope} is null or v.file_path = r.{scope})" if scope else "true"
    votes = " union all ".join(
        f"select {q(lang)} as lang, {q(disp)} as language, {q(tag)} as lang_tag, {i} as pos"
        for i, (lang, disp, tag) in enumerate(P.PROMPT_LANGUAGES))
    return f"""pairs as (
  select r.request_id, v.vector_id, v.document, v.meta_function_name, v.meta_tags,
         list_cosine_distance(r.qvec::DOUBLE[], v.embedding::DOUBLE[]) as distance, r.{k} as k
  from {req} r join cur_vecs v on {cond}),
ranked as (
  select *, row_number() over (partition by request_id order by distance asc nulls last, vector_id) as rank
  from pairs),
hits as (select * from ranked where rank <= k),
langs as ({votes}),
vote as (
  select request_id, language, lang_tag from (
    select h.request_id, l.language, l.lang_tag,
      row_number() over (partition by h.request_id order by count(*) desc, min(h.rank), min(l.pos)) as rn
    from hits h join langs l on contains(coalesce(h.meta_tags, ''), l.lang)
    group by h.request_id, l.lang, l.language, l.lang_tag) t where rn = 1),
chunks as (
  select request_id,
    string_agg(coalesce(meta_function_name, '?'), ',' order by rank) as retrieved,
    string_agg('--- [' || cast(rank as varchar) || '] ' || coalesce(meta_function_name, '?') || ' (similarity: '
      || {similarity('distance')} || ') ---' || chr(10) || document, chr(10) || chr(10) order by rank) as code_chunks
  from hits group by request_id)"""


def _index_oracles(o: dict) -> None:
    from quarry.sources import corpus as C

    ix = index_ctes()
    o["index_files"] = f"""with {ix}
select file_path, file_name, function_count, cast(upload_time as varchar) as upload_time, ingest_seq from cur_files"""
    o["index_functions"] = f"""with {ix}
select file_path, ingest_seq, function_name, file_path || '::' || function_name as vector_id,
  {join_list('tags')} as tags_str, left(coalesce(body, ''), {P.BODY_PREVIEW_CHARS}) as body_preview,
  line_start, line_end, complexity
from cur_fns"""
    o["cleared_functions"] = f"""with {ix},
cleared as (select distinct file_path from ({C.part_corpus_sql('part', where=C.CLEAR_WHERE)}) t),
left_over as (select file_path, count(*) as n from cur_fns where file_path not in (select file_path from cleared) group by file_path)
select f.file_path, f.ingest_seq, cast(coalesce(n, 0) as integer) as functions_left
from cur_files f left join left_over l on l.file_path = f.file_path"""
    o["index_edges"] = f"""with {ix}
select file_path, ingest_seq, function_name as caller, line_start as caller_line, callee_name
from (select *, unnest(calls) as callee_name from cur_fns)"""
    o["index_vectors"] = f"""with {ix}
select vector_id, file_path, ingest_seq, document, meta_function_name, meta_complexity, meta_tags,
  meta_line_start, meta_line_end,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) as embedding_sum,
  cast(len(list_filter(embedding, lambda x: x <> 0)) as integer) as embedding_nnz
from cur_vecs"""
    o["deleted_vectors"] = f"""with {ix},
before as (select v.* from vec_log v where exists (
  select 1 from live_before_delete c where c.file_path = v.file_path and c.ingest_seq = v.ingest_seq)),
wanted as (select distinct file_path from dels)
select w.file_path, cast(coalesce(n, 0) as integer) as deleted
from wanted w left join (select file_path, count(*) as n from before group by file_path) b
  on w.file_path = b.file_path"""
    o["index_count"] = f"with {ix} select cast(count(*) as bigint) as indexed_functions from cur_vecs"
    head, tail = P.INDEXED_MESSAGE.split("{n}")
    mid, tail = tail.split("{lang}")
    o["index_summary"] = f"""with {ix},
last as (select file_path, function_name, max_by(calls, open_off) as calls from b1_fns group by file_path, function_name),
names as (select distinct file_path, function_name as callee from b1_fns),
internal as (
  select e.file_path, e.function_name, list_sort(list(e.callee)) as callees
  from (select file_path, function_name, unnest(calls) as callee from last) e
  where exists (select 1 from names n where n.file_path = e.file_path and n.callee = e.callee)
  group by e.file_path, e.function_name),
graph as (
  select l.file_path, string_agg(l.function_name || ':' || array_to_string(coalesce(i.callees, []::varchar[]), '|'), ';'
           order by l.function_name) as call_graph
  from last l left join internal i on l.file_path = i.file_path and l.function_name = i.function_name
  group by l.file_path)
select f.file_path, f.file_name, f.function_count as functions_indexed, coalesce(g.call_graph, '') as call_graph,
  {q(head)} || cast(f.function_count as varchar) || {q(mid)} || coalesce({display_of_name('f.file_name')}, 'None')
    || {q(tail)} as message
from b1frows f left join graph g on f.file_path = g.file_path"""
    o["latest_file"] = f"""with {ix}
select file_path from cur_files order by upload_time desc, ingest_seq desc, file_path desc limit 1"""
    o["functions_by_file"] = f"""with {ix}
select file_path, function_name, line_start,
  cast(row_number() over (partition by file_path order by line_start, open_off) as integer) as position
from cur_fns"""
    o["first_by_name"] = f"""with {ix}
select function_name, file_path, line_start from (
  select *, row_number() over (partition by function_name order by file_path, line_start, open_off) as rn
  from cur_fns) t where rn = 1"""
    o["events_latest"] = """select file_path, file_name, function_count, ingest_seq from (
  select 'user_' || cast(user_id as varchar) as file_path, event_type as file_name, value as function_count,
    event_id as ingest_seq, event_type,
    row_number() over (partition by user_id order by event_id desc) as rn
  from events) t where rn = 1 and event_type <> 'error'"""

    vsql = ("v as (select cast(vec_id as varchar) as vector_id, 'label_' || cast(label as varchar) as file_path, "
            "embedding, vec_id from embeddings)")
    for name, cond in (("vector_topk", "true"), ("vector_topk_label", "a.file_path = b.file_path")):
        o[name] = f"""with {vsql},
pairs as (select a.vec_id as query_id, b.vector_id,
            list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) as d
          from v a join v b on {cond}),
ranked as (select *, row_number() over (partition by query_id order by d asc nulls last, vector_id) as rn from pairs)
select query_id, cast(rn as integer) as rank, vector_id, {zero_fix('round(d, 6)')} as distance
from ranked where rn <= 5"""
    o["approx_topk_all_lists"] = o["vector_topk"]
    o["get_file"] = f"""with {ix},
req as ({C.debug_requests_sql('conversations')})
select file_path, file_name, function_count, ingest_seq from cur_files
where file_path in (select file_filter from req where file_filter is not null)"""
    o["code_table"] = f"""select path as file_path, regexp_extract(path, '[^/]*$', 0) as file_name, content as source_code
from ({C.document_files_sql('documents')}) t"""
    none_head, none_tail = P.NO_FUNCTIONS_MESSAGE.split("{lang}")
    o["empty_rejects"] = f"""with pfiles as ({C.part_corpus_sql('part')}),
allfiles as (select * from pfiles union all
  select path, regexp_extract(path, '[^/]*$', 0), content from ({C.document_files_sql('documents')}) t),
files as (select * from allfiles where {lang_of_name('file_name')} is not null), {functions_ctes()}
select file_path, 422 as error_code, {q(none_head)} || {display_of_name('file_name')} || {q(none_tail)} as error
from files where file_path not in (select file_path from fns)"""
    o["auto_scope"] = f"""with req as ({C.debug_requests_sql('conversations')}),
uploads as (select path, regexp_extract(path, '[^/]*$', 0) as file_name from ({C.document_files_sql('documents')}) t)
select request_id, coalesce(nullif(file_filter, ''),
  (select max(path) from uploads where {lang_of_name('file_name')} is not null)) as scope from req"""
    o["neighbor_distance"] = f"""select a.vec_id as a_id, b.vec_id as b_id,
  {zero_fix('round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)')} as distance
from embeddings a join embeddings b on b.vec_id - 1 = a.vec_id"""

    # debug prompts (E2 up to U2) -----------------------------------------
    fixes = current_sources_ctes()
    dbg = f"""{ix},
{fixes},
req as ({C.debug_requests_sql('conversations')}),
req1 as (select request_id, query, file_filter, coalesce(top_k, {P.DEFAULT_TOP_K}) as top_k from req),
valid as (select * from req1 where query is not null and top_k between 1 and {P.MAX_TOP_K}
          and (select count(*) from cur_vecs) > 0),
latest as (select file_path from cur_files order by upload_time desc, ingest_seq desc, file_path desc limit 1),
scoped as (select *, coalesce(nullif(file_filter, ''), (select file_path from latest)) as scope from valid),
qv0 as (select *, {embedding('query')} as counts from scoped),
qv as (select * exclude (counts), {unit_vector('counts')} as qvec from qv0),
{hits_ctes('qv', 'scope', 'top_k')},
prompted as (
  select s.request_id, s.query, s.scope, s.top_k,
    coalesce(vt.language, {q(P.DEFAULT_PROMPT_LANGUAGE[0])}) as language,
    coalesce(vt.lang_tag, {q(P.DEFAULT_PROMPT_LANGUAGE[1])}) as lang_tag,
    coalesce(c.retrieved, '') as retrieved,
    coalesce(c.code_chunks, {q(P.NO_CHUNKS_TEXT)}) as code_chunks,
    case when {analyzable('s.scope')} then coalesce(ft.findings_text, '') else '' end as findings_text,
    case when {analyzable('s.scope')} then coalesce(ft.finding_count, 0) else 0 end as finding_count
  from scoped s left join vote vt on s.request_id = vt.request_id
    left join chunks c on s.request_id = c.request_id
    left join ftext ft on ft.file_path = s.scope),
final as (
  select *, {template_sql(P.DEBUG_PROMPT_TEMPLATE, {'language': 'language', 'query': 'query',
                         'code_chunks': 'code_chunks', 'static_analysis': 'findings_text',
                         'lang_tag': 'lang_tag'})} as prompt
  from prompted)"""
    o["debug_prompts"] = f"""with {dbg}
select request_id, scope, top_k, language, lang_tag, retrieved, cast(finding_count as integer) as finding_count, prompt
from final"""
    o["debug_answers"] = f"""with {dbg},
ans as (select *, {strip('prompt')} as response from final)
select request_id, query, retrieved,
  {strip(f"regexp_extract(response, {q(P.P_FENCE)}, 1)")} as suggested_fix,
  case when strpos(response, '## Explanation') > 0
       then {strip("substr(response, strpos(response, '## Explanation') + 14)")} else response end as explanation,
  cast(finding_count as integer) as static_analysis_findings
from ans"""
    o["debug_rejects"] = f"""with {ix},
req as ({C.debug_requests_sql('conversations')}),
req1 as (select request_id, query, coalesce(top_k, {P.DEFAULT_TOP_K}) as top_k from req)
select request_id,
  case when (select count(*) from cur_vecs) = 0 and query is not null and top_k between 1 and {P.MAX_TOP_K} then 400
       else 422 end as error_code,
  case when query is null then 'query: Field required'
       when top_k < 1 then 'top_k: Input should be greater than or equal to 1'
       when top_k > {P.MAX_TOP_K} then 'top_k: Input should be less than or equal to {P.MAX_TOP_K}'
       else {q(P.EMPTY_INDEX_MESSAGE)} end as error
from req1
where query is null or top_k not between 1 and {P.MAX_TOP_K} or (select count(*) from cur_vecs) = 0"""

    # test prompts (E3 up to U3) ------------------------------------------
    fw_case = "case framework " + " ".join(f"when {q(a)} then {q(b)}" for a, b in P.FRAMEWORK_NAMES) + " else framework end"
    tst = f"""{ix},
req as ({C.test_requests_sql('part')}),
req1 as (select request_id, function_name, coalesce(framework, 'catch2') as framework from req),
valid as (select * from req1 where function_name is not null
          and framework in ({', '.join(q(f) for f in P.ACCEPTED_FRAMEWORKS)}) and (select count(*) from cur_vecs) > 0),
qv0 as (select *, {P.TEST_TOP_K} as top_k, {embedding('function_name')} as counts from valid),
qv as (select * exclude (counts), {unit_vector('counts')} as qvec from qv0),
{hits_ctes('qv', None, 'top_k')},
prompted as (
  select s.request_id, s.function_name, s.framework, {fw_case} as framework_name,
    coalesce(vt.language, {q(P.DEFAULT_PROMPT_LANGUAGE[0])}) as language,
    coalesce(vt.lang_tag, {q(P.DEFAULT_PROMPT_LANGUAGE[1])}) as lang_tag,
    coalesce(c.retrieved, '') as retrieved,
    coalesce(c.code_chunks, {q(P.NO_CHUNKS_TEXT)}) as code_chunks
  from valid s left join vote vt on s.request_id = vt.request_id
    left join chunks c on s.request_id = c.request_id),
final as (
  select *, {template_sql(P.TEST_PROMPT_TEMPLATE, {'language': 'language', 'framework': 'framework_name',
                         'code_chunks': 'code_chunks', 'lang_tag': 'lang_tag'})} as prompt
  from prompted)"""
    o["test_prompts"] = f"""with {tst}
select request_id, function_name, framework, framework_name, language, lang_tag, retrieved, prompt from final"""
    o["test_answers"] = f"""with {tst},
ans as (select *, {strip('prompt')} as response from final),
code as (select *, {strip(f"regexp_extract(response, {q(P.P_FENCE)}, 1)")} as c from ans)
select request_id, function_name, coalesce(nullif(c, ''), response) as unit_tests_code, framework,
  'Generated ' || framework_name || ' tests for `' || function_name || '` (' || language || ').' as explanation
from code"""
    o["test_rejects"] = f"""with {ix},
req as ({C.test_requests_sql('part')}),
req1 as (select request_id, function_name, coalesce(framework, 'catch2') as framework from req)
select request_id,
  case when function_name is null then 422 when framework not in ({', '.join(q(f) for f in P.ACCEPTED_FRAMEWORKS)}) then 400
       else 400 end as error_code,
  case when function_name is null then 'function_name: Field required'
       when framework not in ({', '.join(q(f) for f in P.ACCEPTED_FRAMEWORKS)}) then {q(P.BAD_FRAMEWORK_MESSAGE)}
       else {q(P.EMPTY_INDEX_MESSAGE)} end as error
from req1
where function_name is null or framework not in ({', '.join(q(f) for f in P.ACCEPTED_FRAMEWORKS)})
   or (select count(*) from cur_vecs) = 0"""
    o["response_parsing"] = f"""select conv_id, turn,
  {strip(f"regexp_extract(coalesce(text, ''), {q(P.P_FENCE)}, 1)")} as code,
  case when strpos(text, '## Explanation') > 0
       then {strip("substr(text, strpos(text, '## Explanation') + 14)")} else text end as explanation
from ({C.responses_sql('conversations')}) t"""
