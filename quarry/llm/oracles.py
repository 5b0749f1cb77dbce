"""DuckDB twins of the operators' queries: plain relational forms of the contracts, meant for small tables.

They share no code with the operators: sets are compared shingle by shingle, windows word by word,
near words by their one-letter deletions, and codebooks by measuring every part against every entry.
op2's shards, op3, op4's added spans, op8's chunks, op9's mix and op13's tokens are not expressible
(samples, training, rolling hashes, a tokenizer); tests compare those with brute force or held-out rows.
"""

from __future__ import annotations

from quarry.llm.chat import CONTROL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = rf"""
with recursive w as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as w from documents),
s as materialized (
  select rid, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as sh from w),
p as materialized (select rid, len(sh) as n, unnest(sh) as g from s),
links as materialized (
  select a.rid as x, b.rid as y from p a join p b on a.g = b.g and a.rid <> b.rid
  group by a.rid, b.rid, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(x, y) as (select rid, rid from s union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select r.x, min(s.doc_id) as c from reach r join s on s.rid = r.y group by r.x)
select doc_id, len(sh)::bigint as n_shingles, c as component_id from s join least on x = rid"""

OP5 = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) as w from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all({_LOWER}, {_LETTERS}) as w from benchmark),
bw as (select item, w, least(13, len(w)) as size, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0),
bs as materialized (select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as win from bw),
dw as (select rid, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from bs) where len(w) >= size),
ds as (select rid, size, i, array_to_string(w[i:i + size - 1], ' ') as win from dw),
found as materialized (select rid, ds.size, i, item from ds join bs on ds.size = bs.size and ds.win = bs.win),
hit as (select rid, count(distinct k) as n from (select rid, unnest(range(i, i + size)) as k from found) group by rid),
named as (select rid, count(distinct item) as n, string_agg(distinct item, ',' order by item) as items from found group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
from d left join hit using (rid) left join named using (rid)"""

_USABLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

OP6 = f"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings where {_USABLE}),
asked as (select distinct vec_id, q from v where vec_id % 50 = 0),
s as (
  select a.vec_id as query_id, a.q, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from asked a join v b on a.vec_id is distinct from b.vec_id),
r as (select *, row_number() over (partition by query_id, q order by score desc, vec_id nulls last)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""

OP7 = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
win as (select rid, i, array_to_string(w[i:i + 34], ' ') as x
  from (select rid, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
rep as materialized (select rid, i from win join (select x from win group by x having count(*) > 1) using (x)),
gone as (select distinct rid, k from (select rid, unnest(range(i, i + 35)) as k from rep)),
words as (select rid, unnest(w) as x, unnest(range(1, len(w) + 1)) as k from d),
kept as (select rid, count(*) as n, string_agg(x, ' ' order by k) as t from words anti join gone using (rid, k) group by rid)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (rid)"""

_CONTROL = "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROL)


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g')"


OP10 = rf"""
with own as (
  select conv_id, turn, role, text from conversations
  union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from own),
p as (select *, '<|im_start|>' || {_escaped("replace(replace(role, '%', '%25'), chr(10), '%0A')")} || chr(10)
  || {_escaped("text")} || '<|im_end|>' || chr(10) as formatted from t),
g as (
  select conv_id, count(*) as n, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
    sum(length(formatted)) as size from p group by conv_id)
select conv_id, n::bigint as n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
  size::bigint as formatted_chars from g"""


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round spelled out: assignment ``a<r>`` against codebook ``c<r>``, then the floored means."""
    sql = [f"""
with v as materialized (
  select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v
  from embeddings where {_USABLE} and len(embedding) > 0),
p as materialized (
  select rid, k, v[k * (len(v) // {parts}) + 1:(k + 1) * (len(v) // {parts})] as x from v, range({parts}) as parts(k)),
first as (
  select v, row_number() over (order by vec_id) - 1 as e
  from (select vec_id, min(v) as v from v where vec_id is not null group by vec_id)),
c0 as materialized (
  select k, e, v[k * (len(v) // {parts}) + 1:(k + 1) * (len(v) // {parts})] as y from first, range({parts}) as parts(k) where e < {entries})"""]
    for r in range(rounds + 1):
        sql.append(f"""
a{r} as materialized (
  select rid, k, min(d * {entries} + e) as best from (
    select rid, p.k, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from p join c{r} on p.k = c{r}.k) group by rid, k)""")
        if r < rounds:
            sql.append(f"""
m{r} as (
  select k, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as y from (
    select k, e, i, sum(x)::bigint as s, count(*)::bigint as n from (
      select p.k, best % {entries} as e, unnest(x) as x, unnest(range(len(x))) as i from p join a{r} using (rid, k))
    group by k, e, i) group by k, e),
c{r + 1} as materialized (select k, e, coalesce(m{r}.y, c{r}.y) as y from c{r} left join m{r} using (k, e))""")
    sql.append(f"""
coded as (
  select rid, string_agg(printf('%02x', best % {entries}), '' order by k) as code, sum(best // {entries})::bigint as error
  from a{rounds} group by rid),
books as (
  select sha256(string_agg(z::varchar, ',' order by k, e, i)) as digest
  from (select k, e, unnest(y) as z, unnest(range(len(y))) as i from c{rounds}))""")
    return ",".join(sql) + """
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256
from coded join v using (rid), books"""


OP12 = rf"""
with recursive steps as (
  select list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i)),
runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents) group by all),
bytes as (select run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as b from runs),
crc as (
  select run, n, xor(list_reduce([4294967295::bigint] || list_transform(range(0, length(b) // 2),
      lambda i: ('0x' || b[2 * i + 1:2 * i + 2])::bigint),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as h from bytes, steps),
noisy as (
  select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from crc),
words as materialized (
  select word, sum(n)::bigint as n from noisy where length(word) >= 6 group by word having sum(n) >= 5),
less as materialized (
  select word, i, left(word, i - 1) || substr(word, i + 1) as v from (select word, unnest(range(1, length(word) + 1)) as i from words)),
near as materialized (
  select a.word, b.word as other from less a join less b on a.i = b.i and a.v = b.v and a.word <> b.word
  union select word, v from less where v in (select word from words)
  union select v, word from less where v in (select word from words)),
best as (
  select near.word, o.word as top, o.n as top_n, count(*) over (partition by near.word) as n_near,
    row_number() over (partition by near.word order by o.n desc, o.word) as r
  from near join words o on o.word = near.other),
formed as materialized (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when top_n >= 5 * w.n then top end as form,
    case when top_n >= 5 * w.n then top_n end::bigint as form_n from words w left join (from best where r = 1) b on b.word = w.word),
walk(word, root) as (select word, word from formed union select walk.word, form from walk join formed f on f.word = walk.root where form is not null)
select f.word, f.form, walk.root as root, f.n, f.n_near, f.form_n
from formed f join walk on walk.word = f.word join formed e on e.word = walk.root where e.form is null"""

ORACLES = {"op1_jaccard_join": OP1, "op5_decontamination": OP5, "op6_maxscore_topk": OP6, "op7_substring_dedup": OP7,
           "op10_chat_formatting": OP10, "op11_vector_codes": _op11(), "op12_spelling_variants": OP12}
