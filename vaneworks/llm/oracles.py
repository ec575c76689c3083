"""SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from vaneworks.llm.chat_format import END, START
from vaneworks.llm.queries import HOSTILE

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LINES = r"""
lines as (select * from (select doc_id, host, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]'))
"""

OP3 = r"""
with d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
u as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from d),
l as (select doc_id, i, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) as line from u),
n as (select *, row_number() over w as k, lead(line, 1) over w as l2, lead(line, 2) over w as l3, lead(i, 1) over w as i2, lead(i, 2) over w as i3
      from l where line <> '' window w as (partition by doc_id order by i)),
r as (select *, row_number() over (partition by line, l2, l3 order by doc_id, k) as nth from n where l3 is not null),
g as (select distinct doc_id, unnest([i, i2, i3]) as i from r where nth > 1),
gone as (select doc_id, list(i) as gone from g group by doc_id)
select d.doc_id, cast(len(ls) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_removed,
       sha256(case when gone is null then text
              else array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(gone, i)), lambda i: ls[i]), chr(10)) end) as kept_sha256
from d left join gone on d.doc_id = gone.doc_id
"""

OP4 = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{HOSTILE}'), (-1, 1, 'assistant', '{HOSTILE}')),
o as (select *, row_number() over w as n, lag(role, 1, '') over w as before,
             length('{START}') + length(role) + 1 + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + length('{END}') + 1 as size
      from t window w as (partition by conv_id order by turn, role, text)),
b as (select conv_id, min(case when (before = '' and role in ('system', 'user')) or (before = 'system' and role = 'user')
             or (before = 'user' and role = 'assistant') or (before = 'assistant' and role = 'user') then null else n - 1 end) as bad_turn,
             arg_max(role, n) as last_role from o group by conv_id)
select o.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(size) as bigint) as formatted_chars, b.bad_turn is null and b.last_role = 'assistant' as valid, cast(b.bad_turn as integer) as bad_turn
from o join b on o.conv_id = b.conv_id group by o.conv_id, b.bad_turn, b.last_role
"""

OP6 = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, h, sha1(h) as s, min(page_id) over (partition by h) as first from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::integer >> cast(15 - 5 * (i % 4) as integer)) & 31), 1)), '') as payload_digest,
       case when first is distinct from page_id and first is not null then 'revisit' else 'response' end as record_type,
       case when first is distinct from page_id then first end as refers_to
from d
"""

OP7 = rf"""
with d as (select doc_id, source as host, coalesce(text, '') as text, {_WORDS} as ws, string_split(coalesce(text, ''), chr(10)) as ls from documents),
{_LINES.strip()},
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from d)),
many as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from win) where c > 1),
cov as (select doc_id, count(*) as n from (select distinct doc_id, i + j as w from many, range(0, 8) as r(j)) group by doc_id),
dup as (select doc_id, count(*) - count(distinct line) as n from lines group by doc_id),
norm as (select l.doc_id, l.host, l.i, d.text, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') as line
         from lines l join d on l.doc_id = d.doc_id),
freq as (select host, line, count(distinct text) as texts from norm group by host, line),
hosts as (select host, count(distinct text) as n from norm group by host),
lost as (select doc_id, sum(len(string_split(norm.line, ' '))) as n from norm join freq on norm.host = freq.host and norm.line = freq.line
         join hosts on hosts.host = norm.host where texts > 50 and 1000 * texts > 5 * hosts.n group by doc_id),
base as (select d.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
                cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
                cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(coalesce(lost.n, 0) as bigint) as removed_words
         from d left join dup on dup.doc_id = d.doc_id left join cov on cov.doc_id = d.doc_id left join lost on lost.doc_id = d.doc_id)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * removed_words <= 70 * n_words as kept
from base
"""

OP9 = rf"""
with recursive d as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as materialized (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from d where len(ws) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, l.b from reach join l on l.a = reach.b),
least as (select a, min(b) as component_id from reach group by a)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id from d join least on least.a = d.doc_id left join n on n.doc_id = d.doc_id
"""

OP10 = rf"""
with d as (select doc_id, {_WORDS} as ws from documents),
w as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from d)),
r as (select doc_id, i, row_number() over (partition by win order by doc_id, i) as nth from w),
g as (select doc_id, list(distinct i + j) as gone from r, range(0, 20) as k(j) where nth > 1 group by doc_id),
p as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from d),
x as (select distinct doc_id, unnest(gone) as i from g),
kept as (select p.doc_id, string_agg(word, ' ' order by p.i) as kept from p anti join x on p.doc_id = x.doc_id and p.i = x.i group by p.doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join g on d.doc_id = g.doc_id left join kept on d.doc_id = kept.doc_id
"""

OP11 = r"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
      where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, l.b from reach join l on l.a = reach.b),
least as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n from l group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on least.a = vec_id left join n on n.a = vec_id
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CTEs of the table of CRC-32, made by its rule, and the CRC of a text by its UTF-8 bytes.
_CRC_TABLE = """
crc_rule as (select list(v order by i) as tab from (
  select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) as r(i)))
"""
_BYTES = """flatten(list_transform(string_split({0}, ''), lambda c: case when ord(c) < 128 then [ord(c)]
  when ord(c) < 2048 then [192 + (ord(c) >> 6), 128 + (ord(c) & 63)]
  when ord(c) < 65536 then [224 + (ord(c) >> 12), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)]
  else [240 + (ord(c) >> 18), 128 + ((ord(c) >> 12) & 63), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)] end))"""
_CRC = "xor(list_reduce(list_prepend(cast(4294967295 as bigint), cast(" + _BYTES + " as bigint[])), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"

OP12 = rf"""
with recursive {_CRC_TABLE.strip()},
o as (select doc_id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} as run from documents),
u as (select doc_id, run, count(*) as c from o where length(run) >= 7 group by all),
h as (select run, c, {_CRC.format("doc_id || ':' || run")} as h from u, crc_rule),
d as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, c from h),
w as materialized (select word, cast(sum(c) as bigint) as n from d where length(word) >= 7 group by word having sum(c) >= 2),
k as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
star as materialized (select word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as key, substr(word, 1, i - 1) || substr(word, i + 1) as short from k),
p as materialized (
  select a.word, b.word as near, b.n as near_n from star a join star b on a.key = b.key and a.word <> b.word
  union select a.word, b.word, b.n from star a join w b on a.short = b.word
  union select b.word, a.word, a.n from star a join w b on a.short = b.word),
b as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from p group by word),
f as materialized (select w.word, case when near_n >= 10 * n then near end as form, n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near_n end as form_n
      from w left join b on w.word = b.word),
walk as (select word, word as here, 0 as step from f union all select walk.word, f.form, step + 1 from walk join f on f.word = walk.here where f.form is not null),
r as (select word, arg_max(here, step) as root from walk group by word)
select f.word, form, root, n, n_near, form_n from f join r on f.word = r.word
"""

_FEATURES = r"unnest(regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"

OP13 = rf"""
with {_CRC_TABLE.strip()},
o as materialized (select doc_id, {_FEATURES} as word from documents),
t as materialized (select {_FEATURES} as word from benchmark),
v as materialized (select word, {_CRC.format("word")} % 10000 as bucket from (select word from o union select word from t), crc_rule),
s as (select bucket, count(*) as s from o join v on o.word = v.word group by bucket),
g as (select bucket, count(*) as t from t join v on t.word = v.word group by bucket),
gain as materialized (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select count(*) from o) + 10000)
             / ((coalesce(s, 0) + 1.0::double) * ((select count(*) from t) + 10000)))) as bigint) as gain
         from (select unnest(range(10000)) as bucket) left join s using (bucket) left join g using (bucket)),
m as (select doc_id, count(*) as n, cast(floor(sum(gain)::double / count(*)) as bigint) as weight from o join v on o.word = v.word join gain using (bucket) group by doc_id),
d as (select documents.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::bigint as h
      from documents left join m on documents.doc_id = m.doc_id),
c as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from d),
r as (select *, row_number() over (order by n_features >= 20 desc, score desc, doc_id) as place, 10 * count(*) filter (where n_features >= 20) over () // 100 as drawn from c)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= drawn then place end as rank from r
"""

ORACLES = {
    "op11_embedding_near_dedup": OP11, "op12_spelling_variants": OP12, "op13_importance_resampling": OP13,
    "op9_ngram_jaccard_join": OP9, "op10_substring_dedup": OP10, "op3_line_dedup": OP3, "op4_chat_formatting": OP4, "op6_warc_writer": OP6, "op7_quality_rules": OP7,
}
