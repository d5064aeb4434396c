"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tideline.llm import op1_toxicity, op2_near, op3_ann, op4_shards, op5_mix, op6_pack, op7_quality, op8_substring, op9_lm, op10_suffix

QUERIES = {
    "op1_toxicity": op1_toxicity.query,
    "op2_near_dedup": op2_near.query,
    "op3_ann": op3_ann.query,
    "op4_shards": op4_shards.query,
    "op5_mix": op5_mix.query,
    "op6_packing": op6_pack.query,
    "op7_quality": op7_quality.query,
    "op8_substring_dedup": op8_substring.query,
    "op9_lm": op9_lm.query,
    "op10_suffix_dedup": op10_suffix.query,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op2_near_dedup": rf"""
with recursive words as (
  select doc_id, list_transform({_WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
                               when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)),
both_ways as (select x, y from links union select y, x from links),
reach(doc_id, node) as (select doc_id, doc_id from documents union select r.doc_id, b.y from reach r join both_ways b on b.x = r.node),
least as (select doc_id, min(node) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least using (doc_id) left join sizes using (doc_id)""",
    "op8_substring_dedup": rf"""
with words as (select doc_id, {_WORDS} as w from documents),
windows as (
  select doc_id, i, md5(array_to_string(w[i:i+49], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
firsts as (select h, min(doc_id) as first_doc from windows group by 1),
cut as (
  select distinct doc_id, unnest(range(i, i + 50)) as p from windows join firsts using (h) where doc_id > first_doc),
covered as (
  select doc_id, p, word, cut.p is not null as out
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words) left join cut using (doc_id, p)),
kept as (
  select doc_id, count(*)::bigint as n_words, count_if(out)::bigint as n_removed,
         coalesce(string_agg(word, ' ' order by p) filter (where not out), '') as t from covered group by 1)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from documents d left join kept using (doc_id)""",
    "op10_suffix_dedup": """
with raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
strings as (
  select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as s from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from raw where length(h) >= 200)),
hits as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as n from strings) where n > 1),
spans as (
  select doc_id, min(i) as a, max(i) + 100 as b from (
    select doc_id, i, sum(new) over (partition by doc_id order by i) as g from (
      select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from hits)) group by doc_id, g),
pieces as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from spans
  union all select doc_id, max(b), max(length(h)) // 2 from spans join raw using (doc_id) group by 1),
kept as (select doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as k from pieces join raw using (doc_id) group by 1),
sums as (select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans from spans group by 1)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from raw left join sums using (doc_id) left join kept using (doc_id)""",
    "op4_shards": """
with recursive
d as (select doc_id, text, (coalesce(octet_length(encode(text)), 0) + 8)::bigint as size from documents where doc_id is not null),
g as (select text, min(doc_id) as first, sum(size)::bigint as bytes from d group by text),
e as (select text, first, bytes, (sum(bytes) over (order by first))::bigint as e from g),
search(lo, hi, pos, used) as (
  select max(bytes)::bigint, max(e)::bigint, 0::bigint, 0 from e having count(*) > 0
  union all
  select case when next < total and used = 23 then mid + 1 else lo end, case when next = total then mid else hi end,
         case when next = total or used = 23 then 0 else next end, case when next = total or used = 23 then 0 else used + 1 end
  from (select lo, hi, used, mid, max(e.e)::bigint as next, max(total)::bigint as total
        from (select *, (lo + hi) // 2 as mid from search where lo < hi) s, (select max(e) as total from e) t, e where e.e <= s.pos + s.mid group by lo, hi, pos, used, mid)),
walk(pos, n) as (
  select 0::bigint, 0
  union all
  select max(e.e)::bigint, max(n) + 1 from walk, e, (select lo as cap from search where lo = hi limit 1) c where e.e <= pos + cap and n < 24 having count(*) > 0),
cuts as (select pos from walk where n > 0),
placed as (select doc_id, d.size, d.text, e - bytes as before, (select count(*) from cuts where pos <= e.e - e.bytes)::int as shard from d join e on d.text is not distinct from e.text),
crc_table as (select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as crc from (select unnest(range(256)) as n)),
hexed as (select text, hex(encode(text)) as h from (select distinct text from d where text is not null)),
crcs as (
  select text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::bigint)),
    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) as text_crc32 from hexed, crc_table)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by before, doc_id) - 1 as slot, null::int as grown_shard
from placed left join crcs on placed.text = crcs.text""",
}
