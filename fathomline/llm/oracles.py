"""DuckDB SQL with the results of the operators that SQL can express."""

ORACLES: dict[str, str] = {}

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT) >> {s}) & 31)::INT + 1, 1)"
    for k in range(8)
    for s in (15, 10, 5, 0)
)

ORACLES["op2_warc"] = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, strlen(html)::BIGINT as payload_bytes, {_B32} as payload_digest from p),
m as (select payload_digest, max(page_id) as last_id from d group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when d.page_id is not distinct from m.last_id then 'response' else 'revisit' end as record_type,
  case when d.page_id is not distinct from m.last_id then null else m.last_id end as refers_to
from d join m using (payload_digest)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op8_decontaminate"] = f"""
with bw as (select item_id, {_WORDS} as w from benchmark),
b as (select item_id, w, least(10, len(w)) as m from bw where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[k : k + m - 1], ' ') as g
        from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as k from b)),
dw as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
sizes as (select distinct m from win),
pos as (select r, w, m, unnest(range(1, (len(w) - m + 2)::BIGINT)) as k from dw, sizes where len(w) >= m),
hits as (select p.r, p.k, p.m, win.item_id from (select r, k, m, array_to_string(w[k : k + m - 1], ' ') as g from pos) p join win using (m, g)),
words as (select r, count(distinct i) as n_hit from (select r, unnest(range(k, k + m)) as i from (select distinct r, k, m from hits)) group by r),
items as (select r, count(*) as n_items, string_agg(i, ',' order by i) as s from (select distinct r, item_id::VARCHAR as i from hits) group by r)
select doc_id, len(w)::BIGINT as n_words, coalesce(n_hit, 0)::BIGINT as n_hit, coalesce(n_items, 0)::BIGINT as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (r) left join items using (r)
"""

ORACLES["op7_line_dedup"] = r"""
with d as (select distinct doc_id, text, string_split(text, chr(10)) as l from documents where text is not null),
s as (select doc_id, text, l, list_transform(l, lambda x: len(regexp_extract_all(x, '[^\x09-\x0D\x20]+'))) as c from d),
acc as (select doc_id, text, l, [list_sum(c[1:i])::BIGINT for i in range(0, len(c) + 1)] as t from s),
z as (select doc_id, text, l, [coalesce(x, 0) for x in t] as t from acc),
p as (select doc_id, text, l, t, unnest(range(1, len(l) + 1)) as i from z),
ahead as (select doc_id, text, l, i as a, list_position([x - t[i] >= 50 for x in t], true)::BIGINT - 1 as b from p),
back as (select doc_id, text, l, i as b, len(list_filter(t[1:i], lambda x: t[i + 1] - x >= 50)) as a from p),
w as (select distinct doc_id, text, l, a, b from
      (select doc_id, text, l, a, b from ahead where b is not null union all select doc_id, text, l, a, b from back where a >= 1)),
g as (select doc_id, text, a, b, array_to_string(l[a:b], chr(10)) as k, b - a as n from w),
later as (select * from (select *, rank() over (partition by k, n order by coalesce(doc_id, 9223372036854775807), xh, a) as o
          from (select *, text as xh from g)) where o > 1),
gone as (select distinct doc_id, text, unnest(range(a, b + 1)) as i from later),
cut as (select doc_id, text, list(i) as gone from gone group by 1, 2)
select documents.doc_id,
  case when cut.gone is null then documents.text
       else array_to_string([x for x, i in string_split(documents.text, chr(10)) if not list_contains(cut.gone, i)], chr(10)) end as text,
  coalesce(len(string_split(documents.text, chr(10))), 0)::BIGINT as n_lines,
  coalesce(len(cut.gone), 0)::BIGINT as n_deleted
from documents left join cut on documents.doc_id is not distinct from cut.doc_id and documents.text = cut.text
"""

# CRC-32: its table from its rule (eight halvings a byte, the reflected polynomial where a bit falls out), then a byte at a time.
_CRC_ROW = "list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)"
_BYTES = "list_transform(range(1, strlen(w) + 1), lambda k: ('0x' || substr(hex(encode(w)), 2 * k - 1, 2))::BIGINT)"

ORACLES["op12_resampling"] = f"""
with tab as (select list({_CRC_ROW} order by i) as t from range(256) r(i)),
dw as (select row_number() over () as r, doc_id, {_WORDS} as words from documents),
d as (select r, w from (select r, unnest(words) as w from dw)),
b as (select unnest({_WORDS}) as w from benchmark),
dict as (select w, xor(list_reduce({_BYTES}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 as bucket from (select distinct w from (select w from d union all select w from b)), tab),
sums as (select bucket, count(*) filter (k = 0) as s, count(*) filter (k = 1) as t from (select w, 0 as k from d union all select w, 1 from b) join dict using (w) group by bucket),
totals as (select coalesce(sum(s), 0)::DOUBLE as s_all, coalesce(sum(t), 0)::DOUBLE as t_all from sums),
gains as (select bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT as gain from sums, totals),
weights as (select r, floor(sum(gain)::DOUBLE / count(*))::BIGINT as weight from d join dict using (w) join gains using (bucket) group by r),
scored as (select r, doc_id, len(words)::BIGINT as n_features, coalesce(weight, 0)::BIGINT as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT as score from dw left join weights using (r)),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, r) as o, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when o <= n * 10 // 100 then o end::BIGINT as rank from scored left join ranked using (r)
"""
