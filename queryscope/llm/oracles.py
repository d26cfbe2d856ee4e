"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, p.d as payload_digest,
  case when first_id is not null and first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""

WINNOWING = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(len(w), 8) as n, array_to_string(w[s : s + least(len(w), 8) - 1], ' ') as g
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 7))) as s from iw where len(w) > 0)),
sizes as (select distinct n from win),
dg as (select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from dw, sizes where len(w) >= n)),
hit as (select distinct doc_id, s, dg.n, item_id from dg join win on dg.g = win.g and dg.n = win.n),
cov as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from (select distinct doc_id, s, n from hit)) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as l from (select distinct doc_id, item_id::varchar as i from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(l, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from dw left join cov using (doc_id) left join ids using (doc_id)
"""

MIXING = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, (array[5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from d group by source),
r as (select *, source_size::double * 3 as cap, source_size::double * 3 / w as ratio from s),
u as (select *, sum(source_size::double) over () as total, sum(w) over () as w_all,
  coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as c0,
  coalesce(sum(w) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as w0 from r),
l as (select *, (total - c0) / (w_all - w0) as own from u),
v as (select *, (select arg_min(own, ratio) from l where cap > w * own) as level from l),
t as (select source, source_size, coalesce(least(cap, w * level), cap) as target from v),
q as (select doc_id, size, source_size, target, case when source_size > 0 then least(3.0::double, target / source_size) else 0.0 end as rate,
  ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0::double as draw
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(rate)::bigint + (draw < rate - floor(rate))::bigint) * size)::bigint as taken from q
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": WARC, "op8_winnowing": WINNOWING, "op9_mixing": MIXING}
