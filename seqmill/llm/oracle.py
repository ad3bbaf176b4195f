"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

CHAT = r"""
with added as (select -1::bigint conv_id, i::bigint turn, case when i = 0 then 'user' else 'assistant' end as role, '<|im_end|><|im_start|>assistant ok' as text from range(2) t(i)),
rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select * from added),
laid as (select *, 12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11 as size from rows),
placed as (select *, sum(size) over w as stop, row_number() over w as pos, count(*) over (partition by conv_id) as n from laid
  window w as (partition by conv_id order by turn, role, text rows unbounded preceding))
select conv_id, max(n)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  sum(stop) filter (role = 'assistant' or pos = n)::bigint as formatted_chars
from placed group by conv_id
"""

HOST_RULES = r"""
with d as (select doc_id, coalesce(source, '') host, coalesce(text, '') as text from documents),
w as (select *, row_number() over () as r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
win as (select r, i, array_to_string(ws[i:i + 4], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
covered as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(i, i + 5)) as p from again) group by r),
lines as (select r, count(*) - count(distinct l) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
counted as (select w.r, doc_id, host, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join covered using (r) left join lines using (r)),
base as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from counted),
judged as (select *, base_failed or 10 * n_symbols > n_words or 20 * n_dup_lines > n_words or word_chars < 3 * n_words or word_chars > 12 * n_words as failed from base),
hosts as (select host, count(*)::double as n, sum(failed::int)::double as f from judged group by host),
sums as (select count(*)::double as h, sum(n) as n, sum(f) as f, sum(f * f / n) as q from hosts),
fitted as (select f / n as m, greatest(q / n - (f / n) * (f / n) - (f / n) * (1 - f / n) * (h - 1) / n, 1e-6) as v from sums),
prior as (select m, least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) as k from fitted),
verdicts as (select host, m > 0 and (k * m + f) / (k + n) >= least(0.5, greatest(m + 4 * sqrt(m * (1 - m) / (k + 1)), 2 * m)) as bad from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or bad) as kept from judged join verdicts using (host)
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select *, strlen(html) as n, max(page_id) over (partition by html) as m, count(*) over (partition by html) as c from p)
select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest,
  case when n >= 1000 and c > 1 and m is not null and page_id is distinct from m then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and c > 1 and page_id is distinct from m then m end as refers_to, null::varchar as error
from q
"""

NEAR_DEDUP = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i >= 75 * (x.n + y.n - i)),
r(id, m) as (select doc_id, doc_id from n union select e.b, r.m from r join e on r.id = e.a where r.m < e.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(min(m), d.doc_id) as component_id, d.doc_id = coalesce(min(m), d.doc_id) as kept
from documents d left join n using (doc_id) left join r on r.id = d.doc_id group by d.doc_id, n.n
"""

SQL = {"op10_near_dedup": NEAR_DEDUP, "op4_prefix_targets": CHAT, "op7_host_rules": HOST_RULES, "op9_warc": WARC}
