"""DuckDB SQL for those queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP4 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, case when i = 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) r(i)),
s as (select *, length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) as role_chars, length(regexp_replace(text, '([\\#<:])', '\\\1', 'g')) as text_chars,
  row_number() over (partition by conv_id order by turn, role, text) as rn, count(*) over (partition by conv_id) as n from t),
p as (select *, coalesce(sum(4 + role_chars + 2 + text_chars + 9) over (partition by conv_id order by rn rows between unbounded preceding and 1 preceding), 0) as before from s),
e as (select *, case when role = 'assistant' then before + 4 + role_chars + 2 + text_chars when rn = n then before + 4 + role_chars + 2 + text_chars + 9 end as chars from p)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by rn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars, count(chars) as n_examples
from e group by conv_id
"""

OP7 = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w)),
again as (select s from win group by s having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as k from win semi join again using (s)),
word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as k from w),
kept as (select doc_id, string_agg(word, ' ' order by k) as kept, count(*) as n from word anti join gone using (doc_id, k) group by doc_id)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept on w.doc_id = kept.doc_id
"""

OP9 = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) as ws from documents),
g as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, edge.b from reach join edge on edge.a = reach.r)
select d.doc_id, coalesce(n.n, 0) as n_shingles, d.component_id from (select doc_id, min(r) as component_id from reach group by doc_id) d left join n on n.doc_id = d.doc_id
"""
