"""Decontamination, fill-in-the-middle and periodic runs in DuckDB's SQL, to check the operators; nothing in it runs on Spark."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OWN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of benchmark items among all windows of the documents.
DECONTAMINATE = f"""
with d as materialized (select row_number() over () as rid, doc_id, {_OWN} as w from documents),
b as (select coalesce(item_id::varchar, 'null') as item, w, least(10, len(w)) as size from (select item_id, {_OWN} as w from benchmark) where len(w) > 0),
p as materialized (select distinct item, size, array_to_string(w[i : i + size - 1], ' ') as phrase from b, unnest(range(1, (len(w) - size + 2)::bigint)) as u(i)),
g as (select rid, i, size, array_to_string(w[i : i + size - 1], ' ') as phrase from (select * from d, (select distinct size from p)), unnest(range(1, (len(w) - size + 2)::bigint)) as u(i)),
o as materialized (select rid, i, size, item from g join p using (size, phrase)),
h as (select rid, count(distinct i + k) as n_hit from (select distinct rid, i, size from o), unnest(range(0, size::bigint)) as u(k) group by rid),
t as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from o) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (rid) left join t using (rid)"""

_MARKS = " or ".join(f"contains(t, '{m}')" for m in ("<P>", "<S>", "<M>"))
_HASH = ", ".join(f"('0x' || x[{8 * k + 1} : {8 * k + 8}])::bigint as h{k + 1}" for k in range(4))

#: Units, seeded cuts, outputs, and the texts put together again from the outputs.
FILL_IN_MIDDLE = f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, 'null')) as x from documents),
u as (select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as own, {_HASH} from d),
c as (select *, len(own)::bigint as n, least(h1 % (len(own) + 1), h2 % (len(own) + 1)) as a, greatest(h1 % (len(own) + 1), h2 % (len(own) + 1)) as z,
  case when t = '' or {_MARKS} or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(own[1 : a], '') as head, array_to_string(own[a + 1 : z], '') as middle, array_to_string(own[z + 1 :], '') as tail from c),
o as (select *, case form when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || middle when 'spm' then '<S>' || tail || '<P>' || head || '<M>' || middle else t end as output from p),
r as (select *, regexp_extract(output, '(?s)\\A<P>(.*?)<S>(.*?)<M>(.*)\\z', ['head', 'tail', 'middle']) as psm, regexp_extract(output, '(?s)\\A<S>(.*?)<P>(.*?)<M>(.*)\\z', ['tail', 'head', 'middle']) as spm from o)
select doc_id, n, form, case when form <> 'plain' then length(head) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars, sha256(output) as output_sha256,
  sha256(case form when 'psm' then psm.head || psm.middle || psm.tail when 'spm' then spm.head || spm.middle || spm.tail else output end) as restored_sha256 from r"""

#: CRC-32 of a list ``bs`` of bytes, bit by bit.
_CRC = "xor(list_reduce(range(0, len(bs) * 8), lambda acc, k: xor(case when k % 8 = 0 then xor(acc, bs[k // 8 + 1]) else acc end // 2, case when (case when k % 8 = 0 then xor(acc, bs[k // 8 + 1]) else acc end) % 2 = 1 then 3988292384 else 0 end), 4294967295::bigint), 4294967295::bigint)"

#: Stretches of equal words q apart, for every q, joined to runs.
PERIODIC_RUNS = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as own, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint) as bs from documents),
h as (select rid, doc_id, own, len(own)::bigint as n, {_CRC} as h from d),
g as (select *, h // 10 as g, case when n > 0 then (h // 10) % n end as a from h),
p as (select *, case when h % 10 = 0 and n > 0 then 1 + (n - a) // (3 + g % 8) end as p from g),
c as materialized (select rid, doc_id, n, case when p is null then own else list_transform(range(0, n), lambda i: own[1 + case when i < a then i else a + (i - a) % p end]) end as w from p),
e as materialized (select rid, i, w[i + 1] as word from c, unnest(range(0, n)) as u(i)),
m as (select x.rid, x.i, y.i - x.i as q from e x join e y on x.rid = y.rid and x.word = y.word and y.i > x.i join c on c.rid = x.rid where (y.i - x.i) * 4 <= n),
s as (select rid, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by rid, q order by i) as island from m) group by rid, q, island having count(*) + q >= greatest(6, 4 * q)),
r as materialized (select rid, start, length, min(q) as period from s group by rid, start, length),
k as (select rid, arg_min(struct_pack(start := start, length := length, period := period), turn) as best, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said
  from (select *, row_number() over (partition by rid order by length::hugeint * 1000000000000 // period desc, start, period) as turn from r) group by rid),
x as (select distinct rid, i from r, unnest(range(start + period, start + length)) as u(i)),
t as (select rid, string_agg(word, ' ' order by i) as kept from e anti join x using (rid, i) group by rid)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period, (best.length * 1000 // best.period)::bigint as exponent_milli,
  sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256 from c left join k using (rid) left join t using (rid)"""

SQL = {"op11_decontaminate": DECONTAMINATE, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_periodic_runs": PERIODIC_RUNS}
