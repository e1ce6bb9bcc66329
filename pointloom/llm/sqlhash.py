"""XXH64 and the queries that rest on it in DuckDB's SQL, to check the operators; nothing in them runs on Spark.

All numbers are UHUGEINT below 2**64, so products fit and are cut by a modulus.
"""

from __future__ import annotations

#: The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_MOD = "18446744073709551616::uhugeint"


def _n(value: int) -> str:
    return f"{value % 2**64}::uhugeint"


def _times(a: str, value: int) -> str:
    return f"(({a}) * {_n(value)} % {_MOD})"


def _plus(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_MOD})"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::ubigint, ({b})::ubigint)::uhugeint"


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _turned(a: str, bits: int, name: str) -> str:
    """Rotated to the left."""
    return _let(f"({a}) * {2**bits}::uhugeint", name, f"({name} % {_MOD} + {name} // {_MOD})")


def _round(state: str, lane: str, name: str) -> str:
    return _times(_turned(_plus(state, _times(lane, P2)), 31, name), P1)


def _end(h: str) -> str:
    for shift, prime, name in ((33, P2, "e1"), (29, P3, "e2"), (32, None, "e3")):
        h = _let(h, name, _xor(name, f"{name} // {2**shift}::uhugeint"))
        h = _times(h, prime) if prime else h
    return h


def _lane8(h: str, lane: str) -> str:
    return _plus(_times(_turned(_xor(h, _round(_n(0), lane, "r8")), 27, "t8"), P1), _n(P4))


def of_long(value: str, seed: str) -> str:
    """XXH64 of a number's eight bytes."""
    return _end(_lane8(_plus(seed, _n(P5 + 8)), value))


def _lane(at: str, size: int) -> str:
    """A little-endian number of the list ``bs`` of bytes, from place ``at`` (from 1) on."""
    return "(" + " + ".join(f"bs[{at} + {i}] * {256**i}::uhugeint" for i in range(size)) + ")"


def of_text(seed: int) -> str:
    """XXH64 of the text whose UTF-8 bytes are the list ``bs`` and their number ``n``."""
    start = (seed + P1 + P2, seed + P2, seed, seed - P1)
    stripes = [f"list_reduce(range(0, n // 32), lambda acc, s: {_round('acc', _lane(f's * 32 + {8 * k + 1}', 8), 'rs')}, {_n(v)})" for k, v in enumerate(start)]
    turns = [_turned(f"v[{k + 1}]", bits, f"w{k}") for k, bits in enumerate((1, 7, 12, 18))]
    joined = "(" + " + ".join(turns) + f") % {_MOD}"
    for k in range(4):
        joined = _plus(_times(_xor(joined, _round(_n(0), f"v[{k + 1}]", f"m{k}")), P1), _n(P4))
    begun = f"case when n >= 32 then {_let('[' + ', '.join(stripes) + ']', 'v', joined)} else {_n(seed + P5)} end"
    h = _plus(begun, "n::uhugeint")
    h = f"list_reduce(range(n // 32 * 32, n // 8 * 8, 8), lambda acc, o: {_lane8('acc', _lane('o + 1', 8))}, {h})"
    four = _plus(_times(_turned(_xor("acc", _times(_lane("o + 1", 4), P1)), 23, "t4"), P2), _n(P3))
    h = f"list_reduce(range(n // 8 * 8, n // 4 * 4, 4), lambda acc, o: {four}, {h})"
    one = _times(_turned(_xor("acc", _times("bs[o + 1]", P5)), 11, "t1"), P1)
    h = f"list_reduce(range(n // 4 * 4, n), lambda acc, o: {one}, {h})"
    return _end(h)


def hashed(table: str, column: str, seed: int) -> str:
    """Query of ``column`` and its hash ``h`` over the distinct texts of a table."""
    return f"""select {column}, {of_text(seed)} as h from (select {column}, len(hx) // 2 as n, list_transform(range(0, len(hx) // 2), lambda i: ('0x' || hx[2 * i + 1 : 2 * i + 2])::uhugeint) as bs
  from (select {column}, hex(encode({column})) as hx from (select distinct {column} from {table})))"""


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Fingerprints of three-word shingles, and components of those within two bits, by all pairs.
SIMHASH = rf"""
with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as words from documents),
g as materialized (select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
  else list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) end) as s from d),
x as materialized ({hashed("g", "s", 42)}),
b as (select doc_id, count(*) as n, {", ".join(f"sum(h // {2**i}::uhugeint % 2) as c{i}" for i in range(64))} from g join x using (s) group by doc_id),
f as materialized (select doc_id, coalesce({" + ".join(f"case when 2 * c{i} > n then {2**i}::uhugeint else 0 end" for i in range(64))}, 0)::ubigint as fp from d left join b using (doc_id)),
u as (select fp, min(doc_id) as least from f group by fp),
k as materialized (select a.fp as p, b.fp as q from u a, u b where bit_count(xor(a.fp, b.fp)::bit) <= 2),
r as (select fp as p, fp as q from u union select r.p, k.q from r join k on r.q = k.p)
select doc_id, lower(lpad(to_hex(fp), 16, '0')) as fingerprint, component_id from f join (select p, min(least) as component_id from r join u on r.q = u.fp group by p) on p = fp"""

_OWN = f"list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: list_reduce(ws[i : i + 4], lambda acc, x: {of_long('x', 'acc')}, {_n(42)}) // 65536)))"


def _near(a: str, b: str) -> str:
    """Likeness by what two sketches hold."""
    return f"coalesce(len(list_intersect({a}.kept, {b}.kept)) / nullif(least(len({a}.kept), len({b}.kept)), 0), (len({a}.kept) = 0 and len({b}.kept) = 0)::int::double)"


#: Threshold-scaled sketches of five-word shingles of texts and edited texts, and their likeness.
SKETCHES = rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id) as rid, count(*) over () as n from documents),
e as (select d.*, left(d.t, (length(d.t) - length(d.t) // 4)::bigint) || left(y.t, (length(d.t) // 4)::bigint) as edited, y.rid as after from d join d y on y.rid = d.rid % d.n + 1),
t as (select rid, 'text' as kind, t from e union all select rid, 'edited', edited from e),
w as materialized (select rid, kind, unnest(words) as word, generate_subscripts(words, 1) as pos from (select rid, kind, {_WORDS.format("t")} as words from t)),
x as materialized ({hashed("w", "word", 42)}),
s as (select rid, kind, {_OWN} as own from (select rid, kind, list(h order by pos) as ws from w join x using (word) group by rid, kind)),
k as materialized (select rid, kind, coalesce(own, []) as own, coalesce(list_filter(own, lambda h: h < {2**46}), []) as kept from t left join s using (rid, kind))
select doc_id, length(t)::bigint as n_chars, sha256(edited) as edited_sha256,
  '{2**46:x}:' || array_to_string(list_transform(a.kept, lambda h: lower(to_hex(h::ubigint))), ',') as fingerprint, '{2**46:x}:' || array_to_string(list_transform(b.kept, lambda h: lower(to_hex(h::ubigint))), ',') as edited_fingerprint,
  {_near("a", "b")} as near_edited, {_near("a", "c")} as near_next
from e join k a on a.rid = e.rid and a.kind = 'text' join k b on b.rid = e.rid and b.kind = 'edited' join k c on c.rid = e.after and c.kind = 'text'"""
