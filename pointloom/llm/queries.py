"""The queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fillmiddle, mixing, pii, quality, repeats, secretscan, sentencepieces, simhash, sketch, sqlhash, statements, tokencount, toxicity, urls
from .common import table

try:
    import public_tokenizers

    PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
except ImportError:
    PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.seed_labels(pages), urls.RULES, "page_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mixing.shares(table(spark, sf_dir, "documents"))
    return own.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return named.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secretscan.findings(table(spark, sf_dir, "documents"))
    return secretscan.digests(found)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.spans(docs, pii.train(docs)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), "parity", "decoded_same")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return own.select("doc_id", *quality.MEASURES, "failed", "base_failed", "kept")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillmiddle.digests(fillmiddle.transform(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.find(table(spark, sf_dir, "documents"), periodic=True))


#: The rules and the policy of op9 in SQL.
_QUALITY_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
s as (select rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] as w from (select rid, words, unnest(range(1, len(words) - 1)) as i from s)),
c as (select rid, i, count(*) over (partition by rid, w) as n from g),
r as (select rid, count(distinct i + k) as n_repeat_words from c, range(0, 3) as o(k) where n > 1 group by rid),
m as (select doc_id, len(words)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_upper from s left join r using (rid)),
f as (select *, ((n_words < 50)::int + 2 * (n_repeat_words * 100 > n_words * 50)::int + 4 * (n_symbols * 10 > n_words * 3)::int
  + 8 * (n_dup_lines * 100 > (n_words + 1) * 30)::int + 16 * (word_chars > n_words * 25)::int + 32 * (n_upper * 2 > word_chars)::int)::int as failed from m)
select *, failed & 3 <> 0 as base_failed, failed = 0 as kept from f"""


#: The mixture of op3 in SQL.
_MIX_SQL = r"""
with d as (select doc_id, source as own, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint as hash from documents),
c as (select *, case when size > 0 then floor(ln(size::double) * 4)::int else -1 end as class from d),
p as (select own, sum(size)::bigint as source_size, count(*) as docs from d group by own),
w as (select *, [1, 2, 3][(row_number() over (order by own nulls last) - 1) % 3 + 1] as weight, source_size * 3 as most from p),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(most) over before, 0)::double) / ((sum(weight) over ())::double - coalesce(sum(weight) over before, 0)::double) as level,
  row_number() over (order by most::double / weight, own nulls last) as turn from w window before as (order by most::double / weight, own nulls last rows between unbounded preceding and 1 preceding)),
t as (select own, docs, source_size, case when level * weight > most then most::double
  else least(most::double, (select arg_min(level, turn) from l where level * weight <= most) * weight) end as target from l),
h as (select own, min(class) as large_from, sum(words)::bigint as large_words, max(largest) as largest
  from (select *, sum(n) over (partition by own order by class desc rows unbounded preceding) as held, sum(n) over (partition by own) as docs
    from (select own, class, count(*) as n, sum(size) as words, max(size) as largest from c group by own, class))
  where held <= least(256, docs / 4) and class >= 0 group by own),
r as (select t.own, source_size, target, large_from, large_words, largest, case when source_size > 0 then target / source_size else 0 end as rate,
  ('0x' || substr(md5('mix|start|' || coalesce(t.own, 'null')), 1, 13))::bigint / 4503599627370496.0::double as start,
  ('0x' || substr(md5('mix|later|' || coalesce(t.own, 'null')), 1, 13))::bigint / 4503599627370496.0::double as later_start from t left join h on t.own is not distinct from h.own),
q as (select *, floor(rate) as whole, rate - floor(rate) as fraction from r),
x as (select c.*, q.* exclude (own), coalesce(class >= large_from, false) as first from c join q on c.own is not distinct from q.own),
y as (select *, row_number() over (partition by own, first order by case when first then size end desc, case when first then 0 else class end desc, hash, doc_id nulls first) - 1 as place from x),
z as (select own, sum(size * (floor(start + fraction * (place + 1)) - floor(start + fraction * place))) as large_taken from y where first group by own),
v as (select q.own, case when source_size - large_words > 0 then least(1.0::double, greatest(0.0::double, fraction
  + least(1.0::double, (source_size - large_words) * least(fraction, 1 - fraction) / largest) * (fraction * large_words - large_taken) / (source_size - large_words))) end as later
  from q left join z on q.own is not distinct from z.own)
select doc_id, size, source_size, target, (size * (whole + case when first then floor(start + fraction * (place + 1)) - floor(start + fraction * place)
  else floor(later_start + coalesce(later, fraction) * (place + 1)) - floor(later_start + coalesce(later, fraction) * place) end))::bigint as taken
from y join v on y.own is not distinct from v.own"""


def _spans(order: int, kind: str, pattern: str, least: int, group: int = 0, before: int = 0) -> str:
    """Spans of one kind in SQL: the text between matches gives their places. ``before`` characters ahead of a span belong to its match."""
    text = f"repeat(' ', {before}) || t"
    found = f"select rid, regexp_extract_all({text}, '{pattern}', 0) as m, regexp_extract_all({text}, '{pattern}', {group}) as g, regexp_split_to_array({text}, '{pattern}') as gaps from d"
    lengths = lambda own: f"coalesce(list_sum(list_transform({own}, lambda x: length(x))), 0)"
    at = f"select rid, g[i] as g, ({lengths('gaps[1:i]')} + {lengths('m[1:i-1]')})::bigint as start, length(m[i]) as n from ({found}), unnest(range(1, len(m) + 1)) as u(i)"
    return f"select rid, {order} as turn, '{kind}' as kind, start, start + n - {before} as stop from ({at}) where length(g) >= {least}"


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Secrets of op5 in SQL, whose regular expressions have no look-behind.
_SECRETS_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
s as ({" union all ".join([
    _spans(0, "assign", rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    _spans(1, "access", "AKIA[A-Z0-9]+", 20),
    _spans(2, "hex", "[0-9a-f]+", 24),
    _spans(3, "pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0),
    _spans(4, "jwt", r"[^A-Za-z0-9_-]eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 1),
    _spans(5, "vendor", "(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0),
])}),
c as (select rid, {", ".join(f"count(*) filter (where kind = '{k}')::bigint as n_{k}" for k in ("assign", "access", "hex"))},
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, turn) filter (where turn < 3) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, turn) as spans from s group by rid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in ("assign", "access", "hex"))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join c using (rid)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_filter, op2_token_counts, op3_source_mix, op4_simhash_dedup, op5_secret_scan, op6_toxicity, op7_pii, op8_sentencepiece, op9_quality_rules, op10_fingerprints, op11_decontaminate, op12_fill_in_middle, op13_periodic_runs]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Learnt weights and dynamic programs are outside SQL; tests hold those against brute force."""
    return {"op3_source_mix": _MIX_SQL, "op4_simhash_dedup": sqlhash.SIMHASH, "op5_secret_scan": _SECRETS_SQL, "op9_quality_rules": _QUALITY_SQL, "op10_fingerprints": sqlhash.SKETCHES} | statements.SQL
