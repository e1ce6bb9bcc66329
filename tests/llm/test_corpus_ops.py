"""Operators on the whole corpus against brute force: URL filter, mixing, near-duplicates, toxicity, fingerprints."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pytest
import xxhash
from pointloom.llm import mixing, queries, simhash, sketch, toxicity, urls
from pyspark.sql import functions as F

from tests.compare import assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


# URL filter


def brute_rule(url: str | None) -> tuple:
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    best = None
    for rule, verdict in urls.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


ODD_URLS = [None, "", "x", "://", "http://", "HTTP://A.Example.COM/en/7?q#f", "http://example.com/en/8", "http://notexample.com/en/7", "http://com/en/", "ftp://example.net/de/8/9", "http://example.net/de/9", "http://a.org/es", "http://a.org/es/", "http://É.org/es/x", "http://a.com?x://b.org/es/", "a\nb://example.com/en/77\n", "http://x.com/en/1?a=1&b=2"]


def test_url_rules_and_every_row(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(ODD_URLS * 3)], "page_id long, url string, host string, rule string")
    out = urls.judge(pages.select("page_id", "url"), urls.seed_labels(pages), urls.RULES, "page_id").collect()
    assert len(out) == 3 * len(ODD_URLS)
    for r in out:
        host, path, rule, verdict = brute_rule(ODD_URLS[r.page_id % len(ODD_URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))
    empty = pages.limit(0)
    assert urls.judge(empty.select("page_id", "url"), urls.seed_labels(empty), urls.RULES, "page_id").count() == 0


def test_urls_of_a_megabyte(spark):
    """Long hosts, paths and queries, of letters, dots and digits, are judged whole."""
    long = ["http://" + "a" * 1_000_000 + ".com/en/1", "http://x.com/en/" + "7/" * 500_000, "http://x.net/de/?" + "&".join(f"i{i}=1" for i in range(120_000)), "http://" + "b." * 2000 + "org/es/" + "0" * 900_000]
    own = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    for r in urls.judge(own, urls.seed_labels(own), urls.RULES, "page_id").collect():
        assert (r.host, r.path, r.rule) == brute_rule(long[r.page_id])[:3] and r.verdict in ("allow", "block")


def test_url_trees_learn_the_labels(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = urls.seed_labels(pages)
    judged = urls.judge(pages, labels, urls.RULES, "page_id").where("rule is null")
    hit = judged.join(pages, "page_id").select("score", F.regexp_extract("url", "://([^/?#]*)", 1).rlike("|".join(urls.SEED_WORDS)).alias("bad")).collect()
    right = sum((r.score >= 0.5) == r.bad for r in hit) / max(1, len(hit))
    assert right >= 0.9


def bought(own, bad: bool, host: str) -> str:
    """An URL of a host: bad ones have many parameters and digits."""
    word = lambda: own.choice(["news", "home", "about", "shop", "blog"])
    tail = "?" + "&".join(f"id{own.randrange(99)}={own.randrange(10**8)}" for _ in range(own.randrange(3, 7))) if bad else "?page=2" * own.randrange(2)
    return f"https://{host}/{word()}/{word()}{tail}"


def test_trees_judge_hosts_that_they_never_saw(spark):
    """Recall of the bad class and precision on hosts, and top domains, that are in no label."""
    import random

    own = random.Random(3)
    hosts = [(i % 10 == 0, f"{'x' * (i % 5)}site{i}.{['com', 'org', 'net', 'info'][i % 4] if i < 300 else 'example'}") for i in range(400)]
    seen = [(bought(own, bad, h), int(bad)) for bad, h in hosts[:300] for _ in range(12)]
    labels = spark.createDataFrame(seen, "url string, label int")
    new = [(i, bought(own, bad, h), bad) for i, (bad, h) in enumerate(hosts[300:] * 5)]
    found = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(new, "page_id long, url string, bad boolean"), labels, urls.RULES, "page_id").where("rule is null").collect()}
    said = [(bad, found[i] == "block") for i, _, bad in new if i in found]
    hit = sum(b and s for b, s in said)
    assert hit / sum(b for b, _ in said) >= 0.9 and hit / sum(s for _, s in said) >= 0.9
    assert 0 < sum(b for b, _ in said) < 0.2 * len(said)


def test_beyond_the_broadcast_bound_the_verdicts_are_the_same(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = lambda most: sorted(tuple(r) for r in urls.judge(pages, urls.seed_labels(pages), urls.RULES, "page_id", max_suffixes=most).collect())
    assert judged(10_000) == judged(20)


def test_a_suffix_counts_alike_in_small_and_large_tables(spark):
    """Five URLs of a host give it a rate of its own, also among many others."""
    own = [(f"http://a{i}.rare.com/", 1) for i in range(10)]
    rates = []
    for n in (50, 60_000):
        more = spark.range(n).select(F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".net/"), "id").alias("url"), F.lit(0).alias("label"))
        rates.append({r.suffix for r in urls.train(spark.createDataFrame(own, "url string, label int").union(more), max_train=100)[1].collect()})
    assert all("rare.com" in x for x in rates)


# mixing


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        left, open_ = left - sum(target[s] for s in over), open_ - over
    return target


def test_mixing(no_id_docs, no_docs):
    planned = mixing.plan(no_id_docs)
    rows = planned.select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert len(rows) == no_id_docs.count()
    sizes: dict = {}
    for r in rows:
        assert r["size"] == len(words_of(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
    assert mixing.plan(no_docs).count() == 0 == mixing.mix(no_docs).count()


def test_mixture_nears_its_targets_and_reruns_agree(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    own = mixing.plan(docs).groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    for r in own:
        assert r.taken == pytest.approx(r.target, rel=0.01)
    mixed = mixing.mix(docs)
    count = lambda df: {(r.doc_id, r.n) for r in df.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mixed.schema == docs.schema and count(mixed) == count(mixing.mix(docs.repartition(5)))
    assert count(mixed) == {(r.doc_id, r.copies) for r in mixing.plan(docs).where("copies > 0").select("row.doc_id", "copies").collect()}
    assert count(mixed) == {(r.id, r.copies) for r in mixing.shares(docs).where("copies > 0").collect()}


def test_sources_of_one_document_are_drawn_by_their_fraction(spark):
    """Not rounded: as many extra copies as the fractions say, of small fractions and of large ones."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    rows = [(r.target / r.source_size, r.copies) for r in mixing.shares(docs).collect()]
    for low, high in ((0.0, 0.5), (0.5, 1.0)):
        own = [(rate % 1, copies - rate // 1) for rate, copies in rows if low < rate % 1 < high]
        want, got = sum(f for f, _ in own), sum(c for _, c in own)
        assert len(own) > 300 and all(c in (0, 1) for _, c in own) and abs(got - want) <= 4 * sum(f * (1 - f) for f, _ in own) ** 0.5


def test_every_document_has_the_probability_of_its_fraction(spark):
    """Over many salts, large documents too; and the words taken stay near the target under each."""
    sizes = [800, 600, 500] + [20 + i % 60 for i in range(57)]
    docs = spark.createDataFrame([(i, "a", "w " * n) for i, n in enumerate(sizes)] + [(99, "b", "w " * 2000)], "doc_id long, source string, text string").coalesce(1).cache()
    runs, seen = 20, {}
    for salt in range(runs):
        rows = [r for r in mixing.shares(docs, salt=f"s{salt}").collect() if r.of == "a"]
        assert sum(r["size"] * r.copies for r in rows) == pytest.approx(rows[0].target, rel=0.1)
        for r in rows:
            seen[r.id] = seen.get(r.id, 0) + r.copies
    rate = rows[0].target / rows[0].source_size
    f = rate % 1
    for i, n in seen.items():
        assert abs(n - runs * rate) <= 4 * (runs * f * (1 - f)) ** 0.5 + 1, i
    assert sum(seen.values()) == pytest.approx(runs * rate * len(sizes), rel=0.05)


def test_a_hot_source_is_spread(spark):
    """No part of a line holds more than a slice of a source of 100,000 equal sizes, and the line is whole."""
    docs = spark.range(100_000).select(F.col("id").alias("id"), F.lit("hot").alias("of"), F.lit(7).cast("long").alias("size"), F.lit(0).cast("long").alias("tie"))
    per, parts, bits, small = mixing.sources(docs, (1, 2, 3), 3, "mix", 10)
    held = mixing._lined(docs, per, "mix", bits, small).groupBy("of", *mixing.LINE).count().collect()
    assert len(held) == 64 and max(r["count"] for r in held) < 2000
    ahead = {(r["in_class"], r["slice"]): r.ahead for r in parts.collect()}
    at = 0
    for r in sorted(held, key=lambda r: (-r["in_class"], r["slice"])):
        assert ahead[(r["in_class"], r["slice"])] == at
        at += r["count"]


@pytest.mark.parametrize("name", ["op3_source_mix", "op4_simhash_dedup", "op10_fingerprints"])
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name])


def test_hashes_in_sql_are_xxh64():
    import random

    import duckdb
    from pointloom.llm import sqlhash

    own = random.Random(1)
    texts = ["", "a", "x" * 31, "x" * 32, "x" * 33, "é ß 東京 naïve " * 9] + ["".join(own.choice("abcdef é🙂") for _ in range(own.randrange(90))) for _ in range(100)]
    with duckdb.connect() as con:
        con.execute("create table z (t varchar)")
        con.executemany("insert into z values (?)", [[t] for t in texts])
        got = dict(con.execute(sqlhash.hashed("z", "t", 42)).fetchall())
        number = con.execute(f"select {sqlhash.of_long('12345678901234567890::uhugeint', '99::uhugeint')}").fetchall()[0][0]
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
    assert number == xxhash.xxh64_intdigest((12345678901234567890).to_bytes(8, "little"), 99)


def test_beyond_the_broadcast_bound_the_join_is_the_same(docs):
    a = mixing.plan(docs).select("row.doc_id", "target", "copies").collect()
    b = mixing.plan(docs, max_sources=1, max_parts=1).select("row.doc_id", "target", "copies").collect()
    assert sorted(a) == sorted(b)


# near-duplicates


def brute_fingerprint(text: str | None) -> int:
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict) -> dict:
    root = {f: f for f in fps.values()}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[top(b)] = top(a)
    least: dict = {}
    for d, f in fps.items():
        least[top(f)] = min(d, least.get(top(f), d))
    return {d: least[top(f)] for d, f in fps.items()}


def test_near_duplicates(docs, no_docs):
    rows = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex("fp").alias("f"), "component_id").collect()
    assert len(rows) == docs.count()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(fps)
    assert {(r.doc_id, r.f, r.component_id) for r in rows} == {(d, f"{f:016x}", want[d]) for d, f in fps.items()}
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("max_shard", [1, 3, 512])
def test_links_of_crowded_shards(spark, max_shard):
    """A ball of fingerprints around one, chains of two-bit steps, and far ones."""
    import random

    own = random.Random(5)
    centre = own.getrandbits(64)
    values = {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)} | {own.getrandbits(64) for _ in range(60)}
    x = own.getrandbits(64)
    for i in range(0, 20, 2):
        x ^= 3 << i
        values.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = simhash.components(simhash.links(nodes, max_shard)).collect()
    root = {r.node: r.root for r in found}
    got: dict = {}
    for v in values:
        got.setdefault(root.get(signed(v), signed(v)), set()).add(v)
    want: dict = {}
    for v, c in brute_components({v: v for v in values}).items():
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_group_stays(no_id_docs, no_docs):
    kept = simhash.keep_one(no_id_docs)
    assert kept.schema == no_id_docs.schema
    named = simhash.near_duplicates(no_id_docs)
    assert kept.count() == named.select("root").distinct().count()
    ids = {r.component_id for r in named.collect()}
    assert {r.doc_id for r in kept.collect()} == ids
    assert simhash.keep_one(no_docs).count() == 0


def test_bk_tree_finds_what_a_scan_finds():
    import random

    own = random.Random(3)
    values = [own.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 97):
        assert sorted(tree.near(q, 2)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 2)


# toxicity


def test_toxicity_of_odd_rows(docs, no_docs, labels):
    weights = toxicity.train(docs, labels)
    rows = toxicity.score(docs, weights).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert toxicity.score(no_docs, weights).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.keep_clean(docs, nothing).count() == docs.count()
    assert toxicity.keep_clean(docs, weights).schema == docs.schema


def plain_ftrl(rows: list, passes: int, size: int) -> dict:
    """FTRL-proximal coordinate by coordinate: z, n and the weight that they give."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity.L1:
            return 0.0
        sign = 1 if zi > 0 else -1
        return -(zi - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(passes):
        for x, y in rows:
            own = {i: weight(i) for i in [*map(int, x), size]}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(own.values())))))
            for i, w in own.items():
                g, before = p - y, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_a_plain_loop(spark, sf_dir):
    """Weights and scores over the rows of a table, one coordinate at a time."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    known = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    learnt = [(toxicity.features(r.text), r.toxic) for r in known if zlib.crc32(str(r.doc_id).encode()) % 5]
    want, got = plain_ftrl(learnt, toxicity.PASSES, 1 << toxicity.BITS), toxicity.learn(learnt)
    assert set(want) == {int(i) for i in got.nonzero()[0]} and all(got[i] == pytest.approx(w, rel=1e-9, abs=1e-12) for i, w in want.items())
    # by Spark: the same rows in its own fixed order
    weights = toxicity.train(docs, labels)
    order = {r.id: i for i, r in enumerate(labels.select(F.col("doc_id").alias("id")).repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").collect())}
    by_spark = sorted((r for r in known if zlib.crc32(str(r.doc_id).encode()) % 5), key=lambda r: order[r.doc_id])
    want = plain_ftrl([(toxicity.features(r.text), r.toxic) for r in by_spark], toxicity.PASSES, 1 << toxicity.BITS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, weights).collect():
        raw = sum(want.get(int(i), 0.0) for i in toxicity.features(texts[r.doc_id])) + want.get(1 << toxicity.BITS, 0.0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, raw)))), abs=1e-4)


def test_repeated_rows_are_learnt_once_and_features_are_bounded(spark):
    rows = [(i, f"word{i} bad{i % 2}", ) for i in range(40)]
    docs = spark.createDataFrame(rows + [rows[1]] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert (toxicity.train(docs, labels).value == toxicity.train(docs.distinct(), labels).value).all()
    long = toxicity.features(" ".join(f"w{i}" for i in range(60_000)))
    assert 60_000 < len(long) == len(set(long.tolist())) < 1 << toxicity.BITS


def test_held_out_labels_are_never_learnt(docs, labels):
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda own: sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.train(docs, own)).collect())
    assert score(labels) == score(changed)


def test_toxicity_ranks_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    bad, good = [r.score for r in scored if r.toxic == 1], [r.score for r in scored if r.toxic == 0]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc >= 0.95
    assert sum(g >= 0.5 for g in good) <= 0.01 * len(good)


# fingerprints


def grams(text: str) -> set:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def contained(a: str, b: str) -> float:
    x, y = grams(a), grams(b)
    return len(x & y) / min(len(x), len(y)) if x and y else float(x == y)


@pytest.mark.parametrize("run", [3, 2_000])
def test_fingerprints(spark, docs, no_docs, run):
    own = docs.dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in sketch.fingerprints(own, run).collect()}
    order = sorted((r.doc_id, r.text or "") for r in own.collect())
    assert sorted(rows) == [d for d, _ in order]
    by_print: dict = {}
    for i, (d, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        r = rows[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        held = [len(read_back(p)) for p in (r.fingerprint, r.edited_fingerprint, rows[order[(i + 1) % len(order)][0]].fingerprint)]
        # five standard errors by what the sketches hold
        for near, whole, n in ((r.near_edited, contained(text, edited), min(held[:2])), (r.near_next, contained(text, after), min(held[0], held[2]))):
            assert n == 0 or abs(near - whole) <= 5 * math.sqrt((whole * (1 - whole) + 1 / n) / n)
        by_print.setdefault(text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_print.values())
    assert sketch.fingerprints(no_docs).count() == 0


def test_single_and_repeated_documents(spark):
    one = spark.createDataFrame([(None, "a b c d e f g h")], "doc_id long, text string")
    r = sketch.fingerprints(one).first()
    assert r.doc_id is None and r.near_next == 1.0
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d")], "doc_id long, text string")
    assert sketch.fingerprints(same, run=1).count() == 3


def test_short_texts_in_long_ones(spark):
    words = [f"w{i}" for i in range(8000)]
    rows = []
    for i in range(20):
        at, n = 300 * i, (24, 54, 104)[i % 3]
        rows += [(2 * i, " ".join(words[at : at + n])), (2 * i + 1, " ".join(words))]
    found = sketch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 40 and all(r.near_next == 1.0 for r in found)
    pair = spark.createDataFrame([("a", " ".join(words)), ("", " ".join(words))], "a string, b string").select(*(sketch.sketch(F.col(c)).alias(c) for c in "ab"))
    assert [r.near for r in pair.select(sketch.containment(F.col("a"), F.col("b")).alias("near")).collect()] == [None, None]


def brute_word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 42)


def brute_hashes(text: str) -> list[int]:
    """All shingle hashes: those of five words, eight bytes each, one the seed of the next."""
    words = [brute_word_hash(w) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        out.add(h >> 16)
    return sorted(out)


def test_sketches_hold_every_hash_under_the_threshold(spark, docs):
    """Whatever the length; and nothing else."""
    long = " ".join(f"w{i}" for i in range(25_000))
    own = docs.select("text").union(spark.createDataFrame([(long,), (long[:900],)], "text string"))
    found = own.select("text", sketch.sketch(F.coalesce("text", F.lit(""))).alias("s"), sketch.hashes(F.coalesce("text", F.lit(""))).alias("h")).collect()
    for r in found:
        want = brute_hashes(r.text or "")
        assert r.h == want and r.s.kept == [h for h in want if h < 2**46] and r.s.theta == 2**46


def read_back(fingerprint: str) -> set[int]:
    """The hashes that a fingerprint says."""
    theta, kept = fingerprint.split(":")
    found = {int(h, 16) for h in kept.split(",") if h}
    assert all(h < int(theta, 16) for h in found)
    return found


def test_likeness_follows_from_the_fingerprints_alone(spark, sf_dir):
    """For every document, whatever its length, as recomputed from the returned strings."""
    rows = sorted(sketch.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), key=lambda r: r.doc_id)

    def near(a: str, b: str) -> float:
        x, y = read_back(a), read_back(b)
        return len(x & y) / min(len(x), len(y)) if x and y else float(a == b)

    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        assert abs(r.near_edited - near(r.fingerprint, r.edited_fingerprint)) < 1e-9 and abs(r.near_next - near(r.fingerprint, after.fingerprint)) < 1e-9


@pytest.mark.parametrize("run", [2, 50])
def test_rows_of_one_key_are_split_over_runs(spark, run):
    """A third of the rows have no id; the order by id and hash stays, and no run grows with the key."""
    own = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    rows = own.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "text", F.xxhash64("text").alias("tie"))
    led = sketch.with_next(rows, {}, ["text"], run).collect()
    order = [r.text for r in sorted(rows.collect(), key=lambda r: (r.key, r.tie))]
    assert {r.text: r.next_text for r in led} == dict(zip(order, order[1:] + order[:1], strict=True))
    sizes = [r["count"] for r in sketch.in_runs(rows, run).groupBy("in_run").count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 4 * run + 6


def test_likeness_by_length(spark):
    """Halves of texts against the whole: the error falls with the number of hashes held."""
    made = []
    for n in (300, 1000, 4000):
        for i in range(20):
            words = [f"w{i}_{n}_{j}" for j in range(n)]
            made.append((n, " ".join(words[: n // 2] + [f"x{j}" for j in range(n // 2)]), " ".join(words)))
    df = spark.createDataFrame(made, "n int, a string, b string")
    near = df.select("n", "a", "b", sketch.containment(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("near")).collect()
    for n, most in ((300, 0.11), (1000, 0.06), (4000, 0.03)):
        errors = [r.near - contained(r.a, r.b) for r in near if r.n == n]
        assert (sum(e * e for e in errors) / len(errors)) ** 0.5 <= most


def test_sketches_merge(spark):
    words = [str(i) for i in range(9000)]
    df = spark.createDataFrame([(" ".join(words[:6000]), " ".join(words[5996:]), " ".join(words))], "a string, b string, whole string")
    s = df.select(*(sketch.sketch(F.col(c)).alias(c) for c in df.columns))
    r = s.select(sketch.merged(F.col("a"), F.col("b")).alias("m"), "whole", sketch.containment(F.col("a"), F.col("whole")).alias("near")).first()
    assert r.m == r.whole and r.near == 1.0


# registration


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
