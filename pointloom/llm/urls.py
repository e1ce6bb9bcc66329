"""URL filter: host and path rules first, then boosted trees on lexical features.

Rules are ``host/path`` prefixes for a host and its subdomains; the longest that fits
wins. Other URLs are judged by gradient-boosted trees (Spark ML) over length, depth,
digit ratio, entropy, parameter counts and statistics of the host's suffixes, trained
from labelled URLs. One half of the labelled URLs, by hash, gives the suffix statistics,
a sample of at most ``max_train`` of the other half the trees, so that no URL's own label
is among its features.

A suffix has a rate of its own from ``LEAST`` labelled URLs on, however many URLs there are;
rarer ones take the overall rate. The statistics are broadcast if they have at most
``MAX_SUFFIXES`` rows. Beyond, the suffixes that hold at least one in ``MAX_SUFFIXES`` of the labelled
URLs, so at most that many of a level, are broadcast, and only the URLs of other suffixes
are joined with the rest by shuffle.

Defined cases: a null URL, or one without ``://``, has empty host and path and no rule,
and is judged by the trees like any other; equal URLs get equal verdicts; an empty table
gives an empty result; with labels of fewer than two kinds every such URL is allowed.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, spread

#: The rules of the query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Words that mark a seed URL's host as one to block.
SEED_WORDS = ["casino", "bets", "pills", "ads-"]
MAX_TRAIN = 8_000
MAX_SUFFIXES, LEAST = 10_000, 3
LEVELS = 3
FEATURES = ["url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "fragment", *(f"suffix_{k}" for k in range(1, LEVELS + 1))]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict), else null.

    Rules are looked up by each of the host's suffixes, so the cost of a URL follows its
    labels and not the number of rules.
    """
    by_host: dict[str, list[Column]] = {}
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        by_host.setdefault(name, []).append(F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit("/" + rest).alias("start")))
    found = F.create_map(*(x for name, own in by_host.items() for x in (F.lit(name), F.array(*own))))
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fitting = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(found, s)), lambda r: r.isNotNull()))
    return F.array_max(F.filter(fitting, lambda r: path.startswith(r.start)))


def entropy(text: Column) -> Column:
    """Bits per character of the characters' distribution."""
    n = F.length(text).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise((n - F.length(F.replace(text, c, F.lit("")))) / n))
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)), F.lit(0.0))


def suffix_of(host: Column, level: int) -> Column:
    return F.substring_index(host, ".", -level)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (key, url) with host, path and the features that need no statistics."""
    u = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(u, r"(?s)\A[^?#]*\?([^#]*)", 1)
    base = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return base.withColumns({
        "url_len": F.length(u), "host_len": F.length("host"), "path_len": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")), "labels": F.size(F.split("host", r"\.")),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1)), "entropy": entropy(u),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "hyphens": F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit(""))),
        "fragment": F.instr(u, "#") > 0,
    })


def with_suffixes(urls: DataFrame, statistics: DataFrame, prior: float, max_suffixes: int = MAX_SUFFIXES) -> DataFrame:
    """``urls`` (lexical) with the rate of each of the host's suffixes, and all features as a vector; ``statistics`` has level, suffix, rate, share."""
    few = statistics.count() <= max_suffixes
    for k in range(1, LEVELS + 1):
        own = statistics.where(F.col("level") == k)
        side = lambda rows, name: rows.select(F.col("suffix").alias(f"{name}_{k}"), F.col("rate").alias(f"{name}_rate"))  # noqa: B023, E731
        often = side(own if few else own.where(F.col("share") * max_suffixes >= 1), "often")
        suffix = suffix_of(F.col("host"), k)
        urls = urls.join(F.broadcast(often), suffix == F.col(f"often_{k}"), "left")
        if few:
            rate = F.col("often_rate")
        else:
            # an URL with a common suffix meets no rare one, and is spread by its own hash
            rare = side(own.where(F.col("share") * max_suffixes < 1), "rare")
            urls = urls.withColumn(f"meets_{k}", F.when(F.col("often_rate").isNull(), suffix).otherwise(F.concat(F.lit("/"), F.hex(F.xxhash64("url")))))
            urls = urls.join(rare, F.col(f"meets_{k}") == F.col(f"rare_{k}"), "left")
            rate = F.coalesce("often_rate", "rare_rate")
        urls = urls.withColumn(f"suffix_{k}", F.coalesce(rate, F.lit(prior))).drop("often_rate", "rare_rate")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(urls)


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, max_suffixes: int = MAX_SUFFIXES, trees: int = 10, depth: int = 3):
    """(model or None, suffix statistics, prior) from labelled (url, label 0/1); nulls are left out."""
    rows = labelled.select("url", F.col("label").cast("double").alias("label"), spread(F.col("url"), "half", 2).alias("half")).where("url is not null and label in (0, 1)")
    n, ones, fit = rows.agg(F.count("*"), F.sum("label"), F.sum(F.col("half").cast("long"))).first()
    prior = (ones or 0.0) / max(n, 1)
    levels = F.array(*(F.struct(F.lit(k).alias("level"), suffix_of(host_of(F.col("url")), k).alias("suffix")) for k in range(1, LEVELS + 1)))
    counts = rows.where("half = 0").select(F.explode(levels).alias("s"), "label").groupBy("s.level", "s.suffix").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    share = F.col("n") / max(n - (fit or 0), 1)
    statistics = cut(counts.where(F.col("n") >= LEAST).select("level", "suffix", ((F.col("ones") + 4 * prior) / (F.col("n") + 4)).alias("rate"), share.alias("share")))
    if not n or prior in (0.0, 1.0) or not fit:
        return None, statistics, prior
    sample = rows.where("half = 1").where(spread(F.col("url"), "sample") < int(1_000_000 * min(1.0, max_train / fit)))
    prepared = cut(with_suffixes(lexical(sample), statistics, prior, max_suffixes).select("features", "label").coalesce(4))
    kinds = prepared.select("label").distinct().count()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=7, stepSize=0.3).fit(prepared) if kinds == 2 else None
    return model, statistics, prior


def judge(urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], key: str, max_train: int = MAX_TRAIN, max_suffixes: int = MAX_SUFFIXES) -> DataFrame:
    """key, host, path, rule, verdict, score (chance to be blocked by the trees) of every row of ``urls`` (key, url)."""
    model, statistics, prior = train(labelled, max_train, max_suffixes)
    ready = with_suffixes(lexical(urls.select(F.col(key).alias("page_key"), "url")), statistics, prior, max_suffixes)
    if model is None:
        scored = ready.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    r = scored.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return r.select(F.col("page_key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_trees).alias("verdict"), "score")


def seed_labels(urls: DataFrame) -> DataFrame:
    """Labelled URLs (url, label) from the seed words: 1 where the host has one of them."""
    host = host_of(F.col("url"))
    hit = F.lit(False)
    for word in SEED_WORDS:
        hit = hit | host.contains(word)
    return urls.where("url is not null").select("url", hit.cast("int").alias("label"))
