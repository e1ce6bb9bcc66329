"""Quality rules as a ledger of bitmasks.

Every rule is evaluated once in one pass over the text; a row of the ledger holds the
measurements and one bit for each rule that fails. A policy is a version with the mask of the
rules it enforces, so applying another version, or measuring what each rule does, reads
the ledger's bits and no text. Ablations group the masked bits first, which leaves at most
2**rules rows to work on however many documents there are.

Defined cases: a null text counts as the empty text and fails ``few_words``; texts are
measured whole; repeated rows are measured alike; an empty table gives empty results;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Fixed values.
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]
_UPPER = re.compile("[A-Z]+")


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, again = set(), set()
        for w in windows:
            (again if w in seen else seen).add(w)
        covered = 0
        for i, w in enumerate(windows):
            if w in again:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        sum(map(len, _UPPER.findall(text))),
    )


@dataclass(frozen=True)
class Rule:
    name: str
    #: True where the rule fails.
    fails: Column
    base: bool = False


def rules() -> list[Rule]:
    """Rule i owns bit i; rules are only ever added at the end, so old ledgers stay readable."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 50, True),
        Rule("repeats", c("n_repeat_words") * 100 > c("n_words") * 50, True),
        Rule("symbols", c("n_symbols") * 10 > c("n_words") * 3),
        Rule("duplicate_lines", c("n_dup_lines") * 100 > (c("n_words") + 1) * 30),
        Rule("long_words", c("word_chars") > c("n_words") * 25),
        Rule("upper_case", c("n_upper") * 2 > c("word_chars")),
    ]


def mask(names: list[str]) -> int:
    own = [r.name for r in rules()]
    return sum(1 << own.index(n) for n in names)


BASE_MASK = 0b11
#: Versions of the policy: the names of the rules that each enforces.
POLICIES = {"v1": ["few_words", "repeats"], "v2": ["few_words", "repeats", "symbols", "duplicate_lines", "long_words", "upper_case"]}


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the MEASURES and ``failed`` (a bit for each failing rule) of every row."""
    short_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*(measure(t.as_py()) for t in b.column(1)), strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in found)], ["doc_id", *MEASURES])

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0)
    for i, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, 1 << i).otherwise(0))
    return measured.withColumn("failed", bits)


def apply_policy(own: DataFrame, version: str = "v2", policies: dict[str, list[str]] | None = None) -> DataFrame:
    """``own`` (a ledger) with base_failed and kept under a version of the policy; the base rules always hold."""
    enforced = mask((policies or POLICIES)[version]) | BASE_MASK
    return own.withColumns({"base_failed": F.col("failed").bitwiseAND(BASE_MASK) != 0, "kept": F.col("failed").bitwiseAND(enforced) == 0})


def ablations(own: DataFrame, version: str = "v2", policies: dict[str, list[str]] | None = None) -> DataFrame:
    """For each rule of a policy: documents it fails, documents that only it fails, documents kept without it."""
    names = (policies or POLICIES)[version]
    enforced = mask(names)
    patterns = own.groupBy(F.col("failed").bitwiseAND(enforced).alias("bits")).agg(F.count("*").alias("docs"))
    each = patterns.select("bits", "docs", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).alias("bit")) for n in names))).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    count = lambda c: F.sum(F.when(c, F.col("docs")).otherwise(0)).alias
    return each.groupBy(F.col("r.rule").alias("rule")).agg(count(hit)("fails"), count(alone)("fails_alone"), count((F.col("bits") == 0) | alone)("kept_without"))
