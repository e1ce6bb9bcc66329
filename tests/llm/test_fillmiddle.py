"""Fill-in-the-middle against brute force, and the lists of its index."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pointloom.llm import fillmiddle
from pyspark.sql import functions as F

from .conftest import rows

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    units, x = UNIT.findall(text), sha(f"1:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, z = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    head, middle, tail = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form, output = ("spm", f"<S>{tail}<P>{head}<M>{middle}") if h4 % 100 < 20 else ("psm", f"<P>{head}<S>{tail}<M>{middle}")
    return doc_id, len(units), form, len(head), len(middle), sha(output), sha(text)


ODD = ["<P>", "a<S>b", "x<M>", "<p>small</p>", "<<P", "<", "<S<P<M", "P>S>M>", "\U0001f642é" * 30, "9" * 3000, "ab" * 40_000, "éaébé", "\n\n", "a" * 10 + "<" * 40]


def test_documents_against_brute_force(spark, docs):
    own = [(i, t) for i, t in enumerate(ODD * 4)] + [(None, "no id"), (None, None)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(own, "doc_id long, text string"))
    expected = Counter(brute(r[0], r[1]) for r in [*rows(), *own])
    assert Counter(map(tuple, fillmiddle.digests(fillmiddle.transform(every)).collect())) == expected
    assert {row[2] for row in expected} == {"plain", "psm", "spm"}


def test_one_list_for_each_distinct_text(docs):
    made = fillmiddle.index(docs).collect()
    texts = {r[1] or "" for r in rows()}
    assert Counter(r.text for r in made) == Counter(texts)
    for r in made:
        ends = np.cumsum([0, *map(len, UNIT.findall(r.text))]).tolist()
        assert r.n == len(ends) - 1
        for k in {0, r.n, *random.Random(1).sample(range(r.n + 1), min(20, r.n + 1))}:
            assert fillmiddle.select(k, r.width, bytes(r.low), bytes(r.high)) == ends[k]


def test_lists_are_small_and_read_back():
    own = random.Random(6)
    for n, most in [(1, 0), (1, 9), (50, 50), (1000, 10**6), (3000, 9000)]:
        numbers = np.array(sorted(own.sample(range(most + 1), n)))
        width, low, high = fillmiddle.packed(numbers)
        assert [fillmiddle.select(k, width, low, high) for k in range(n)] == numbers.tolist()
        assert 8 * (len(low) + len(high)) <= n * (3 + np.log2(max(1, most / n)) + 1) + 24


def test_a_hot_text_is_dealt_over_places(spark):
    text = "one text in very many rows " * 20
    every = spark.range(6000).repartition(8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, text).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    held = fillmiddle.gathered(every).where(F.col("text") == text)
    assert held.select("place").distinct().count() > 1 and held.agg(F.sum(F.size("docs"))).first()[0] == 2000
    found = {r.doc_id: tuple(r) for r in fillmiddle.digests(fillmiddle.transform(every)).where("doc_id % 300 = 0").collect()}
    assert len(found) == 20 and all(row == brute(i, text) for i, row in found.items())


def test_equal_sums_are_no_equal_texts():
    lists = fillmiddle.Lists()
    assert lists.of(b"k", "a b")[0] and lists.of(b"k", "other")[0] and not lists.of(b"k", "a b")[0]


def test_empty_table(no_docs):
    assert fillmiddle.digests(fillmiddle.transform(no_docs)).count() == 0 and fillmiddle.index(no_docs).count() == 0
