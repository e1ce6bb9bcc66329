"""Personal data: base spans against brute force, message passing against enumeration, mentions that no pattern sees."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pointloom.llm import pii
from pyspark.sql import functions as F


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text: str | None) -> list[tuple[str, int, int]]:
    text, spans = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for kind, pattern, fits in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(re.fullmatch("0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])", x) for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        spans += [(kind, *m.span()) for m in re.finditer(pattern, text) if fits(m)]
    return spans


def listed(spans: list) -> str:
    return ",".join(":".join(map(str, s)) for s in spans)


def digest(spans: list) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus(sf_dir) -> list[str]:
    return list(pd.read_parquet(sf_dir.replace("sf0.01", "sf0.1") + "/documents.parquet", columns=["text"])["text"])


@pytest.fixture(scope="module")
def learnt(corpus) -> dict:
    """Weights from every other document."""
    return pii.learn(*pii._joined([pii.lessons(t, pii.base_spans(t)) for t in corpus[::2]]))


ODD = ["0" * 5000 + ".1.1.1", "1.2.3." + "0" * 5000 + "255", "1.2.3." + "0" * 5000 + "256", "1.1.1." + "9" * 5000, "007.010.255.0", "1.2.3.4 " * 40_000, "+1 " * 3000, "4111111111111111 4111111111111111"]


def test_base_spans_of_every_row(spark, no_id_docs, no_docs):
    docs = no_id_docs.select("doc_id", "text").union(spark.createDataFrame([(50_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    rows = pii.digests(pii.spans(docs, pii.train(docs))).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    assert len(rows) == sum(texts.values())
    want = Counter()
    for (d, t), n in texts.items():
        own = brute(t)
        want[(d, *(sum(s[0] == k for s in own) for k in pii.KINDS), digest(own))] += n
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    by_digest = {digest(brute(t)): set(listed(brute(t)).split(",")) - {""} for _, t in texts}
    assert all(by_digest[r.base_sha256] <= set(r.spans.split(",")) for r in rows)
    assert pii.digests(pii.spans(no_docs, pii.train(no_docs))).count() == 0


def test_octets_of_any_length():
    for i in range(1500):
        assert pii.is_octet(str(i)) is pii.is_octet("0" * 5000 + str(i)) is (i <= 255)


def test_long_runs_take_linear_time():
    assert pii.base_spans("1" * 300_000 + " a@" * 50_000) == []
    assert len(pii.base_spans("x " * 150_000 + "a@b.c")) == 1


def test_repeated_rows_are_learnt_once(spark):
    rows = [(1, "mail me at john.17@mail.example.com or 1.2.3.4")]
    once, often = (pii.train(spark.createDataFrame(rows * n, "doc_id long, text string")).value for n in (1, 400))
    assert once["learnt"] == often["learnt"] and np.array_equal(once["unary"], often["unary"])


# the field


def some_field(seed: int, n: int) -> tuple[np.ndarray, dict]:
    own = np.random.default_rng(seed)
    w = {"unary": own.normal(0, 1.5, (pii.BUCKETS, 5)).astype(np.float32), "chain": own.normal(0, 1, (5, 5)), "skip": np.array([1.5, 0.8]), "learnt": 1}
    return own.integers(0, pii.BUCKETS, (n, 3)), w


def enumerated(x: np.ndarray, chain: np.ndarray, skip: np.ndarray, w: dict, held: np.ndarray) -> np.ndarray:
    unary, total = w["unary"][x].sum(1).astype(float), np.zeros((len(x), 5))
    for labels in itertools.product(range(5), repeat=len(x)):
        if any(h and h != y for h, y in zip(held, labels, strict=True)):
            continue
        energy = sum(unary[i, y] for i, y in enumerate(labels) if not held[i])
        energy += sum(w["chain"][labels[a], labels[b]] for a, b in chain) + sum(w["skip"][kind] * (labels[a] == labels[b]) for a, b, kind in skip)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(energy)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize(("chain", "skip", "most"), [([(0, 1), (1, 2)], [(1, 3, 0), (3, 4, 1), (0, 5, 1)], 1e-6), ([(0, 1), (1, 2), (2, 3)], [(0, 3, 1)], 0.12), ([(0, 1), (3, 4)], [(0, 2, 0), (0, 4, 1), (2, 4, 0)], 0.12)])
def test_messages_equal_enumeration(seed, chain, skip, most):
    """Exact without loops, close with small ones; some nodes hold their label."""
    n = 1 + max(max(e[:2]) for e in chain + skip)
    x, w = some_field(seed, n)
    held = np.zeros(n, int)
    held[seed % n] = seed % 5
    chain, skip = np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 3)
    assert np.abs(pii.marginals(x, chain, skip, w, held) - enumerated(x, chain, skip, w, held)).max() <= most


def test_whole_values_far_apart_are_linked():
    text = "call +1 (555) 123-4567 " + "some plain words " * 50 + "or 555 123 4567 and " + "more words " * 40 + "15551234567, not 1234567 or 995551234567"
    found = pii.nodes(text, pii.base_spans(text))
    assert [text[s:e] for s, e, *_ in found] == ["+1 (555) 123-4567", "555 123 4567", "15551234567"]
    chain, skip = pii.edges(text, found)
    assert not chain and skip == [(0, 1, pii.SIMILAR), (0, 2, pii.EQUAL)]
    text = "+1 555 123 4567 and then 5551234567 5551234567"
    found = pii.nodes(text, pii.base_spans(text))
    assert len(found) == 3 and pii.edges(text, found) == ([(1, 2)], [(0, 1, pii.SIMILAR), (0, 2, pii.SIMILAR)])
    text = "to anna.smith@mail.example.com " + "anna.smith(at)mail.example.com ANNA.SMITH_at_other.org anna.smith@2 smith@mail.example.com " * 30
    found = pii.nodes(text, pii.base_spans(text)[:1])
    assert len(found) == 61
    chain, skip = pii.edges(text, found)
    assert {(0, i) for i in range(1, 61)} <= {*chain, *(e[:2] for e in skip)} and len(skip) < 180


PARTS = [
    ("call +1 (132) 555-1352 and then meet in room 132", []), ("call +1 (132) 555-1352 " + "and some words " * 20 + "in the year 132", []), ("pay 4111 1111 1111 1111 and see page 1111", []),
    ("call +1 (132) 555-1352 about invoice 99915551352", []), ("call +1 (132) 555-1352 about part number 5551352", []), ("mail report@mail.example.com and see report@2", []),
    ("call +1 (132) 555-1352 " + "and some words " * 20 + "or 132 555 1352 then", [("phone", "132 555 1352")]),
    ("call +1 (132) 555-1352, room 132 555 or 555 1352", []), ("from 10.20.30.40 to 20.30.40 and 10-20-30-40", [("ip", "10-20-30-40")]), ("pay 4111 1111 1111 1111 or 4111_1111_1111_1111 not 4111_1111_1111", [("card", "4111_1111_1111_1111")]),
]


@pytest.mark.parametrize(("text", "more"), PARTS)
def test_parts_of_values_get_no_span(learnt, text, more):
    base = pii.base_spans(text)
    assert base and [(k, text[s:e]) for k, s, e in pii.find([text], learnt)[0] if (k, s, e) not in base] == more


def test_pieces_decide_as_the_whole_does(learnt):
    text = " ".join(["first 132 555 1352 then"] * 20 + ["+1 (132) 555-1352"] + ["words 1325551352 and 132/5551352 side by side"] * 40 + ["1325551352 1325551352 1325551352"])
    whole = pii.find([text], learnt)[0]
    assert len(whole) == 1 + 20 + 80 + 3
    for most in (1, 2, 7, 50):
        assert pii.find([text], learnt, most)[0] == whole


def test_numeric_texts_take_bounded_memory_and_linear_time(learnt):
    import time
    import tracemalloc

    own = random.Random(4)
    for text in ("+1 (132) 555-1352 " + " ".join(str(own.randrange(10**7, 10**8)) for _ in range(220_000)), "+1 (132) 555-1352 " + "132 555 1352, " * 30_000, "1-2-3-" * 200_000 + " 1.2.3.4"):
        began = time.perf_counter()
        pii.find([text], learnt)
        assert time.perf_counter() - began < 12 * max(0.4, len(text) / 1e6)
        tracemalloc.start()
        pii.find([text[: len(text) // 4]], learnt)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 120e6


def test_the_field_carries_labels_across_a_document(learnt):
    apart = " plain words between them" * 40 + " "
    text = "reach me at +1 (132) 555-1352 today" + apart + "or try 1325551352 then" + apart + "not 7261930485"
    found = pii.find([text], learnt)[0]
    assert [(k, text[s:e]) for k, s, e in found] == [("phone", "+1 (132) 555-1352"), ("phone", "1325551352")]
    assert pii.find([text], learnt | {"skip": np.zeros(2)})[0] == pii.base_spans(text)


def test_cards_side_by_side_stay_apart(learnt):
    card = "4845168114407329"
    text = f"first {card} and " + "some words " * 30 + f"then {card} {card} here"
    found = [x for x in pii.find([text], learnt)[0] if x[0] == "card"]
    assert [text[s:e] for _, s, e in found] == [card] * 3


def disguised(kind: str, value: str, own: random.Random) -> str:
    """A mention of ``value`` that no pattern sees."""
    digits = re.sub(r"\D", "", value)
    if kind == "card":
        return own.choice("./_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone":
        return own.choice([f"{digits[1:4]}-{digits[4:7]}-{digits[7:]}", digits[1:], f"{digits[1:4]}/{digits[4:]}"])
    return value.replace(".", own.choice("-_")) if kind == "ip" else value.replace("@", own.choice(["(at)", "_at_"]))


def other(kind: str, value: str, own: random.Random) -> str:
    """Another value of the same form: any digits, or, as often, the same last ones."""
    if kind == "email":
        return own.choice([f"qu{own.randrange(100)}x@mail{own.randrange(10)}.example.com", value.partition("@")[0].rpartition(".")[2] + "x@" + value.partition("@")[2]])
    same = own.choice([0, 7]) if kind in ("card", "phone") else 0
    changed = [i for i, c in enumerate(value) if c.isdigit()][: -same or None]
    return "".join(str((int(c) + own.randrange(1, 9)) % 10) if i in changed else c for i, c in enumerate(value))


def test_mentions_hidden_from_the_patterns(corpus, learnt):
    """In documents that were not learnt from: a disguised mention of a value is found, one of a stranger is not."""
    own, cases = random.Random(1), []
    for t in corpus[1::2]:
        spans = pii.base_spans(t)
        words = t.split(" ")
        if spans and len(words) >= 60:
            kind, s, e = spans[0]
            said, strange = disguised(kind, t[s:e], own), disguised(kind, other(kind, t[s:e], own), own)
            for x in (said, strange):
                words.insert(own.randrange(len(words)), x)
            text = " ".join(words)
            if (kind, s, e) in spans and text.count(said) == 1 == text.count(strange):
                cases.append((kind, said, text))
    assert len(cases) > 100

    def scores(w: dict) -> tuple[float, float]:
        hit = added = 0
        for (kind, said, text), found in zip(cases, pii.find([c[2] for c in cases], w), strict=True):
            more = [(k, text[s:e]) for k, s, e in found if (k, s, e) not in pii.base_spans(text)]
            hit, added = hit + ((kind, said) in more), added + len(more)
        return hit / len(cases), hit / max(added, 1)

    recall, precision = scores(learnt)
    assert recall >= 0.85 and precision >= 0.95
    assert scores(learnt | {"skip": np.zeros(2)})[0] <= 0.1


def test_added_spans_of_the_corpus_say_a_value_again(corpus, learnt):
    """Each added span has the digits of a base span of its text, all or all but the first, or its address."""
    for t, found in zip(corpus, pii.find(corpus, learnt), strict=True):
        base = pii.base_spans(t)
        for k, s, e in set(found) - set(base):
            values = [t[a:b] for kind, a, b in base if kind == k]
            own = pii.digits_of(t[s:e])
            assert any(pii.digits_of(v).endswith(own) if k != "email" else v.lower().partition("@")[0] in t[s:e].lower() for v in values)


def test_digests_keep_null_ids(no_id_docs):
    rows = pii.digests(pii.spans(no_id_docs, pii.train(no_id_docs)))
    assert rows.where("doc_id is null").count() == no_id_docs.where(F.col("doc_id").isNull()).count() == 2
