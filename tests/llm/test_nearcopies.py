"""Near copies against all pairs of whole shingle sets."""

from __future__ import annotations

import random
import re

import pytest
from pointloom.llm import nearcopies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(texts: dict) -> set:
    own = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in own}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(own)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = own[a], own[b]
            if (x == y) if not x or not y else len(x & y) >= 0.8 * len(x | y):
                root[top(b)] = top(a)
    out: dict = {}
    for k in keys:
        out.setdefault(top(k), set()).add(k)
    return set(map(frozenset, out.values()))


def edited(text: str, times: int, own: random.Random) -> str:
    words = text.split(" ")
    for _ in range(times):
        words[own.randrange(len(words))] = f"new{own.randrange(10**6)}"
    return " ".join(words)


def family(seed: int, copies: int, words: int, edits: int) -> list[str]:
    own = random.Random(seed)
    base = " ".join(f"w{own.randrange(5000)}" for _ in range(words))
    return [base] + [edited(base, own.randrange(edits + 1), own) for _ in range(copies)]


@pytest.mark.parametrize("max_shard", [4, 512])
def test_groups_equal_all_pairs(spark, max_shard):
    texts = [t for s in range(30) for t in family(s, 4, 60 + 20 * (s % 8), 5)] + family(99, 60, 150, 2) + [None, "", " \n", "one two", "ONE  two", "one two three"]
    texts = dict(enumerate(texts))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = nearcopies.near_copies(df, max_shard=max_shard).collect()
    assert len(rows) == len(texts)
    got: dict = {}
    for r in rows:
        got.setdefault(bytes(r.root), set()).add(r.doc_id)
    assert set(map(frozenset, got.values())) == groups(texts)


def test_long_texts_are_estimated(spark):
    own = random.Random(4)
    base = " ".join(f"w{own.randrange(10**6)}" for _ in range(9000))
    texts = {1: base, 2: edited(base, 200, own), 3: edited(base, 700, own), 4: base + " " + base.replace("w", "v")}
    assert groups(texts) == {frozenset({1, 2}), frozenset({3}), frozenset({4})}
    kept = nearcopies.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_one_stays_with_all_columns(no_id_docs, no_docs):
    kept = nearcopies.keep_one(no_id_docs)
    assert kept.schema == no_id_docs.schema
    rows = no_id_docs.dropDuplicates(["doc_id", "text"]).where("doc_id is not null").collect()
    want = {min(g) for g in groups({r.doc_id: r.text for r in rows})}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want
    assert nearcopies.keep_one(no_docs).count() == 0 == nearcopies.near_copies(no_docs).count()


def grouped(spark, texts: dict, **how) -> set:
    got: dict = {}
    for r in nearcopies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **how).collect():
        got.setdefault(bytes(r.root), set()).add(r.doc_id)
    return set(map(frozenset, got.values()))


def test_copies_far_from_the_leader_are_found(spark):
    """A family of likeness 0.74 whose members have copies of their own, all keys of a pair in large shards or none."""
    own = random.Random(5)
    made = lambda n: [f"w{own.randrange(10**6)}" for _ in range(n)]
    common, texts = made(170), []
    for _ in range(60):
        tail = made(30)
        for _ in range(2):
            texts.append(" ".join(common + tail[:16] + made(14)))
    texts = dict(enumerate(texts))
    want = groups(texts)
    assert sum(len(g) > 1 for g in want) >= 30
    assert grouped(spark, texts, max_shard=8) == want


def test_parities_never_part_alike_sets():
    """Bits that differ are at most the hashes that differ."""
    import numpy as np

    own = np.random.default_rng(3)
    for n in (1, 20, 150, 3000):
        for moved in (0, 1, n // 10, n):
            a = np.unique(own.integers(0, 1 << 48, n, dtype=np.int64))
            b = np.unique(np.concatenate([a[moved:], own.integers(0, 1 << 48, moved, dtype=np.int64)]))
            differ = sum(int(x).bit_count() for x in (nearcopies.parity(a) ^ nearcopies.parity(b)).view(np.uint64))
            assert differ <= len(np.setxor1d(a, b)) and (moved or not differ)


def test_a_template_with_very_many_copies(spark):
    """2,000 copies of one text with up to six edits, in shards far over the limit: the groups are those of all pairs."""
    import numpy as np

    own = random.Random(11)
    base = " ".join(f"w{own.randrange(10**6)}" for _ in range(140))
    texts = {i: edited(base, own.randrange(7), own) for i in range(2000)}
    sets = [shingles(t) for t in texts.values()]
    ids = {g: k for k, g in enumerate(set().union(*sets))}
    held = np.zeros((len(sets), len(ids)), np.float32)
    for i, x in enumerate(sets):
        held[i, [ids[g] for g in x]] = 1
    common, sizes = held @ held.T, held.sum(1)
    alike = common >= 0.8 * (sizes[:, None] + sizes[None] - common) - 1e-3
    left, want = set(texts), set()
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            more = set(map(int, np.flatnonzero(alike[i]))) & left
            left -= more
            todo += more
        want.add(frozenset(group))
    assert len(want) > 100
    assert grouped(spark, texts) == want


def test_repeated_passages_do_not_part_copies(spark):
    texts = {}
    for s in range(12):
        own = random.Random(s)
        base, passage = ([f"w{own.randrange(10**6)}" for _ in range(n)] for n in (150, 30))
        texts |= {2 * s: " ".join(base + passage), 2 * s + 1: " ".join(base + passage * 10)}
    assert grouped(spark, texts) == groups(texts) == {frozenset({2 * s, 2 * s + 1}) for s in range(12)}


@pytest.mark.parametrize("max_shard", [1, 512])
def test_whole_sets_decide_about_long_texts(spark, max_shard):
    """Likeness just above and below the limit, where an estimate goes either way."""
    texts = {}
    for s in range(12):
        own = random.Random(100 + s)
        made = lambda n: [f"w{own.randrange(10**9)}" for _ in range(n)]
        base, n = made(2000), 220 + s % 2 * 8
        texts |= {2 * s: " ".join(base), 2 * s + 1: " ".join(base[:-n] + made(n))}
    want = groups(texts)
    assert {len(g) for g in want} == {1, 2}
    assert grouped(spark, texts, max_shard=max_shard) == want


def test_small_shards_with_equal_members_are_one(spark):
    keys = {b"a": [1, 2, 3, 4], b"b": [1, 2, 3, 5], b"c": [3, 6, 7, 8], b"d": [6, 7], b"e": [6, 7]}
    rows = spark.createDataFrame([(c, k) for c, k in keys.items()] * 2, "class binary, keys array<long>")
    for max_shard, want in ((2, [{"a", "b"}, {"a", "b", "c"}, {"c", "d", "e"}, {"c", "d", "e"}]), (3, [{"a", "b"}, {"a", "b", "c"}, {"c", "d", "e"}])):
        held: dict = {}
        for r in nearcopies.shards(rows, max_shard).collect():
            held.setdefault(r.shard, set()).add(bytes(r["class"]).decode())
            assert r.leader is not None
        assert sorted(map(sorted, held.values())) == [sorted(s) for s in want]
