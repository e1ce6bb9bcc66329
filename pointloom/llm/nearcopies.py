"""Near copies by SimHash fingerprints, BK-trees in shards, and likeness of shingle sets.

For 64-bit fingerprints of five-word shingles, texts that share 0.8 of their shingles differ in
about ten bits, too many to shard by blocks of bits. So texts meet in shards by the least hashes
of their shingles (``BANDS`` keys of ``ROWS`` hashes each; texts of likeness 0.8 share a
key with probability 0.9998). A shard's BK-tree links the fingerprints within ``REACH`` bits
first; then all pairs that its links leave apart are compared, so the fingerprints decide
nothing. A pair counts if its likeness, by distinct shingles, is at least ``similarity``. In
shards a text of over ``KEPT`` distinct shingles goes by its KEPT smallest hashes; pairs whose
likeness is then estimated within ``DOUBT`` (four standard errors) of the limit are settled by
their whole sets. Only a spanning forest of each shard's links leaves its task.

Texts with the same words, case of A-Z aside, are one class; only classes go on. A shard of
over ``max_shard`` classes is not gathered. Its members are first compared with the shard's
leader, another one for each of its keys. Where that leaves members of one shard in several
components, all their classes are joined by a prefix filter over their whole sets, rarest hashes
first: of two texts of the least likeness, the first hashes of the one are among those of the
other, so no link is lost. Classes of one component are not paired again, and of two that meet at a hash only
those become a pair whose parities allow it: each hash in one set alone turns one of ``PARITY`` bits, so
sets whose parities differ in more bits than alike sets differ in hashes are apart for sure.

Defined cases: null and wordless texts are one class without links; texts under five words are
one shingle; texts of any length are taken whole; an empty table gives an empty result; other columns are kept
and never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches, written
from .simhash import SEED, BKTree, components, keep_first

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS, REACH, KEPT, DOUBT, MAX_SHARD = 16, 4, 18, 1024, 0.05, 512
#: Counters in each of the two rows that tell the prefix filter which hashes are rare: at least, and at most.
COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 23
#: Bits of a parity, in longs.
PARITY = 512
_LONGS = [f"p{i}" for i in range(PARITY // 64)]
_BLOCK = 65_536
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PAIRS = "a binary, b binary, sure boolean"


def outline(text: str | None, width: int = WIDTH) -> tuple[bytes, int, list[int], bytes, bytes | None, bytes]:
    """Class, fingerprint (signed), shard keys (signed), and the distinct shingle hashes of 48 bits, ascending: the first 32 bits
    of the ``KEPT`` smallest and of the further ones, and the last 16 bits of all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    own = xxhash.xxh3_128_digest(b" ".join(words))
    if not words:
        return own, 0, [], b"", None, b""
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    h = np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits((ones * 2 > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0]
    least = np.array([(h * odd).min() for odd in _ODD]).reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least)]
    hashes = np.unique(h >> np.uint64(16))
    first, last = (hashes >> np.uint64(16)).astype("<u4"), (hashes & np.uint64(0xFFFF)).astype("<u2")
    return own, int(fp), keys, first[:KEPT].tobytes(), first[KEPT:].tobytes() if len(hashes) > KEPT else None, last.tobytes()


def short_set(kept: bytes) -> np.ndarray:
    """The different first halves of the kept hashes."""
    return np.unique(np.frombuffer(kept, "<u4"))


def whole_set(first: bytes, last: bytes) -> np.ndarray:
    """All hashes of a text."""
    return np.frombuffer(first, "<u4").astype(np.int64) << 16 | np.frombuffer(last, "<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among all of both."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if common else 0.0


def judged(a: tuple, b: tuple, similarity: float) -> bool | None:
    """Whether two (kept hashes, number of all) are alike; None where only their whole sets can say."""
    (x, n), (y, m) = a, b
    if min(n, m) < similarity * max(n, m):
        return False
    if n <= KEPT and m <= KEPT:
        return likeness(x, y) >= similarity
    both = np.union1d(x, y)[:KEPT]
    near = float((np.isin(both, x, assume_unique=True) & np.isin(both, y, assume_unique=True)).mean())
    return None if abs(near - similarity) < DOUBT else near >= similarity


def forest(members: list[tuple[bytes, int, np.ndarray, int]], similarity: float, reach: int = REACH) -> list[tuple[bytes, bytes, bool]]:
    """Links (a, b, True) of a spanning forest among a shard's (class, fingerprint, hashes, number of all), and the
    pairs (a, b, False) between its trees that only whole sets can judge."""
    parent = list(range(len(members)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    tree, at, out, open_pairs = BKTree(), {}, [], []

    def meet(i: int, j: int) -> None:
        a, b = top(i), top(j)
        if a != b:
            alike = judged(members[i][2:], members[j][2:], similarity)
            if alike:
                parent[a] = b
                out.append((members[i][0], members[j][0], True))
            elif alike is None:
                open_pairs.append((i, j))

    for i, (_, fp, _, _) in enumerate(members):
        fp &= (1 << 64) - 1
        for value in tree.near(fp, reach):
            for j in at[value]:
                meet(i, j)
        tree.add(fp)
        at.setdefault(fp, []).append(i)
    open_pairs.clear()
    if len({top(i) for i in range(len(members))}) > 1:
        # each member's common hashes with all before it at once; kept hashes bound those of whole sets where both are whole
        sizes = np.array([m[3] for m in members])
        starts = np.cumsum([0] + [len(m[2]) for m in members])
        values, flat = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True)
        mark = np.zeros(len(values), bool)
        for i in range(1, len(members)):
            own = flat[starts[i] : starts[i + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[flat[: starts[i]]], starts[:i], dtype=np.int64)
            mark[own] = False
            n, before = sizes[i], sizes[:i]
            whole = (before <= KEPT) & (n <= KEPT)
            for j in np.flatnonzero(np.where(whole, common >= similarity * (n + before - common) - 1e-6, np.minimum(n, before) >= similarity * np.maximum(n, before))):
                meet(i, int(j))
    return out + [(members[i][0], members[j][0], False) for i, j in open_pairs if top(i) != top(j)]


def outlines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, class, fp, keys, n, kept, further, last of every row."""
    short_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, fp, keys, kept, further, last = zip(*(outline(t.as_py(), width) for t in b.column(2)), strict=True) if b.num_rows else ((),) * 6
            n = [len(x) // 2 for x in last]
            columns = [b.column(0), b.column(1), pa.array(own, pa.binary()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(kept, pa.binary()), pa.array(further, pa.binary()), pa.array(last, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "class", "fp", "keys", "n", "kept", "further", "last"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(of, "doc_id long, text_hash long, class binary, fp long, keys array<long>, n int, kept binary, further binary, last binary")


def shards(rows: DataFrame, max_shard: int = MAX_SHARD) -> DataFrame:
    """shard, class, members, leader of the shards of over one class; ``rows`` as of outlines, those of a class are equal.

    Close copies share most of their keys, so of shards that are not large and have the same members, by two
    hashes of 64 bits, one stays: in it all of their pairs meet. Large ones stay, each for its own leader.
    """
    keyed = rows.groupBy("class").agg(F.first("keys").alias("keys")).select("class", F.explode("keys").alias("shard"))
    lead = F.min(F.struct(F.xxhash64("class", "shard").alias("rank"), F.col("class"))).getField("class").alias("leader")
    same = [F.bit_xor(F.xxhash64(F.lit(i), "class")).alias(f"same{i}") for i in range(2)]
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("members"), lead, *same).where("members > 1")
    large = F.when(F.col("members") > max_shard, F.col("shard")).alias("large")
    once = sizes.groupBy("members", "same0", "same1", large).agg(F.min(F.struct("shard", "leader")).alias("one"))
    return cut(keyed.join(once.select("one.shard", "members", "one.leader"), "shard"))


def whole_sets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """class, first and last (all hashes, in two parts) of some classes."""
    own = rows.join(classes, "class", "left_semi").select("class", F.concat("kept", F.coalesce("further", F.lit(b""))).alias("first"), "last")
    return own.groupBy("class").agg(F.first(F.struct("first", "last")).alias("whole")).select("class", "whole.first", "whole.last")


def by_whole_sets(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = [likeness(whole_set(*(v.as_py() for v in own[:2])), whole_set(*(v.as_py() for v in own[2:]))) >= similarity for own in zip(*b.columns[2:], strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    sets = whole_sets(rows, pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
    side = lambda s: sets.select(F.col("class").alias(s), F.col("first").alias(f"first_{s}"), F.col("last").alias(f"last_{s}"))
    beside = pairs.join(side("a"), "a").join(side("b"), "b")
    return beside.select("a", "b", "first_a", "last_a", "first_b", "last_b").mapInArrow(compare, "a binary, b binary")


def links(rows: DataFrame, shared: DataFrame, similarity: float = SIMILARITY, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links (a, b) between classes that connect all alike within small shards, and members of others with their leaders."""
    # of each class one row's sketch, and only for classes that meet another
    each = rows.groupBy("class").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("kept").alias("kept"))
    sketches = written(each.join(shared.select("class").distinct(), "class", "left_semi"), "sketches")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [e for own in b["own"] for e in forest([(bytes(m["class"]), m["fp"], short_set(m["kept"]), m["n"]) for m in sorted(own, key=lambda m: bytes(m["class"]))], similarity)]
            yield pd.DataFrame(found, columns=["a", "b", "sure"], dtype=object)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [[(short_set(k.as_py()), n.as_py()) for k, n in zip(b.column(i), b.column(i + 1), strict=True)] for i in (2, 4)]
            alike = [judged(x, y, similarity) for x, y in zip(*sides, strict=True)]
            own = b.select(["a", "b"]).append_column("sure", pa.array(alike, pa.bool_()).fill_null(False))
            yield own.filter(pa.array([x is not False for x in alike], pa.bool_()))

    small = shared.where(F.col("members") <= max_shard).select("shard", "class").join(sketches, "class")
    by_tree = small.groupBy("shard").agg(F.collect_list(F.struct("class", "fp", "kept", "n")).alias("own")).select("own").mapInPandas(search, PAIRS)
    pairs = shared.where((F.col("members") > max_shard) & (F.col("class") != F.col("leader"))).select("class", "leader").distinct()
    side = lambda c, s: sketches.select(F.col("class").alias(c), F.col("kept").alias(f"kept_{s}"), F.col("n").alias(f"n_{s}"))
    beside = pairs.join(side("class", "a"), "class").join(side("leader", "b"), "leader")
    by_leader = beside.select(F.col("class").alias("a"), F.col("leader").alias("b"), "kept_a", "n_a", "kept_b", "n_b").mapInArrow(compare, PAIRS)
    found = cut(by_tree.unionByName(by_leader).distinct())
    sure, open_pairs = found.where("sure").select("a", "b"), found.where("not sure").select("a", "b")
    return sure if open_pairs.isEmpty() else sure.unionByName(by_whole_sets(open_pairs, rows, similarity))


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY bits, as longs: whether an odd number of the hashes falls on each."""
    at = (hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARITY.bit_length() + 1)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(np.uint8), bitorder="little").view("<i8")


def may_be_alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two structs (class, n, short, parity) can be a pair, the smaller set first."""
    in_order = (a.n < b.n) | ((a.n == b.n) & (a["class"] < b["class"]))
    differ = sum((F.bit_count(a[p].bitwiseXOR(b[p])) for p in _LONGS[1:]), F.bit_count(a[_LONGS[0]].bitwiseXOR(b[_LONGS[0]])))
    return a.short & in_order & (a.n >= similarity * b.n - 1e-6) & (differ <= (1 - similarity) / (1 + similarity) * (a.n + b.n) + 1e-6)


def meeting_pairs(keyed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes of different roots that meet at a hash and may be alike; ``keyed`` has hash, root and the struct own.

    Roots meet first. A root that has one class at a hash takes it along, so that it is held against each
    class of the other root inside the join and only what may be alike leaves it.
    """
    single = F.when(F.count("*") == 1, F.first("own"))
    roots = keyed.groupBy("hash", "root").agg(F.max("own.short").alias("short"), single.alias("one"))
    left = roots.where("short").select("hash", F.col("root").alias("root_a"), F.col("one").alias("one_a"))
    right = roots.select(F.col("hash").alias("hash_b"), F.col("root").alias("root_b"), F.col("one").alias("one_b"))
    one_a, one_b = F.col("one_a"), F.col("one_b")
    open_ends = one_a.isNull() | one_b.isNull()
    met = cut(left.join(right, (F.col("hash") == F.col("hash_b")) & (F.col("root_a") != F.col("root_b")) & (open_ends | may_be_alike(one_a, one_b, similarity))).drop("hash_b"))
    side = lambda s: keyed.select(F.col("hash").alias(f"hash_{s}"), F.col("root").alias(f"of_{s}"), F.col("own").alias(f"own_{s}"))
    at = lambda s: (F.col("hash") == F.col(f"hash_{s}")) & (F.col(f"root_{s}") == F.col(f"of_{s}"))
    pair = lambda a, b: (F.col(f"{a}.class").alias("a"), F.col(f"{b}.class").alias("b"))
    both = met.where(~open_ends).select(*pair("one_a", "one_b"))
    first = met.where(one_a.isNotNull() & one_b.isNull()).join(side("b"), at("b") & may_be_alike(one_a, F.col("own_b"), similarity)).select(*pair("one_a", "own_b"))
    second = met.where(one_a.isNull() & one_b.isNotNull()).join(side("a"), at("a") & may_be_alike(F.col("own_a"), one_b, similarity)).select(*pair("own_a", "one_b"))
    many = met.where(one_a.isNull() & one_b.isNull()).join(side("a").where("own_a.short"), at("a")).join(side("b"), at("b") & may_be_alike(F.col("own_a"), F.col("own_b"), similarity)).select(*pair("own_a", "own_b"))
    return both.union(first).union(second).union(many).distinct()


def _counted(hashes: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each hash in the first and in the second row."""
    h = hashes.astype(np.uint64)
    return tuple(((h * odd >> np.uint64(40)) % np.uint64(counters)).astype(np.int64) + row * counters for row, odd in enumerate(_ODD[:2]))


def links_across(rows: DataFrame, shared: DataFrame, found: DataFrame, similarity: float = SIMILARITY, max_shard: int = MAX_SHARD) -> DataFrame | None:
    """The links (a, b) between classes of large shards that ``found`` (node, root) leaves in several components; None without such shards."""
    hot = shared.where(F.col("members") > max_shard).select("shard", "class")
    if hot.isEmpty():
        return None
    rooted = cut(hot.join(found, hot["class"] == found.node, "left").select("shard", "class", F.coalesce("root", "class").alias("root")))
    apart = rooted.groupBy("shard").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    classes = rooted.join(apart, "shard", "left_semi").select("class", "root").distinct()
    sets = written(whole_sets(rows, classes.select("class")).join(classes, "class"), "sets")
    spark = rows.sparkSession
    total = sets.agg(F.sum(F.octet_length("last") / 2)).first()[0] or 0
    counters = min(MOST_COUNTERS, max(COUNTERS, 1 << (int(total).bit_length())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * counters, np.int32)
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                for at in _counted(whole_set(x.as_py(), y.as_py()), counters):
                    np.add.at(held, at, 1)
        used = np.flatnonzero(held)
        for at in range(0, len(used), _BLOCK):
            part = used[at : at + _BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part].astype(np.int64))], ["counter", "n"])

    counted = sets.select("first", "last").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(2 * counters, np.int32)
    often[counted["counter"].to_numpy(np.int64)] = np.minimum(counted["n"].to_numpy(np.int64), 2**31 - 1)
    held = spark.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a pair, the text with more hashes has one of its ``first`` among the ``short`` of the other
        names = ["hash", "short", "class", "root", "n", *_LONGS]
        for b in batches:
            for own, root, high, low in zip(*b.columns, strict=True):
                h = whole_set(high.as_py(), low.as_py())
                bits = parity(h)
                one, two = _counted(h, counters)
                h = h[np.lexsort((h, np.minimum(held.value[one], held.value[two])))]
                n = len(h)
                first = n - math.ceil(similarity * n - 1e-6) + 1
                short = n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-6) + 1
                h = h[:first]
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.arange(len(h)) < short), pa.array([own.as_py()] * len(h), pa.binary()), pa.array([root.as_py()] * len(h), pa.binary()), pa.array([n] * len(h), pa.int32()), *(pa.array(np.full(len(h), x)) for x in bits)], names)

    made = sets.select("class", "root", "first", "last").mapInArrow(prefixes, "hash long, short boolean, class binary, root binary, n int, " + ", ".join(f"{p} long" for p in _LONGS))
    keyed = written(made.select("hash", "root", F.struct("class", "n", "short", *_LONGS).alias("own")), "prefixes")
    # components that meet at a hash, and only then their classes: a component's own classes are never paired
    pairs = cut(meeting_pairs(keyed, similarity))
    return by_whole_sets(pairs, rows, similarity)


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, max_shard: int = MAX_SHARD) -> DataFrame:
    """doc_id, text_hash, class, root (one for all classes that links connect) of every row of ``docs``."""
    rows = written(outlines(docs, width), "outlines")
    shared = shards(rows, max_shard)
    found = components(links(rows, shared, similarity, max_shard))
    across = links_across(rows, shared, found, similarity, max_shard)
    if across is not None:
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across))
    return rows.join(found, rows["class"] == found.node, "left").select("doc_id", "text_hash", "class", F.coalesce("root", "class").alias("root"))


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, max_shard: int = MAX_SHARD) -> DataFrame:
    """The rows of ``docs``, with its columns, that stay: of each group of near copies the one with the
    smallest doc_id (nulls last; then by text hash); of equal rows one."""
    return keep_first(docs, near_copies(docs, width, similarity, max_shard))
