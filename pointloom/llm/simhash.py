"""SimHash near-duplicates: fingerprints, BK-tree search in shards, connected components.

Two fingerprints of 64 bits that differ in at most two bits agree on at least two of
four 16-bit blocks, so each pair of blocks keys a shard (six per fingerprint) and every
link shows inside one of them. A shard's BK-tree is built where its members meet after
the shuffle: trees are co-located with their queries rather than broadcast, as all trees
together grow with the corpus. Shards over ``max_shard`` fingerprints (templates whose
copies fill a Hamming ball) are not searched by tree; their members are joined on the 65
values at distance 0 or 1, which is exact for distance 2 and puts at most 65 distinct
fingerprints in any group.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; equal
rows are one node; null ids count as documents but never name a component unless all its
ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, short_batches

SEED = 42
RADIUS = 2
MAX_SHARD = 512
EDGES_IN_FILE = 50_000
_BLOCK = 65_536


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits over the XXH64 of all ``width``-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    count = max(1, len(words) - width + 1)
    while total < count:
        size = min(_BLOCK, count - total)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(size)), "<u8", size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += size
    return int(np.packbits((ones * 2 > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of every row."""
    short_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(of, "doc_id long, text_hash long, fp long")


def as_hex(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_keys(fp: str):
    """Six longs: the number of a pair of 16-bit blocks with the bits of both."""
    block = [F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*(F.lit(n << 32).cast("long") + block[i] * 65_536 + block[j] for n, (i, j) in enumerate(pairs)))


class BKTree:
    """Values under a root by Hamming distance: a child hangs on the edge of its distance to the parent."""

    def __init__(self) -> None:
        self.root: list | None = None

    def near(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                found.append(value)
            for edge in range(max(d - radius, 0), d + radius + 1):
                if edge in children:
                    todo.append(children[edge])
        return found

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (x ^ node[0]).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child


def shard_links(values: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among a shard's values: each value with its group's smallest."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, mask = BKTree(), (1 << 64) - 1
    for x in sorted(set(values)):
        parent[x] = x
        for y in tree.near(x & mask, RADIUS):
            a, b = top(x), top(y if y < 1 << 63 else y - (1 << 64))
            parent[max(a, b)] = min(a, b)
        tree.add(x & mask)
    return [(x, t) for x in parent if (t := top(x)) != x]


def links(fps: DataFrame, max_shard: int = MAX_SHARD) -> DataFrame:
    """Edges a > b between distinct fingerprints (column fp) that connect all within two bits."""
    keyed = fps.select("fp", F.explode(block_keys("fp")).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("members")).where("members > 1")
    crowded = cut(keyed.join(sizes, "shard"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [e for values in b["values"] for e in shard_links([int(v) for v in values])]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    small = crowded.where(F.col("members") <= max_shard).groupBy("shard").agg(F.collect_list("fp").alias("values"))
    by_tree = small.select("values").mapInPandas(search, "a long, b long")

    hot = crowded.where(F.col("members") > max_shard).select("fp").distinct()
    reach = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)]
    around = hot.select("fp", F.explode(F.array(*reach)).alias("centre"))
    groups = around.groupBy("centre").agg(F.collect_set("fp").alias("ball")).where(F.size("ball") > 1)
    pairs = groups.select(F.explode("ball").alias("a"), F.array_min("ball").alias("b")).where("a != b")
    return by_tree.unionByName(pairs).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge: large-star and small-star rounds until nothing changes.

    Each star groups by node with partial aggregation, which spreads a hub with very many edges, and joins the
    minima back by node, where only adaptive execution splits a hub; every round is checkpointed, in as many
    files as its edges need.
    """
    parts = 1

    def lowest(pairs: DataFrame) -> DataFrame:
        return cut(pairs.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = lowest(both).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = lowest(down)
        across = down.join(least, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return across.union(own).where("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = state(now)
    while before[0]:
        parts = -(-before[0] // EDGES_IN_FILE)
        now = cut(small(cut(large(now).coalesce(parts))).coalesce(parts))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, max_shard: int = MAX_SHARD) -> DataFrame:
    """doc_id, text_hash, fp, component_id (smallest doc_id reachable by links) of every row of ``docs``."""
    fps = cut(fingerprints(docs, width))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = components(links(nodes.select("fp"), max_shard))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = cut(rooted.join(named, "root").select("fp", "component_id", "root"))
    return fps.join(classes, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, width: int = 3, max_shard: int = MAX_SHARD) -> DataFrame:
    """The rows of ``docs``, with its columns, that stay: of each component the one with the smallest
    doc_id (nulls last; then by text hash); of equal rows one."""
    return keep_first(docs, near_duplicates(docs, width, max_shard))


def keep_first(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group; ``named`` has doc_id, text_hash and root of every row."""
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
    kept = cut(first.select(*row_key("k.doc_id", "k.text_hash")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")).select("row", *row_key("id", "hash"))
    same = keyed.join(kept.hint("shuffle_hash"), KEY, "left_semi")
    turn = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(1)))
    return same.withColumn("turn", turn).where("turn = 1").select("row.*")


KEY = ["key_null", "key_id", "key_hash"]


def row_key(doc_id: str, text_hash: str):
    """The columns KEY, none of them null, so that joins and windows on them share one shuffle."""
    return F.col(doc_id).isNull().alias(KEY[0]), F.coalesce(F.col(doc_id), F.lit(0)).alias(KEY[1]), F.col(text_hash).alias(KEY[2])
