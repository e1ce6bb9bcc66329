"""Benchmark decontamination: an FM-index of each shard of documents is searched for all phrases of a benchmark.

A phrase is ``WINDOW`` consecutive words of an item, or all words of an item of fewer. A shard is an
Arrow batch of documents. Its index holds, as numbers, the stretches of words that phrases have, if they
are as long as the shortest phrase (nothing else can hold one), each different stretch once. All phrases are
searched backwards at once through the ranks of the index's wavelet tree, occurrences are located by sampled
suffix positions, and their spans are merged. Documents are not shuffled, so no key can be hot.

The benchmark is the stated query set. It is taken in blocks of items of at most ``BLOCK`` words
(an item of more is its own block), each broadcast for a pass over the documents; between passes
what was found is written to the shared folder.

Defined cases: a null text has no words; an item without words has no phrases; items of equal id are
one item; a null item_id is listed as ``null``; texts and items of any length are taken whole; repeated
documents each have their row; null ids are kept; an empty table on either side gives rows without hits, or no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, written
from .fmindex import FMIndex

WINDOW, BLOCK = 10, 4_000_000
#: Occurrences located at a time.
LOCATED = 1 << 18
#: Bytes of words: digits, small letters and all beyond ASCII stay, capital letters become small, others end a word.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOUND = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Numbers(dict):
    """Numbers of words, from 1; others are 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Phrases:
    """The different phrases of some items, by length, and the items of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.numbers, held = Numbers(), {}
        for name, words in items:
            if words:
                own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
                size = min(window, len(own))
                for i in range(len(own) - size + 1):
                    held.setdefault(size, {}).setdefault(tuple(own[i : i + size]), set()).add(name)
        self.by_size = [(size, np.array(list(own), np.int32), [sorted(x) for x in own.values()]) for size, own in sorted(held.items())]
        self.shortest = self.by_size[0][0] if held else 0


def stretches(own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches without 0 of at least ``least`` numbers."""
    edges = np.flatnonzero(np.diff(np.r_[False, own > 0, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def occurrences(texts: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Merged spans (first word, one past the last) and items in each numbered text of a shard, by one index."""
    known: dict[bytes, int] = {}
    parts, uses, at = [], [], 1  # the index's text, and which stretch of it each text has where
    begins: list[int] = []
    for k, own in enumerate(texts):
        for start, end in zip(*stretches(own, phrases.shortest), strict=True):
            part = own[start:end]
            key = part.tobytes()
            if key not in known:
                known[key] = len(begins)
                begins.append(at)
                parts.append(part)
                at += len(part) + 1
            uses.append((k, int(start), known[key]))
    out: list[tuple[list, set]] = [([], set()) for _ in texts]
    if not parts:
        return [([], []) for _ in texts]
    text = np.zeros(at, np.int32)
    for begin, part in zip(begins, parts, strict=True):
        text[begin : begin + len(part)] = part
    index = FMIndex(text)
    hits: dict[int, list[tuple[int, int]]] = {}
    named: dict[int, set[str]] = {}
    opens = np.array(begins)
    for size, own, items in phrases.by_size:
        low, high = index.search(own)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        before = np.r_[0, np.cumsum(counts)]
        for a in range(0, int(before[-1]), LOCATED):
            nth = np.arange(a, min(a + LOCATED, int(before[-1])))
            which = np.searchsorted(before, nth, "right") - 1
            places = index.locate(low[found[which]] + nth - before[which])
            part = np.searchsorted(opens, places, "right") - 1
            turn = np.lexsort((places, part))
            part, places, which = part[turn], places[turn] - opens[part[turn]], which[turn]
            # overlapping and touching occurrences of one stretch are one span
            new = np.r_[True, (part[1:] != part[:-1]) | (places[1:] > places[:-1] + size)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(part)] - 1
            for p, s, e in zip(part[first].tolist(), places[first].tolist(), (places[last] + size).tolist(), strict=True):
                hits.setdefault(p, []).append((s, e))
            pairs = np.unique(part * len(found) + which)
            for p, w in zip((pairs // len(found)).tolist(), (pairs % len(found)).tolist(), strict=True):
                named.setdefault(p, set()).update(items[found[w]])
    for k, start, p in uses:
        if p in hits:
            out[k][0].extend((start + s, start + e) for s, e in hits[p])
            out[k][1].update(named[p])
    return [(merged(spans), sorted(items)) for spans, items in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK) -> Iterator[Broadcast]:
    """The phrases of ``benchmark`` (item_id, text), block after block, broadcast."""
    context, own, held = benchmark.sparkSession.sparkContext, [], 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator():
        words = words_of(text)
        if own and held + len(words) > most:
            yield context.broadcast(Phrases(own, window))
            own, held = [], 0
        own.append((item, words))
        held += len(words)
    if own:
        yield context.broadcast(Phrases(own, window))


def _searched(docs: DataFrame, block: Broadcast | None) -> DataFrame:
    """``docs`` (text, doc_id, n_words, spans, items) with what the phrases of a block add."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.value if block else Phrases([])
        number = phrases.numbers.__getitem__
        for b in batches:
            texts, sizes = [], []
            for t in b.column(0):
                words = words_of(t.as_py())
                sizes.append(len(words))
                texts.append(np.fromiter(map(number, words), np.int32, len(words)) if phrases.shortest else np.zeros(0, np.int32))
            found = occurrences(texts, phrases)
            spans = [merged([(s["start"], s["end"]) for s in old or ()] + new) for old, (new, _) in zip(b.column(3).to_pylist(), found, strict=True)]
            items = [sorted({*(old or ()), *new}) for old, (_, new) in zip(b.column(4).to_pylist(), found, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            rows = [[{"start": s, "end": e} for s, e in own] for own in spans]
            columns = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(rows, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["text", "doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(search, "text string, " + FOUND)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans (words that occurrences cover: first, one past the last) and items of every row of ``docs``."""
    short_batches(docs.sparkSession)
    spans, items = (F.lit(None).cast(f"array<{kind}>").alias(name) for name, kind in (("spans", "struct<start:int,end:int>"), ("items", "string")))
    own, held = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), spans, items), None
    for following in blocks(benchmark, window, block):
        if held is not None:
            own = written(_searched(own, held), "phrases")
        held = following
    return _searched(own, held).drop("text")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
