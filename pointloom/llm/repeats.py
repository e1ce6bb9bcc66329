"""Periodic runs of words by Crochemore's partition refinement.

Positions are in one class of level k if the k words from each on are equal. A class of level
k + 1 is what of a class of level k is followed by one class; so of the pieces that a class falls into all
but the largest are handed on to the next level (the smaller halves), and a position moves at most
log n times. Neighbouring members of a class of level q that are q apart begin a square whose root
is no power itself; squares of one period that begin at consecutive positions are one run. Which
neighbours are k apart is kept in buckets by distance, so no level looks at what did not move.

Only runs of at least ``least`` words and ``times`` periods are asked for. In those each position of the first level has ``times``
equals, and a position that begins a square ``times`` - 1 in its class, so classes of fewer are given up at once; a text
is cut at words of fewer occurrences first, and each part refined by itself.

Defined cases: a null text has no words; texts of any length are taken whole; equal texts with equal
ids have equal runs; null ids are kept (their text is taken as it is); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

LEAST, TIMES = 6, 4
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def parts(words: Sequence, least: int = LEAST, times: int = TIMES, passes: int = 3) -> Iterator[tuple[int, int]]:
    """Start and end of the parts of at least ``least`` words that are left when the text is cut at words of
    fewer than ``times`` occurrences in their part, ``passes`` times."""
    found = [(0, len(words))]
    for _ in range(passes):
        now, found = found, []
        for start, end in now:
            often, at = Counter(words[start:end]), start
            for i in range(start, end + 1):
                if i == end or often[words[i]] < times:
                    if i - at >= least:
                        found.append((at, i))
                    at = i + 1
    yield from found


def squares(words: Sequence, times: int = TIMES) -> Iterator[tuple[int, list[int]]]:
    """Each period q up to a ``times``-th of the words, with the positions that begin a square of root length q which is no power.

    Positions whose class falls below ``times`` - 1 members are left out.
    """
    n, few, none = len(words), max(2, times - 1), -1
    place: dict = {}
    for i, w in enumerate(words):
        place.setdefault(w, []).append(i)
    of, after, before = [none] * n, [none] * n, [none] * n  # class, next and last member of each position
    first: list[int] = []
    last: list[int] = []
    size: list[int] = []
    apart: defaultdict[int, list[int]] = defaultdict(list)  # positions by the distance to their next member, some of them no longer

    def tie(i: int, j: int) -> None:
        after[i], before[j] = j, i
        apart[j - i].append(i)

    gone = [n]  # positions that left all classes at this level; n is the end
    for own in place.values():
        if len(own) < few:
            gone += own
            continue
        c = len(size)
        first.append(own[0])
        last.append(own[-1])
        size.append(len(own))
        for i in own:
            of[i] = c
        for i, j in zip(own, own[1:], strict=False):
            tie(i, j)
    largest = max(range(len(size)), key=size.__getitem__, default=none)
    small = [c for c in range(len(size)) if c != largest]

    def take(i: int) -> int:
        """Takes a position out of its class, which is returned."""
        c, a, b = of[i], before[i], after[i]
        if a == none:
            first[c] = b
        if b == none:
            last[c] = a
        else:
            before[b] = a
        if a != none:
            after[a] = b
            if b != none:
                apart[b - a].append(a)
        of[i] = none
        size[c] -= 1
        return c

    for q in range(1, n // times + 1):
        near = apart.pop(q, None)
        if near:
            yield q, sorted({i for i in near if of[i] != none and after[i] == i + q})
        handed = []
        for c in small:
            own, i = [], first[c]
            while i != none:
                own.append(i)
                i = after[i]
            handed.append(own)
        split: dict[int, list[int]] = {}  # class to the pieces that leave it
        left = []
        for i in gone:
            if i and of[i - 1] != none:
                split.setdefault(take(i - 1), [])
                left.append(i - 1)
        for own in handed:
            new: dict[int, int] = {}
            for i in own:
                j = i - 1
                if j < 0 or of[j] == none:
                    continue
                c = take(j)
                d = new.get(c)
                if d is None:
                    d = new[c] = len(size)
                    first.append(j)
                    last.append(j)
                    size.append(1)
                    split.setdefault(c, []).append(d)
                    before[j] = none
                else:
                    tie(last[d], j)
                    last[d] = j
                    size[d] += 1
                after[j], of[j] = none, d
        small = []
        for c, pieces in split.items():
            pieces = [d for d in (c, *pieces) if size[d]]
            for d in [d for d in pieces if size[d] < few]:
                i = first[d]
                while i != none:
                    left.append(i)
                    of[i], i = none, after[i]
                size[d] = 0
            pieces = [d for d in pieces if size[d]]
            if len(pieces) > 1:
                most = max(pieces, key=size.__getitem__)
                small += [d for d in pieces if d != most]
        gone = left


def runs(words: Sequence, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length, smallest period of all runs of at least ``least`` words and ``times`` periods that cannot be extended, by start, then period."""
    found = []
    for begin, end in parts(words, least, times):
        for q, starts in squares(words[begin:end], times):
            at = next(iter(starts), None)
            for i, j in zip(starts, [*starts[1:], None], strict=False):
                if j != i + 1:
                    length = i - at + 2 * q
                    if length >= max(least, times * q):
                        found.append((begin + at, length, q))
                    at = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def with_period(words: list, doc_id: int | None) -> list:
    """The words of the query: for a tenth of the ids, by their sum, an end of the text repeats its beginning."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (1 + (n - a) // p))[: n - a]


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds behind its first period."""
    keep = bytearray(b"\1") * len(words)
    for start, length, q in found:
        keep[start + q : start + length] = bytes(length - q)
    return [w for w, k in zip(words, keep, strict=True) if k] if found else words


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, periodic: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text of every row; ``periodic`` first changes the words as ``with_period`` does."""
    short_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            sizes, found, texts = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                own = with_period(own, doc_id) if periodic else own
                held = runs(own, least, times)
                sizes.append(len(own))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in held])
                texts.append(b" ".join(collapsed(own, held)))
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length for its period (start, length, period, exponent_milli), and sums of all runs and of the collapsed text."""
    better = lambda a, x: F.when(a.period.isNull() | (x.length * a.period > a.length * x.period), x).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x.start.cast("string"), x.length.cast("string"), x.period.cast("string"))), "\n")
    said = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000L div best.period").alias("exponent_milli"), sha(said).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
