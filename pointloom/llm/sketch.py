"""Document fingerprints: threshold-scaled sketches of shingle hashes, DataFrame operations only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, whatever
the text's length, so sketches of any two texts are comparable and the sketch of a union is
the union of the sketches. It grows with its text: a text of n shingles keeps about ``FRACTION`` * n.

Hashes are spread over [0, 2**48); a text's sketch is written as its threshold and its hashes in
hexadecimal, so equal texts have equal fingerprints and the sketch can be read back.

Likeness is the containment in the smaller text by what the two sketches hold, whatever the texts' length. Where a
sketch holds no hash, as that of a text without words or, by chance, of a few shingles, ``containment`` is null, and
likeness in ``fingerprints`` is 1 if the fingerprints are equal, else 0.

Defined cases: a null text counts as the empty text; texts of under five words are one
shingle, texts without words have an empty sketch; texts of any length are taken whole; ties of doc_id are ordered by the
text's hash; null ids come first; after the last document the first follows, so a single row
follows itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP

WIDTH, FRACTION = 5, 1 / 4
_BITS = 48
#: Documents in a run of neighbours, about, and runs at most.
RUN, MAX_RUNS = 2_000, 65_536


def hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct hashes, ascending, of all ``width``-word shingles."""
    words = F.transform(F.filter(F.split(text, GAP), lambda w: w != ""), lambda w: F.xxhash64(w))
    count = F.size(words)

    def of(own: Column) -> Column:
        n = F.greatest(F.size(own) - width + 1, F.lit(1))
        shingle = lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(own, i + k) for k in range(width))), 64 - _BITS)
        return F.transform(F.sequence(F.lit(0), n - 1), shingle)

    made = F.element_at(F.transform(F.array(words), of), 1)
    return F.when(F.coalesce(count, F.lit(0)) > 0, F.array_sort(F.array_distinct(made))).otherwise(F.array().cast("array<bigint>"))


def under(own: Column, fraction: float = FRACTION) -> Column:
    """struct(theta, kept) from all distinct hashes: kept are those under theta."""
    limit = int(fraction * 2**_BITS)
    return F.struct(F.lit(limit).cast("long").alias("theta"), F.filter(own, lambda h: h < limit).alias("kept"))


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    return under(hashes(text), fraction)


def written_out(s: Column) -> Column:
    return F.lower(F.concat(F.hex(s.theta), F.lit(":"), F.array_join(F.transform(s.kept, lambda h: F.hex(h)), ",")))


def shared(a: Column, b: Column) -> Column:
    """Share of the smaller set of hashes that the other has; null if one is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def _both(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The lesser theta, and the hashes of each under it."""
    least = F.least(a.theta, b.theta)
    return least, *(F.filter(side.kept, lambda h: h < least) for side in (a, b))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller text's shingles that the other has, by what both sketches hold; null if that is nothing."""
    return shared(*_both(a, b)[1:])


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts together; sketches of unequal fractions meet at the smaller."""
    least, x, y = _both(a, b)
    return F.struct(least.alias("theta"), F.array_sort(F.array_union(x, y)).alias("kept"))


def likeness(a: Column, b: Column) -> Column:
    """Containment by sketches of one fraction; with an empty one, whether both are."""
    empty = F.when((F.size(a.kept) == 0) & (F.size(b.kept) == 0), 1.0).otherwise(0.0)
    return F.coalesce(shared(a.kept, b.kept), empty)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, sketch of every row."""
    return docs.select("doc_id", sketch(F.coalesce("text", F.lit(""))).alias("sketch"))


def _literal(values: list, kind: str) -> Column:
    """A constant of very many values, as one expression."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _rank(cuts: list[int], key: Column, same: bool) -> Column:
    """How many of the ascending cuts are under ``key`` (``same``: or equal), looked up by blocks."""
    width = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda own: F.size(F.filter(own, lambda c: c <= key if same else c < key))
    block = below(_literal([b[-1] for b in blocks], "array<bigint>"))
    inside = F.get(_literal(blocks, "array<array<bigint>>"), block)
    return block * width + F.when(block < len(blocks), below(inside)).otherwise(len(cuts) - block * width)


def in_runs(rows: DataFrame, run: int = RUN) -> DataFrame:
    """``rows`` (key, tie) with ``in_run``, the number of a run of about ``run`` neighbours by key, then tie.

    Runs end at quantiles of the key. A key that holds several quantiles is split by tie, a
    hash, into as many parts and one more.
    """
    n = rows.count()
    runs = min(MAX_RUNS, -(-n // run))
    if runs < 2:
        return rows.withColumn("in_run", F.lit(0))
    at = _literal([i / runs for i in range(1, runs)], "array<double>")
    cuts = rows.agg(F.percentile_approx("key", at, max(10_000, 10 * runs))).first()[0]
    less = _rank(cuts, F.col("key"), False)
    if len(set(cuts)) == len(cuts):
        return rows.withColumn("in_run", less)
    held = _rank(cuts, F.col("key"), True) - F.col("less")
    part = F.when(F.col("held") > 1, F.least(F.col("held"), F.floor((F.col("tie") / 2.0**64 + 0.5) * (F.col("held") + 1)).cast("int"))).otherwise(0)
    return rows.withColumn("less", less).withColumn("held", held).withColumn("in_run", F.col("less") + part).drop("less", "held")


def with_next(rows: DataFrame, made: dict[str, Column], carried: list[str], run: int = RUN) -> DataFrame:
    """``rows`` (key, tie and others) with the columns ``made``, and ``next_<c>`` of each carried column: its value in the next row by key, then tie.

    The first row of a run is also sent to the end of the run before it (the very first to the end of
    the last), so each run is finished by itself: one shuffle of the rows as they are, after which
    ``made`` is computed once for each.
    """
    placed = in_runs(rows, run)
    firsts = placed.groupBy("in_run").agg(F.min(F.struct("key", "tie")).alias("first"))
    around = Window.orderBy("in_run")
    ends = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select(F.col("in_run").alias("run_at"), "first", F.coalesce(F.lag("in_run").over(around), F.last("in_run").over(ends)).alias("run_before"))
    joined = placed.join(F.broadcast(before), F.col("in_run") == F.col("run_at"))
    here = F.struct(F.col("in_run").alias("run"), F.lit(0).alias("guest"))
    there = F.struct(F.col("run_before").alias("run"), F.lit(1).alias("guest"))
    opens = (F.col("key") == F.col("first.key")) & (F.col("tie") == F.col("first.tie"))
    copies = joined.select(*rows.columns, F.explode(F.when(opens, F.array(here, there)).otherwise(F.array(here))).alias("at"))
    dealt = copies.select(*rows.columns, F.col("at.run").alias("run"), F.col("at.guest").alias("guest")).repartition("run").withColumns(made)
    order = Window.partitionBy("run").orderBy("guest", "key", "tie")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("guest = 0").drop("run", "guest")


def fingerprints(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), text.alias("text"), F.xxhash64(text).alias("tie"))
    led = with_next(rows, {"sketch": sketch(F.col("text"))}, ["text", "sketch"], run)
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter))
    e = led.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return e.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written_out(F.col("sketch")).alias("fingerprint"), written_out(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
