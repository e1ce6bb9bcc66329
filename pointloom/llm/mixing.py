"""Mixing sources to target weights with DataFrame operations only.

Sizes are counted in words and added up per source, the targets fill up by weight to at
most ``most`` times a source's size, and a document is emitted floor(rate) times plus
once more by a hash-seeded draw whose probability is the rate's fraction.

The draws of a source are systematic: its documents stand in a line, by class of size and then
by a hash of the id, a start in [0, 1) is hashed from the source, and a document is drawn
where start + fraction * place passes a whole number. Over all starts each document has the
probability ``fraction``, and the drawn ones are spread evenly over the sizes.

The largest documents of a source, its highest size classes that hold at most a quarter of it and ``LARGE`` together, are
drawn first, in a line of their own. What they take above or under fraction * their words is made
up for by the fraction of the others. That is zero on average, so each document's probability stays;
and it is made up for only as far as the others' fraction can never leave [0, 1]. So the words
taken miss the target by little, where draws one by one may miss that of a small source by half.

A document's place is the number of documents in the parts of the line before its own, from
a table of counts, and its place inside the part. A part is a size class, cut by the
leading bits of the hash into slices, so no part, and no task, holds a source; as a slice is a range of the
hash, the line is the same however many there are.

The targets have a closed form. Sources ordered by most * size / weight reach their limit
in that order while the level (what is left, by weight) exceeds that ratio, so two running
sums over the per-source table give each target without repeating the resharing. That table,
a row for each source and none for documents, is sorted in one task.

The tables of sources and of parts are broadcast if they have at most ``MAX_SOURCES`` and
``MAX_PARTS`` rows; beyond, they are joined by shuffle, where adaptive execution splits a hot source's rows.

Defined cases: a null text has size 0; a null source is a source of its own, ordered
last; null ids share one hash and are told apart by size and text; repeated rows are drawn each for
itself; sources without words have target 0 and their documents are not taken; an empty table
gives an empty result; other columns are kept and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, whole_rows

WEIGHTS = (1, 2, 3)
MOST = 3
MAX_SOURCES, MAX_PARTS = 50_000, 200_000
#: Size classes for each factor e, bits of a hash, documents in a slice of all, and slices at least and at most.
STEPS, BITS, SLICE, LEAST_BITS, MOST_BITS = 4, 52, 1_000_000, 6, 16
#: Documents that a source's first line holds at most.
LARGE = 256


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(salt: str, *of: Column) -> Column:
    """``BITS`` bits from a salt and values, as a long."""
    return F.conv(F.left(F.md5(F.concat_ws("|", F.lit(salt), *(F.coalesce(c.cast("string"), F.lit("null")) for c in of)).cast("binary")), F.lit(BITS // 4)), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log(size.cast("double")) * STEPS)).otherwise(-1).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, docs, source_size, target for each source of ``sizes`` (source, size)."""
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * most
    order = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / open_weight).withColumn("full", F.col("level") * F.col("weight") > limit)
    # the first source that is not full sets the level of all from there on
    final = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(whole)
    return levels.select("source", "docs", "source_size", F.when(F.col("full"), limit.cast("double")).otherwise(F.least(limit.cast("double"), final * F.col("weight"))).alias("target"))


def _beside(rows: DataFrame, side: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """``rows`` with the other columns of ``side``, whose null keys fit null keys."""
    own = side.withColumnsRenamed({k: f"_{k}" for k in keys})
    fits = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(F.broadcast(own) if small else own, fits, "left").drop(*(f"_{k}" for k in keys))


def _drawn(start: Column, fraction: Column, place: Column) -> Column:
    """1 where the line passes a whole number at ``place`` (from 0), else 0."""
    return F.floor(start + fraction * (place + 1)) - F.floor(start + fraction * place)


LINE = ["in_class", "slice"]


def _lined(rows: DataFrame, per: DataFrame, salt: str, bits: int, small: bool) -> DataFrame:
    """``rows`` with the columns of their source, their part of a line (large documents have one part, 0 of class 1000) and the place inside it."""
    known = _beside(rows.withColumns({"in_class": size_class(F.col("size")), "hash": hashed(salt, F.col("id"))}), per, ["of"], small)
    first = F.coalesce(F.col("in_class") >= F.col("large_from"), F.lit(False))
    parts = known.withColumn("first", first).withColumns({"in_class": F.when(F.col("first"), 1000).otherwise(F.col("in_class")), "slice": F.when(F.col("first"), 0).otherwise(F.shiftright("hash", BITS - bits).cast("int"))})
    order = Window.partitionBy("of", *LINE).orderBy(F.when(F.col("first"), F.col("size")).desc_nulls_last(), "hash", "id", "size", "tie")
    return parts.withColumn("inside", F.row_number().over(order) - 1)


def sources(sizes: DataFrame, weights: tuple[int, ...], most: int, salt: str, max_sources: int) -> tuple[DataFrame, DataFrame, int, bool]:
    """A table of the sources (of, source_size, target, whole: copies of every document, fraction, start, large_from, later_fraction, later_start),
    one of the parts (of, LINE, ahead), the bits of a slice, and whether the sources are few."""
    per = cut(targets(sizes.select(F.col("of").alias("source"), "size"), weights, most).withColumnRenamed("source", "of"))
    number, docs = per.agg(F.count("*"), F.sum("docs")).first()
    bits, small = min(MOST_BITS, max(LEAST_BITS, ((docs or 0) // SLICE).bit_length())), number <= max_sources
    sliced = sizes.select("of", "size", size_class(F.col("size")).alias("in_class"), F.shiftright(hashed(salt, F.col("id")), BITS - bits).cast("int").alias("slice"))
    counts = cut(sliced.groupBy("of", *LINE).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("size").alias("largest")))
    classes = counts.groupBy("of", "in_class").agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "words"), (F.max, "largest"))))
    held = F.sum("n").over(Window.partitionBy("of").orderBy(F.col("in_class").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = F.least(F.lit(LARGE), F.sum("n").over(Window.partitionBy("of")) / 4)
    high = classes.withColumns({"held": held, "few": few}).where("held <= few and in_class >= 0").groupBy("of").agg(F.min("in_class").alias("large_from"), F.sum("words").alias("large_words"), F.max("largest").alias("largest"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = _beside(per, high, ["of"], small).withColumn("rate", rate)
    begun = rated.withColumns({"whole": F.floor("rate"), "fraction": F.col("rate") - F.floor("rate"), "start": hashed(salt, F.lit("start"), F.col("of")) / 2.0**BITS, "later_start": hashed(salt, F.lit("later"), F.col("of")) / 2.0**BITS})
    begun = cut(begun.drop("docs", "rate"))
    large = _beside(sizes, begun.select("of", "large_from"), ["of"], small).where(size_class(F.col("size")) >= F.col("large_from")).drop("large_from")
    taken = _lined(large, begun, salt, bits, small).groupBy("of").agg(F.sum(F.col("size") * _drawn(F.col("start"), F.col("fraction"), F.col("inside"))).alias("large_taken"))
    over = F.col("fraction") * F.col("large_words") - F.col("large_taken")
    others = F.col("source_size") - F.col("large_words")
    # over is at most the largest size either way, so that this share of it keeps the fraction in [0, 1]
    share = F.least(F.lit(1.0), others * F.least(F.col("fraction"), 1 - F.col("fraction")) / F.col("largest"))
    later = F.when(others > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fraction") + share * over / others)))
    table = _beside(begun, taken, ["of"], small).withColumn("later_fraction", F.coalesce(later, F.col("fraction"))).drop("large_words", "largest", "large_taken")
    line = Window.partitionBy("of").orderBy(F.col("in_class").desc(), "slice").rowsBetween(Window.unboundedPreceding, -1)
    rest = _beside(counts, begun.select("of", "large_from"), ["of"], small).where(F.col("large_from").isNull() | (F.col("in_class") < F.col("large_from")))
    parts = rest.select("of", *LINE, F.coalesce(F.sum("n").over(line), F.lit(0)).alias("ahead"))
    return cut(table), cut(parts), bits, small


def decided(sized: DataFrame, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, salt: str = "mix", max_sources: int = MAX_SOURCES, max_parts: int = MAX_PARTS) -> DataFrame:
    """``sized`` (of: its source, id, size, tie and others) with source_size, target and copies (times that the mix has the row).

    ``sizes`` are the same rows with of, id, size and tie alone; they are read three times.
    """
    per, parts, bits, small = sources(sizes, weights, most, salt, max_sources)
    placed = _beside(_lined(sized, per, salt, bits, small), parts, ["of", *LINE], parts.count() <= max_parts)
    later = _drawn(F.col("later_start"), F.col("later_fraction"), F.coalesce("ahead", F.lit(0)) + F.col("inside"))
    copies = F.col("whole") + F.when(F.col("first"), _drawn(F.col("start"), F.col("fraction"), F.col("inside"))).otherwise(later)
    return placed.select(*sized.columns, "source_size", "target", copies.cast("long").alias("copies"))


def sizes_of(docs: DataFrame) -> DataFrame:
    """of, id, size, tie of every row."""
    return docs.select(F.col("source").alias("of"), F.col("doc_id").cast("long").alias("id"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))


def shares(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """of, id, size, source_size, target, copies of every row; texts are read once and never moved."""
    sizes = cut(sizes_of(docs))
    return decided(sizes, sizes, **how).drop("tie")


def plan(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """Every row of ``docs`` as struct ``row``, with size, source_size, target and copies."""
    rows = whole_rows(docs).select("row", F.col("row.source").alias("of"), F.col("row.doc_id").cast("long").alias("id"), size_of(F.col("row.text")).alias("size"), F.xxhash64("row.text").alias("tie"))
    return decided(rows, cut(sizes_of(docs)), **how).select("row", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """The mixture: rows of ``docs``, with its columns, each as often as its source's rate says."""
    return plan(docs, **how).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
