"""Lists of image files: filters, new names, removal, appending, listings by prefix.

A list is rows with a place ``pos`` from 0, without gaps, within each ``key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.text import basename, is_image, raw_extension, stem

#: Objects that one listing request returns.
PAGE = 1000
#: Numbers and places that one task ranks.
BLOCK = 100_000


def only_files(items: DataFrame) -> DataFrame:
    return items.where(F.col("kind") == "file")


def only_images(files: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name has one of the image extensions."""
    return files.where(is_image(F.col(name)))


def rejected_images(files: DataFrame, name: str = "name") -> DataFrame:
    return files.where(~F.coalesce(is_image(F.col(name)), F.lit(False)))


def _numbered(names: DataFrame) -> DataFrame:
    """end, stem, k of the names (old) that are stem_k.end with a number."""
    end, before = raw_extension(F.col("old")), stem(F.col("old"))
    k = F.regexp_extract(before, r"_([1-9][0-9]{0,17})$", 1)
    dotted = names.where(F.instr("old", ".") > 0).select(end.alias("end"), before.alias("before"), k.alias("k")).where("k != ''")
    return dotted.select("end", F.left("before", F.length("before") - F.length("k") - 1).alias("stem"), F.col("k").try_cast("long").alias("k"))


def _made(end: str, before: str, k: str):  # noqa: ANN202
    return F.concat(F.col(before), F.lit("_"), F.col(k).cast("string"), F.lit("."), F.col(end))


def rename_apart(new: DataFrame, existing: DataFrame, pos: str = "pos", name: str = "name", block: int = BLOCK) -> DataFrame:
    """``new`` with column ``new_name``, in which no name is one of ``existing`` and no two are equal.

    Of equal names the first by ``pos`` (distinct places of the batch, from 0) keeps its name unless
    ``existing`` has it; each other one becomes stem_k.extension, in order of pos with the smallest
    numbers under which neither ``existing`` nor the batch has a name. Null names stay null.

    The j-th in need takes the j-th free number: both are ranked by blocks, with sums of counts
    before each block, so neither a name that a third of the batch has nor its numbers are ranked in one task.
    """
    old = existing.select(F.col(name).alias("old")).where("old is not null").distinct()
    batch = new.select(F.col(name).alias("old"), F.col(pos).cast("long").alias("place")).where("old is not null")
    first = batch.groupBy("old").agg(F.min("place").alias("first")).join(old.withColumn("held", F.lit(True)), "old", "left")
    kept = F.col("held").isNull() & (F.col("place") == F.col("first"))
    needy = batch.join(first, "old").where(~kept).select("old", "place", F.floor(F.col("place") / block).alias("block"))
    ahead = lambda *keys: Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = needy.groupBy("old", "block").agg(F.count("*").alias("n"))
    before = counts.select("old", "block", F.coalesce(F.sum("n").over(ahead("old")), F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("old", "block").orderBy("place"))
    asked = needy.withColumn("turn", turn).join(before, ["old", "block"]).select("old", "place", (F.col("turn") + F.col("before")).alias("j"))
    taken = _numbered(old.union(batch.select("old")).distinct()).distinct()
    wants = counts.groupBy("old").agg(F.sum("n").alias("m")).select("old", "m", raw_extension(F.col("old")).alias("end"), stem(F.col("old")).alias("stem"))
    sizes = wants.join(taken, ["end", "stem"], "left").groupBy("old", "end", "stem", "m").agg(F.count("k").alias("t"))
    # among the first m + t numbers at least m are free
    blocks = sizes.select("old", "end", "stem", (F.col("m") + F.col("t")).alias("most"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") + F.col("t") - 1) / block))).alias("block"))
    numbers = F.sequence(F.col("block") * block + 1, F.least(F.col("most"), (F.col("block") + 1) * block))
    free = blocks.select("old", "end", "stem", "block", F.explode(numbers).alias("k")).join(taken, ["end", "stem", "k"], "left_anti")
    earlier = free.groupBy("old", "block").agg(F.count("*").alias("n")).select("old", "block", F.coalesce(F.sum("n").over(ahead("old")), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("old", "block").orderBy("k"))
    ranked = free.withColumn("rank", rank).join(earlier, ["old", "block"]).select("old", (F.col("rank") + F.col("before")).alias("j"), _made("end", "stem", "k").alias("made"))
    found = asked.join(ranked, ["old", "j"]).select(F.col("place").alias("_place"), "made")
    return new.join(found, new[pos] == found["_place"], "left").select(*(new[c] for c in new.columns), F.coalesce(found["made"], new[name]).alias("new_name"))


def rename_collisions(new: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """``new`` with column ``new_name``: a name that ``existing`` has becomes stem_k.extension with the first free k.

    The strict form: two equal names of one batch stay equal, as each is compared with ``existing``
    only (``rename_apart`` tells them apart). The first free number of a stem is the least of 1 and the numbers behind taken ones that is not
    taken: an anti-join keyed by stem and number, and a minimum with partial aggregation, so a
    stem with very many files is not gathered anywhere.
    """
    old = existing.select(F.col(name).alias("old")).where("old is not null").distinct()
    end, before, taken = raw_extension(F.col("old")), stem(F.col("old")), _numbered(old)
    hit = old.join(new.select(F.col(name).alias("old")).distinct(), "old", "left_semi").select("old", end.alias("end"), before.alias("stem"))
    after = hit.select("old", "end", "stem", F.lit(1).cast("long").alias("k")).union(hit.join(taken, ["end", "stem"]).select("old", "end", "stem", F.col("k") + 1))
    free = after.join(taken, ["end", "stem", "k"], "left_anti").groupBy("old", "end", "stem").agg(F.min("k").alias("k"))
    made = free.select("old", _made("end", "stem", "k").alias("made"))
    return new.join(made, new[name] == made.old, "left").select(*(new[c] for c in new.columns), F.coalesce(made.made, new[name]).alias("new_name"))


def remove_at(lists: DataFrame, place: int, pos: str = "pos") -> DataFrame:
    """Without the entry at ``place``; those behind it move up. No shuffle, as places have no gaps."""
    return lists.where(F.col(pos) != place).withColumn(pos, F.col(pos) - (F.col(pos) > place).cast("long"))


def append(lists: DataFrame, more: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``more`` behind the entries of the same key; nothing is deduplicated."""
    sizes = lists.groupBy(F.col(key).alias("_list")).agg(F.count("*").alias("_size"))
    joined = more.join(sizes, F.col(key).eqNullSafe(F.col("_list")), "left")
    return lists.unionByName(joined.withColumn(pos, F.col(pos) + F.coalesce("_size", F.lit(0))).drop("_list", "_size"))


def listing(objects: DataFrame, prefix: str, page: int | None = None, key: str = "key", strict: bool = False) -> DataFrame:
    """Objects in the folder ``prefix``; with ``strict`` those whose key begins with it as it is, so that ``a/rgb`` also fits ``a/rgb2/b.png``.

    ``page`` is a listing's limit in order of the keys; without one the listing is whole.
    """
    found = objects.where(F.col(key).startswith(prefix if strict or prefix.endswith("/") else prefix + "/"))
    return found.orderBy(key).limit(page) if page else found


def named(objects: DataFrame, key: str = "key") -> DataFrame:
    """Objects with their names, as images whatever the extension."""
    return objects.withColumns({"name": basename(F.col(key)), "mime": F.lit("image/jpeg")})


def has_enough(images: DataFrame, key: str, least: int = 1, owners: DataFrame | None = None) -> DataFrame:
    """key, n_images, enough for each key of ``owners``, of which some have no image; without them for each key that has images."""
    counts = images.groupBy(key).agg(F.count("*").alias("n_images"))
    if owners is not None:
        counts = owners.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n_images", F.lit(0)).alias("n_images"))
    return counts.withColumn("enough", F.col("n_images") >= least)


def images_replaced(images: DataFrame, updated: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``images`` with the lists of the projects in ``updated`` (columns ``keys``) replaced by theirs in ``new``; without one there they are empty."""
    hit = updated.select(*keys).distinct()
    return images.join(hit, keys, "left_anti").select(*images.columns).unionByName(new.join(hit, keys, "left_semi").select(*images.columns))
