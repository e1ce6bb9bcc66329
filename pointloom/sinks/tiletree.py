"""Clouds as trees of tiles by place: cells of a cube are split until one holds at most ``per_tile`` points.

The cube is that of all points; a cell of a level is a prefix of its points' keys. Points are counted by key, and level
by level the counts of the cells that are still too large go on, so no point moves until the cells are known. A cell of the last
level that still holds more, as where many points share a place, is dealt into parts by idx.

Defined cases: points without a finite place are in tiles of level -1, dealt by idx; idx tells the points of a cloud apart; a
cloud of at most ``per_tile`` points is one tile; an empty cloud has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import octree
from pointloom.shared import cut
from pointloom.sinks import gltf

TILE = ["cloud_id", "level", "cell", "part"]
_BOUNDS = [f"{n}_{a}" for a in octree.AXES for n in ("min", "max")]


def placed(points: DataFrame, per_tile: int = gltf.PER_TILE) -> DataFrame:
    """``points`` with the level, cell and part of the leaf of each."""
    at = octree.world(points)
    key = F.lit(None).cast("long") if at is None else octree.key(at)
    keyed = points.withColumn("key", key)
    open_keys = keyed.where("key is not null").groupBy(F.struct("cloud_id").alias("cloud"), "key").agg(F.count("*").alias("n"))
    leaves = None
    for level in range(octree.DEPTH + 1):
        here = open_keys.withColumn("cell", F.shiftright("key", 3 * (octree.DEPTH - level)))
        sizes = here.groupBy("cloud", "cell").agg(F.sum("n").alias("held"))
        both = cut(here.join(sizes, ["cloud", "cell"]))
        done = (F.col("held") <= per_tile) | F.lit(level == octree.DEPTH)
        found = both.where(done).select("cloud", F.col("key").alias("leaf_key"), F.lit(level).alias("level"), "cell", "held")
        leaves = found if leaves is None else leaves.unionByName(found)
        open_keys = both.where(~done).select("cloud", "key", "n")
        if open_keys.isEmpty():
            break
    same = (F.struct("cloud_id") == F.col("cloud")) & (F.col("key") == F.col("leaf_key"))
    joined = keyed.join(leaves, same, "left")
    by_idx = F.when(F.col("held") <= per_tile, 0).otherwise(F.floor(F.col("idx") / per_tile)).cast("long")
    return joined.select(*points.columns, F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("cell", F.lit(0)).cast("long").alias("cell"), by_idx.alias("part"))


def nodes(tiled: DataFrame) -> DataFrame:
    """cloud_id, level, cell, part, leaf, n_points and bounds (single precision) of every leaf of ``placed`` points and of every cell above them (part null)."""
    known = lambda c: F.nullif(F.col(c).cast("float"), F.lit(float("nan")).cast("float"))
    bounds = [f(known(a)).alias(f"{n}_{a}") for a in octree.AXES for n, f in (("min", F.min), ("max", F.max))]
    leaves = cut(tiled.groupBy(*TILE).agg(F.count("*").alias("n_points"), *bounds))
    up = leaves.where("level > 0").withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level") - 1)))
    above = up.groupBy("cloud_id", "up", F.expr("shiftright(cell, 3 * (level - up))").alias("over"))
    inner = above.agg(F.sum("n_points").alias("n_points"), *((F.min if c.startswith("min") else F.max)(c).alias(c) for c in _BOUNDS))
    inner = inner.select("cloud_id", F.col("up").alias("level"), F.col("over").alias("cell"), F.lit(None).cast("long").alias("part"), F.lit(False).alias("leaf"), "n_points", *_BOUNDS)
    return leaves.select(*TILE, F.lit(True).alias("leaf"), "n_points", *_BOUNDS).unionByName(inner)


def documents(tree: DataFrame) -> DataFrame:
    """cloud_id, level, cell and json of every cell above leaves: its box and points, and of each of its at most eight children the box and the address.

    A child that is a cell above leaves refers to its own document, a leaf to the tile, or to the number of its parts.
    """
    half = [((F.col(f"max_{a}").cast("double") - F.col(f"min_{a}")) / 2) for a in octree.AXES]
    centre = [((F.col(f"max_{a}").cast("double") + F.col(f"min_{a}")) / 2) for a in octree.AXES]
    zero = F.lit(0.0)
    box = F.array(*centre, half[0], zero, zero, zero, half[1], zero, zero, zero, half[2])
    sides = [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in _BOUNDS]
    cells = tree.where("level >= 0").groupBy("cloud_id", "level", "cell").agg(F.every("leaf").alias("leaf"), F.sum("n_points").alias("n_points"), F.count("*").alias("parts"), *sides)
    address = F.concat_ws("/", F.col("level").cast("string"), F.col("cell").cast("string"))
    child = F.struct(F.col("cell"), F.struct(box.alias("box")).alias("boundingVolume"), F.col("n_points").alias("points"), F.when(F.col("leaf"), F.col("parts")).alias("parts"), F.struct(F.concat(address, F.when(F.col("leaf"), ".gltf").otherwise(".json")).alias("uri")).alias("content"))
    below = cells.where("level > 0").groupBy("cloud_id", (F.col("level") - 1).alias("level"), F.shiftright("cell", 3).alias("cell")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    whole = cells.where("not leaf").select(F.struct("cloud_id", "level", "cell").alias("at"), F.struct(box.alias("box")).alias("volume"), "n_points")
    joined = whole.join(below.select(F.struct("cloud_id", "level", "cell").alias("at"), "children"), "at")
    root = F.struct(F.col("volume").alias("boundingVolume"), F.col("n_points").alias("points"), F.lit("ADD").alias("refine"), "children")
    return joined.select("at.*", F.to_json(F.struct(F.struct(F.lit("1.1").alias("version")).alias("asset"), root.alias("root"))).alias("json"))


def sampled(tiled: DataFrame, tree: DataFrame, per_tile: int = gltf.PER_TILE) -> DataFrame:
    """Points for the cells above leaves, level, cell and all columns of ``tiled`` points: of each cell about half of ``per_tile``, by hash.

    A point that a cell shows is shown by all cells below it, too.
    """
    shares = tree.where("not leaf").select(F.struct("cloud_id", "level", "cell").alias("at"), (F.lit(per_tile / 2) / F.col("n_points")).alias("share"))
    up = tiled.where("level > 0").withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level") - 1)))
    up = up.withColumn("at", F.struct("cloud_id", F.col("up").alias("level"), F.expr("shiftright(cell, 3 * (level - up))").alias("cell")))
    draw = F.pmod(F.xxhash64("cloud_id", "idx", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rest = [c for c in tiled.columns if c not in TILE]
    return up.join(shares, "at").where(draw < F.col("share")).select("at.*", *rest)


def tiles(tiled: DataFrame) -> DataFrame:
    """cloud_id, level, cell, part, n_points and gltf of every leaf of ``placed`` points."""
    return gltf.built(gltf.gathered(tiled, TILE))


def write(points: DataFrame, path: str, per_tile: int = gltf.PER_TILE) -> None:
    """Leaves and documents as text files, in folders by cloud, level and cell."""
    tiled = placed(points, per_tile)
    tiles(tiled).select(*TILE, "gltf").write.partitionBy(*TILE).text(f"{path}/tiles")
    documents(nodes(tiled)).write.partitionBy("cloud_id", "level", "cell").text(f"{path}/documents")
