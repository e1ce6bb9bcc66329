"""Places as numbers whose bits of x, y and z alternate, and the nearest point of many cameras by a tree of boxes.

A world is the smallest cube, from its lowest corner, that holds all finite points. A key has ``DEPTH`` bits of each axis;
its first 3 * level bits name the cell of a level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.vectors import distance
from pointloom.shared import cut

DEPTH = 16
AXES = ("x", "y", "z")
World = tuple[tuple[float, float, float], float]


def is_finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out


def world(points: DataFrame) -> World | None:
    """Lowest corner and side of the cube of all finite points; None without any. One row comes to the driver."""
    low_high = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))]
    found = points.where(is_finite(*AXES)).agg(*low_high).first()
    if found is None or found["low_x"] is None:
        return None
    low = tuple(float(found[f"low_{a}"]) for a in AXES)
    return low, max(max(float(found[f"high_{a}"]) - at for a, at in zip(AXES, low, strict=True)), 5e-324)


def spread_bits(c: Column) -> Column:
    """The bits of a number under 2**16, each three places from the last."""
    table = F.array(*(F.lit(sum((i >> b & 1) << 3 * b for b in range(8))).cast("long") for i in range(256)))
    return F.get(table, c.bitwiseAND(255)) + F.shiftleft(F.get(table, F.shiftright(c, 8).bitwiseAND(255)), 24)


def key(at: World) -> Column:
    """The key of x, y, z; null where one of them is not finite."""
    low, side = at
    step = lambda a, o: F.least(F.floor((F.col(a) - F.lit(o)) / F.lit(side) * 2**DEPTH), F.lit(2**DEPTH - 1)).cast("int")
    x, y, z = (spread_bits(step(a, o)) for a, o in zip(AXES, low, strict=True))
    return F.when(is_finite(*AXES), F.shiftleft(x, 2) + F.shiftleft(y, 1) + z)


def boxes(rows: DataFrame, by: Column) -> DataFrame:
    """key, low_ and high_ of each axis of groups; ``rows`` has x, y, z or boxes."""
    whole = "low_x" in rows.columns
    sides = [f(F.col(f"{n}_{a}" if whole else a)).alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy(by.alias("key")).agg(*sides)


def nearest_of(points: DataFrame, cameras: DataFrame, per_box: int = 16) -> DataFrame:
    """``cameras`` (x, y, z and others) with near_cloud, near_idx, near_x, near_y, near_z and d of its nearest point.

    All cameras go down a tree of boxes together, level by level, from the box of all points. Of a camera's boxes only those go on that
    are no farther than the farthest corner of its best one. So each level is a join by key, no camera meets
    a point that a box rules out, and neither side is gathered or broadcast for this.

    Of equal distances the smaller idx wins, then the smaller cloud_id; points with a coordinate that is null, NaN or infinite never
    do; for such a camera, or without any point, the new columns are null. Repeated cameras each have their row.
    """
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("d", "double"), ("near_idx", "long"), ("near_cloud", dict(points.dtypes)["cloud_id"]), ("near_x", "double"), ("near_y", "double"), ("near_z", "double"))]
    at = world(points)
    if at is None:
        return cameras.select("*", *none)
    own = points.where(is_finite(*AXES)).groupBy(*(F.col(a).cast("double").alias(a) for a in AXES)).agg(F.min(F.struct("idx", "cloud_id")).alias("least"))
    own = cut(own.withColumn("key", key(at)))
    depth = min(DEPTH, max(1, math.ceil(math.log(max(own.count() / per_box, 1), 8)) + 1))
    own = own.withColumn("key", F.shiftright("key", 3 * (DEPTH - depth)))
    levels = [cut(boxes(own, F.col("key")))]
    for _ in range(depth - 1):
        levels.append(cut(boxes(levels[-1], F.shiftright("key", 3))))
    c = [F.col(f"at_{a}") for a in AXES]
    looking = cameras.where(is_finite(*AXES)).select(*(F.col(a).cast("double").alias(f"at_{a}") for a in AXES)).distinct()
    held = looking.withColumn("key", F.lit(0).cast("long"))
    squares = lambda parts: parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]
    near = squares([F.greatest(F.col(f"low_{a}") - v, v - F.col(f"high_{a}"), F.lit(0.0)) for a, v in zip(AXES, c, strict=True)])
    far = squares([F.greatest(F.abs(F.col(f"low_{a}") - v), F.abs(F.col(f"high_{a}") - v)) for a, v in zip(AXES, c, strict=True)])
    each = Window.partitionBy(*(f"at_{a}" for a in AXES))
    for own_boxes in reversed(levels):  # all cameras look into the box of all points
        held = held.withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.shiftleft("key", 3) + i)))
        seen = held.join(own_boxes, "key").withColumns({"near": near, "far": far}).withColumn("most", F.min("far").over(each))
        held = seen.where(F.col("near") <= F.col("most") * (1 + 1e-12)).select("key", *(f"at_{a}" for a in AXES))
    d = distance(tuple(F.col(a) for a in AXES), tuple(c))
    met = held.join(own, "key").withColumn("d", d)
    best = met.groupBy(*(f"at_{a}" for a in AXES)).agg(F.min(F.struct("d", F.col("least.idx").alias("idx"), F.col("least.cloud_id").alias("cloud_id"), *AXES)).alias("best"))
    same = [F.col(a).cast("double") == F.col(f"at_{a}") for a in AXES]
    joined = cameras.join(best, same, "left")
    named = {"d": "d", "near_idx": "idx", "near_cloud": "cloud_id", "near_x": "x", "near_y": "y", "near_z": "z"}
    return joined.select(*cameras.columns, *(F.col(f"best.{f}").alias(n) for n, f in named.items()))
