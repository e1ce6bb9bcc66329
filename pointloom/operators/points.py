"""Point clouds: reshaping flat arrays, narrowing, the nearest point and the viewpoint before it.

A cloud is rows (cloud_id, idx, x, y, z, r, g, b); idx is the place in the array and decides
ties. All operators are column expressions or one grouped aggregate with partial
aggregation, so a cloud of any size is reduced where its rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import distance, stand_off

PARTS = ("x", "y", "z", "r", "g", "b")
STRIDE = len(PARTS)
#: Where the viewer's camera stands at first.
CAMERA = (0.0, 0.0, 5.0)


def reshape(df: DataFrame, key: str, values: str, missing: float | None = float("nan")) -> DataFrame:
    """One row for each six values of an array column; a last group of fewer has ``missing`` at its end.

    A null or empty array has no points.
    """
    size = F.size(values)
    fill = F.lit(missing).cast("double")
    part = lambda at: F.when(at < size, F.get(F.col(values), at).cast("double")).otherwise(fill)
    point = lambda i: F.struct(*(part((i * STRIDE + k).cast("int")).alias(name) for k, name in enumerate(PARTS)))
    made = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.ceil(size / STRIDE) - 1), point))
    # points are exploded rather than places, so the array is not copied into every row
    rows = df.select(F.col(key).alias("cloud_id"), F.posexplode(made).alias("idx", "point"))
    return rows.select("cloud_id", F.col("idx").cast("long").alias("idx"), "point.*")


def split(points: DataFrame) -> DataFrame:
    """cloud_id, idx, position and colour structs."""
    return points.select("cloud_id", "idx", F.struct("x", "y", "z").alias("position"), F.struct("r", "g", "b").alias("colour"))


def narrow(points: DataFrame) -> DataFrame:
    """Values as drawn: single precision. Distances use the values before this."""
    return points.withColumns({c: F.col(c).cast("float") for c in PARTS})


def with_all_coordinates(points: DataFrame) -> DataFrame:
    return points.where("x is not null and y is not null and z is not null")


def _literals(camera: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    x, y, z = (F.lit(float(c)) for c in camera)
    return x, y, z


def nearest(points: DataFrame, camera: tuple[float, float, float] = CAMERA, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """The point nearest the camera of each group (columns ``by``; none: of all), with its distance ``d``.

    Of equal distances the smaller idx wins (then the smaller cloud_id); points with a coordinate
    that is null, NaN or infinite never do. A group without a valid point has no row; with ``strict`` it
    is an error when the result is read, as is an empty cloud where no columns are given.
    """
    d = distance((F.col("x"), F.col("y"), F.col("z")), _literals(camera))
    own, valid = ["d", "idx", "cloud_id", "x", "y", "z"], F.expr("d is not null and not isnan(d) and d < double('Infinity')")
    measured = points.withColumn("d", d)
    if strict:
        least = measured.groupBy(*(by or [])).agg(F.min(F.when(valid, F.struct(*own))).alias("p"))
        where = F.concat(F.lit("no valid point in the cloud "), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by or []))
        found = least.withColumn("p", F.when(F.col("p").isNull(), F.raise_error(where)).otherwise(F.col("p")))
    else:
        found = measured.where(valid).groupBy(*(by or [])).agg(F.min(F.struct(*own)).alias("p")).where("p is not null")
    return found.select(*(by or []), *(f"p.{c}" for c in own if c not in (by or [])))


def viewpoint(near: DataFrame, camera: tuple[float, float, float] = CAMERA, by: float = 0.5) -> DataFrame:
    """``near`` (x, y, z) with view_x, view_y, view_z: ``by`` towards the camera from the point."""
    moved = stand_off((F.col("x"), F.col("y"), F.col("z")), _literals(camera), by)
    return near.withColumns({f"view_{c}": v for c, v in zip("xyz", moved, strict=True)})


def bounds(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least and largest coordinates in single precision, NaN left out, and the number of points."""
    known = lambda c: F.nullif(F.col(c).cast("float"), F.lit(float("nan")).cast("float"))
    return points.groupBy(*(by or [])).agg(*(f(known(c)).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n_points"))
