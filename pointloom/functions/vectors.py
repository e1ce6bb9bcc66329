"""Columns of three-dimensional geometry and of camera rules of thumb."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def distance(a: Vector, b: Vector) -> Column:
    x, y, z = ((p - q) * (p - q) for p, q in zip(a, b, strict=True))
    return F.sqrt(x + y + z)


def direction(a: Vector, b: Vector) -> Vector:
    """Unit vector from a to b; zero where they coincide."""
    long = distance(a, b)
    x, y, z = (F.coalesce(F.try_divide(q - p, long), F.lit(0.0)) for p, q in zip(a, b, strict=True))
    return x, y, z


def stand_off(point: Vector, camera: Vector, by: float = 0.5) -> Vector:
    """``point`` moved towards ``camera``."""
    x, y, z = (p + d * by for p, d in zip(point, direction(point, camera), strict=True))
    return x, y, z


def aspect(width: Column, height: Column) -> Column:
    return F.try_divide(width, height)


def nearest_depth(depth_max: Column, object_depth: Column) -> Column:
    """Least depth of a scene from the largest and the object's own."""
    return depth_max - object_depth


def focal_from_mm(mm: Column) -> Column:
    """Focal parameter from a lens's millimetres: 52 mm is 520."""
    return mm * 10


def centre(value: Column, side: Column) -> Column:
    """Principal point: half the image side where the form still has -1."""
    return F.when(value == -1, side / 2).otherwise(value)
