"""Point clouds as glTF 2.0 in tiles.

One glTF of a whole cloud would pass through one task. A tile holds at most ``per_tile``
neighbouring points (by idx), so what a task gathers is bounded; a viewer loads the tiles of
a cloud side by side. A cloud of at most ``per_tile`` points is one tile.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_TILE = 100_000
#: Fixed values of the format: drawing mode of points, type of single-precision numbers, target of vertex data.
POINTS, FLOAT, ARRAY_BUFFER = 0, 5126, 34962


def document(points: np.ndarray) -> str:
    """glTF JSON with positions and colours (n x 6) in an embedded buffer; n is at least 1."""
    data = np.ascontiguousarray(points, "<f4")
    position, colour = np.ascontiguousarray(data[:, :3]), np.ascontiguousarray(data[:, 3:])
    raw, n = position.tobytes() + colour.tobytes(), len(data)
    known = np.where(np.isfinite(position), position, np.nan)
    empty = np.isnan(known).all(0)
    low, high = (np.where(empty, 0, f(np.where(np.isnan(known), fill, known), 0)).tolist() for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
    half = len(raw) // 2
    return json.dumps({
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"mode": POINTS, "attributes": {"POSITION": 0, "COLOR_0": 1}}]}],
        "buffers": [{"byteLength": len(raw), "uri": "data:application/octet-stream;base64," + base64.b64encode(raw).decode()}],
        "bufferViews": [{"buffer": 0, "byteOffset": o, "byteLength": half, "target": ARRAY_BUFFER} for o in (0, half)],
        "accessors": [
            {"bufferView": 0, "componentType": FLOAT, "count": n, "type": "VEC3", "min": low, "max": high},
            {"bufferView": 1, "componentType": FLOAT, "count": n, "type": "VEC3"},
        ],
    })


def built(gathered: DataFrame) -> DataFrame:
    """``gathered`` with n_points and gltf in place of ``own``, an array of structs that ends with x, y, z, r, g, b, in order; whole batches of tiles at a time."""
    keys = [c for c in gathered.columns if c != "own"]
    kinds = dict(gathered.dtypes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(len(keys))
            ends, values = own.offsets.to_numpy(), own.values
            parts = np.column_stack([values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "r", "g", "b")])
            made = [document(parts[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
            columns = [*(b.column(i) for i in range(len(keys))), pa.array(np.diff(ends), pa.int64()), pa.array(made, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n_points", "gltf"])

    kept = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return gathered.select(*keys, "own").mapInArrow(build, f"{kept}, n_points long, gltf string")


def gathered(placed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and own, the points of each group by idx; a group must be bounded."""
    point = F.struct("idx", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "r", "g", "b")))
    return placed.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("own"))


def tiles(points: DataFrame, per_tile: int = PER_TILE) -> DataFrame:
    """cloud_id, tile, n_points, gltf for each tile of each cloud."""
    placed = points.withColumn("tile", F.floor(F.col("idx") / per_tile).cast("long"))
    return built(gathered(placed, ["cloud_id", "tile"]))


def write(points: DataFrame, path: str, per_tile: int = PER_TILE) -> None:
    """One text file for each tile, in folders by cloud and tile."""
    tiles(points, per_tile).select("cloud_id", "tile", "gltf").write.partitionBy("cloud_id", "tile").text(path)
