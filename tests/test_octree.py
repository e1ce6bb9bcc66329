"""Keys by place, the nearest point of many cameras, and trees of tiles."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pointloom.operators import octree
from pointloom.sinks import gltf, tiletree
from pyspark.sql import functions as F

POINT = "cloud_id long, idx long, x double, y double, z double"
FULL = POINT + ", r double, g double, b double"


def finite(p: tuple) -> bool:
    return all(c is not None and math.isfinite(c) for c in p)


def brute_nearest(points: list[tuple], camera: tuple) -> tuple | None:
    if not finite(camera):
        return None
    measured = [(math.sqrt(sum((a - b) * (a - b) for a, b in zip(p[2:], camera, strict=True))), p[1], p[0], *p[2:]) for p in points if finite(p[2:])]
    return min(measured, default=None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_camera_has_its_nearest_point(spark, seed):
    own = random.Random(seed)
    at = lambda: own.choice([own.uniform(-1, 1), own.randrange(-4, 5) / 4, own.gauss(0.5, 0.001)])
    points = [(own.randrange(4), own.randrange(90), at(), at(), at()) for _ in range(700)] + [(9, 0, None, 0.0, 0.0), (9, 1, float("nan"), 0.0, 0.0), (9, 2, 0.0, float("inf"), 0.0)]
    cameras = [(i, at(), at(), at()) for i in range(60)] + [(100, 50.0, -900.0, 1e6), (101, None, 0.0, 0.0), (102, float("nan"), 0.0, 0.0), (103, 0.0, float("-inf"), 0.0), (104, 0.25, 0.25, 0.25), (104, 0.25, 0.25, 0.25), (105, -0.0, 0.0, 0.0)]
    rows = octree.nearest_of(spark.createDataFrame(points, POINT), spark.createDataFrame(cameras, "d_id long, x double, y double, z double"), per_box=4).collect()
    assert len(rows) == len(cameras)
    for r in rows:
        want = brute_nearest(points, (r.x, r.y, r.z))
        assert r.d == (pytest.approx(want[0], rel=1e-12) if want else None)
        assert (r.near_idx, r.near_cloud, r.near_x, r.near_y, r.near_z) == (want[1:] if want else (None,) * 5)


def test_cameras_without_points(spark):
    cameras = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "camera long, x double, y double, z double")
    for points in ([], [(0, 0, None, 1.0, 1.0)]):
        assert [r.d for r in octree.nearest_of(spark.createDataFrame(points, POINT), cameras).collect()] == [None]
    one = octree.nearest_of(spark.createDataFrame([(3, 7, 1.0, 1.0, 1.0)] * 5, POINT), cameras).first()
    assert (one.near_cloud, one.near_idx, one.d) == (3, 7, math.sqrt(3))
    assert octree.nearest_of(spark.createDataFrame([(3, 7, 1.0, 1.0, 1.0)], POINT), cameras.limit(0)).count() == 0


def test_no_camera_meets_all_points(spark, capsys):
    points = spark.range(2000).select(F.lit(0).cast("long").alias("cloud_id"), F.col("id").alias("idx"), *(F.rand(i).alias(c) for i, c in enumerate("xyz")))
    capsys.readouterr()
    octree.nearest_of(points, points.select("x", "y", "z").limit(50)).explain("formatted")
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", capsys.readouterr().out)


def test_keys_alternate_bits(spark):
    rows = spark.range(1).select(octree.spread_bits(F.lit(0b1011)).alias("a"), octree.spread_bits(F.lit(65535)).alias("b")).first()
    assert rows.a == 0b001000001001 and rows.b == sum(1 << 3 * i for i in range(16))


def cloud(spark, seed: int, n: int):
    own = random.Random(seed)
    rows = [(i % 2, i, *(own.gauss(0, 1) ** 3 for _ in range(3)), 0.1, 0.2, 0.3) for i in range(n)]
    rows += [(0, n + i, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0) for i in range(300)]  # many at one place
    rows += [(1, 2 * n + i, None if i % 2 else float("nan"), 1.0, 1.0, 0.0, 0.0, 0.0) for i in range(40)] + [(None, 5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    return rows, spark.createDataFrame(rows, FULL).repartition(5)


def test_leaves_hold_each_point_once_and_are_bounded(spark):
    rows, points = cloud(spark, 4, 900)
    tiled = tiletree.placed(points, 32).collect()
    assert sorted((r.cloud_id is None, r.cloud_id or 0, r.idx) for r in tiled) == sorted((r[0] is None, r[0] or 0, r[1]) for r in rows)
    sizes: dict = {}
    for r in tiled:
        sizes[r.cloud_id, r.level, r.cell, r.part] = sizes.get((r.cloud_id, r.level, r.cell, r.part), 0) + 1
    assert max(sizes.values()) <= 32 and {r.level for r in tiled if not finite((r.x, r.y, r.z))} == {-1}
    assert sum(n for (_, level, _, _), n in sizes.items() if level == octree.DEPTH) == 300


def test_bounds_are_nested_and_documents_name_their_children(spark):
    rows, points = cloud(spark, 5, 700)
    tree = tiletree.nodes(tiletree.placed(points, 32))
    nodes = tree.where("level >= 0").collect()
    held: dict = {}
    for r in nodes:
        held.setdefault((r.cloud_id, r.level, r.cell), []).append(r)
    for (cloud_id, level, cell), own in held.items():
        if level:
            above = held[cloud_id, level - 1, cell >> 3][0]
            assert not above.leaf and all(above[f"min_{a}"] <= r[f"min_{a}"] and r[f"max_{a}"] <= above[f"max_{a}"] for a in "xyz" for r in own)
    assert sum(r.n_points for r in nodes if r.leaf) == sum(finite(p[2:5]) for p in rows)
    made = {(r.cloud_id, r.level, r.cell): json.loads(r.json) for r in tiletree.documents(tree).collect()}
    assert set(made) == {k for k, own in held.items() if not own[0].leaf}
    for (cloud_id, level, cell), said in made.items():
        children = said["root"]["children"]
        assert [c["cell"] for c in children] == sorted(k[2] for k in held if k[:2] == (cloud_id, level + 1) and k[2] >> 3 == cell) and len(children) <= 8
        assert sum(c["points"] for c in children) == said["root"]["points"] and len(said["root"]["boundingVolume"]["box"]) == 12


def test_coarse_levels_are_samples(spark):
    _, points = cloud(spark, 6, 1500)
    tiled = tiletree.placed(points, 64)
    tree = tiletree.nodes(tiled)
    shown: dict = {}
    for r in tiletree.sampled(tiled, tree, 64).collect():
        shown.setdefault((r.cloud_id, r.level, r.cell), set()).add(r.idx)
    inner = {(r.cloud_id, r.level, r.cell): r.n_points for r in tree.where("not leaf").collect()}
    assert set(shown) <= set(inner) and 10 <= len(shown[0, 0, 0]) <= 64
    assert all(own & shown[c, level - 1, cell >> 3] <= own for (c, level, cell), own in shown.items() if level)
    for (c, level, cell), own in shown.items():
        if level:
            below = [k for k in shown if k == (c, level, cell)]
            assert below and len(own) <= 64


def test_tiles_are_written_with_their_documents(spark, tmp_path):
    _, points = cloud(spark, 7, 200)
    tiletree.write(points.where("cloud_id is not null"), f"{tmp_path}/tree", 64)
    tiles = spark.read.text(f"{tmp_path}/tree/tiles").collect()
    assert sum(json.loads(r.value)["accessors"][0]["count"] for r in tiles) == points.where("cloud_id is not null").count()
    assert spark.read.text(f"{tmp_path}/tree/documents").where("level = 0").count() == 2
    assert tiletree.placed(points.limit(0)).count() == 0 and tiletree.nodes(tiletree.placed(points.limit(0))).count() == 0


def test_batched_documents_equal_single_ones(spark):
    rows, points = cloud(spark, 8, 50)
    made = gltf.tiles(points.where("cloud_id = 0"), 40).collect()
    assert sum(r.n_points for r in made) == sum(r[0] == 0 for r in rows)
    assert all(json.loads(r.gltf)["accessors"][0]["count"] == r.n_points for r in made)
