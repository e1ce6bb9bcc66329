from __future__ import annotations

import base64
import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pointloom.operators import points
from pointloom.sinks import copies, gltf
from pointloom.sources.npy import read_points

CLOUD = "cloud_id string, idx long, x double, y double, z double, r double, g double, b double"
NAN, INF = float("nan"), float("inf")


def cloud(spark, *rows):
    return spark.createDataFrame([("a", i, *map(float, p), 0.0, 0.0, 0.0) for i, p in enumerate(rows)], CLOUD)


def test_reshape_tail_null_and_empty(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(64)]), (2, []), (3, None)], "k int, v array<double>")
    rows = sorted(points.reshape(df, "k", "v").collect(), key=lambda r: r.idx)
    assert [r.cloud_id for r in rows] == [1] * 11
    assert rows[10][2:6] == (60.0, 61.0, 62.0, 63.0)
    assert math.isnan(rows[10].g) and math.isnan(rows[10].b)


def test_nearest_ties_and_invalid(spark):
    df = cloud(spark, (NAN, 0, 5), (INF, 0, 5), (1, 0, 5), (-1, 0, 5), (3, 3, 3))
    r = points.nearest(df).collect()
    assert [(x.idx, x.d) for x in r] == [(2, 1.0)]


def test_nearest_of_nothing_has_no_row(spark):
    assert points.nearest(cloud(spark, (NAN, NAN, NAN))).collect() == []
    assert points.nearest(cloud(spark).limit(0)).collect() == []


def test_nearest_of_nothing_is_an_error_if_strict(spark):
    for by in (None, ["cloud_id"]):
        with pytest.raises(Exception, match="no valid point"):
            points.nearest(cloud(spark, (NAN, NAN, NAN)), by=by, strict=True).collect()
        assert points.nearest(cloud(spark, (1, 0, 5), (NAN, 0, 0)), by=by, strict=True).first().idx == 0
    with pytest.raises(Exception, match="no valid point"):
        points.nearest(cloud(spark).limit(0), strict=True).collect()


def test_viewpoint(spark):
    r = points.viewpoint(points.nearest(cloud(spark, (0, 0, 5)))).first()
    assert (r.view_x, r.view_y, r.view_z) == (0, 0, 5)
    r = points.viewpoint(points.nearest(cloud(spark, (0, 0, 1)))).first()
    assert (r.view_x, r.view_y, r.view_z) == (0, 0, 1.5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(-9, 9, width=32), min_size=3, max_size=3), min_size=1, max_size=40))
def test_nearest_equals_numpy(spark, rows):
    a = np.array(rows, float) - np.array(points.CAMERA)
    d = np.sqrt(a[:, 0] * a[:, 0] + a[:, 1] * a[:, 1] + a[:, 2] * a[:, 2])
    assert points.nearest(cloud(spark, *rows)).first().idx == int(d.argmin())


def test_narrow(spark):
    r = points.narrow(cloud(spark, (0.1, 0, 0))).first()
    assert r.x == float(np.float32(0.1)) != 0.1


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f8", "<i4"])
def test_npy_in_ranges(spark, tmp_path, kind):
    flat = np.arange(64).astype(kind)
    np.save(tmp_path / "a.npy", flat)
    rows = read_points(spark, str(tmp_path / "a.npy"), split=3).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(11))
    assert np.array_equal(np.array([r[2:] for r in rows]).ravel()[:64], flat.astype(float))
    assert math.isnan(rows[10].b)


def test_npy_memory_order_folder_and_empty(spark, tmp_path):
    made = np.asfortranarray(np.arange(60.0).reshape(10, 6))
    np.save(tmp_path / "f.npy", made)
    np.save(tmp_path / "none.npy", np.zeros((0, 6)))
    rows = read_points(spark, f"file://{tmp_path}").orderBy("idx").collect()
    assert np.array_equal(np.array([r[2:] for r in rows]).ravel(), made.ravel(order="K"))


def test_npy_of_objects_is_refused(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(Exception, match="no numbers"):
        read_points(spark, str(tmp_path / "o.npy")).collect()


def test_gltf_tiles(spark):
    df = cloud(spark, *((i, -i, 2) for i in range(7)))
    rows = sorted(gltf.tiles(df, per_tile=3).collect(), key=lambda r: r.tile)
    assert [r.n_points for r in rows] == [3, 3, 1]
    made = json.loads(rows[1].gltf)
    raw = base64.b64decode(made["buffers"][0]["uri"].split(",")[1])
    assert len(raw) == made["buffers"][0]["byteLength"]
    assert np.frombuffer(raw, "<f4")[:9].reshape(3, 3).tolist() == [[3, -3, 2], [4, -4, 2], [5, -5, 2]]
    assert made["accessors"][0]["min"] == [3, -5, 2] and made["accessors"][0]["max"] == [5, -3, 2]
    assert made["meshes"][0]["primitives"][0]["mode"] == 0


def test_gltf_written_by_tile(spark, tmp_path):
    gltf.write(cloud(spark, (1, 2, 3), (4, 5, 6)), str(tmp_path / "out"), per_tile=1)
    files = sorted((tmp_path / "out").rglob("part-*.txt"))
    assert len(files) == 2 and all(json.loads(f.read_text())["asset"] == {"version": "2.0"} for f in files)


def test_npy_copies_are_bytes(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12.0))
    r = copies.result_copies(spark, str(tmp_path), "a b  c").first()
    assert r.file == "a_b__c_result.npy" and bytes(r.content) == (tmp_path / "a.npy").read_bytes()


def test_bounds_leave_nan_out(spark):
    r = points.bounds(cloud(spark, (1, 2, 3), (NAN, 4, 1))).first()
    assert (r.min_x, r.max_x, r.max_y, r.min_z, r.n_points) == (1, 1, 4, 1, 2)


def test_splits_stay_pandas_free_of_nan_loss(spark):
    rows = points.split(cloud(spark, (NAN, 1, 2))).collect()
    assert math.isnan(rows[0].position.x) and isinstance(pd.DataFrame(rows), pd.DataFrame)
