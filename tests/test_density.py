"""Density clusters against all pairs, and what a crowded cell costs."""

from __future__ import annotations

import random

import pytest
from pointloom.operators import density
from pointloom.operators.graph import components
from pyspark.sql import functions as F

POINT = "cloud_id long, idx long, x double, y double, z double"


def brute(points: list[tuple], eps: float, least: int) -> dict:
    """(cloud_id, idx) to (core, cluster or None), by all pairs."""
    ok = [p for p in points if all(c is not None and c == c and abs(c) < float("inf") for c in p[2:])]
    near = [[j for j, q in enumerate(ok) if (p[2] - q[2]) * (p[2] - q[2]) + (p[3] - q[3]) * (p[3] - q[3]) + (p[4] - q[4]) * (p[4] - q[4]) <= eps * eps] for p in ok]
    core, label = [len(n) >= least for n in near], {}
    for i in sorted(range(len(ok)), key=lambda i: ok[i][:2]):
        todo = [i] if core[i] and i not in label else []
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = ok[i][:2]
                todo += [k for k in near[j] if core[k] and k not in label]
    out = {p[:2]: (False, None) for p in points}
    for i, p in enumerate(ok):
        reached = [label[j] for j in near[i] if core[j]]
        out[p[:2]] = (core[i], min(reached, default=None))
    return out


def found(spark, points: list[tuple], eps: float, least: int, **more) -> dict:
    rows = density.clusters(spark.createDataFrame(points, POINT), eps, least, **more).collect()
    assert len(rows) == len(points) and all(r.noise == (r.cluster is None) for r in rows)
    return {(r.cloud_id, r.idx): (r.core, tuple(r.cluster) if r.cluster else None) for r in rows}


@pytest.mark.parametrize("seed, eps, least, block", [(1, 0.6, 4, 4096), (2, 1.0, 6, 3)])
def test_clusters_equal_all_pairs(spark, seed, eps, least, block):
    own = random.Random(seed)
    points = [(own.randrange(3), i, *(own.choice([own.uniform(-3, 3), own.gauss(2, 0.3), own.randrange(-6, 7) / 4]) for _ in range(3))) for i in range(220)]
    points += [(5, 1, None, 0.0, 0.0), (5, 2, float("nan"), 0.0, 0.0), (5, 3, float("inf"), 0.0, 0.0), (5, 4, -0.0, 0.0, 0.0), (5, 5, 0.0, -0.0, 0.0)]
    assert found(spark, points, eps, least, block=block) == brute(points, eps, least)


def test_chains_and_gaps(spark):
    line = [(0, i, i * 0.99, 0.0, 0.0) for i in range(60)] + [(1, i, 70 + i * 1.01, 0.0, 0.0) for i in range(20)] + [(2, 0, 0.5, 0.9, 0.0)]
    assert found(spark, line, 1.0, 2) == brute(line, 1.0, 2)
    slabs = [(0, i, (i % 12) * 0.05, (i // 12) * 0.05, 0.0) for i in range(144)] + [(1, i, (i % 12) * 0.05, (i // 12) * 0.05, 1.0 + 1e-9) for i in range(144)]
    assert len({c for _, c in found(spark, slabs, 1.0, 5).values()}) == 2


def test_empty_and_lonely_clouds(spark):
    assert density.clusters(spark.createDataFrame([], POINT), 1.0, 3).count() == 0
    assert found(spark, [(0, 0, 1.0, 1.0, 1.0)], 1.0, 1) == {(0, 0): (True, (0, 0))}
    assert found(spark, [(0, 0, 1.0, 1.0, 1.0)], 1.0, 2) == {(0, 0): (False, None)}
    kept = density.without_noise(spark.createDataFrame([(0, i, i * 10.0 if i < 3 else 50.0, 0.0, 0.0) for i in range(8)], POINT), 1.0, 4)
    assert sorted(r.idx for r in kept.collect()) == [3, 4, 5, 6, 7]


def test_a_crowded_cell_is_dealt_and_not_compared(spark):
    """100,000 points in one cell, as many at one place, and a few around: all core, one cluster; the cell's positions are in many slots."""
    cell = spark.range(100_000).select(F.lit(0).cast("long").alias("cloud_id"), F.col("id").alias("idx"), (F.rand(1) * 0.1).alias("x"), (F.rand(2) * 0.1).alias("y"), (F.rand(3) * 0.1).alias("z"))
    place = spark.range(100_000).select(F.lit(1).cast("long").alias("cloud_id"), F.col("id").alias("idx"), *(F.lit(9.0).alias(c) for c in "xyz"))
    few = spark.createDataFrame([(2, i, 0.6 + 0.01 * i, 0.0, 0.0) for i in range(4)], POINT)
    points = cell.union(place).union(few).repartition(8)
    rows = density.clusters(points, 1.0, 50).groupBy("cloud_id", "core", "cluster").count().collect()
    assert sorted((r.cloud_id, r.core, tuple(r.cluster), r["count"]) for r in rows) == [(0, True, (0, 0), 100_000), (1, True, (1, 0), 100_000), (2, True, (0, 0), 4)]
    own = density.positions(points, 1.0)
    cells = own.groupBy("cell").agg(F.count("*").alias("held"))
    slots = density.dealt(own.select("p", "cell", "n"), cells).groupBy("at", "slot").count()
    assert slots.agg(F.max("count")).first()[0] < 2 * density.BLOCK and slots.count() > 20


def test_components_of_long_chains_and_stars(spark):
    chain, star = [(i, i + 1) for i in range(500)], [(1000, 1000 + i) for i in range(1, 300)]
    nodes = spark.createDataFrame([(i,) for i in [*range(501), *range(1000, 1300), 5000]], "node long")
    edges = spark.createDataFrame(chain + star + [(7, 7), (9000, 9001)], "a long, b long")
    roots = {r.node: r.root for r in components(nodes, edges).collect()}
    assert roots == {**{i: 0 for i in range(501)}, **{i: 1000 for i in range(1000, 1300)}, 5000: 5000}


def test_a_dense_cloud_compares_few_parts(spark):
    """Cells that neighbours join are not compared by parts: without that each pair of cells costs up to 4,096 pairs of parts."""
    points = spark.range(20_000).select(F.lit(0).cast("long").alias("cloud_id"), F.col("id").alias("idx"), *(F.rand(k).alias(c) for k, c in enumerate("xyz", 1)), F.lit(True).alias("core"))
    core = density.positions(points, 0.35).cache()
    cells = core.select("cell").distinct().count()
    assert density.beside_links(core, 0.35).count() > cells  # most cells are linked side by side
    plain = {(r.a, r.b) for r in density.cell_links(core, 0.35).collect()}
    assert {(r.a, r.b) for r in density.beside_links(core, 0.35).collect()} <= plain
    seen = []
    links = density.cell_links
    try:
        density.cell_links = lambda core, eps, block, pairs: seen.append(pairs.count()) or links(core, eps, block, pairs)
        roots = {r.root for r in density.cell_components(core, 0.35).collect()}
    finally:
        density.cell_links = links
    assert len(roots) == 1 and seen[0] < cells < len(plain) / 10
