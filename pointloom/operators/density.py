"""Density filter of a cloud: core points, clusters and noise for a radius ``eps`` and a least number of points.

An extension: the settings are kept with a project, and what they ask for is computed here. A point is core if at
least ``min_points`` points, itself included, are within ``eps`` of it; core points within eps of each other are one cluster; a point
that is not core belongs to the smallest cluster of a core point within eps, or is noise.

Equal places are one position. Positions lie in cells whose diagonal is under eps, so the points of a cell with
``min_points`` or more are core without a comparison, and core points of a cell are one cluster. Only positions of sparser cells, of which a cell
has fewer than ``min_points``, are compared with the cells around them; a crowded cell's positions are dealt over
tasks by ``BLOCK``. So each point is compared with a bounded number of others, however crowded its cell is. Clusters are components of
cells. Two cells are linked if some core points of theirs are within eps. Cells side by side are linked first where the positions nearest their
centres are, and joined; of all other cells only those that this leaves in different components are looked at: by the corners of the boxes of their 64 parts,
or by one position of each; only parts that may reach each other and settle nothing are compared point by point.

Defined cases: points with a coordinate that is null, NaN or infinite are noise; the cluster's name is its smallest core
point (cloud_id, idx); repeated rows count as often as they are there; coordinates are to be below 10**6 times eps, beyond which
cells have no room in a double; an empty cloud gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.graph import components
from pointloom.shared import cut

#: Positions of a cell that one task compares.
BLOCK = 4096
PARTS = 4
AXES = ("x", "y", "z")
_CELL = [f"c{a}" for a in AXES]


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def _square(one: str, other: str) -> Column:
    x, y, z = (F.col(f"{one}.{a}") - F.col(f"{other}.{a}") for a in AXES)
    return x * x + y * y + z * z


def _gap(low: Column, high: Column, c: Column) -> Column:
    return F.greatest(low - c, c - high, F.lit(0.0))


#: Of the 125 cells around one those that share a side or an edge with it, and of each two that face each other one.
_BESIDE = [i for i in range(63, 125) if max(d := (abs(i // 25 - 2), abs(i // 5 % 5 - 2), abs(i % 5 - 2))) == 1 and sum(d) <= 2]


def _around(ahead: bool, beside: bool = False) -> Column:
    """The cells up to two steps from ``cell`` on each axis, without itself; ``ahead``: of each two that face each other one; ``beside``: of those the ones in ``_BESIDE``."""
    step = "struct(cell.cx + i div 25 - 2 as cx, cell.cy + i div 5 % 5 - 2 as cy, cell.cz + i % 5 - 2 as cz)"
    chosen = f"array({', '.join(map(str, _BESIDE))})" if beside else "sequence(63, 124)" if ahead else "filter(sequence(0, 124), i -> i != 62)"
    return F.expr(f"transform({chosen}, i -> {step})").cast("array<struct<cx:long,cy:long,cz:long>>")


def _total(parts: list[Column]) -> Column:
    x, y, z = parts
    return x * x + y * y + z * z


def positions(points: DataFrame, eps: float) -> DataFrame:
    """p (x, y, z), n, least (smallest cloud_id, idx), cell and part of every place."""
    side = eps / math.sqrt(3) * (1 - 1e-9)
    own = points.where(_finite("x") & _finite("y") & _finite("z")).groupBy(*AXES).agg(F.count("*").alias("n"), F.min(F.struct("cloud_id", "idx")).alias("least"))
    cell = {f"c{a}": F.floor(F.col(a) / side).cast("long") for a in AXES}
    inner = [F.least(F.greatest(F.floor((F.col(a) - F.col(f"c{a}") * side) / (side / PARTS)), F.lit(0)), F.lit(PARTS - 1)) for a in AXES]
    placed = own.withColumns(cell).withColumn("part", (inner[0] * PARTS * PARTS + inner[1] * PARTS + inner[2]).cast("int"))
    return placed.select(F.struct(*AXES).alias("p"), "n", "least", F.struct(*_CELL).alias("cell"), "part")


def reach(some: DataFrame, cells: DataFrame, eps: float, block: int = BLOCK) -> DataFrame:
    """``some`` positions (p, cell, others) beside each other cell of ``cells`` (cell, held) whose box is within eps: with ``at`` and ``slot``, once for each of the cell's blocks."""
    side = eps / math.sqrt(3) * (1 - 1e-9)
    away = lambda at: _total([_gap(at[c] * side, (at[c] + 1) * side, F.col(f"p.{a}")) for a, c in zip(AXES, _CELL, strict=True)])
    probes = some.withColumn("at", F.explode(F.filter(_around(False), lambda at: away(at) <= eps * eps * (1 + 1e-6))))
    sizes = cells.select(F.col("cell").alias("at"), F.ceil(F.col("held") / block).cast("int").alias("slots"))
    return probes.join(sizes, "at").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")


def dealt(own: DataFrame, cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Positions as the other side of ``reach``: at, slot, q and their other columns."""
    crowded = cells.where(F.col("held") > block).select("cell", F.ceil(F.col("held") / block).cast("int").alias("slots"))
    slot = F.pmod(F.xxhash64("p"), F.coalesce("slots", F.lit(1))).cast("int")
    return own.join(crowded, "cell", "left").select(F.col("cell").alias("at"), slot.alias("slot"), F.col("p").alias("q"), *(c for c in own.columns if c not in ("p", "cell")))


def beside_links(core: DataFrame, eps: float) -> DataFrame:
    """a, b for cells side by side whose core positions (p, cell) nearest the cells' centres are within eps."""
    side = eps / math.sqrt(3) * (1 - 1e-9)
    off = _total([(F.col(f"cell.{c}") + 0.5) * side - F.col(f"p.{a}") for a, c in zip(AXES, _CELL, strict=True)])
    ones = cut(core.groupBy("cell").agg(F.min(F.struct(off.alias("off"), "p")).getField("p").alias("one")))
    ahead = ones.select(F.col("cell").alias("a"), F.col("one").alias("a_one"), F.explode(_around(True, True)).alias("b"))
    return ahead.join(ones.select(F.col("cell").alias("b"), F.col("one").alias("b_one")), "b").where(_square("a_one", "b_one") <= eps * eps).select("a", "b")


def cell_components(core: DataFrame, eps: float, block: int = BLOCK) -> DataFrame:
    """node, root for every cell with core positions (p, cell, part): those linked by any way have one root."""
    first = components(core.select(F.col("cell").alias("node")).distinct(), beside_links(core, eps))
    of = lambda s: first.select(F.col("node").alias(s), F.col("root").alias(f"{s}_root"))
    ahead = first.select(F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("node").alias("cell")).withColumn("b", F.explode(_around(True))).drop("cell")
    apart = cut(ahead.join(of("b"), "b").where("a_root != b_root").select("a", "b"))
    links = cell_links(core, eps, block, apart)
    joined = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    second = components(first.select(F.col("root").alias("node")).distinct(), joined.distinct())
    return first.withColumnRenamed("root", "first").join(second.select(F.col("node").alias("first"), "root"), "first").select("node", "root")


def cell_links(core: DataFrame, eps: float, block: int = BLOCK, pairs: DataFrame | None = None) -> DataFrame:
    """a, b (cells) for all pairs of cells, or all of ``pairs``, with core positions (p, cell, part) within eps of each other."""
    if pairs is not None:  # only cells of the pairs
        core = core.join(pairs.select(F.col("a").alias("cell")).union(pairs.select("b")).distinct(), "cell", "left_semi")
    sides = [f(f"p.{a}").alias(f"{name}_{a}") for a in AXES for name, f in (("low", F.min), ("high", F.max))]
    boxes = cut(core.groupBy("cell", "part").agg(*sides, F.min("p").alias("one"), F.count("*").alias("held")))
    if pairs is None:
        cells = boxes.select("cell").distinct()
        pairs = cells.select(F.col("cell").alias("a"), F.explode(_around(True)).alias("b")).join(cells.select(F.col("cell").alias("b")), "b")
    side = lambda s: boxes.select(F.col("cell").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in boxes.columns if c != "cell"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    c = lambda s, name, axis: F.col(f"{s}_{name}_{axis}")
    nearest = _total([F.greatest(c("a", "low", x) - c("b", "high", x), c("b", "low", x) - c("a", "high", x), F.lit(0.0)) for x in AXES])
    farthest = _total([F.greatest(c("a", "high", x) - c("b", "low", x), c("b", "high", x) - c("a", "low", x)) for x in AXES])
    sure = (farthest <= eps * eps * (1 - 1e-12)) | (_square("a_one", "b_one") <= eps * eps)
    may = cut(both.where(nearest <= eps * eps * (1 + 1e-12)).select("a", "b", "a_part", "b_part", F.col("b_held").alias("held"), sure.alias("sure")))
    settled = may.where("sure").select("a", "b").distinct()
    rest = may.join(settled, ["a", "b"], "left_anti").withColumn("slots", F.ceil(F.col("held") / block).cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    crowded = boxes.where(F.col("held") > block).select("cell", "part", F.ceil(F.col("held") / block).cast("int").alias("slots"))
    left = core.select(F.col("cell").alias("a"), F.col("part").alias("a_part"), "p")
    right = core.join(crowded, ["cell", "part"], "left").select(F.col("cell").alias("b"), F.col("part").alias("b_part"), F.col("p").alias("q"), F.pmod(F.xxhash64("p"), F.coalesce("slots", F.lit(1))).cast("int").alias("slot"))
    met = rest.select("a", "b", "a_part", "b_part", "slot").join(left, ["a", "a_part"]).join(right, ["b", "b_part", "slot"]).where(_square("p", "q") <= eps * eps)
    return settled.unionByName(met.select("a", "b").distinct())


def clusters(points: DataFrame, eps: float, min_points: int, block: int = BLOCK) -> DataFrame:
    """cloud_id, idx, core, noise and cluster (cloud_id, idx; null for noise) of every row of ``points``."""
    own = cut(positions(points, eps))
    cells = cut(own.groupBy("cell").agg(F.sum("n").alias("total"), F.count("*").alias("held")))
    near = own.join(cells.select("cell", "total"), "cell")
    sparse = near.where(F.col("total") < min_points)
    beside = reach(sparse.select("p", "cell"), cells, eps, block).join(dealt(own.select("p", "cell", "n"), cells, block), ["at", "slot"])
    counted = beside.where(_square("p", "q") <= eps * eps).groupBy("p").agg(F.sum("n").alias("beside"))
    is_core = F.col("total") + F.coalesce("beside", F.lit(0)) >= min_points
    judged = cut(near.join(counted, "p", "left").select("p", "least", "cell", "part", is_core.alias("core")))
    core = judged.where("core")
    named = core.groupBy("cell").agg(F.min("least").alias("name"), F.count("*").alias("held"))
    nodes = cut(named)
    found = cell_components(core, eps, block)
    # a component is called by its smallest core point
    rooted = nodes.join(found, nodes["cell"] == found["node"]).select("cell", "held", "root", "name")
    names = rooted.groupBy("root").agg(F.min("name").alias("cluster"))
    rooted = cut(rooted.join(names, "root").select("cell", "held", "cluster"))
    inside = judged.join(rooted.select("cell", F.col("cluster").alias("within")), "cell", "left")
    edge = inside.where(~F.col("core")).select("p", "cell")
    across = reach(edge, rooted, eps, block).join(dealt(core.select("p", "cell").join(rooted.select("cell", "cluster"), "cell"), rooted, block), ["at", "slot"])
    touched = across.where(_square("p", "q") <= eps * eps).groupBy("p").agg(F.min("cluster").alias("touched"))
    both = inside.join(touched, "p", "left").select("p", "core", F.when(F.col("core"), F.col("within")).otherwise(F.least("within", "touched")).alias("cluster"))
    keyed = both.select(*(F.col(f"p.{a}").alias(a) for a in AXES), "core", "cluster")
    out = points.select("cloud_id", "idx", *AXES).join(keyed, list(AXES), "left")
    return out.select("cloud_id", "idx", F.coalesce("core", F.lit(False)).alias("core"), F.col("cluster").isNull().alias("noise"), "cluster")


def without_noise(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """``points`` (cloud_id and idx tell them apart) without noise."""
    kept = clusters(points, eps, min_points).where("not noise").select("cloud_id", "idx").distinct()
    return points.join(kept, ["cloud_id", "idx"], "left_semi")
