"""Queries of the point-cloud and project operators over the driver's tables, with SQL that says the same.

The tables hold no clouds or projects, so other columns stand in: embeddings for arrays of
points, orders for projects, parts for files, events for progress messages.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import routes, text, vectors
from pointloom.operators import config, density, files, octree, points, progress, projects
from pointloom.operators.stored import ProjectStore
from pointloom.shared import shared_dir
from pointloom.sinks import copies, gltf, tiletree
from pointloom.sinks.files import spread, write_objects
from pointloom.sources import eventstream, listing, objects, samples
from pointloom.sources.npy import read_points
from pointloom.streaming import progress as stream
from pointloom.streaming import recovery, timed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.reshape(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", None)


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as projects: O is idle, P processing, F completed; dates keep their type."""
    status = F.when(F.col("o_orderstatus") == "O", "idle").when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "completed")
    return _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("projectId"), F.col("o_orderpriority").alias("projectName"), F.col("o_orderdate").alias("projectDate"),
        status.alias("projectStatus"), F.col("o_totalprice").alias("projectProgress"), F.to_json(F.struct(F.col("o_totalprice").alias("fx"))).alias("projectConfig"),
    )


#: SQL of the stand-ins.
_CLOUDS = """(select vec_id as cloud_id, i as idx, embedding[i*6+1]::double as x, embedding[i*6+2]::double as y, embedding[i*6+3]::double as z,
  embedding[i*6+4]::double as r, embedding[i*6+5]::double as g, embedding[i*6+6]::double as b
  from (select vec_id, embedding, unnest(range(0, ((len(embedding) + 5) // 6)::bigint)) as i from embeddings where len(embedding) > 0))"""
_DISTANCES = f"(select *, sqrt((x-0)*(x-0) + (y-0)*(y-0) + (z-5)*(z-5)) as d from {_CLOUDS} where x is not null and y is not null and z is not null)"
_PROJECTS = """(select o_custkey as user_id, o_orderkey as "projectId", o_orderpriority as "projectName", o_orderdate as "projectDate",
  case o_orderstatus when 'O' then 'idle' when 'P' then 'processing' when 'F' then 'completed' end as "projectStatus", o_totalprice as "projectProgress" from orders)"""
_LOCAL = "strftime({}, '%-m/%-d/%Y %-I:%M:%S %p')"
_CAPITAL = "upper({0}[1]) || {0}[2:]"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


@query(f"select * from {_CLOUDS}")
def point_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clouds(spark, sf_dir)


@query(f"select cloud_id, idx, x as px, y as py, z as pz, r as cr, g as cg, b as cb from {_CLOUDS}")
def point_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.split(_clouds(spark, sf_dir)).select("cloud_id", "idx", *(F.col(f"position.{c}").alias(f"p{c}") for c in "xyz"), *(F.col(f"colour.{c}").alias(f"c{c}") for c in "rgb"))


@query("""select l_orderkey as cloud_id, l_linenumber::bigint as idx, (l_extendedprice / 7)::float::double as x, l_quantity::float::double as y, l_discount::float::double as z,
  (l_discount::float::double = l_discount) as same from lineitem""")
def float32_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cloud_id"), F.col("l_linenumber").cast("long").alias("idx"), (F.col("l_extendedprice") / 7).alias("x"), F.col("l_quantity").alias("y"),
        F.col("l_discount").alias("z"), *(F.lit(0.0).alias(c) for c in "rgb"), F.col("l_discount").alias("wide"),
    )
    narrow = points.narrow(own)
    return narrow.select("cloud_id", "idx", *(F.col(c).cast("double").alias(c) for c in "xyz"), (F.col("z").cast("double") == F.col("wide")).alias("same"))


@query(f"select round(d, 6) as d, idx, cloud_id, x, y, z from (select *, row_number() over (order by d, idx, cloud_id) as n from {_DISTANCES}) where n = 1")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(points.nearest(_clouds(spark, sf_dir)), "d")


@query(f"select cloud_id, round(d, 6) as d, idx, x, y, z from (select *, row_number() over (partition by cloud_id order by d, idx) as n from {_DISTANCES}) where n = 1")
def nearest_per_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(points.nearest(_clouds(spark, sf_dir), by=["cloud_id"]), "d")


@query(f"""select round(d, 6) as d, idx, cloud_id, x, y, z, round(x + 0.5 * (0 - x) / d, 6) as view_x, round(y + 0.5 * (0 - y) / d, 6) as view_y, round(z + 0.5 * (5 - z) / d, 6) as view_z
  from (select *, row_number() over (order by d, idx, cloud_id) as n from {_DISTANCES}) where n = 1""")
def camera_standoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(points.viewpoint(points.nearest(_clouds(spark, sf_dir))), "d", "view_x", "view_y", "view_z")


@query(f"select cloud_id, {', '.join(f'{f}({c})::float::double as {f}_{c}' for c in 'xyz' for f in ('min', 'max'))}, count(*) as n_points from {_CLOUDS} group by cloud_id")
def cloud_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points.bounds(_clouds(spark, sf_dir), ["cloud_id"])
    return found.withColumns({c: F.col(c).cast("double") for c, kind in found.dtypes if kind == "float"})


@query("select p_partkey, round(p_size / p_retailprice, 9) as aspect, 200.0 - p_size as depth_min, p_size * 10.0 as focal, case when p_size = 1 then p_retailprice / 2 else p_size end::double as cx from part")
def camera_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    unset = F.when(size == 1, -1.0).otherwise(size)
    return _table(spark, sf_dir, "part").select(
        "p_partkey", F.round(vectors.aspect(size, price), 9).alias("aspect"), vectors.nearest_depth(F.lit(200.0), size).alias("depth_min"), vectors.focal_from_mm(size).alias("focal"), vectors.centre(unset, price).alias("cx")
    )


@query(f'select "projectId", case "projectStatus" when \'idle\' then 1 when \'processing\' then 3 when \'completed\' then 4 else 0 end as stage from {_PROJECTS}')
def status_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projects(spark, sf_dir).select("projectId", projects.stage(F.col("projectStatus")).alias("stage"))


@query(f"select event_id, {_CAPITAL.format('event_type')} as status from events")
def capitalise_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", text.capitalised(F.col("event_type")).alias("status"))


_STATUS = _CAPITAL.format('"projectStatus"')
_DATE = _LOCAL.format('"projectDate"')


@query(f'select "projectId", "projectName", {_DATE} as date, {_STATUS} as status from {_PROJECTS}')
def list_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.list_rows(_projects(spark, sf_dir))


@query(f'select "projectName", {_DATE} as date, "projectId" % 101 || \'%\' as progress, {_STATUS} as status from {_PROJECTS}')
def detail_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.detail_rows(_projects(spark, sf_dir).withColumn("projectProgress", (F.col("projectId") % 101).cast("int")))


@query("select page_id, list_extract(string_split(url, '/'), -1) as name from pages where url is not null")
def path_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").where("url is not null").select("page_id", text.basename(F.col("url")).alias("name"))


#: Parts as files: the extension follows from the key, every seventh has none.
_FILES = "(select p_partkey, case when p_partkey % 7 = 0 then p_name else p_name || '.v' || p_size || ['.PNG', '.jpg', '.gif', '.jpeg'][p_partkey % 4 + 1] end as name from part)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, (".PNG", ".jpg", ".gif", ".jpeg")))
    full = F.concat("p_name", F.lit(".v"), F.col("p_size").cast("string"), F.get(kinds, (F.col("p_partkey") % 4).cast("int")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(full).alias("name"))


@query(f"select p_partkey, name from {_FILES} where lower(list_extract(string_split(name, '.'), -1)) in ('jpg', 'jpeg', 'png')")
def ext_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.only_images(_files(spark, sf_dir))


@query(f"select p_partkey, name from {_FILES} where lower(list_extract(string_split(name, '.'), -1)) not in ('jpg', 'jpeg', 'png')")
def ext_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rejected_images(_files(spark, sf_dir))


@query("select p_partkey, p_type as kind from part where p_type = 'SMALL'")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_type") == "SMALL", "file").otherwise(F.col("p_type")).alias("kind"))
    return files.only_files(own).withColumn("kind", F.lit("SMALL"))


#: Names of parts with a number: every other key has its number 1, every fourth also 2.
_OLD = """(select distinct name from (select p_name || '.png' as name from part union all select p_name || '_1.png' from part where p_partkey % 2 = 0 and p_size < 40
  union all select p_name || '_2.png' from part where p_partkey % 4 = 0 and p_size < 30 union all select p_name || '_4.png' from part where p_size > 45))"""


@query(f"""select p_partkey, p_name || '.png' as name, p_name || '_' || (select min(k) from range(1, 7) as t(k) where not exists (select 1 from {_OLD} o where o.name = p_name || '_' || k || '.png')) || '.png' as new_name from part
  union all select p_partkey, p_name || '.webp', p_name || '.webp' from part""")
def collision_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    of = lambda rows, end: rows.select(F.concat("p_name", F.lit(end)).alias("name"))
    old = of(part, ".png").union(of(part.where("p_partkey % 2 = 0 and p_size < 40"), "_1.png")).union(of(part.where("p_partkey % 4 = 0 and p_size < 30"), "_2.png")).union(of(part.where("p_size > 45"), "_4.png"))
    new = part.select("p_partkey", F.explode(F.array(*(F.concat("p_name", F.lit(e)) for e in (".png", ".webp")))).alias("name"))
    return files.rename_collisions(new, old)


#: A batch of names with many equal ones, and the names that are there.
_BATCH = "(select p_partkey - 1 as pos, 'img' || p_size || case when p_partkey % 3 = 0 then '_' || p_partkey % 7 else '' end || '.png' as name from part)"
_THERE = "(select distinct 'img' || p_size || '_' || p_partkey % 5 || '.png' as name from part where p_size % 2 = 0)"


@query(f"""with b as (select *, regexp_extract(name, '(.*)[.]png', 1) as stem from {_BATCH}),
  n as (select *, name in (select name from {_THERE}) as held, row_number() over (partition by name order by pos) as turn from b),
  j as (select pos, name, stem, row_number() over (partition by name order by pos) as j from n where held or turn > 1),
  f as (select stem, k, row_number() over (partition by stem order by k) as j from (select distinct stem from j), range(1, (select count(*) + 1 from b)) as t(k)
    where not exists (select 1 from (select name from b union all select name from {_THERE}) x where x.name = stem || '_' || k || '.png'))
  select n.pos, n.name, case when j.j is null then n.name else n.stem || '_' || f.k || '.png' end as new_name from n left join j on j.pos = n.pos left join f on f.stem = j.stem and f.j = j.j""")
def batch_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = _table(spark, sf_dir, "part"), F.col("p_partkey")
    said = lambda number: F.concat(F.lit("img"), F.col("p_size").cast("string"), number, F.lit(".png"))
    new = part.select((key - 1).alias("pos"), said(F.when(key % 3 == 0, F.concat(F.lit("_"), (key % 7).cast("string"))).otherwise("")).alias("name"))
    return files.rename_apart(new, part.where("p_size % 2 = 0").select(said(F.concat(F.lit("_"), (key % 5).cast("string"))).alias("name")))


@query("select p_partkey, replace(p_name, ' ', '_') || '_result.npy' as npy, replace(p_name, ' ', '_') || '_result.gltf' as gltf from part")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text.result_file(F.col("p_name"), "npy").alias("npy"), text.result_file(F.col("p_name"), "gltf").alias("gltf"))


@query("select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, role from conversations where turn <> 1")
def remove_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.remove_at(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 1, "turn")


@query("""select conv_id, turn, role from conversations union all
  select c.conv_id, c.turn + n.n, 'again' from conversations c join (select conv_id, count(*) as n from conversations group by conv_id) n using (conv_id) where c.turn < 2""")
def append_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return files.append(own, own.where("turn < 2").withColumn("role", F.lit("again")), "conv_id", "turn")


@query("select url as key, page_id from pages where starts_with(url, 'http://blog') order by url, page_id limit 1000")
def prefix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.listing(_table(spark, sf_dir, "pages").select(F.col("url").alias("key"), "page_id"), "http://blog", files.PAGE, strict=True)


#: Parts as stored images of five users, each in one of the folders rgb and rgb2.
_STORED = "(select *, 'user-' || p_size % 5 || '/p/' || case when p_partkey % 2 = 0 then 'rgb' else 'rgb2' end || '/' || p_name || '.png' as key from part)"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("p_partkey") % 2 == 0, "rgb").otherwise("rgb2")
    return _table(spark, sf_dir, "part").withColumn("key", F.concat(F.lit("user-"), (F.col("p_size") % 5).cast("string"), F.lit("/p/"), folder, F.lit("/"), "p_name", F.lit(".png")))


@query(f"select p_partkey, key, p_name || '.png' as name from {_STORED} where starts_with(key, 'user-3/p/rgb/')")
def folder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.named(files.listing(_stored(spark, sf_dir).select("p_partkey", "key"), "user-3/p/rgb")).drop("mime")


@query(f"select p_partkey, key from {_STORED} where starts_with(key, 'user-3/p/rgb')")
def folder_list_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.listing(_stored(spark, sf_dir).select("p_partkey", "key"), "user-3/p/rgb", strict=True)


@query("select page_id, list_extract(string_split(url, '/'), -1) as name, 'image/jpeg' as mime from pages where starts_with(url, 'https://')")
def prefix_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "pages").select(F.col("url").alias("key"), "page_id")
    return files.named(files.listing(own, "https://", strict=True)).select("page_id", "name", "mime")


@query("select conv_id, count(*) as n_images, count(*) >= 8 as enough from conversations group by conv_id")
def enough_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.has_enough(_table(spark, sf_dir, "conversations"), "conv_id", 8)


@query("select c_custkey as user_id, count(o_orderkey) as n_images, count(o_orderkey) >= 1 as enough from customer left join orders on o_custkey = c_custkey group by c_custkey")
def any_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects and orders as their images: a third have none."""
    owners = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return files.has_enough(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")), "user_id", owners=owners)


@query("""select l_orderkey, l_partkey, l_returnflag from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')
  union all select o_orderkey, o_custkey, 'new' from orders where o_orderstatus = 'F' and o_totalprice > 100000""")
def image_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the images of orders; those of completed orders are replaced by one or by none."""
    own = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = _table(spark, sf_dir, "orders")
    hit = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_partkey"), F.lit("new").alias("l_returnflag"))
    return files.images_replaced(own, hit, new, ["l_orderkey"])


@query("""select user_id, "projectId", case when "projectId" % 3 = 0 then 'ready' else 'error' end as state from """ + _PROJECTS)
def result_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _projects(spark, sf_dir)
    there = own.where("projectId % 3 = 0").select(text.cloud_key(F.col("user_id"), F.col("projectId")).alias("key"))
    return projects.result_states(own, there)


@query("""select "projectId", 'user-' || user_id || '/' || "projectId" || '/output/accumulated_numpy.npy' as cloud, 'user-' || user_id || '/' || "projectId" || '/rgb' as images,
  'https://api/process_image/' || user_id || '/' || "projectId" as progress, 'https://api/getProjectDetails/' || user_id || '/' || "projectId" || '?detail=status' as detail from """ + _PROJECTS)
def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, project = F.col("user_id"), F.col("projectId")
    return _projects(spark, sf_dir).select(
        "projectId", text.cloud_key(user, project).alias("cloud"), text.image_prefix(user, project).alias("images"),
        text.progress_url("https://api/", user, project).alias("progress"), text.detail_url("https://api", user, project, "status").alias("detail"),
    )


@query("select event_id, event_type <> 'view' as has_fields from events")
def nonempty_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "events")
    return own.select("event_id", text.has_fields(F.when(F.col("event_type") == "view", "{}").otherwise(F.col("props"))).alias("has_fields"))


@query('select "projectId", "projectName", "projectStatus" from ' + _PROJECTS + " where user_id = 7")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.of_user(_projects(spark, sf_dir), 7).select("projectId", "projectName", "projectStatus")


@query(f"""select p."projectId", "projectStatus" as status, case when p."projectId" % 2 = 0 then '{{"fx":' || p."projectId" || '}}' end as config, "projectName" as name, "projectDate" as date, "projectStatus" as full_status, "projectProgress" as progress
  from {_PROJECTS} p where user_id = 899""")
def detail_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the three modes for all projects of a user."""
    key = F.col("projectId")
    own = _projects(spark, sf_dir).withColumn("projectConfig", F.when(key % 2 == 0, F.concat(F.lit('{"fx":'), key.cast("string"), F.lit("}"))))
    keys = projects.of_user(own, 899).select("user_id", "projectId")
    status, full = (projects.details_of(keys, own, mode) for mode in ("status", "full"))
    settings = projects.details_of(keys, own, "config").withColumnRenamed("projectConfig", "config")
    both = status.withColumnRenamed("projectStatus", "status").join(settings, ["user_id", "projectId"]).join(full, ["user_id", "projectId"])
    return both.select("projectId", "status", "config", F.col("projectName").alias("name"), F.col("projectDate").alias("date"), F.col("projectStatus").alias("full_status"), F.col("projectProgress").alias("progress"))


@query(f'select c_custkey as user_id, k as "projectId", "projectStatus" from (select c_custkey, unnest([c_custkey, c_custkey + 1]) as k from customer) left join {_PROJECTS} p on p.user_id = c_custkey and p."projectId" = k')
def batch_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1)).alias("projectId"))
    return projects.details_of(keys, _projects(spark, sf_dir), "status").select("user_id", "projectId", "projectStatus")


@query(f"""select user_id, "projectId", case when "projectId" % 11 = 0 then 'new name' else "projectName" end as "projectName",
  case when "projectId" % 7 = 0 then 'processing' when "projectId" % 5 = 0 then 'config' else "projectStatus" end as "projectStatus",
  case when "projectId" % 7 = 0 then 0.0 else "projectProgress" end as "projectProgress" from {_PROJECTS} where "projectId" % 3 <> 0
  union all select c_custkey, c_custkey, c_name, 'idle', null from customer where c_custkey % 2 = 0""")
def project_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("projectId")
    own = projects.deleted(_projects(spark, sf_dir).drop("projectConfig", "projectDate").withColumn("projectDate", F.lit(None).cast("timestamp")), key % 3 == 0)
    own = projects.restarted(projects.with_status(projects.renamed(own, key % 11 == 0, "new name"), key % 5 == 0, "config"), key % 7 == 0)
    own = projects.renamed(own, key % 2 == 0, " \t")  # blank: nothing changes
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("  ")
    new = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("projectId"), name.alias("projectName"), F.lit(None).cast("timestamp").alias("projectDate"))
    return projects.created(own, new).drop("projectDate")


@query(f"""select p.user_id, p."projectId", case when k = 0 then 'again ' || p."projectId" else "projectName" end as "projectName",
  case when k = 1 then 'error' when k = 2 then 'processing' else "projectStatus" end as "projectStatus", case when k = 2 then 0.0 else "projectProgress" end as "projectProgress"
  , case when k = 4 then '{{"fx":' || "projectId" || '}}' else '{{}}' end as "projectConfig"
  from (select *, case when "projectId" % 4 = 0 then ("projectId" // 4) % 6 end as k from {_PROJECTS}) p where k is distinct from 3""")
def project_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _projects(spark, sf_dir).drop("projectDate").withColumn("projectConfig", F.lit("{}"))
    action = F.get(F.array(*map(F.lit, ("rename", "status", "restart", "delete", "config", "nothing"))), F.floor(F.col("projectId") / 4).cast("int") % 6)
    key = F.col("projectId").cast("string")
    value = F.when(action == "rename", F.concat(F.lit("again "), key)).when(action == "status", "error").when(action == "config", F.concat(F.lit('{"fx":'), key, F.lit("}")))
    return projects.updated(own, own.where("projectId % 4 = 0").select("user_id", "projectId", action.alias("action"), value.alias("value")))


#: Settings as JSON from events: a number, the same as text, blank and junk in turn.
_SETTING = """(select event_id, event_id % 4 as how, json_extract_string(props, '$.k') as k from events)"""


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of which fx, fy, eps and minPts follow the event, three are set and one is missing."""
    k = F.get_json_object("props", "$.k")
    how = F.col("event_id") % 4
    said = F.when(how == 0, k).when(how == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(how == 2, F.lit('" "')).otherwise(F.concat(F.lit('"'), k, F.lit('d"')))
    json = F.concat(F.lit('{"cx": -1, "cy": "-1", "depthMin": 0.5'), *(x for f in ("fx", "fy", "eps", "minPts") for x in (F.lit(f', "{f}": '), said)), F.lit("}"))
    return _table(spark, sf_dir, "events").select("event_id", config.parse(json).alias("settings"))


_NUMBER = "case how when 0 then k::double when 1 then k::double when 2 then 0 end"


@query(f"""select event_id, 0.5::double as "depthMin", null::double as "depthMax", {_NUMBER} as fx, {_NUMBER} as fy, -1.0::double as cx, -1.0::double as cy, {_NUMBER} as eps, {_NUMBER} as "minPts" from {_SETTING}""")
def config_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settings(spark, sf_dir).select("event_id", config.coerced(F.col("settings")).alias("s")).select("event_id", "s.*")


@query(f"""select event_id, case how when 2 then ' ' when 3 then k || 'd' else k end as fx, {_NUMBER} as fx_number, '-1' as cx, 'edited ' || event_id as "depthMax", null::double as depth_number from {_SETTING}""")
def config_set_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = config.with_field(F.col("settings"), "depthMax", F.concat(F.lit("edited "), F.col("event_id").cast("string")))
    own = _settings(spark, sf_dir).select("event_id", edited.alias("s")).withColumn("n", config.coerced(F.col("s")))
    return own.select("event_id", "s.fx", F.col("n.fx").alias("fx_number"), "s.cx", "s.depthMax", F.col("n.depthMax").alias("depth_number"))


_SAVED = "case how when 2 then '0.0' when 3 then 'null' else k || '.0' end"


@query(f"""select event_id, '{{"depthMin":0.5,"depthMax":null,"fx":' || {_SAVED} || ',"fy":' || {_SAVED} || ',"cx":-1.0,"cy":-1.0,"eps":' || {_SAVED} || ',"minPts":' || {_SAVED} || '}}' as saved from {_SETTING}""")
def config_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settings(spark, sf_dir).select("event_id", config.saved(config.coerced(F.col("settings"))).alias("saved"))


@query("select r_name as name, (r_regionkey * 10)::double as \"depthMin\", 150.5::double as \"depthMax\", 1000.0::double as fx, null::double as cy from region")
def sample_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as samples: their settings are written as JSON files in the shared folder and read back."""
    place = f"{shared_dir(spark)}/samples-{uuid.uuid4().hex}"
    own = _table(spark, sf_dir, "region").select(F.format_string('{"%s": {"depthMin": %d,\n "depthMax": 150.5, "fx": 1000}}', "r_name", F.col("r_regionkey") * 10).alias("value"), "r_name")
    own.write.partitionBy("r_name").text(place)
    return config.sample_settings(spark, f"{place}/*/*.txt").select("name", "settings.depthMin", "settings.depthMax", "settings.fx", "settings.cy")


def _messages(events: DataFrame, *more: str) -> DataFrame:
    said = F.when(F.col("event_type") == "signup", progress.READY).when(F.col("event_type") == "error", progress.CLOSE).otherwise(F.col("event_id").cast("string"))
    return events.select(F.col("user_id").alias("pid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), said.alias("data"), *more)


_FOLD = """with m as (select user_id as pid, ts, event_id, event_type, min(case when event_type = 'error' then ts end) over (partition by user_id) as closed_at from events)
  select pid, arg_max(event_id::varchar, ts) filter (where event_type not in ('signup', 'error') and (closed_at is null or ts < closed_at)) as progress,
  coalesce(bool_or(event_type = 'signup' and (closed_at is null or ts < closed_at)), false) as connected, max(closed_at) is not null as closed,
  max(closed_at) is not null and coalesce(arg_max(event_id::varchar, ts) filter (where event_type not in ('signup', 'error') and (closed_at is null or ts < closed_at)) <> '100', true) as incomplete
  from m group by pid"""


@query(_FOLD)
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.fold(_messages(_table(spark, sf_dir, "events")))


@query(_FOLD)
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a stream over the table's files; the last state of each process counts."""
    kind = _table(spark, sf_dir, "events").schema
    place = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    # a stream takes a single file only as a pattern
    source = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parque[t]")
    states = stream.follow(_messages(source))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("append").parquet(f"{place}/states")

    started = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    own = spark.read.parquet(f"{place}/states")
    last = own.groupBy("pid").agg(F.max(F.struct("number", "progress", "connected", "closed", "incomplete")).alias("s"))
    return last.select("pid", "s.progress", "s.connected", "s.closed", "s.incomplete")


@query("select r_name as name, k::int as label, 'img_' || k || '.png' as file from region, range(1, 19) as t(k) where r_regionkey > 0 and k <= r_regionkey * 6")
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.least(F.col("r_regionkey") * 6, F.lit(18))
    return samples.image_series(_table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("img_").alias("prefix"), count.cast("int").alias("count"), F.lit(".png").alias("suffix")))


@query("select p_partkey, p_name from part where p_partkey % 5 > 1")
def nonblank_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("p_partkey") % 5 == 0, "\t  ").when(F.col("p_partkey") % 5 == 1, "﻿").otherwise(F.concat(F.lit("\n "), "p_name", F.lit("　")))
    own = _table(spark, sf_dir, "part").select("p_partkey", named.alias("n"))
    return own.where(~text.is_blank(F.col("n"))).select("p_partkey", text.trimmed(F.col("n")).alias("p_name"))


@query("select p_partkey, case when p_partkey % 3 < 2 then 'overview' else p_type end as tab from part")
def default_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    tab = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 2, F.col("p_type"))
    return _table(spark, sf_dir, "part").select("p_partkey", text.default_tab(tab).alias("tab"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_partkey::varchar end as project_id, case when p_partkey % 4 = 0 then p_type end as tab from part")
def route_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/project/"), key, F.lit("/"), "p_type")).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/project/"), key)).otherwise(F.concat(F.lit("/projects/"), key))
    return _table(spark, sf_dir, "part").select("p_partkey", text.route_params(path).alias("r")).select("p_partkey", "r.project_id", "r.tab")


@query("select page_id, url from pages where page_id % 3 = 0")
def success_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("page_id") % 3 == 0, 200).when(F.col("page_id") % 3 == 1, 404)
    return projects.succeeded(_table(spark, sf_dir, "pages").withColumn("status", status)).select("page_id", "url")


@query("select name, label, 'set/' || label || '.jpg' as file from (values ('switch', 18), ('box', 3), ('none', 0)) as v(name, n), range(1, 19) as t(label) where label <= n")
def sample_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = samples.sample_sets(spark, [("switch", "set/", 18, ".jpg"), ("box", "set/", 3, ".jpg"), ("none", "set/", 0, ".jpg")])
    return samples.image_series(own)


@query(f"select cloud_id, idx, x, z, b from {_CLOUDS} where idx <> 3 and (idx <> 4 or cloud_id % 2 = 0) and z is not null")
def complete_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose coordinates are all there; one of each cloud lacks x, one of every other y."""
    own = _clouds(spark, sf_dir)
    holes = own.withColumns({"x": F.when(F.col("idx") != 3, F.col("x")), "y": F.when((F.col("idx") != 4) | (F.col("cloud_id") % 2 == 0), F.col("y"))})
    return points.with_all_coordinates(holes).select("cloud_id", "idx", "x", "z", "b")


@query(f"select cloud_id, round(d, 6) as d, idx, x, y, z from (select *, row_number() over (partition by cloud_id order by d, idx) as n from {_DISTANCES}) where n = 1")
def nearest_or_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(points.nearest(_clouds(spark, sf_dir), by=["cloud_id"], strict=True), "d")


def _arrays(spark: SparkSession, sf_dir: str) -> str:
    """Embeddings by the hundred as NPY files, f4, in the shared folder."""
    own = _table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 100).alias("n")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("own"))
    flat = own.select("n", F.flatten(F.transform("own", lambda x: x.embedding)).alias("flat"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for x in b.column(1):
                out = io.BytesIO()
                np.save(out, x.values.to_numpy(zero_copy_only=False).astype("<f4"))
                made.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"user-1/{n}/output/accumulated_numpy.npy" for n in b.column(0).to_pylist()]), pa.array(made, pa.binary())], ["file", "content"])

    place = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}"
    write_objects(flat.mapInArrow(encoded, "file string, content binary"), place)
    return place


_FLAT = "(select vec_id // 100 as n, flatten(list(embedding order by vec_id)) as v from embeddings group by 1)"


@query(f"select n::varchar as project, i as idx, {', '.join(f'v[i*6+{k + 1}]::double as {c}' for k, c in enumerate('xyzrgb'))} from {_FLAT}, unnest(range(0, ((len(v) + 5) // 6)::bigint)) as t(i)")
def npy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_points(spark, _arrays(spark, sf_dir), split=500)
    return own.select(F.regexp_extract("cloud_id", "user-1/([0-9]+)/", 1).alias("project"), "idx", *(F.nullif(F.col(c), F.lit(float("nan"))).alias(c) for c in "xyzrgb"))


@query(f"select 'a_b_result.npy' as file, (128 + 4 * len(v))::bigint as length, true as same from {_FLAT}")
def npy_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results offered as they are stored: the bytes of each file, by size and by sum."""
    place = _arrays(spark, sf_dir)
    found = copies.result_copies(spark, place, "a b")
    stored = objects.images(spark, place).select(F.col("key").alias("path"), F.sha2("content", 256).alias("sum"))
    return found.join(stored, "path").select("file", F.octet_length("content").cast("long").alias("length"), (F.col("sha256") == F.col("sum")).alias("same"))


_IMAGES = "(select p_name || '.v' || p_partkey || '.PNG' as name, p_size % 7 as project_id, p_type as bytes from part)"


def _image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as small image files: file and content, dealt over the tasks that are to write them."""
    name = F.concat(F.lit("images/"), (F.col("p_size") % 7).cast("string"), F.lit("/"), "p_name", F.lit(".v"), F.col("p_partkey").cast("string"), F.lit(".PNG"))
    return spread(_table(spark, sf_dir, "part").select(name.alias("file"), F.col("p_type").cast("binary").alias("content")))


def _images(spark: SparkSession, sf_dir: str) -> str:
    """Parts as small image files in the shared folder."""
    place = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
    write_objects(_image_rows(spark, sf_dir), place)
    return place


@query(f"select name, project_id::varchar as project, bytes as content, 'image/jpeg' as mime, length(bytes)::bigint as length from {_IMAGES} where project_id = 3")
def image_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing by folder, and the contents of the files it names."""
    place = _images(spark, sf_dir)
    listed = objects.objects(spark, place, "*.PNG").withColumn("short", F.regexp_extract("key", "(images/[^/]*/[^/]*)$", 1))
    found = files.named(objects.with_content(spark, files.listing(listed, "images/3", key="short").select("key", "short", "length"), place))
    return found.select("name", F.regexp_extract("short", "images/([0-9]+)/", 1).alias("project"), F.col("content").cast("string").alias("content"), "mime", "length")


@query("select 0::bigint as n_objects, 0::bigint as n_images, 'error' as state")
def missing_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_dir(spark)}/nothing-{uuid.uuid4().hex}"
    state, _ = objects.result(spark, place)
    rows = objects.objects(spark, place).select(F.lit(1).alias("o"), F.lit(0).alias("i")).union(objects.images(spark, place).select(F.lit(0), F.lit(1)))
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("o", "n_objects"), ("i", "n_images")))).withColumn("state", F.lit(state))


@query(f"select project_id, count(*) as n, sum(length(bytes))::bigint as n_bytes from {_IMAGES} group by project_id")
def image_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images read from files and written as the table of uploads, by project."""
    own = objects.images(spark, _images(spark, sf_dir))
    place = f"{shared_dir(spark)}/uploads-{uuid.uuid4().hex}"
    copies.write_images(own.select(F.regexp_extract("key", "images/([0-9]+)/", 1).cast("int").alias("project_id"), "name", "content", "mime"), place)
    return spark.read.parquet(place).groupBy("project_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


@query(f"""select cloud_id, i // 4 as tile, count(*) as n_points, 3 * 4 * 2 * count(*) as bytes, {', '.join(f'{f}({c}::float)::double as {f}_{c}' for c in 'xyz' for f in ('min', 'max'))}
  from (select *, idx as i from {_CLOUDS}) group by 1, 2""")
def gltf_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of tiles say about themselves."""
    made = gltf.tiles(_clouds(spark, sf_dir), per_tile=4)
    said = lambda path, name, kind: F.get_json_object("gltf", path).cast(kind).alias(name)
    bound = [said(f"$.accessors[0].{f}[{k}]", f"{f}_{c}", "double") for k, c in enumerate("xyz") for f in ("min", "max")]
    return made.select("cloud_id", "tile", said("$.accessors[0].count", "n_points", "long"), said("$.buffers[0].byteLength", "bytes", "long"), *bound)


@query()
def gltf_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gltf.tiles(_clouds(spark, sf_dir))


_EPS, _LEAST = 0.03, 10
#: All pairs within eps, and labels that go along them until none changes.
_DENSITY = f"""with recursive p as materialized (select cloud_id, idx, cloud_id * 1000 + idx as id, x, y, z from {_CLOUDS}),
  e as materialized (select a.id as a, b.id as b from p a, p b where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= {_EPS} * {_EPS}::double),
  core as materialized (select a as id from e group by a having count(*) >= {_LEAST}),
  l as materialized (select a, b from e where a in (select id from core) and b in (select id from core) and a <> b),
  c(id, label) using key (id) as (select id, id from core union select l.b, min(c.label) from c join l on l.a = c.id join recurring.c r on r.id = l.b where c.label < r.label group by l.b),
  f as (select p.cloud_id, p.idx, p.id in (select id from core) as core, (select min(c.label) from e join c on c.id = e.b where e.a = p.id) as label from p)
  select cloud_id, idx, core, label is null as noise, label // 1000 as cluster_cloud, label % 1000 as cluster_idx from f"""


@query(_DENSITY)
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one cloud: core points, noise, and each cluster by its smallest core point."""
    found = density.clusters(_clouds(spark, sf_dir), _EPS, _LEAST)
    return found.select("cloud_id", "idx", "core", "noise", F.col("cluster.cloud_id").alias("cluster_cloud"), F.col("cluster.idx").alias("cluster_idx"))


#: Customers as cameras, some of them equal, some without a place, some far from all points.
_CAMERAS = """(select c_custkey, case when c_custkey % 17 <> 0 then ((c_custkey // 2) % 40 - 20) / 50.0::double end as x, ((c_custkey // 80) % 40 - 20) / 50.0::double as y,
  case when c_custkey % 13 = 0 then c_acctbal::double else (c_nationkey - 12) / 40.0::double end as z from customer)"""


@query(f"""with n as (select c_custkey, c.x, c.y, c.z, p.cloud_id, p.idx, p.x as px, p.y as py, p.z as pz, sqrt((p.x - c.x)*(p.x - c.x) + (p.y - c.y)*(p.y - c.y) + (p.z - c.z)*(p.z - c.z)) as d
  from {_CAMERAS} c join {_CLOUDS} p on c.x is not null),
  b as (select * from n qualify row_number() over (partition by c_custkey order by d, idx, cloud_id) = 1)
  select c_custkey, round(d, 9) as d, idx as near_idx, cloud_id as near_cloud, px as near_x, py as near_y, pz as near_z from {_CAMERAS} left join b using (c_custkey)""")
def nearest_of_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, key = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    x = F.when(key % 17 != 0, (F.floor(key / 2) % 40 - 20) / F.lit(50.0))
    z = F.when(key % 13 == 0, F.col("c_acctbal").cast("double")).otherwise((F.col("c_nationkey") - 12) / F.lit(40.0))
    cameras = own.select("c_custkey", x.alias("x"), ((F.floor(key / 80) % 40 - 20) / F.lit(50.0)).alias("y"), z.alias("z"))
    return octree.nearest_of(_clouds(spark, sf_dir), cameras).drop("x", "y", "z").withColumn("d", F.round("d", 9))


_PER_LEAF = 200
_KEYED = f"""with p as (select * from {_CLOUDS} where x is not null and y is not null and z is not null),
  w as (select min(x) as lx, min(y) as ly, min(z) as lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) as side from p),
  s as (select p.*, least(floor((x - lx) / side * 65536), 65535)::bigint as i, least(floor((y - ly) / side * 65536), 65535)::bigint as j, least(floor((z - lz) / side * 65536), 65535)::bigint as k from p, w),
  m as materialized (select *, list_sum(list_transform(range(16), lambda b: (((i >> b) & 1) << (3 * b + 2)) + (((j >> b) & 1) << (3 * b + 1)) + (((k >> b) & 1) << (3 * b))))::bigint as key from s),
  c as materialized (select level, key >> (3 * (16 - level)) as cell, count(*) as n, {', '.join(f'{f}({a}::float)::double as {f}_{a}' for a in 'xyz' for f in ('min', 'max'))} from m, range(0, 17) as t(level) group by 1, 2),
  t as materialized (select c.*, c.n <= {_PER_LEAF} or c.level = 16 as leaf from c left join c o on o.level = c.level - 1 and o.cell = c.cell >> 3 where c.level = 0 or o.n > {_PER_LEAF})"""


def _one_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as the points of one cloud."""
    return _clouds(spark, sf_dir).withColumn("idx", F.col("cloud_id") * 1000 + F.col("idx")).withColumn("cloud_id", F.lit(0).cast("long"))


@query(f"""{_KEYED} select level::int as level, cell, case when leaf then 0 end::bigint as part, leaf, n as n_points, {', '.join(f'{f}_{a}' for a in 'xyz' for f in ('min', 'max'))} from t""")
def tile_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the tree with their points and bounds."""
    found = tiletree.nodes(tiletree.placed(_one_cloud(spark, sf_dir), _PER_LEAF)).drop("cloud_id")
    return found.withColumns({c: F.col(c).cast("double") for c, kind in found.dtypes if kind == "float"})


@query(f"""{_KEYED} select o.cloud_id, o.idx, t.level::int as level, t.cell from (select cloud_id, idx, key from m) o join t on t.leaf and t.cell = o.key >> (3 * (16 - t.level))""")
def tile_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one leaf of each point."""
    own = tiletree.placed(_one_cloud(spark, sf_dir), _PER_LEAF)
    return own.select(F.floor(F.col("idx") / 1000).alias("cloud_id"), (F.col("idx") % 1000).alias("idx"), "level", "cell")


@query(f"""{_KEYED} select t.level::int as level, t.cell, t.n as n_points, count(*) as children, count(*) filter (where u.leaf) as leaves, sum(u.n)::bigint as below
  from t join t u on u.level = t.level + 1 and u.cell >> 3 = t.cell where not t.leaf group by 1, 2, 3""")
def tile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the document of each cell says about its children."""
    made = tiletree.documents(tiletree.nodes(tiletree.placed(_one_cloud(spark, sf_dir), _PER_LEAF)))
    said = F.from_json("json", "root struct<points:long,children:array<struct<points:long,content:struct<uri:string>>>>")
    c = F.col("d.root.children")
    return made.withColumn("d", said).select(
        "level", "cell", F.col("d.root.points").alias("n_points"), F.size(c).cast("long").alias("children"),
        F.size(F.filter(c, lambda x: x.content.uri.endswith(".gltf"))).cast("long").alias("leaves"), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.points).alias("below"),
    )


@query(f"""{_KEYED} select level::int as level, cell, n as n_points, 24 * n as bytes, {', '.join(f'{f}_{a}' for a in 'xyz' for f in ('min', 'max'))} from t where leaf""")
def tile_gltf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the glTF of each leaf says about itself."""
    made = tiletree.tiles(tiletree.placed(_one_cloud(spark, sf_dir), _PER_LEAF))
    said = lambda path, name, kind: F.get_json_object("gltf", path).cast(kind).alias(name)
    bound = [said(f"$.accessors[0].{f}[{k}]", f"{f}_{c}", "double") for k, c in enumerate("xyz") for f in ("min", "max")]
    return made.select("level", "cell", said("$.accessors[0].count", "n_points", "long"), said("$.buffers[0].byteLength", "bytes", "long"), *bound)


@query(f"select n::varchar as project, i as idx, {', '.join(f'v[i*6+{k + 1}]::double as {c}' for k, c in enumerate('xyz'))} from {_FLAT}, unnest(range(0, ((len(v) + 5) // 6)::bigint)) as t(i) where i >= 300 and i < 420")
def npy_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of each array; only that range is read."""
    own = read_points(spark, _arrays(spark, sf_dir), split=50).where("idx >= 300 and idx < 420")
    return own.select(F.regexp_extract("cloud_id", "user-1/([0-9]+)/", 1).alias("project"), "idx", *(F.nullif(F.col(c), F.lit(float("nan"))).alias(c) for c in "xyz"))


@query(f"select 'images/' || project_id || '/' || name as key, length(bytes)::bigint as length from {_IMAGES} where project_id = 4")
def key_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of one folder of a store of all parts; other folders are not listed."""
    place = f"{shared_dir(spark)}/keys-{uuid.uuid4().hex}"
    copies.write_files(_image_rows(spark, sf_dir), place).agg(F.sum("length")).first()
    return listing.object_keys(spark, place).where(F.col("key").startswith("images/4/")).select("key", "length")


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    """The table of events as a stream of messages (pid, ts, seq, data), and a folder for the stream's own files."""
    kind = _table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parque[t]")
    return _messages(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts"), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _run(states: DataFrame, place: str) -> DataFrame:
    """The last state of each process of a stream that is run to its end."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{place}/states/batch={number}")

    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _last_states(states.sparkSession, place)


def _last_states(spark: SparkSession, place: str) -> DataFrame:
    own = spark.read.parquet(f"{place}/states")
    last = own.groupBy("pid").agg(F.max(F.struct("number", "progress", "connected", "closed", "incomplete")).alias("s"))
    return last.select("pid", "s.progress", "s.connected", "s.closed", "s.incomplete")


def _timed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    messages, place = _streamed(spark, sf_dir, "timed")
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, timed.ROCKS)
    try:
        return _run(timed.follow(messages, timedelta(days=25)), place), f"{place}/checkpoint"
    finally:
        spark.conf.set(name, before)


@query(_FOLD)
def progress_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold as a stream that forgets processes 25 days after they closed."""
    return _timed(spark, sf_dir)[0]


@query("""select user_id as pid, min(ts) filter (where event_type = 'error') is not null as closed from events group by 1
  having min(ts) filter (where event_type = 'error') is null or epoch_ms(min(ts) filter (where event_type = 'error')) + 25 * 86400000::bigint > (select epoch_ms(max(ts)) from events)""")
def progress_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processes whose state is still there when all events were read: those that have not been closed for 25 days."""
    return timed.open_processes(spark, _timed(spark, sf_dir)[1]).select("pid", "closed")


@query("select event_id::varchar as id, event_type as event, user_id || chr(10) || props as data from events")
def event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as event-stream text in three goes, each read when it is there."""
    own, place = _table(spark, sf_dir, "events"), f"{shared_dir(spark)}/event-text-{uuid.uuid4().hex}"
    said = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\n: a remark\nevent: "), "event_type", F.lit("\ndata: "), F.col("user_id").cast("string"), F.lit("\ndata: "), "props", F.lit("\n"))
    spark.dataSource.register(eventstream.EventText)
    spark.createDataFrame([], "value string").write.text(f"{place}/text")
    frames = spark.readStream.format("event_text").option("split", 50_000).load(f"{place}/text")
    query = frames.writeStream.format("parquet").option("path", f"{place}/read").option("checkpointLocation", f"{place}/checkpoint").start()
    try:
        for turn in range(3):
            own.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == turn).select(said.alias("value")).write.mode("append").text(f"{place}/text")
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{place}/read").select("id", "event", "data")


#: Events of all parts for each file of a part.
_PER_FILE = 500_000


@query(_FOLD.replace("select pid, arg_max", "select 1::bigint as errors, true as ended_well, pid, arg_max"))
def progress_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold as a stream that breaks in its second micro-batch and goes on from its checkpoint."""
    own, place, held = _table(spark, sf_dir, "events"), f"{shared_dir(spark)}/broken-{uuid.uuid4().hex}", 0
    at = own.agg(*(F.expr(f"percentile_approx(unix_micros(cast(ts as timestamp)), {q})") for q in (0.3, 0.6))).first()
    seq = F.unix_micros(F.col("ts").cast("timestamp"))
    n = max(1, -(-own.count() // _PER_FILE))
    for part in (seq <= at[0], (seq > at[0]) & (seq <= at[1]), seq > at[1]):
        # a process is in one file of each part, and older files are read first, so its messages keep their order
        own.where(part).repartition(n, "user_id").write.mode("append").parquet(f"{place}/events")
        held = held or len(spark.read.parquet(f"{place}/events").inputFiles())
    source = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", held).parquet(f"{place}/events")
    states, broken = stream.follow(_messages(source)), []

    def keep(batch: DataFrame, number: int) -> None:
        if number == 1 and not broken:
            broken.append(number)
            raise ConnectionError("the source went away")
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{place}/states/batch={number}")

    start = lambda: states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    found = recovery.keep_running(spark, start, wait=0.1)
    return _last_states(spark, place).select(F.lit(len(found.errors)).cast("long").alias("errors"), F.lit(not found.failed).alias("ended_well"), "*")


@query(f"""select p.user_id, p."projectId", case when k = 0 then 'twice ' || p."projectId" else "projectName" end as "projectName",
  case when k = 1 then 'error' when k = 2 then 'processing' else "projectStatus" end as "projectStatus", case when k = 2 then 0.0 else "projectProgress" end as "projectProgress"
  , case when k = 4 then '{{"fx":' || "projectId" || '}}' else '{{}}' end as "projectConfig"
  from (select *, case when "projectId" % 4 = 0 then ("projectId" // 4) % 6 end as k from {_PROJECTS}) p where k is distinct from 3""")
def project_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions on a stored table: a batch that is folded into its buckets, and one that is still in the log."""
    own = _projects(spark, sf_dir).drop("projectDate").withColumn("projectConfig", F.lit("{}"))
    store = ProjectStore(spark, f"{shared_dir(spark)}/projects-{uuid.uuid4().hex}", 16)
    store.create(own)
    action = F.get(F.array(*map(F.lit, ("rename", "status", "restart", "delete", "config", "nothing"))), F.floor(F.col("projectId") / 4).cast("int") % 6)
    key = F.col("projectId").cast("string")
    value = F.when(action == "rename", F.concat(F.lit("once "), key)).when(action == "status", "error").when(action == "config", F.concat(F.lit('{"fx":'), key, F.lit("}")))
    updates = own.where("projectId % 4 = 0").select("user_id", "projectId", action.alias("action"), value.alias("value"), F.lit(1).alias("seq"))
    store.append(updates.where("action <> 'restart'"))
    store.compact()
    store.append(updates.where("action = 'restart'"))
    again = F.when(F.col("action") == "rename", F.concat(F.lit("twice "), key)).otherwise("late")
    store.append(updates.where("action in ('rename', 'delete')").select("user_id", "projectId", F.lit("rename").alias("action"), again.alias("value"), F.lit(2).alias("seq")))
    return store.read()


#: Pages as addresses of the application: the path of a page's URL behind one of five beginnings.
_ADDRESS = r"""(select page_id, case page_id % 7 when 0 then '/project' || path when 1 then '/Project/' || page_id when 2 then '/projects' when 3 then path when 4 then '/' when 5 then '/login/' else '/samples//' || page_id end as path
  from (select page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages where url is not null))"""


@query(rf"""with r(pattern, fit, rank) as (values {', '.join(f"('{p}', '(?i)^/*' || '{q}' || '/*$', {i})" for i, (p, q) in enumerate([('/', ''), ('/login', 'login'), ('/register', 'register'), ('/samples', 'samples'), ('/profile', 'profile'), ('/projects', 'projects'), ('/project/:projectId', 'project/+([^/]+)'), ('/project/:projectId/:tab', 'project/+([^/]+)/+([^/]+)'), ('*', '.*')]))}),
  m as (select page_id, path, pattern, fit from {_ADDRESS} a join r on regexp_matches(a.path, r.fit) qualify row_number() over (partition by page_id order by rank) = 1)
  select page_id, pattern, case when pattern like '/project/%' then regexp_extract(path, fit, 1) end as project_id, case when pattern = '/project/:projectId/:tab' then regexp_extract(path, fit, 2) end as tab,
  case when pattern = '*' then array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/') end as rest from m""")
def best_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the nine routes for each page's address, with its parameters."""
    path, how, key = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.col("page_id") % 7, F.col("page_id").cast("string")
    address = F.when(how == 0, F.concat(F.lit("/project"), path)).when(how == 1, F.concat(F.lit("/Project/"), key)).when(how == 2, "/projects").when(how == 3, path).when(how == 4, "/").when(how == 5, "/login/").otherwise(F.concat(F.lit("/samples//"), key))
    own = _table(spark, sf_dir, "pages").where("url is not null").select("page_id", routes.best_route(address).alias("r"))
    return own.select("page_id", "r.pattern", F.col("r.params")["projectId"].alias("project_id"), F.col("r.params")["tab"].alias("tab"), F.col("r.params")["*"].alias("rest"))
