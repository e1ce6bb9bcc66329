from __future__ import annotations

import json
import threading
import time

import pytest
from pointloom.functions import text
from pointloom.operators import config, files, progress, projects
from pointloom.sinks import copies
from pointloom.sources import objects, samples
from pointloom.streaming import progress as stream
from pointloom.streaming.control import LatestOnly
from pyspark.sql import functions as F

PROJECT = "user_id string, projectId string, projectName string, projectDate timestamp, projectStatus string, projectProgress double, projectConfig string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("name", "want"), [("a.b.png", "a.b_2.png"), ("README", "_1.README"), ("new.png", "new.png"), ("x", "x"), ("c.png", "c_1.png"), (None, None)])
def test_collision_rename(spark, name, want):
    old = spark.createDataFrame([(n,) for n in ("a.b.png", "a.b_1.png", "a.b_3.png", "a.b_01.png", "README", "c.png", "c_2.png", "c_0.png", None)], "name string")
    new = spark.createDataFrame([(name,), (name,)], "name string")
    assert [r.new_name for r in files.rename_collisions(new, old).collect()] == [want, want]


def test_collision_rename_never_exists(spark):
    old = spark.createDataFrame([(f"s_{i}.png",) for i in range(1, 500) if i != 321] + [("s.png",)], "name string")
    new = spark.createDataFrame([("s.png",)], "name string")
    assert files.rename_collisions(new, old).first().new_name == "s_321.png"


@pytest.mark.parametrize(("name", "fits"), [("A.B.PNG", True), ("png", True), ("x.", False), ("x.gif", False)])
def test_image_names(spark, name, fits):
    assert one(spark, text.is_image(F.lit(name))) is fits


@pytest.mark.parametrize(("value", "want"), [("520", 520.0), ("", 0.0), (" \t", 0.0), ("abc", None), ("12d", None), ("-1", -1.0), ("1e3", 1000.0), (".5", 0.5), ("0x10", None), (None, None)])
def test_numbers(spark, value, want):
    assert one(spark, text.number(F.lit(value).cast("string"))) == want


def test_settings_from_numbers_and_text(spark):
    df = spark.createDataFrame([('{"fx": 520, "fy": "520", "eps": "x"}',)], "j string")
    r = df.select(config.coerced(config.parse(F.col("j"))).alias("s")).select("s.*", config.saved(F.col("s")).alias("saved")).first()
    assert (r.fx, r.fy, r.eps, r.cx) == (520.0, 520.0, None, None)
    assert json.loads(r.saved)["eps"] is None and list(json.loads(r.saved)) == list(config.FIELDS)
    with pytest.raises(ValueError):
        config.with_field(F.col("s"), "nothing", F.lit(1))


def test_sample_settings(spark, tmp_path):
    (tmp_path / "config.json").write_text('{"box": {"depthMin": 85,\n "fx": 1000, "cx": 320}}')
    r = config.sample_settings(spark, str(tmp_path)).first()
    assert (r.name, r.settings.depthMin, r.settings.fx, r.settings.fy) == ("box", 85, 1000, None)


@pytest.mark.parametrize(("status", "stage"), [("idle", 1), ("config", 2), ("processing", 3), ("completed", 4), ("error", 4), ("other", 7), (None, 7)])
def test_stage(spark, status, stage):
    assert one(spark, projects.stage(F.lit(status).cast("string"), 7)) == stage


def test_rows_and_names(spark):
    own = spark.sql("select 'u' user_id, '1' projectId, 'n' projectName, timestamp'2024-03-05 14:07:09' projectDate, 'middle EAST' projectStatus")
    r = projects.list_rows(own).first()
    assert (r.date, r.status) == ("3/5/2024 2:07:09 PM", "Middle EAST")
    assert one(spark, text.local_date(F.lit(None).cast("timestamp"))) == "Invalid Date Invalid Date"
    assert one(spark, text.result_file(F.lit("a b  c"), "npy")) == "a_b__c_result.npy"
    assert one(spark, text.basename(F.lit("user-1/p/rgb/"))) == ""


def test_updates(spark):
    own = spark.createDataFrame([("u", "1", "a", None, "idle", 1.0, None), ("u", "2", "b", None, "error", 2.0, None)], PROJECT)
    hit = F.col("projectId") == "1"
    assert [r.projectName for r in projects.renamed(own, hit, "z").orderBy("projectId").collect()] == ["z", "b"]
    assert [r.projectName for r in projects.renamed(own, hit, " \t").orderBy("projectId").collect()] == ["a", "b"]
    assert [r.projectId for r in projects.deleted(own, hit).collect()] == ["2"]
    again = projects.restarted(own, F.col("projectId") == "2").orderBy("projectId").collect()
    assert [(r.projectStatus, r.projectProgress) for r in again] == [("idle", 1.0), ("processing", 0.0)]
    assert projects.configured(own, hit, F.lit("{}")).where(hit).first().projectConfig == "{}"
    new = spark.createDataFrame([("u", "3", "c", None), ("u", "4", "﻿", None)], "user_id string, projectId string, projectName string, projectDate timestamp")
    assert [(r.projectId, r.projectStatus) for r in projects.created(own, new).orderBy("projectId").collect()][2:] == [("3", "idle")]
    assert projects.detail(own, "u", "1", "status").collect() == [("idle",)]


def test_lists(spark):
    own = spark.createDataFrame([("k", i, n) for i, n in enumerate("abc")], "k string, pos long, n string")
    assert [(r.pos, r.n) for r in files.remove_at(own, 1).orderBy("pos").collect()] == [(0, "a"), (1, "c")]
    more = spark.createDataFrame([("k", 0, "c"), ("new", 0, "x")], "k string, pos long, n string")
    assert [(r.k, r.pos, r.n) for r in files.append(own, more, "k").where("n in ('c', 'x')").orderBy("k", "pos").collect()] == [("k", 2, "c"), ("k", 3, "c"), ("new", 0, "x")]


def test_listing_by_raw_prefix(spark):
    own = spark.createDataFrame([(k,) for k in ("user-1/p/rgb/a.png", "user-1/p/rgb2/b.png", "user-1/p/out/c.npy")], "key string")
    prefix = one(spark, text.image_prefix(F.lit(1), F.lit("p")))
    assert [r.name for r in files.named(files.listing(own, prefix, files.PAGE, strict=True)).collect()] == ["a.png", "b.png"]
    assert [r.name for r in files.named(files.listing(own, prefix)).collect()] == ["a.png"]
    assert files.listing(own, prefix + "/").count() == 1
    assert one(spark, text.cloud_key(F.lit(1), F.lit("p"))) == "user-1/p/output/accumulated_numpy.npy"


@pytest.mark.parametrize("block", [2, 100_000])
def test_names_of_one_batch_are_told_apart(spark, block):
    old = spark.createDataFrame([(n,) for n in ("x_1.png", "x_3.png", "y.png", "README", "z.png", "z_2.png")], "name string")
    names = ["x.png", "x.png", "x_2.png", "x.png", "y.png", "README", "README", "new.png", None, "x.png", None, "z.png", "z.png", "z_1.png", "x_2.png"]
    new = spark.createDataFrame(list(enumerate(names)), "pos long, name string")
    got = [r.new_name for r in files.rename_apart(new, old, block=block).orderBy("pos").collect()]
    assert got == ["x.png", "x_4.png", "x_2.png", "x_5.png", "y_1.png", "_1.README", "_2.README", "new.png", None, "x_6.png", None, "z_3.png", "z_4.png", "z_1.png", "x_2_1.png"]


def test_a_name_that_fills_the_batch(spark):
    new = spark.range(30_000).select(F.col("id").alias("pos"), F.lit("img.png").alias("name"))
    old = spark.range(1, 20_000, 2).select(F.concat(F.lit("img_"), "id", F.lit(".png")).alias("name"))
    got = files.rename_apart(new, old, block=1000)
    names = [r.new_name for r in got.orderBy("pos").collect()]
    assert len(set(names)) == 30_000 and names[:3] == ["img.png", "img_2.png", "img_4.png"] and not set(names) & {r.name for r in old.collect()}


def test_image_lists_are_replaced(spark):
    row = "user_id string, projectId string, pos long, name string"
    own = spark.createDataFrame([("u", "1", 0, "a"), ("u", "1", 1, "b"), ("u", "2", 0, "c"), ("u", "3", 0, "d")], row)
    new = spark.createDataFrame([("u", "1", 0, "z"), ("u", "3", 0, "never")], row)
    hit = spark.createDataFrame([("u", "1"), ("u", "2")], "user_id string, projectId string")
    assert sorted(tuple(r) for r in files.images_replaced(own, hit, new, ["user_id", "projectId"]).collect()) == [("u", "1", 0, "z"), ("u", "3", 0, "d")]


def test_projects_without_images(spark):
    own = spark.createDataFrame([("a",), ("a",)], "project string")
    owners = spark.createDataFrame([("a",), ("b",)], "project string")
    assert sorted(tuple(r) for r in files.has_enough(own, "project", owners=owners).collect()) == [("a", 2, True), ("b", 0, False)]


def test_missing_result_is_an_error_state(spark, tmp_path):
    (tmp_path / "a.npy").write_bytes(b"12")
    state, found = objects.result(spark, str(tmp_path / "a.npy"))
    assert state == "ready" and bytes(found.first().content) == b"12"
    state, found = objects.result(spark, str(tmp_path / "missing.npy"))
    assert state == "error" and found.count() == 0
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        objects.result(spark, "nosuchstore://x/y")


@pytest.mark.parametrize(("json", "want"), [('{"a": 1}', True), ("{}", False), ("[1]", False), ("x", False), (None, False)])
def test_objects_with_fields(spark, json, want):
    assert one(spark, text.has_fields(F.lit(json).cast("string"))) is want


def test_files_are_written_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([("p/a.bin", bytearray(b"\x00\xff")), ("b.bin", bytearray(b""))], "file string, content binary")
    done = sorted(tuple(r)[:2] for r in copies.write_files(rows, f"file://{tmp_path}/out").collect())
    assert done == [("b.bin", 0), ("p/a.bin", 2)] and (tmp_path / "out/p/a.bin").read_bytes() == b"\x00\xff"


def test_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"1")
    assert [(r.name, bytes(r.content), r.mime) for r in objects.images(spark, str(tmp_path / "in")).collect()] == [("a.png", b"1", "image/jpeg")]
    assert objects.objects(spark, str(tmp_path / "in")).first().length == 1
    assert objects.objects(spark, str(tmp_path / "missing")).count() == 0
    assert objects.images(spark, str(tmp_path / "missing")).count() == 0
    rows = objects.images(spark, str(tmp_path / "in")).select(F.lit("p").alias("project_id"), "name", "content", "mime")
    copies.write_images(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_series(spark):
    own = samples.sample_sets(spark, [("switch", "s/", 2, ".jpg"), ("none", "n/", 0, ".jpg")])
    assert [tuple(r) for r in samples.image_series(own).orderBy("label").collect()] == [("switch", 1, "s/1.jpg"), ("switch", 2, "s/2.jpg")]


MESSAGES = {1: ["READY", "10", "55", "100", "CLOSE", "77"], 2: ["READY", "30", "CLOSE"], 3: ["READY", "40", "20"], 4: ["CLOSE"], 5: ["READY"]}
STATES = {1: ("100", True, True, False), 2: ("30", True, True, True), 3: ("20", True, False, False), 4: (None, False, True, True), 5: (None, True, False, False)}


def test_progress_fold(spark):
    rows = [(p, i, m) for p, own in MESSAGES.items() for i, m in enumerate(own)]
    got = progress.fold(spark.createDataFrame(rows, "pid long, seq long, data string")).collect()
    assert {r.pid: (r.progress, r.connected, r.closed, r.incomplete) for r in got} == STATES


def test_progress_stream_restarts(spark, tmp_path):
    """Two micro-batches with a restart between them end in the batch fold's state."""
    seen = {}

    def keep(batch, number):
        seen.update({r.pid: (r.progress, r.connected, r.closed, r.incomplete) for r in batch.collect()})

    for part in (0, 1):
        rows = [(p, i, m) for p, own in MESSAGES.items() for i, m in enumerate(own) if (i >= 2) == part]
        spark.createDataFrame(rows, "pid long, seq long, data string").write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("pid long, seq long, data string").parquet(str(tmp_path / "in"))
        started = stream.follow(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        started.awaitTermination()
    assert seen == STATES


def test_latest_request_wins(spark):
    latest = LatestOnly(spark)
    with latest.request() as first:
        assert first in spark.sparkContext.getJobTags()
    with latest.request() as second:
        assert second != first and spark.range(10).count() == 10
    assert not spark.sparkContext.getJobTags()


def test_new_request_cancels_running_jobs(spark):
    latest, ended = LatestOnly(spark), []

    def slow(batches):
        time.sleep(60)
        yield from batches

    def first():
        with latest.request():
            try:
                spark.range(0, 4, 1, 1).mapInPandas(slow, "id long").count()
                ended.append("finished")
            except Exception as e:  # noqa: BLE001
                ended.append(str(e))

    own = threading.Thread(target=first)
    own.start()
    began = time.time()
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() - began < 20:
        time.sleep(0.2)
    with latest.request():
        assert spark.range(5).count() == 5
    own.join(30)
    assert len(ended) == 1 and "cancel" in ended[0].lower()


def test_updates_by_action(spark):
    own = spark.createDataFrame([("u", str(i), "a", None, "idle", 1.0, None) for i in range(6)], PROJECT)
    changes = spark.createDataFrame([("u", "0", "rename", "z"), ("u", "1", "rename", " "), ("u", "2", "delete", None), ("u", "3", "restart", None), ("u", "4", "config", "{}"), ("v", "5", "delete", None)], "user_id string, projectId string, action string, value string")
    rows = {r.projectId: r for r in projects.updated(own, changes).collect()}
    assert sorted(rows) == ["0", "1", "3", "4", "5"]
    assert rows["0"].projectName == "z" and rows["1"].projectName == "a"
    assert (rows["3"].projectStatus, rows["3"].projectProgress) == ("processing", 0.0)
    assert rows["4"].projectConfig == "{}" and rows["5"] == own.where("projectId = 5").first()
